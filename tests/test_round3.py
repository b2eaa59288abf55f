"""Cases that showed on larger tables only: shared addresses, and plans whose tasks grew with the input."""

import duckdb

import __spark_entry__


def test_parts_that_share_an_address_keep_their_rows(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 7), (1, 400_007), (2, 7), (2, 3_600_001)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["j7_ip_ranges"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["j7_ip_ranges"]).fetchall()
    assert len(want) == 4 and sorted(got) == sorted(want)


def test_the_input_of_first_wins_is_read_once(spark):
    from siteloom.operators.relational import first_wins

    rows = [("a", 2, 1.0), ("a", 1, None), ("a", 3, None), ("b", 5, float("nan")), ("b", 6, float("nan")), ("b", 7, 0.0), ("c", None, 4.0), ("c", None, None), (None, 1, 1.0)]
    out = first_wins(spark.createDataFrame(rows, "k string, at int, v double").repartition(3), "k", "at", "v")
    got = {r[0]: (r[1], str(r[2]), r[3], r[4]) for r in out.collect()}
    assert got == {"a": (1, "None", 2, 1), "b": (5, "nan", 2, 1), "c": (None, "None", 1, 1)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_plain_hosts_are_not_put_through_idna():
    from siteloom.functions import urls as U

    assert U._ascii_name(None) is None and U._ascii_name("bücher.de") == "xn--bcher-kva.de"


def test_sources_are_listed_on_the_row(spark):
    from siteloom.operators.estimate import source_status

    seen = [("a", "crawl", True, True, True), ("a", "dns", False, None, None), ("b", "crawl", True, False, False), ("z", "dns", True, None, None)]
    out = source_status(spark.createDataFrame([("a",), ("b",), ("c",)], "domain string"), spark.createDataFrame(seen, "domain string, source string, found boolean, blocked boolean, reachable boolean"), ["crawl", "dns"])
    want = {("a", "crawl", "blocked"), ("a", "dns", "absent"), ("b", "crawl", "unreachable"), ("b", "dns", "missing"), ("c", "crawl", "missing"), ("c", "dns", "missing")}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    counted = out.groupBy("domain").count()._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in counted and counted.count("Exchange hashpartitioning(domain") == 2  # both inputs, and nothing gathered before


def test_a_key_with_all_values_is_joined_by_range(spark):
    from siteloom.operators.evaluate import running_counts

    rows = [("all", float(i * 7 % 50)) for i in range(200)] + [(None, 1.0), (None, 0.5), ("b", 3.0)]
    out = running_counts(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    got = {(r[0], r[1]): tuple(r[2:]) for r in out.collect()}
    of = lambda k: [v for x, v in rows if x == k]
    assert got == {(k, v): (of(k).count(v), sum(x < v for x in of(k)), len(of(k))) for k, v in set(rows)}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and "_part" in joins[0]


def test_small_groups_keep_the_stated_partitions(spark):
    from siteloom.operators.evaluate import spearman

    rows = [(i % 9, float(i * 7 % 11), float(i * 5 % 13)) for i in range(900)]
    out = spearman(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y", small=True)
    assert out.count() == 9
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_payloads_are_dealt_before_they_are_picked(spark):
    from siteloom.operators.estimate import extract_features, feature_vector

    latest = spark.createDataFrame([("a", "tranco", '{"status":"present","rank":3}'), ("a", "dns", "{}")], "domain string, source string, payload string")
    for out in (feature_vector(latest), extract_features(latest, {"rank": ("tranco", "$.rank")})):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.index("partial_max") < plan.index("Exchange") and plan.count("Exchange") == 1  # the plan reads from its end


def test_facts_come_out_in_small_batches(spark, monkeypatch):
    from siteloom.operators import pages as P

    rows = spark.range(300).repartition(1).selectExpr("id", "'https://a.com/' url", "'<title>t</title>' html")
    out = P.page_facts(rows, extra=["id"])
    assert out.agg({"id": "sum"}).first()[0] == 300 * 299 // 2 and P.FACT_ROWS < 300
