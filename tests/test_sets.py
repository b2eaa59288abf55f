"""Owner listings, conditional counts and sets, with nulls, repeats and empty tables."""

from pyspark.sql import functions as F

from siteloom.operators import relational as R


def test_sets_of_keys(spark):
    df = spark.createDataFrame([("a", ["x", "y", None]), ("a", ["y", "z"]), ("b", ["z"]), ("c", None), (None, ["q"]), ("d", [])], "k string, s array<string>")
    got = {r["k"]: r["s"] for r in R.union_of_sets(df, "k", "s", without=["z"]).collect()}
    assert got == {"a": ["x", "y"], None: ["q"]}
    assert {r["k"]: r["s"] for r in R.union_of_sets(df, "k", "s").collect()} == {"a": ["x", "y", "z"], "b": ["z"], None: ["q"]}
    assert R.union_of_sets(df.limit(0), "k", "s").count() == 0
    keys = lambda *v: spark.createDataFrame([(x, 1) for x in v], "k string, k2 int")
    assert sorted(r["k"] or "" for r in R.disabled_keys(keys("a", "a", "b", None), keys("b", "b"), keys("z", "a"), "k").collect()) == ["", "a", "z"]
    assert R.disabled_keys(keys("a").limit(0), keys("b"), keys("z", "z"), "k").collect() == [("z",)]


def test_counts_and_listings(spark):
    jobs = spark.createDataFrame([("u", "open"), ("u", None), ("v", "done"), (None, "open"), ("w", "open")], "owner string, status string")
    s = F.col("status")
    got = {r["owner"]: (r["n"], r["n_open"], r["n_done"]) for r in R.conditional_counts(jobs, ["owner"], {"n_open": s == "open", "n_done": s == "done"}).collect()}
    assert got == {"u": (2, 1, 0), "v": (1, 0, 1), None: (1, 1, 0), "w": (1, 1, 0)}
    owners = spark.createDataFrame([("u", "Una"), ("x", "Xan"), (None, "none")], "owner string, name string")
    assert sorted((r["name"], r["status"] or "") for r in R.owned_rows(jobs, owners, "owner").collect()) == [("Una", ""), ("Una", "open")]
