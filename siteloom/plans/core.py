"""Queries over the given tables for URLs, keyed picks, joins, roll-ups and evaluation, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import evaluate as E
from ..operators import relational as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    url = F.col("url")
    return p.select("page_id", "url", U.url_host(url).alias("host"), U.url_path(url).alias("path"))


def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = U.suffix_table(spark)
    return U.registrable_domains(pages(spark, sf_dir), "host", suffixes)


_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_DOMAIN = f"regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1)"
_KIND = "CASE WHEN path IN ('', '/') THEN 'home' " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{k}'" for k, p in U.PATH_KINDS) + " ELSE 'page' END"
_P = f"(SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, {_DOMAIN} AS domain FROM pages)"
_KEY = rf"regexp_replace({_HOST}, '^www\.', '') || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)"


@query(f"""WITH p AS {_P} SELECT domain, count(*) AS n_pages, count(DISTINCT host) AS n_hosts,
  count(*) FILTER (WHERE {_KIND} = 'product') AS n_product, count(*) FILTER (WHERE {_KIND} = 'article') AS n_article,
  count(*) FILTER (WHERE {_KIND} = 'page') AS n_page FROM p GROUP BY domain""")
def s14_site_rollup(spark, sf_dir):
    """Pages by registrable domain."""
    rows = page_domains(spark, sf_dir).withColumn("kind", U.path_kind(F.col("path")))
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("product", "article", "page")]
    return rows.groupBy("domain").agg(F.count("*").alias("n_pages"), F.count_distinct("host").alias("n_hosts"), *kinds)


@query(f"WITH p AS {_P} SELECT {_KIND} AS kind, count(*) AS n FROM p GROUP BY 1")
def p6_url_kind_counts(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.path_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS {_P}, l AS (SELECT host, lower(regexp_extract(path, '(?i)^/([a-z]{{2}})(-[a-z]{{2}})?(/|$)', 1)) AS c,
  lower(regexp_extract(path, '(?i)^/([a-z]{{2}})(-[a-z]{{2}})?(/|$)', 2)) AS r FROM p)
SELECT CASE WHEN c IN ({', '.join(repr(x) for x in U.LANGUAGES)}) AND (r <> '' OR c NOT IN ({', '.join(repr(x) for x in U.AMBIGUOUS)})) THEN c || r END AS lang,
  count(*) AS n, count(DISTINCT host) AS n_hosts FROM l GROUP BY 1""")
def p7_lang_prefix_counts(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("lang", U.language_prefix(F.col("path")))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("host").alias("n_hosts"))


@query(f"SELECT url_key, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, {_KEY} AS url_key FROM pages) GROUP BY url_key")
def p21_url_key_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", U.url_key(F.col("url")).alias("url_key"))
    return rows.groupBy("url_key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query(f"""WITH p AS {_P} SELECT page_id, url, domain, host, (host = domain OR host = 'www.' || domain) AS apex_scope,
  (host = domain OR ends_with(host, '.' || domain)) AS site_scope,
  (regexp_matches(path, '^/(en|fr)/') AND NOT regexp_matches(path, '\\.html$')) AS pattern_ok FROM p""")
def p19_scope_and_patterns(spark, sf_dir):
    """Scope and path patterns of each page URL."""
    url, domain = F.col("url"), F.col("domain")
    rows = page_domains(spark, sf_dir)
    return rows.select(
        "page_id", "url", "domain", "host", U.in_scope(url, domain, False).alias("apex_scope"), U.same_site(F.col("host"), domain).alias("site_scope"),
        U.matches_patterns(url, ["^/(en|fr)/"], [r"\.html(\?|$)"]).alias("pattern_ok"),
    )


@query(f"""WITH p AS {_P}, u AS (
  SELECT page_id, url AS u FROM p UNION ALL SELECT page_id, 'http://10.0.' || page_id % 256 || '.1' || path FROM p
  UNION ALL SELECT page_id, 'ftp://' || host || path FROM p UNION ALL SELECT page_id, 'https://' || host || ':' || (page_id % 3 + 79) || path FROM p
  UNION ALL SELECT page_id, 'https://user:x@' || host || path FROM p UNION ALL SELECT page_id, 'http://db.internal' || path FROM p)
SELECT CASE WHEN starts_with(u, 'ftp') OR contains(u, '@') THEN 'UNSUPPORTED_URL'
  WHEN contains(u, '://10.0.') OR contains(u, 'db.internal') OR regexp_matches(u, ':(79|81)(/|$)') THEN 'BLOCKED_URL' END AS code, count(*) AS n FROM u GROUP BY 1""")
def p23_url_screening(spark, sf_dir):
    """P23 on the page URLs and on variants of them that must be refused."""
    p = pages(spark, sf_dir)
    host, path, i = F.col("host"), F.col("path"), F.col("page_id")
    made = [F.col("url"), F.concat(F.lit("http://10.0."), i % 256, F.lit(".1"), path), F.concat(F.lit("ftp://"), host, path), F.concat(F.lit("https://"), host, F.lit(":"), i % 3 + 79, path),
            F.concat(F.lit("https://user:x@"), host, path), F.concat(F.lit("http://db.internal"), path)]
    rows = p.select(F.explode(F.array(*made)).alias("u"))
    return rows.groupBy(U.screen_url(F.col("u")).alias("code")).agg(F.count("*").alias("n"))


@query(f"WITH p AS {_P} SELECT host, array_to_string(list_reverse(string_split(host, '.')), '.') AS rev, host AS back, count(*) AS n FROM p GROUP BY host")
def p4_reversed_hosts(spark, sf_dir):
    rows = pages(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"))
    rows = rows.withColumn("rev", U.reverse_domain(F.col("host")))
    return rows.withColumn("back", U.reverse_domain(F.col("rev")))


@query(f"""WITH p AS {_P} SELECT DISTINCT host AS raw, domain AS name, host, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT DISTINCT host || ':8080/x', domain, host, NULL FROM p UNION ALL SELECT DISTINCT '-' || host, NULL, NULL, 'invalid label' FROM p""")
def p1_normalized_hosts(spark, sf_dir):
    """P1 on hosts, hosts with port and path, and hosts with a bad label."""
    h = pages(spark, sf_dir).select("host").distinct()
    raw = h.select(F.explode(F.array("host", F.concat("host", F.lit(":8080/x")), F.concat(F.lit("-"), "host"))).alias("raw"))
    return U.normalize_domains(raw, "raw", U.suffix_table(spark)).select("raw", "name", "host", "error")


@query(f"WITH p AS {_P} SELECT host AS domain, count(*) AS n FROM p GROUP BY host")
def p5_list_domains(spark, sf_dir):
    """P5: cleaned list names out of dotted, padded, upper-case host spellings; what is no name goes."""
    p = pages(spark, sf_dir)
    raw = p.select(F.concat(F.lit("  ."), F.upper("host"), F.lit(". ")).alias("raw")).unionByName(p.select(F.lit("no name").alias("raw")))
    return raw.select(U.list_domain(F.col("raw")).alias("domain")).where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN d <= 30 THEN '30d' WHEN d <= 90 THEN '90d' WHEN d <= 365 THEN '365d' ELSE 'older' END AS age, count(*) AS n
FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS d FROM orders) GROUP BY 1""")
def p8_modified_ages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("lastmod"))
    return o.groupBy(U.modified_age(F.col("lastmod"), F.lit("1998-08-02").cast("date")).alias("age")).agg(F.count("*").alias("n"))


# keyed picks ------------------------------------------------------------------------------

_EV = "user_id, event_type, event_id, ts, value"


@query(f"SELECT {_EV} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w1_latest_per_key(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return R.latest_per_key(ev, ["user_id", "event_type"], "ts", "event_id")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn FROM events QUALIFY rn <= 30")
def w2_top_k_per_key(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return R.top_k_per_key(ev, "user_id", 30, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "rn")


@query("SELECT l_suppkey, l_partkey, min(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey")
def w3_lowest_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("rank"))
    return R.lowest_rank(rows, ["l_suppkey", "l_partkey"], "rank")


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC NULLS LAST) > 2""")
def w4_outdated_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "O").alias("active"))
    return R.outdated_versions(rows, "o_custkey", "active", "o_orderkey", 3).select("o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT user_id, event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS ft,
  first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS fe FROM events)
SELECT user_id, fe AS event_id, ft AS event_type, count(*) - 1 AS n_duplicates, count(*) FILTER (WHERE event_type IS DISTINCT FROM ft) AS n_conflicts FROM f GROUP BY 1, 2, 3""")
def w5_first_wins_conflicts(spark, sf_dir):
    return R.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""SELECT l_orderkey, l_linenumber, l_shipmode_key, rank() OVER (PARTITION BY l_shipmode_key ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_shipmode_key, l_quantity) - 1) / 2.0 AS avg_rank
FROM (SELECT *, l_suppkey AS l_shipmode_key FROM lineitem)""")
def w6_average_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipmode_key", F.col("l_suppkey"))
    return R.average_ranks(rows, "l_shipmode_key", "l_quantity").select("l_orderkey", "l_linenumber", "l_shipmode_key", "avg_rank")


@query("""SELECT * FROM (SELECT o_orderkey, o_totalprice, 'over' AS side, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 15
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'under', CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 15""")
def w7_extremes(spark, sf_dir):
    return R.extremes(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query(f"""WITH p AS {_P}, k AS (SELECT page_id, domain, {_KIND} AS kind FROM p),
  t AS (SELECT *, list_position(['product', 'article', 'category', 'page', 'home'], kind) AS turn FROM k WHERE kind <> 'media'),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain, kind ORDER BY page_id) AS rn FROM t),
  q AS (SELECT domain, kind, page_id, CAST(row_number() OVER (PARTITION BY domain ORDER BY rn, turn) AS INTEGER) AS pick FROM r)
SELECT * FROM q WHERE pick <= 6""")
def w8_round_robin_pick(spark, sf_dir):
    rows = page_domains(spark, sf_dir).withColumn("kind", U.path_kind(F.col("path")))
    return R.round_robin(rows, "domain", "kind", ["product", "article", "category", "page", "home"], "page_id", 6).select("domain", "kind", "page_id", "pick")


@query()
def w9_hash_sample(spark, sf_dir):
    return R.hash_sample(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").withColumn("item", F.concat_ws("-", "l_orderkey", "l_linenumber")), "l_suppkey", "item", 40, 7)


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
  s AS (SELECT DISTINCT p_brand, n, CAST(floor(k * (n / 7.0::DOUBLE)) AS BIGINT) AS i FROM n, range(7) t(k) WHERE n > 7)
SELECT p_brand, p_partkey FROM n WHERE n <= 7 UNION ALL SELECT n.p_brand, p_partkey FROM n JOIN s ON n.p_brand = s.p_brand AND n.i = s.i""")
def w10_spread_pick(spark, sf_dir):
    return R.spread_pick(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 7)


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size <= 25 AS is_product FROM part),
  c AS (SELECT *, count(*) FILTER (WHERE is_product) OVER (PARTITION BY p_brand) AS np, count(*) FILTER (WHERE NOT is_product) OVER (PARTITION BY p_brand) AS no,
        row_number() OVER (PARTITION BY p_brand, is_product ORDER BY p_partkey) AS rn FROM p),
  q AS (SELECT *, least(no, 20 - least(np, CAST(ceil(20 * 0.25) AS BIGINT))) AS qo FROM c)
SELECT p_brand, p_partkey, is_product FROM q WHERE rn <= CASE WHEN is_product THEN least(np, 20 - qo) ELSE qo END""")
def w11_quota_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") <= 25).alias("is_product"))
    return R.quota_pick(rows, "p_brand", "is_product", "p_partkey", 20)


@query(f"""WITH k AS (SELECT page_id, {_DOMAIN} AS domain, {_KEY} AS url_key, page_id % 50 = 0 AS is_start FROM pages),
  f AS (SELECT *, row_number() OVER (PARTITION BY domain, url_key ORDER BY NOT is_start, page_id) AS rn FROM k),
  q AS (SELECT domain, url_key, page_id, CAST(row_number() OVER (PARTITION BY domain ORDER BY NOT is_start, page_id) AS INTEGER) AS pick FROM f WHERE rn = 1)
SELECT * FROM q WHERE pick <= 10""")
def w12_ordered_distinct(spark, sf_dir):
    rows = page_domains(spark, sf_dir).select("page_id", "domain", U.url_key(F.col("url")).alias("url_key"), (F.col("page_id") % 50 == 0).alias("is_start"))
    return R.ordered_distinct(rows, "domain", "url_key", "is_start", "page_id", 10).select("domain", "url_key", "page_id", "pick")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def w13_keyset_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return R.keyset_page(o, "o_orderdate", "o_orderkey", F.lit(datetime(1996, 1, 1)), 100, F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate")


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS total,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn > 2 AND rn <= 7""")
def w14_page_with_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.page_with_total(o, "o_custkey", ["o_orderdate", "o_orderkey"], 5, 2).drop("o_orderdate")


@query("""WITH c AS (SELECT l_suppkey, l_shipmode, count(*) AS n FROM (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS l_shipmode FROM lineitem) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_shipmode) AS rn FROM c)
SELECT l_suppkey, string_agg(l_shipmode || '=' || n, ',' ORDER BY l_shipmode) AS top FROM r WHERE rn <= 10 GROUP BY l_suppkey""")
def w15_top10_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    top = R.top_counts(rows, "l_suppkey", "q", 10, "m")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return top.select("l_suppkey", text.alias("top"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def w16_oldest_per_key(spark, sf_dir):
    return R.oldest_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query()
def w18_random_rows(spark, sf_dir):
    """25 page URLs in seeded random order."""
    return R.random_rows(table(spark, sf_dir, "pages").select("page_id", "url"), 25, "url", 3)


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey % 4000 AS p_partkey FROM lineitem)
SELECT pos, p_partkey, coalesce(p_brand, 'unknown') AS p_brand FROM a LEFT JOIN part USING (p_partkey)""")
def w19_bulk_answer(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 4000).alias("p_partkey"))
    states = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return R.in_input_order(asked, states, "p_partkey", "pos", "unknown", "p_brand").select("pos", "p_partkey", "p_brand")


# joins ------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT p_brand || '-' || p_size AS domain FROM part GROUP BY 1),
  e AS (SELECT 'list-' || p_size % 3 AS list_id, p_brand || '-' || p_size AS domain, min(p_partkey) AS rank FROM part GROUP BY 1, 2),
  v AS (SELECT * FROM (VALUES ('a', 'list-0', true), ('a', 'list-old', false), ('b', 'list-1', true), ('c', 'list-2', false)) t(provider, list_id, active)),
  n AS (SELECT list_id, count(*) AS row_count FROM e GROUP BY 1),
  g AS (SELECT domain, p.provider, v.list_id, n.row_count FROM d, (SELECT DISTINCT provider FROM v) p LEFT JOIN v ON p.provider = v.provider AND v.active LEFT JOIN n ON n.list_id = v.list_id)
SELECT g.domain, g.provider, CASE WHEN g.list_id IS NULL THEN 'no_list' WHEN e.rank IS NOT NULL THEN 'present' ELSE 'absent' END AS status, e.rank, g.row_count
FROM g LEFT JOIN e ON g.list_id = e.list_id AND g.domain = e.domain""")
def j1_list_lookup(spark, sf_dir):
    """Part families looked up in ranked lists made of part sizes; one provider has no active version."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("domain"), F.concat(F.lit("list-"), F.col("p_size") % 3).alias("list_id"), "p_partkey")
    entries = p.groupBy("list_id", "domain").agg(F.min("p_partkey").alias("rank"))
    names = spark.createDataFrame([("a", "list-0", True), ("a", "list-old", False), ("b", "list-1", True), ("c", "list-2", False)], "provider string, list_id string, active boolean")
    versions = names.join(entries.groupBy("list_id").agg(F.count("*").alias("row_count")), "list_id", "left")
    return R.list_lookup(p.select("domain").distinct(), versions, entries).select("domain", "provider", "status", "rank", "row_count")


@query("""WITH raw AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS d FROM orders WHERE o_orderpriority LIKE '1%'),
  open AS (SELECT DISTINCT o_custkey AS d FROM orders WHERE o_orderstatus = 'P'),
  done AS (SELECT o_custkey AS d, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT pos, raw.d AS domain, CASE WHEN raw.d IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY raw.d ORDER BY pos) > 1 THEN 'duplicate' WHEN open.d IS NOT NULL THEN 'existing'
  WHEN last >= TIMESTAMP '1995-06-17' - INTERVAL 2160 HOUR THEN 'recent' ELSE 'queued' END AS status FROM raw LEFT JOIN open ON raw.d = open.d LEFT JOIN done ON raw.d = done.d""")
def j2_classify_ingest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("domain"))
    open_ = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("domain"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("domain"), F.col("o_orderdate").alias("completed_at"))
    return R.classify_ingest(raw, "pos", "domain", open_, done, F.lit(datetime(1995, 6, 17)), 2160).select("pos", "domain", "status")


@query("""WITH t AS (SELECT DISTINCT user_id AS domain, c AS collector FROM events, (VALUES ('x'), ('y')) v(c)),
  s AS (SELECT * FROM (VALUES ('x', 'click'), ('x', 'view'), ('y', 'purchase')) v(collector, source)),
  l AS (SELECT user_id AS domain, event_type AS source, max(ts) AS seen FROM events GROUP BY 1, 2), m AS (SELECT max(ts) AS now FROM events),
  d AS (SELECT t.domain, t.collector FROM t JOIN s USING (collector) LEFT JOIN l USING (domain, source), m GROUP BY 1, 2 HAVING bool_and(coalesce(seen >= now - INTERVAL 72 HOUR, false)))
SELECT domain, collector FROM t ANTI JOIN d USING (domain, collector)""")
def j3_freshness_anti(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    tasks = ev.select(F.col("user_id").alias("domain")).distinct().withColumn("collector", F.explode(F.array(F.lit("x"), F.lit("y"))))
    sources = spark.createDataFrame([("x", "click"), ("x", "view"), ("y", "purchase")], "collector string, source string")
    obs = ev.select(F.col("user_id").alias("domain"), F.col("event_type").alias("source"), F.col("ts").alias("collected_at"))
    now = F.lit(ev.agg(F.max("ts")).first()[0])
    return R.not_fresh(tasks, obs, sources, now, 72).select("domain", "collector")


@query("""SELECT c_custkey, coalesce((SELECT arg_max(o_orderstatus, o_orderdate * 1) FROM (SELECT o_custkey, o_orderstatus, epoch(o_orderdate) * 10000000 + o_orderkey AS o_orderdate FROM orders) o
  WHERE o.o_custkey = c_custkey), 'not_submitted') AS status FROM customer""")
def j4_last_status(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return R.last_status(table(spark, sf_dir, "customer").select("c_custkey"), runs, "c_custkey", "at", "status")


@query("""WITH g AS (SELECT p_brand AS domain, p_size % 5 AS source, CASE WHEN count(*) < 2 THEN 'missing' ELSE 'present' END AS status FROM part GROUP BY 1, 2),
  f AS (SELECT DISTINCT p_brand AS domain, p_size % 5 AS source FROM part WHERE p_partkey % 3 = 0)
SELECT domain, source, CASE WHEN status = 'missing' AND source = 4 THEN 'disabled' WHEN status = 'missing' AND f.domain IS NOT NULL THEN 'failed' ELSE status END AS status FROM g LEFT JOIN f USING (domain, source)""")
def j5_overlay_status(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain"), (F.col("p_size") % 5).alias("source"), "p_partkey")
    grid = p.groupBy("domain", "source").agg(F.when(F.count("*") < 2, "missing").otherwise("present").alias("status"))
    return R.overlay_status(grid, p.where("p_partkey % 3 = 0"), spark.createDataFrame([(4,)], "source int"))


@query("""WITH l AS (SELECT user_id, event_id AS snapshot, value AS feature FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT e.event_id, e.user_id, e.value, snapshot, feature FROM events e JOIN l ON e.user_id = l.user_id WHERE event_type = 'purchase'""")
def j6_latest_attached(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    features = ev.select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("snapshot"), F.col("value").alias("feature"))
    return R.attach_latest(ev.where("event_type = 'purchase'").select("event_id", "user_id", "value"), features, "user_id", "at").drop("at")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def j14_owner_listing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return R.owned_rows(o, c, "c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n_children, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j15_parent_rollup_zero(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return R.roll_up_children(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders o WHERE o_orderdate < TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def j16_stale_parents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return R.stale_parents(o, lines, "o_orderkey", "o_orderdate", F.lit(datetime(1997, 1, 1)), F.col("l_returnflag") == "R")


@query("""WITH p AS (SELECT c_custkey AS provider, 24 * (1 + c_custkey % 60) AS refresh_hours FROM customer),
  v AS (SELECT o_custkey AS provider, max(o_orderdate) AS downloaded_at FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT provider, downloaded_at FROM p LEFT JOIN v USING (provider) WHERE downloaded_at IS NULL OR downloaded_at < TIMESTAMP '1998-08-02' - to_hours(refresh_hours)""")
def j22_due_lists(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("provider"), (24 * (1 + F.col("c_custkey") % 60)).cast("int").alias("refresh_hours"))
    v = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("provider")).agg(F.max("o_orderdate").alias("downloaded_at")).withColumn("active", F.lit(True))
    return R.due_lists(p, v, F.lit(datetime(1998, 8, 2))).select("provider", "downloaded_at")


# roll-ups ---------------------------------------------------------------------------------


@query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS n_{s}" for s in "OFP") + " FROM orders GROUP BY 1")
def a23_status_pivot(spark, sf_dir):
    return R.status_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"])


@query("SELECT l_orderkey, count(*) AS n_tasks FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linestatus <> 'F') = 0")
def a24_finished_parents(spark, sf_dir):
    return R.finished_parents(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", ["F"])


@query("""SELECT o_custkey, count(*) AS n_jobs, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done FROM orders GROUP BY 1""")
def a25_filter_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return R.conditional_counts(table(spark, sf_dir, "orders"), ["o_custkey"], {"n_open": s == "O", "n_done": s == "F"}, total="n_jobs")


@query("""SELECT event_type, count(*) FILTER (WHERE value <= 1) AS le_1, count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 50) AS le_50,
  count(*) FILTER (WHERE value <= 100) AS le_100, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1""")
def a26_duration_histogram(spark, sf_dir):
    return R.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [1, 10, 50, 100]).withColumn("total", F.round("total", 4))


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS children, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def a34_nested_children(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = R.nest_children(table(spark, sf_dir, "orders").select("o_orderkey"), c, "o_orderkey", ["l_linenumber", "l_partkey"])
    text = F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return rows.select("o_orderkey", text.alias("children"), F.size("children").cast("long").alias("n"))


@query("""SELECT 'c' AS provider, c_custkey AS rank, c_name AS domain, c_acctbal AS score, CAST(NULL AS VARCHAR) AS segment FROM customer
UNION ALL SELECT 's', s_suppkey, s_name, NULL, 'supply' FROM supplier""")
def u1_union_schema(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("provider"), F.col("c_custkey").alias("rank"), F.col("c_name").alias("domain"), F.col("c_acctbal").alias("score"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("provider"), F.col("s_suppkey").alias("rank"), F.col("s_name").alias("domain"), F.lit("supply").alias("segment"))
    return R.union_entries(c, s)


@query(f"""WITH k AS (SELECT DISTINCT {_DOMAIN} AS domain, regexp_extract({_PATH}, '^/([a-z]{{2}})/', 1) AS l FROM pages)
SELECT domain, string_agg(l, ',' ORDER BY l) AS langs FROM k WHERE l NOT IN ('', 'de') GROUP BY 1""")
def u2_set_unions(spark, sf_dir):
    """The union of the languages of a domain's hosts, less one that doesn't count."""
    rows = page_domains(spark, sf_dir).withColumn("l", F.regexp_extract("path", "^/([a-z]{2})/", 1))
    per_host = rows.groupBy("domain", "host").agg(F.collect_set("l").alias("ls"))
    sets = R.union_of_sets(per_host, "domain", "ls", without=["", "de"])
    return sets.select("domain", F.array_join("ls", ",").alias("langs"))


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def u3_minus_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return R.minus_by_key(c, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey")


@query("(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def u4_disabled_sources(spark, sf_dir):
    of = lambda name, col: table(spark, sf_dir, name).withColumn("k", F.col(col))
    return R.disabled_keys(of("customer", "c_nationkey"), of("supplier", "s_nationkey"), of("nation", "n_nationkey").where("n_regionkey = 1"), "k")


@query("""SELECT o_orderkey, '{"order_priority":"' || o_orderpriority || '","ship_u_r_l":"' || o_custkey || '"}' AS options, date_diff('millisecond', o_orderdate, o_orderdate + to_days(CAST(o_custkey % 9 AS INTEGER))) AS duration_ms,
  CASE WHEN o_custkey % 3 = 0 THEN 'ready' WHEN o_orderstatus IN ('O', 'F') THEN 'pending' ELSE 'failed' END AS view_status, o_custkey % 3 = 0 AND o_orderstatus = 'O' AS refreshing FROM orders""")
def p30_job_view(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    jobs = o.select(
        "o_orderkey", F.create_map(F.lit("orderPriority"), F.col("o_orderpriority"), F.lit("shipURL"), F.col("o_custkey").cast("string")).alias("options"),
        F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 9).cast("int"))).alias("b"), status.alias("s"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")).alias("e"),
    )
    return R.job_view(jobs, "options", "a", "b", "s", "e").select("o_orderkey", F.to_json("options").alias("options"), "duration_ms", "view_status", "refreshing")


# evaluation -------------------------------------------------------------------------------


def scored(spark, sf_dir) -> DataFrame:
    """Order lines as scored rows: price as reference, quantity times a constant as estimate."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("reference"), (F.col("l_quantity") * F.lit(1500.0)).alias("estimate"),
        (F.col("l_quantity") * F.lit(1000.0)).alias("lower"), (F.col("l_quantity") * F.lit(2200.0)).alias("upper"),
    )
    return E.with_buckets(rows, "reference", "estimate")


def _b(c):
    return "CASE " + " ".join(f"WHEN {c} >= {e} THEN '{x}'" for x, e in reversed(E.BUCKETS[1:])) + " ELSE '<1K' END"


_LBL = "[" + ", ".join(repr(x) for x in E.LABELS) + "]"
_SC = f"""(SELECT *, list_position({_LBL}, est_bucket) - list_position({_LBL}, ref_bucket) AS bucket_diff FROM (
  SELECT *, {_b('reference')} AS ref_bucket, {_b('estimate')} AS est_bucket, log10(greatest(estimate, 1.0)) - log10(greatest(reference, 1.0)) AS error FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_extendedprice AS reference, l_quantity * 1500.0 AS estimate, l_quantity * 1000.0 AS lower, l_quantity * 2200.0 AS upper FROM lineitem)))"""


def _round(df: DataFrame, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, t in df.dtypes if t == "double"})


def _metrics(key: str) -> str:
    return f"""WITH s AS {_SC}, r AS (SELECT *, abs(error) AS a, row_number() OVER (PARTITION BY {key} ORDER BY abs(error)) AS rn, count(*) OVER (PARTITION BY {key}) AS cnt FROM s)
SELECT {key}, count(*) AS n, round(avg(error), 6) AS bias, round(median(error), 6) AS median, round(avg(a), 6) AS mae, round(sqrt(avg(error * error)), 6) AS rmse,
  round(max(a) FILTER (WHERE rn = least(cnt, CAST(floor(cnt * 0.9::DOUBLE) AS BIGINT) + 1)), 6) AS p90, round(avg(CAST(a <= 0.3 AS INTEGER)), 6) AS within_03, round(avg(CAST(a <= 0.5 AS INTEGER)), 6) AS within_05,
  round(avg(CAST(a <= 1.0 AS INTEGER)), 6) AS within_10, round(avg(CAST(bucket_diff = 0 AS INTEGER)), 6) AS bucket_exact, round(avg(CAST(abs(bucket_diff) <= 1 AS INTEGER)), 6) AS bucket_within_1,
  round(avg(CAST(reference BETWEEN lower AND upper AS INTEGER)), 6) AS in_range FROM r GROUP BY {key}"""


@query(f"SELECT ref_bucket, est_bucket, CAST(bucket_diff AS BIGINT) AS bucket_diff, count(*) AS n FROM {_SC} GROUP BY 1, 2, 3")
def p29_bucket_assign(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("ref_bucket", "est_bucket", F.col("bucket_diff").cast("long").alias("bucket_diff")).agg(F.count("*").alias("n"))


@query(_metrics("l_returnflag"))
def a17_error_groups(spark, sf_dir):
    """A13 and A17 by return flag."""
    return _round(E.group_metrics(scored(spark, sf_dir), "l_returnflag"))


@query(f"""WITH s AS (SELECT *, 'all' AS "all" FROM {_SC}), m AS (SELECT median(reference) AS mv FROM s), b AS (SELECT round(avg(abs(log10(greatest(reference, 1.0)) - log10(greatest(mv, 1.0)))), 6) AS median_mae, round(any_value(mv), 6) AS median_visits FROM s, m)
SELECT g.*, b.median_visits, b.median_mae FROM ({_metrics('"all"').replace('FROM lineitem', 'FROM lineitem').replace('WITH s AS ' + _SC, 'WITH s AS (SELECT *, ' + "'all'" + ' AS "all" FROM ' + _SC + ')')}) g, b""")
def a18_overall_metrics(spark, sf_dir):
    return _round(E.overall_metrics(scored(spark, sf_dir)))


@query("WITH s AS " + _SC + " SELECT l.x AS ref_bucket, l.i AS idx, " + ", ".join(f"coalesce(sum(CAST(est_bucket = '{x}' AS INTEGER)), 0)::BIGINT AS est_{i}" for i, x in enumerate(E.LABELS)) + f" FROM (SELECT unnest({_LBL}) AS x, unnest(range({len(E.LABELS)}))::INTEGER AS i) l LEFT JOIN s ON s.ref_bucket = l.x GROUP BY 1, 2")
def a19_confusion_matrix(spark, sf_dir):
    return E.confusion(scored(spark, sf_dir))


@query(f"""WITH s AS {_SC} SELECT 'l_returnflag' AS grouping, l_returnflag AS label, count(*) AS n, round(avg(abs(error)), 6) AS mae FROM s GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), round(avg(abs(error)), 6) FROM s GROUP BY 2 UNION ALL SELECT 'ref_bucket', ref_bucket, count(*), round(avg(abs(error)), 6) FROM s GROUP BY 2""")
def a20_three_groupings(spark, sf_dir):
    rows = E.three_groupings(scored(spark, sf_dir), "l_returnflag", "l_linestatus", "ref_bucket")
    return _round(rows)


_RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS ry FROM p)"""


@query(f"WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_discount AS y FROM lineitem), {_RANKS} SELECT k AS l_suppkey, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END AS rho FROM r GROUP BY k")
def a15_spearman_by_group(spark, sf_dir):
    """A14 and A15 by supplier."""
    return _round(E.spearman(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_discount", small=True))


@query("SELECT l_suppkey, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY 1")
def a16_ols_by_group(spark, sf_dir):
    return _round(E.least_squares(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice"), 3)


@query(f"""WITH t AS (SELECT count(*) AS n FROM lineitem), p AS (SELECT 'q' AS k, log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem UNION ALL
  SELECT 'd', CASE WHEN l_discount > 0 THEN l_discount END, log10(l_extendedprice) FROM lineitem WHERE l_discount > 0), {_RANKS}
SELECT k AS signal, round(count(*) / any_value(t.n), 6) AS coverage, round(avg(abs(x - y)), 6) AS mae, round(corr(rx, ry), 6) AS rho, round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope FROM r, t GROUP BY k""")
def a21_per_signal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.create_map(F.lit("q"), F.log10("l_quantity"), F.lit("d"), F.when(F.col("l_discount") > 0, F.col("l_discount"))).alias("signals"), F.col("l_extendedprice").alias("reference")
    )
    return _round(E.signal_metrics(rows, "signals", "reference"))


@query(f"""WITH s AS {_SC} SELECT count(*) AS n, count(*) FILTER (WHERE reference IS NULL) AS n_no_reference, count(*) FILTER (WHERE estimate IS NULL) AS n_no_estimate,
  count(DISTINCT l_suppkey) AS n_domains, count(*) FILTER (WHERE l_linestatus = 'F') AS n_completed FROM s""")
def a22_counts(spark, sf_dir):
    return E.run_counts(scored(spark, sf_dir), "l_suppkey", "reference", "estimate", F.col("l_linestatus") == "F")


@query("""WITH k AS (SELECT 'mode' AS source, l_returnflag AS status FROM lineitem WHERE l_linenumber <> 3 UNION ALL SELECT 'line', l_linestatus FROM lineitem WHERE l_quantity < 20)
SELECT source, status, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT source, 'none', (SELECT count(*) FROM lineitem) - count(*) FROM k GROUP BY 1""")
def a22_source_statuses(spark, sf_dir):
    mode, line = F.struct(F.lit("mode").alias("key"), F.col("l_returnflag").alias("value")), F.struct(F.lit("line").alias("key"), F.col("l_linestatus").alias("value"))
    kept = F.array_compact(F.array(F.when(F.col("l_linenumber") != 3, mode), F.when(F.col("l_quantity") < 20, line)))
    return E.source_statuses(table(spark, sf_dir, "lineitem").select(F.map_from_entries(kept).alias("sources")), "sources")


@query("""SELECT CASE WHEN e >= 10000000 THEN '10M+' WHEN e >= 1000000 THEN '1M-10M' WHEN e >= 100000 THEN '100K-1M' WHEN e >= 10000 THEN '10K-100K' WHEN e >= 1000 THEN '1K-10K' ELSE '<1K' END AS bucket,
  count(*) AS n, count(*) FILTER (WHERE e < 5000) AS n_below FROM (SELECT CASE WHEN l_linenumber = 2 THEN 0 ELSE l_extendedprice END AS e FROM lineitem WHERE l_discount = 0) GROUP BY 1""")
def a22_without_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("reference"), F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("estimate"))
    return E.without_reference(rows, "reference", "estimate")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_custkey END AS d, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, -5) END AS v FROM orders),
  f AS (SELECT *, first_value(v) OVER (PARTITION BY d ORDER BY o_orderkey) AS fv FROM r)
SELECT count(*) AS n_rows, count(DISTINCT d) AS n_domains, count(d) - count(DISTINCT d) AS n_duplicates, count(*) FILTER (WHERE d IS NOT NULL AND v IS DISTINCT FROM fv) AS n_conflicts,
  count(*) FILTER (WHERE d IS NULL) AS n_invalid, count(*) FILTER (WHERE v IS NULL) AS n_missing FROM f""")
def a32_load_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey")).alias("d"), F.when(F.col("o_orderkey") % 7 != 0, F.round("o_totalprice", -5)).alias("v"))
    return E.load_statistics(rows, "d", "o_orderkey", "v")
