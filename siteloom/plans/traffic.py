"""Queries of the estimate chain, on features that Spark derives from parts, order lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimate as T
from ..operators import relational as R
from ..sources.scratch import scratch
from .core import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def part_features(spark, sf_dir):
    """A feature vector per part: ranks from its key and price, counts from its order lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    rows = table(spark, sf_dir, "part").repartition("p_partkey").join(lines, "p_partkey", "left")  # one file of parts is few tasks
    k = F.col("p_partkey")
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        k.cast("string").alias("domain"), F.when(k % 3 != 0, k * 37).cast("double").alias("tranco_rank"), F.lit(4_600_000.0).alias("tranco_list_size"), F.when(k % 4 == 0, F.lit(1000.0) * F.pow(F.lit(10.0), k % 4)).alias("crux_rank_bucket"),
        F.when(k % 5 != 0, k * 211).cast("double").alias("ccg_harmonic_rank"), F.when(k % 5 != 0, k * 307).cast("double").alias("ccg_pagerank_rank"), F.col("q").alias("opr_ref_domains"), n.cast("double").alias("commoncrawl_url_count"),
        (k % 7 != 0).alias("crawl_reachable"), (k % 31 == 0).alias("crawl_parked"), (k % 11 == 0).alias("crawl_blocked"), (k % 13 != 0).alias("dns_resolves"), (k % 13 == 0).alias("dns_nxdomain"),
        F.when(k % 26 == 0, "not_found").otherwise("found").alias("rdap_status"), (k % 2 == 0).alias("analytics_detected"), (k % 9 == 0).alias("advertising_tags_detected"), (n > 0).alias("sitemap_found"), (n * 5).cast("double").alias("sitemap_page_count"),
    )


def part_status(spark, sf_dir):
    f = part_features(spark, sf_dir)
    found = {"tranco": F.col("tranco_rank").isNotNull(), "crux_top": F.col("crux_rank_bucket").isNotNull(), "cc_webgraph": F.col("ccg_harmonic_rank").isNotNull(), "crawl": F.col("crawl_reachable"), "dns": F.col("dns_resolves")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("found")) for k, v in found.items()])).alias("x")
    seen = f.select("domain", "crawl_blocked", "crawl_reachable", pairs).select("domain", "x.source", "x.found", F.col("crawl_blocked").alias("blocked"), F.col("crawl_reachable").alias("reachable"))
    return T.source_status(f, seen, list(T.V2["source_weights"]))


def stored(spark, sf_dir):
    """Features and status as written tables, which the chain reads several times."""
    out = []
    for name, df in (("features", part_features(spark, sf_dir)), ("status", part_status(spark, sf_dir))):
        path = scratch(spark, name)
        df.write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


_SEG = " UNION ALL ".join(
    f"SELECT '{n}' AS signal, '{f}' AS feature, {w}::DOUBLE AS weight, '{k}' AS kind, {x0}::DOUBLE AS x0, {x1}::DOUBLE AS x1, {y0}::DOUBLE AS y0, {y1}::DOUBLE AS y1"
    for n, f, w, k, p in T.SIGNALS_V2
    for (x0, y0), (x1, y1) in zip([(-99, p[0][1]), *p], [*p, (99, p[-1][1])], strict=True)
)
_FEAT = """(SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 37 END AS tranco, CASE WHEN p_partkey % 4 = 0 THEN 1000 END AS crux, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 211 END AS har,
  CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 307 END AS pr, q, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
_LONG = f"""(SELECT CAST(k AS VARCHAR) AS domain, feature, x FROM (SELECT k, unnest(['log_tranco_rank', 'log_crux_bucket', 'log_ccg_harmonic_rank', 'log_ccg_pagerank_rank', 'log_opr_ref_domains', 'log_cc_url_count', 'log_sitemap_pages']) AS feature,
  unnest([round(log10(tranco), 4), round(log10(crux), 4), round(log10(har), 4), round(log10(pr), 4), round(log10(q + 1), 4), round(log10(n + 1), 4), CASE WHEN k % 7 <> 0 AND n > 0 THEN round(log10(n * 5 + 1), 4) END]) AS x FROM {_FEAT}) WHERE x IS NOT NULL)"""
_SIG = f"(SELECT domain, signal, kind, weight, round(y0 + (y1 - y0) * (x - x0) / (x1 - x0) + 1e-9, 3) AS log10_estimate FROM {_LONG} JOIN ({_SEG}) USING (feature) WHERE x >= x0 AND x < x1)"


@query(f"SELECT domain, signal, kind, weight, log10_estimate FROM {_SIG}")
def j12_curve_interpolate(spark, sf_dir):
    rows = T.signal_estimates(T.normalize(part_features(spark, sf_dir)), T.V2)
    return rows


@query(f"""WITH s AS {_SIG}, g AS (SELECT domain, sum(weight * log10_estimate) / sum(weight) AS mean, count(*) FILTER (WHERE kind = 'popularity') AS n_popularity, count(*) AS n_signals,
  stddev_pop(log10_estimate) FILTER (WHERE kind = 'popularity') AS sp, stddev_pop(log10_estimate) AS sa FROM s GROUP BY 1)
SELECT domain, round(mean + 1e-9, 5) AS mean, n_popularity, n_signals, CASE WHEN CASE WHEN n_popularity > 0 THEN n_popularity ELSE n_signals END >= 2 THEN round(CASE WHEN n_popularity > 0 THEN sp ELSE sa END + 1e-9, 4) END AS stddev FROM g""")
def a10_weighted_mean(spark, sf_dir):
    """A8 and A10 per part."""
    rows = T.combine_signals(T.signal_estimates(T.normalize(part_features(spark, sf_dir)), T.V2))
    return rows.select("domain", F.round(F.col("mean") + 1e-9, 5).alias("mean"), "n_popularity", "n_signals", "stddev")


_ST = """(SELECT CAST(k AS VARCHAR) AS domain, s AS source, CASE s WHEN 'tranco' THEN CASE WHEN k % 3 <> 0 THEN 'present' ELSE 'absent' END WHEN 'crux_top' THEN CASE WHEN k % 4 = 0 THEN 'present' ELSE 'absent' END
  WHEN 'cc_webgraph' THEN CASE WHEN k % 5 <> 0 THEN 'present' ELSE 'absent' END WHEN 'dns' THEN CASE WHEN k % 13 <> 0 THEN 'present' ELSE 'absent' END
  WHEN 'crawl' THEN CASE WHEN k % 11 = 0 THEN 'blocked' WHEN k % 7 = 0 THEN 'unreachable' ELSE 'present' END ELSE 'missing' END AS status, w
  FROM (SELECT p_partkey AS k FROM part), (VALUES ('tranco', 2.0), ('crux_top', 2.0), ('cc_webgraph', 1.5), ('majestic', 1.0), ('openpagerank', 1.0), ('commoncrawl', 1.0), ('crawl', 1.5), ('dns', 0.5)) t(s, w))"""


@query(f"SELECT domain, source, status FROM {_ST}")
def p27_source_status(spark, sf_dir):
    return part_status(spark, sf_dir)


@query(f"SELECT domain, round(sum(w * CASE status WHEN 'present' THEN 1 WHEN 'absent' THEN 0.8 WHEN 'unreachable' THEN 0.5 WHEN 'blocked' THEN 0.3 ELSE 0 END) / sum(w), 4) AS coverage, count(*) FILTER (WHERE status = 'present' AND source IN ('tranco', 'crux_top', 'cc_webgraph')) AS n_present FROM {_ST} GROUP BY 1")
def a7_evidence_coverage(spark, sf_dir):
    return T.evidence_coverage(part_status(spark, sf_dir), T.V2["source_weights"]).select("domain", "coverage", "n_present")


@query("SELECT CAST(p_partkey AS VARCHAR) AS domain, 4.3::DOUBLE AS cap FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0")
def j13_absence_caps(spark, sf_dir):
    return T.absence_caps(part_features(spark, sf_dir), part_status(spark, sf_dir), T.V2)


_NORM = ["log_tranco_rank", "log_opr_ref_domains", "log_cc_url_count", "log_sitemap_pages", "crawl_reachable", "analytics_detected", "advertising_detected"]


@query(f"""SELECT CAST(k AS VARCHAR) AS domain, round(log10(tranco), 4) AS log_tranco_rank, round(log10(q + 1), 4) AS log_opr_ref_domains, round(log10(n + 1), 4) AS log_cc_url_count,
  CASE WHEN k % 7 <> 0 AND n > 0 THEN round(log10(n * 5 + 1), 4) END AS log_sitemap_pages, CAST(k % 7 <> 0 AS INTEGER)::DOUBLE AS crawl_reachable,
  CASE WHEN k % 7 <> 0 THEN CAST(k % 2 = 0 AS INTEGER)::DOUBLE END AS analytics_detected, CASE WHEN k % 7 <> 0 THEN CAST(k % 9 = 0 AS INTEGER)::DOUBLE END AS advertising_detected FROM {_FEAT}""")
def p28_normalized(spark, sf_dir):
    return T.normalize(part_features(spark, sf_dir)).select("domain", *_NORM)


@query("""WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT CAST(user_id AS VARCHAR) AS domain, max(CAST(json_extract(props, '$.k') AS DOUBLE)) FILTER (WHERE event_type = 'click') AS click_k, max(CAST(json_extract(props, '$.k') AS DOUBLE)) FILTER (WHERE event_type = 'view') AS view_k FROM l GROUP BY 1""")
def p26_extract_features(spark, sf_dir):
    """Two features out of the latest event payload per user and type."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("domain"), F.col("event_type").alias("source"), F.col("props").alias("payload"), "ts", "event_id")
    latest = R.latest_per_key(ev, ["domain", "source"], "ts", "event_id")
    return T.extract_features(latest, {"click_k": ("click", "$.k"), "view_k": ("view", "$.k")})


def _chain(model: str, signals: str, base: float, most: float, caps: bool) -> str:
    """The whole chain in SQL, for a version's signals, range and absence caps."""
    bucket = lambda v: f"CASE WHEN {v} >= 10000000 THEN '10M+' WHEN {v} >= 1000000 THEN '1M-10M' WHEN {v} >= 100000 THEN '100K-1M' WHEN {v} >= 10000 THEN '10K-100K' WHEN {v} >= 1000 THEN '1K-10K' ELSE '<1K' END"
    return f"""(WITH s AS {signals}, g AS (SELECT domain, sum(weight * log10_estimate) / sum(weight) AS mean, count(*) FILTER (WHERE kind = 'popularity') AS np, count(*) AS ns,
    stddev_pop(log10_estimate) FILTER (WHERE kind = 'popularity') AS sp, stddev_pop(log10_estimate) AS sa FROM s GROUP BY 1),
  j AS (SELECT *, CASE WHEN np > 0 THEN np ELSE ns END AS nj, CASE WHEN np > 0 THEN sp ELSE sa END AS sd FROM g),
  c AS (SELECT domain, round(sum(w * CASE status WHEN 'present' THEN 1 WHEN 'absent' THEN 0.8 WHEN 'unreachable' THEN 0.5 WHEN 'blocked' THEN 0.3 ELSE 0 END) / sum(w), 4)::DOUBLE AS coverage, count(*) FILTER (WHERE status = 'present' AND source IN ('tranco', 'crux_top', 'cc_webgraph')) AS n_present,
    bool_or(source = 'crawl' AND status = 'blocked') AS blocked FROM {_ST} GROUP BY 1),
  e0 AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS domain, mean, np, coverage, n_present, blocked, CASE WHEN nj >= 2 THEN round(sd + 1e-9, 4) END AS stddev,
    CASE WHEN nj < 2 THEN 0.6 ELSE round(greatest(0.0, 1 - least(1.0, sd)), 4) END AS agreement, mean IS NOT NULL AND np = 0 AND mean > 4.3 AS free,
    CASE WHEN {str(caps).lower()} AND p_partkey % 3 = 0 AND p_partkey % 4 <> 0 THEN 4.3::DOUBLE END AS cap FROM part LEFT JOIN j ON j.domain = CAST(p_partkey AS VARCHAR) LEFT JOIN c ON c.domain = CAST(p_partkey AS VARCHAR)),
  e1 AS (SELECT *, CASE WHEN free THEN 4.3 WHEN mean IS NOT NULL THEN mean WHEN k % 7 <> 0 THEN 3.0 WHEN k % 13 <> 0 THEN 2.5 ELSE 2.0 END::DOUBLE AS v FROM e0),
  e2 AS (SELECT * REPLACE (CASE WHEN k % 26 = 0 THEN least(v, 1.5::DOUBLE) WHEN k % 13 = 0 THEN least(v, 2.0::DOUBLE) ELSE v END AS v) FROM e1),
  e3 AS (SELECT * REPLACE (CASE WHEN k % 31 = 0 THEN least(v, 2.3::DOUBLE) ELSE v END + CASE WHEN k % 7 = 0 AND k % 13 <> 0 THEN -0.4 ELSE 0 END::DOUBLE + CASE WHEN k % 2 = 0 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN k % 9 = 0 THEN 0.1 ELSE 0 END::DOUBLE AS v) FROM e2),
  e4 AS (SELECT *, coalesce(v > cap, false) AS capped, greatest(0::DOUBLE, CASE WHEN coalesce(v > cap, false) THEN cap ELSE v END) AS est,
    least({base}::DOUBLE + 0.5::DOUBLE * (1 - coalesce(coverage, 0)) + 0.8::DOUBLE * coalesce(stddev, 0), {most}::DOUBLE) AS spread,
    0.55::DOUBLE * coalesce(coverage, 0) + 0.35::DOUBLE * coalesce(CASE WHEN mean IS NOT NULL THEN agreement END, 0.3) + CASE WHEN n_present >= 2 THEN 0.1 ELSE 0 END::DOUBLE AS raw FROM e3),
  e5 AS (SELECT *, CAST(round_even(pow(10::DOUBLE, est), 0) AS BIGINT) AS visits, CAST(round_even(pow(10::DOUBLE, greatest(0::DOUBLE, est - spread)), 0) AS BIGINT) AS lower, CAST(round_even(pow(10::DOUBLE, est + spread), 0) AS BIGINT) AS upper,
    round(greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN blocked THEN least(raw, 0.65::DOUBLE) ELSE raw END)), 2) AS score FROM e4)
SELECT '{model}' AS model_version, domain, visits, lower, upper, {bucket('visits')} AS bucket, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, score,
  concat_ws('; ', CASE WHEN free THEN 'no popularity signal: capped' END, CASE WHEN mean IS NULL THEN CASE WHEN k % 7 <> 0 THEN 'reachable site assumed small' WHEN k % 13 <> 0 THEN 'resolves, no page' ELSE 'no evidence' END END,
    CASE WHEN k % 26 = 0 THEN 'unregistered' WHEN k % 13 = 0 THEN 'does not resolve' END, CASE WHEN k % 31 = 0 THEN 'parked' END, CASE WHEN k % 7 = 0 AND k % 13 <> 0 THEN 'unreachable' END, CASE WHEN k % 11 = 0 THEN 'crawl blocked' END,
    CASE WHEN capped THEN 'absent from a complete list: capped' END) AS notes, round(est + 1e-9, 3) AS log10_estimate, round(spread + 1e-9, 3) AS spread FROM e5)"""


_SIG_V1 = f"(SELECT domain, signal, kind, CASE signal WHEN 'cc_webgraph' THEN 2.0::DOUBLE ELSE weight END AS weight, log10_estimate FROM {_SIG} WHERE signal <> 'cc_webgraph_pagerank')"
_V1, _V2 = _chain("heuristic_v1", _SIG_V1, 0.3, 1.3, False), _chain("heuristic_v2", _SIG, 0.5, 1.5, True)


@query(f"SELECT domain, visits, lower, upper, bucket, confidence, score, notes, log10_estimate, spread FROM {_V2}")
def a12_estimates(spark, sf_dir):
    """J12, A7 to A13 in order: the whole chain of version 2 per part."""
    e = T.estimate(*stored(spark, sf_dir), "heuristic_v2")
    return e.select("domain", "visits", "lower", "upper", "bucket", "confidence", "score", F.array_join("notes", "; ").alias("notes"), "details.log10_estimate", "details.spread")


@query(f"""WITH r AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS domain, CASE WHEN l_partkey % 17 = 0 THEN 'failed' ELSE 'completed' END AS run_status FROM lineitem),
  e AS (SELECT * FROM {_V1} UNION ALL SELECT * FROM {_V2})
SELECT CAST(p_partkey AS VARCHAR) AS domain, p_retailprice AS reference, coalesce(run_status, 'not_submitted') AS run_status, e.visits AS estimate, e.lower, e.upper, e.bucket, e.confidence, m.v AS model_version
FROM part CROSS JOIN (VALUES ('heuristic_v1'), ('heuristic_v2')) m(v) LEFT JOIN r ON r.domain = CAST(p_partkey AS VARCHAR) LEFT JOIN e ON e.domain = r.domain AND run_status = 'completed' AND e.model_version = m.v""")
def j21_compare_models(spark, sf_dir):
    """parts' prices as reference under both versions; a part without order lines never ran."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("domain"), F.col("p_retailprice").alias("reference"))
    ran = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("domain"), F.when(F.col("l_partkey") % 17 == 0, "failed").otherwise("completed").alias("run_status")).distinct()
    return T.compare_models(parts, ran, *stored(spark, sf_dir), ["heuristic_v1", "heuristic_v2"])


@query("""WITH t AS (SELECT p_partkey, CASE p_size % 14 WHEN 0 THEN 'Product' WHEN 1 THEN 'ProductGroup' WHEN 2 THEN 'Offer' WHEN 3 THEN 'AggregateOffer' WHEN 4 THEN 'Article' WHEN 5 THEN 'NewsArticle' WHEN 6 THEN 'BlogPosting' WHEN 7 THEN 'TechArticle'
  WHEN 8 THEN 'Organization' WHEN 9 THEN 'Corporation' WHEN 10 THEN 'LocalBusiness' WHEN 11 THEN 'Store' END AS a, CASE WHEN contains(p_type, 'BRASS') THEN 'Store' WHEN contains(p_type, 'STEEL') THEN 'TechArticle' END AS b FROM part)
SELECT p_partkey, coalesce(a IN ('Product', 'ProductGroup', 'Offer', 'AggregateOffer'), false) AS schema_product, coalesce(a IN ('Article', 'NewsArticle', 'BlogPosting', 'TechArticle') OR b = 'TechArticle', b = 'TechArticle', false) AS schema_article,
  coalesce(a IN ('Organization', 'Corporation', 'LocalBusiness', 'Store') OR b = 'Store', b = 'Store', false) AS schema_organization FROM t""")
def j19_type_flags(spark, sf_dir):
    """J19 on type lists made of part types."""
    p = table(spark, sf_dir, "part")
    names = "Product ProductGroup Offer AggregateOffer Article NewsArticle BlogPosting TechArticle Organization Corporation LocalBusiness Store Thing Person".split()
    one = F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 14 + 1).cast("int"))
    types = F.array_compact(F.array(F.when(F.col("p_type").contains("BRASS"), "Store").when(F.col("p_type").contains("STEEL"), "TechArticle"), one))
    return p.select("p_partkey", *[v.alias(k) for k, v in T.type_flags(types).items()])


def payloads(spark, sf_dir):
    """Latest payloads of a tranco, crawl and dns source made of the parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tranco = F.to_json(F.struct(F.when(k % 3 == 0, "absent").otherwise("present").alias("status"), k.alias("rank"), F.lit(1_000_000).alias("list_size")))
    tech = F.struct(F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("jQuery").alias("name"))).alias("technologies"), F.col("p_type").alias("cms"), F.when(k % 2 == 0, F.array(F.lit("GA"))).alias("analytics"))
    crawl = F.to_json(F.struct(
        (k % 5 > 0).alias("reachable"), F.struct(F.col("p_size").alias("url_count"), F.create_map(F.lit("product"), F.col("p_size")).alias("kinds"), F.array(F.lit("/s.xml")).alias("fetched")).alias("sitemaps"), tech.alias("tech"),
        F.struct(F.create_map(F.lit("Offer"), F.lit(1), F.lit("Thing"), F.lit(2)).alias("schema_types"), F.col("p_size").alias("ok")).alias("pages"), F.struct((k % 7 == 0).alias("parked"), F.col("p_name").alias("title")).alias("signals"),
    ))
    dns = F.to_json(F.struct(F.lit(True).alias("resolves"), F.create_map(F.lit("A"), F.array(F.lit("1.2.3.4"), F.lit("1.2.3.5"))).alias("records"), F.struct(F.when(k % 4 == 0, "ok").otherwise("error").alias("status"), F.col("p_brand").alias("registrar"), F.col("p_size").alias("domain_age_days")).alias("rdap")))
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.when(k % 11 != i, v).alias("payload")) for i, (s, v) in enumerate((("tranco", tranco), ("crawl", crawl), ("dns", dns)))])
    return p.select(k.cast("string").alias("domain"), F.explode(rows).alias("r")).select("domain", "r.*").where("payload is not null")


@query("""WITH p AS (SELECT p_partkey AS k, *, p_partkey % 11 <> 0 AS t, p_partkey % 11 <> 1 AS c, p_partkey % 11 <> 2 AS d FROM part), q AS (SELECT *, c AND k % 5 > 0 AS up FROM p)
SELECT CAST(k AS VARCHAR) AS domain, CASE WHEN t AND k % 3 <> 0 THEN k END AS tranco_rank, CASE WHEN t THEN 1000000 END::BIGINT AS tranco_list_size, CASE WHEN c THEN k % 5 > 0 END AS crawl_reachable, CASE WHEN c THEN k % 7 = 0 END AS crawl_parked,
  CASE WHEN c THEN false END AS crawl_blocked, CASE WHEN up THEN p_size END::BIGINT AS sitemap_url_count, CASE WHEN up THEN p_size END::BIGINT AS sitemap_product_count, CASE WHEN up THEN 0 END::BIGINT AS sitemap_article_count, CASE WHEN up THEN true END AS sitemap_found,
  CASE WHEN up THEN p_size END::BIGINT AS pages_ok, CASE WHEN up THEN true END AS schema_product, CASE WHEN up THEN false END AS schema_article, CASE WHEN up THEN p_name END AS title, CASE WHEN up THEN 2 END::BIGINT AS technology_count,
  CASE WHEN up THEN p_brand || ',jQuery' ELSE '' END AS technologies, CASE WHEN up THEN p_type END AS cms, CASE WHEN up THEN k % 2 = 0 END AS analytics_detected, CASE WHEN up AND k % 2 = 0 THEN 'GA' ELSE '' END AS analytics_tags,
  CASE WHEN d THEN true END AS dns_resolves, CASE WHEN d THEN false END AS dns_parked, CASE WHEN d THEN 2 END::BIGINT AS dns_a_count, CASE WHEN d AND k % 4 = 0 THEN p_brand END AS registrar, CASE WHEN d AND k % 4 = 0 THEN p_size END::BIGINT AS domain_age_days,
  CASE WHEN d THEN CASE WHEN k % 4 = 0 THEN 'ok' ELSE 'error' END END AS rdap_status, 93::BIGINT AS n_columns FROM q""")
def p26_feature_vector(spark, sf_dir):
    """All features of payloads made of the parts; those that they set."""
    rows = T.feature_vector(payloads(spark, sf_dir))
    listed = lambda name: F.array_join(name, ",").alias(name)
    return rows.select(
        "domain", "tranco_rank", "tranco_list_size", "crawl_reachable", "crawl_parked", "crawl_blocked", "sitemap_url_count", "sitemap_product_count", "sitemap_article_count", "sitemap_found", "pages_ok", "schema_product", "schema_article",
        "title", "technology_count", listed("technologies"), "cms", "analytics_detected", listed("analytics_tags"), "dns_resolves", "dns_parked", "dns_a_count", "registrar", "domain_age_days", "rdap_status", F.lit(len(rows.columns)).cast("long").alias("n_columns"),
    )
