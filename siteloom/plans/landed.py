"""Queries of sources, sinks, infrastructure signals, brand data and streams, on data derived from the given tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import brand as B
from ..operators import signals as S
from ..sources import lists as L
from ..sources import sinks as K
from ..sources.scratch import scratch
from ..streaming import jobs as J
from .core import _HOST, _KIND, _P, _round, page_domains, pages, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# sources ----------------------------------------------------------------------------------


@query(f"WITH p AS {_P} SELECT host AS domain, min(page_id) + 1 AS rank, count(*) AS n FROM p WHERE page_id % 10 <> 9 GROUP BY 1")
def s1_ranked_lines(spark, sf_dir):
    """S1 on lines ``rank,domain`` of page hosts; every tenth line has no rank, some no domain."""
    p = pages(spark, sf_dir)
    value = F.concat(F.when(F.col("page_id") % 10 == 9, "x").otherwise((F.col("page_id") + 1).cast("string")), F.lit(","), F.upper("host"))
    lines = p.select(value.alias("value")).unionByName(p.select(F.lit("5,").alias("value")))
    return L.ranked_lines(lines).groupBy("domain").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))


@query("SELECT 'site' || s_suppkey || '.com' AS domain, s_suppkey AS rank, CAST(s_nationkey AS BIGINT) AS ref_subnets, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS ref_ips FROM supplier WHERE s_suppkey <> 0")
def s2_majestic(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    t = lambda c: c.cast("string")
    csv = s.select(t(F.col("s_suppkey")).alias("GlobalRank"), F.concat(F.lit("Site"), "s_suppkey", F.lit(".com")).alias("Domain"), t(F.col("s_nationkey")).alias("RefSubNets"), F.when(F.col("s_suppkey") % 2 == 0, t(F.col("s_suppkey") * 3)).otherwise("n/a").alias("RefIPs"))
    return L.majestic(csv)


@query("SELECT 'c' || c_custkey || '.org' AS domain, c_custkey AS rank, round(c_acctbal, 2) AS score, CAST(c_nationkey AS BIGINT) AS ref_domains FROM customer WHERE c_custkey <> 0")
def s3_open_page_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    csv = c.select(F.col("c_custkey").cast("string").alias("Rank"), F.concat(F.lit("c"), "c_custkey", F.lit(".org")).alias("Domain"), F.col("c_acctbal").cast("string").alias("open_page_rank"), F.col("c_nationkey").cast("string").alias("Referring Domains"))
    return _round(L.open_page_rank(csv), 2)


@query(f"WITH p AS {_P} SELECT domain, min(1000 * (1 + page_id % 7)) AS rank FROM p GROUP BY 1")
def s4_origin_buckets(spark, sf_dir):
    p = pages(spark, sf_dir).select(U.url_origin(F.col("url")).alias("origin"), (1000 * (1 + F.col("page_id") % 7)).cast("string").alias("rank"))
    return L.origin_buckets(p, U.suffix_table(spark))


@query(f"WITH p AS {_P} SELECT host AS domain, page_id AS rank, page_id * 2 AS pr_rank, CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id END AS n_hosts FROM p WHERE page_id % 5 <> 4")
def s5_web_graph(spark, sf_dir):
    """S5 on tab-separated lines of page hosts; some lack the host count, some have a bad rank, one is a comment."""
    p = pages(spark, sf_dir)
    i = F.col("page_id")
    value = F.concat_ws("\t", F.when(i % 5 == 4, "bad").otherwise(i.cast("string")), F.lit("0.5"), i * 2, F.lit("0.1"), U.reverse_domain(F.col("host")), F.when(i % 3 != 0, i))
    lines = p.select(value.alias("value")).unionByName(p.select(F.lit("#harmonicc_pos").alias("value")))
    return L.web_graph(lines)[0]


@query(f"WITH p AS {_P} SELECT domain, 'crawl-' || page_id % 3 AS crawl, url, '2024' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '01000000' AS timestamp, CASE WHEN page_id % 6 = 0 THEN '404' ELSE '200' END AS status, CASE WHEN page_id % 4 = 0 THEN 'image/png' ELSE 'text/html' END AS mime, md5(url) AS digest FROM p")
def s7_captures(spark, sf_dir):
    return captured(spark, sf_dir).select("domain", "crawl", "url", "timestamp", "status", "mime", "digest")


def captured(spark, sf_dir):
    """Capture index lines of the pages, with blank, foreign and cut lines among them."""
    p = page_domains(spark, sf_dir)
    i = F.col("page_id")
    row = F.struct(
        "url", F.concat(F.lit("2024"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("01000000")).alias("timestamp"), F.when(i % 6 == 0, "404").otherwise("200").alias("status"),
        F.when(i % 2 == 0, F.when(i % 4 == 0, "image/png").otherwise("text/html")).alias("mime-detected"), F.lit("text/html").alias("mime"), F.md5("url").alias("digest"),
    )
    crawl = F.concat(F.lit("crawl-"), i % 3)
    good = p.select("domain", crawl.alias("crawl"), F.to_json(row).alias("value"))
    bad = p.select("domain", crawl.alias("crawl"), F.explode(F.array(F.lit(""), F.lit("No captures"), F.lit('{"status":"200"}'), F.lit('{"url":"http://x'))).alias("value"))
    return L.captures(good.unionByName(bad))


@query(f"""WITH p AS (SELECT *, page_id % 3 AS c FROM {_P}), t AS (SELECT domain, 'crawl-' || c AS crawl, count(*) AS url_count, count(DISTINCT host || path) AS n_pages, count(DISTINCT md5(url)) AS n_digests, count(DISTINCT host) AS n_hosts,
  count(*) FILTER (WHERE page_id % 4 <> 0) AS html FROM p GROUP BY 1, 2) SELECT * FROM t""")
def a1_two_level_summary(spark, sf_dir):
    rows = S.capture_summary(captured(spark, sf_dir))
    return rows.select("domain", "crawl", "url_count", "n_pages", "n_digests", "n_hosts", F.element_at("top_mime", "text/html").alias("html"))


@query(f"""WITH p AS (SELECT *, page_id % 3 AS c FROM {_P}), t AS (SELECT domain, c, count(*) AS n, count(*) FILTER (WHERE page_id % 4 <> 0) AS h, count(*) FILTER (WHERE page_id % 6 <> 0) AS o FROM p GROUP BY 1, 2)
SELECT domain, CAST(sum(n) AS BIGINT) AS url_count, max(n) AS most_per_crawl, count(*) AS n_crawls, round(sum(h) / sum(n), 6) AS html_share, round(sum(o) / sum(n), 6) AS ok_share,
  CASE WHEN sum(h) > sum(n) - sum(h) AND sum(n) > sum(h) THEN 'text/html=' || sum(h)::BIGINT || ';image/png=' || (sum(n) - sum(h))::BIGINT WHEN sum(n) = sum(h) THEN 'text/html=' || sum(h)::BIGINT
       WHEN sum(h) = 0 THEN 'image/png=' || sum(n)::BIGINT ELSE 'image/png=' || (sum(n) - sum(h))::BIGINT || ';text/html=' || sum(h)::BIGINT END AS content_types, false AS limit_hit FROM t GROUP BY 1""")
def a2_capture_rollup(spark, sf_dir):
    return _round(S.capture_rollup(S.capture_summary(captured(spark, sf_dir)))).select(
        "domain", "url_count", "most_per_crawl", "n_crawls", "html_share", "ok_share", F.array_join(F.transform(F.map_entries("content_types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("content_types"), "limit_hit"
    )


def sitemaps(spark, sf_dir):
    """One sitemap body per host, of its page URLs; every third host a plain-text one."""
    p = page_domains(spark, sf_dir)
    item = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-0"), F.col("page_id") % 9 + 1, F.lit("-15T00:00Z</lastmod><xhtml:link rel='alternate' hreflang=\"fr\"/></url>"))
    rows = p.groupBy("domain", "host").agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("xml"), F.array_join(F.array_sort(F.collect_list("url")), "\n").alias("txt"))
    plain = F.length("host") % 3 == 0
    body = F.when(plain, F.col("txt")).otherwise(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "xml", F.lit("</urlset>")))
    return rows.select("domain", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), body.alias("body"))


@query(f"WITH p AS {_P} SELECT 'https://' || host || '/sitemap.xml' AS url, CASE WHEN length(host) % 3 = 0 THEN 'text' ELSE 'urls' END AS kind, url AS loc, CASE WHEN length(host) % 3 <> 0 THEN '2024-0' || (page_id % 9 + 1) || '-15T00:00Z' END AS lastmod, CASE WHEN length(host) % 3 <> 0 THEN 'fr' ELSE '' END AS langs FROM p")
def s8_sitemap_entries(spark, sf_dir):
    return L.sitemap_entries(sitemaps(spark, sf_dir)).select("url", "kind", "loc", "lastmod", F.array_join("langs", ",").alias("langs"))


@query(f"""WITH p AS (SELECT *, {_KIND} AS kind, length(host) % 3 = 0 AS plain FROM {_P}) SELECT host AS site, count(*) AS url_count, count(*) FILTER (WHERE kind = 'page') AS n_page, count(*) FILTER (WHERE NOT plain) AS lastmod_count,
  count(*) FILTER (WHERE NOT plain AND page_id % 9 + 1 >= 9) AS n_30d FROM p GROUP BY 1""")
def a3_sitemap_statistics(spark, sf_dir):
    rows = L.sitemap_entries(sitemaps(spark, sf_dir)).withColumn("site", U.url_host(F.col("url")))
    return S.sitemap_statistics(rows, F.lit(date(2024, 9, 20))).select("site", "url_count", "n_page", "lastmod_count", "n_30d")


@query("""SELECT l_suppkey, CASE WHEN n > 3 THEN CAST(floor(q + (q + 2 * n) / 3.0::DOUBLE * (n - 3)) AS BIGINT) ELSE q END AS estimated FROM (SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1)""")
def a4_extrapolated_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    return rows.select("l_suppkey", S.extrapolated_count(F.col("q"), F.col("q") + 2 * F.col("n"), F.lit(3), F.col("n"), F.lit(True)).cast("long").alias("estimated"))


@query("""WITH r AS (SELECT o_orderkey, 'shop' || o_custkey || '.com' AS domain, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE floor(o_totalprice) END AS visits FROM orders), f AS (SELECT *, first_value(visits) OVER (PARTITION BY domain ORDER BY o_orderkey) AS fv,
  first_value(o_orderkey) OVER (PARTITION BY domain ORDER BY o_orderkey) AS fo FROM r) SELECT domain, fo AS o_orderkey, fv AS visits, count(*) - 1 AS n_duplicates, count(*) FILTER (WHERE visits IS DISTINCT FROM fv) AS n_conflicts FROM f GROUP BY 1, 2, 3""")
def s9_reference_rows(spark, sf_dir):
    """S9 on rows with grouped digits, a website for every other domain, and missing values."""
    o = table(spark, sf_dir, "orders")
    site = F.concat(F.lit("shop"), "o_custkey", F.lit(".com"))
    csv = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, site).otherwise(" ").alias("domain"), F.concat(F.lit("https://www."), site, F.lit("/x")).alias("website"),
                   F.when(F.col("o_orderkey") % 8 == 0, "n/a").otherwise(F.format_number(F.floor("o_totalprice"), 0)).alias("visits"))
    return L.reference_rows(csv, "domain", "website", "visits", U.suffix_table(spark), "o_orderkey")


@query("SELECT 'p' || p_partkey || '.com' AS domain, p_retailprice AS actual_monthly_visits, 'other_legitimate' AS source, DATE '2024-01-01' AS measurement_date FROM part")
def s10_ground_truth(spark, sf_dir):
    """Measurements exported as JSON lines and read back."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".com")).alias("domain"), F.col("p_retailprice").alias("actual_monthly_visits"), F.lit(date(2024, 1, 1)).alias("measurement_date"))
    path = scratch(spark, "truth")
    K.export_ground_truth(p, path)
    return L.ground_truth(spark, path).select("domain", "actual_monthly_visits", "source", "measurement_date")


@query(f"SELECT DISTINCT 'https://www.' || {_HOST} || '/' AS url FROM pages UNION SELECT url FROM pages")
def s11_url_list(spark, sf_dir):
    p = pages(spark, sf_dir)
    text = F.concat(F.lit("see ("), "url", F.lit("), <www."), "host", F.lit("/>; mailto:x and https://nodot"))
    return L.url_list(p.select(text.alias("value")))


_CIDR = "SELECT 'f' || s_nationkey % 3 AS provider, (10 + s_suppkey % 90) || '.' || s_suppkey % 256 || '.0.0/16' AS cidr FROM supplier"


@query(_CIDR)
def s12_ip_feed(spark, sf_dir):
    """One feed per nation, of three forms."""
    s = table(spark, sf_dir, "supplier").withColumn("cidr", F.concat(F.col("s_suppkey") % 90 + 10, F.lit("."), F.col("s_suppkey") % 256, F.lit(".0.0/16"))).withColumn("form", F.col("s_nationkey") % 3)
    g = s.groupBy("s_nationkey", "form").agg(F.collect_list("cidr").alias("c"))
    body = F.when(F.col("form") == 0, F.array_join("c", "\n")).when(F.col("form") == 1, F.to_json(F.struct(F.transform("c", lambda x: F.struct(x.alias("ip_prefix"))).alias("prefixes")))).otherwise(F.to_json(F.struct(F.col("c").alias("addresses"))))
    return L.ip_feed(g.select(F.concat(F.lit("f"), "form").alias("provider"), body.alias("body")))


@query("""SELECT DISTINCT 'https://s' || s_suppkey || '.com' AS site, CASE s_suppkey % 3 WHEN 0 THEN 'https://s' || s_suppkey || '.com/k' || s_nationkey || '.html' WHEN 1 THEN 'https://s' || s_suppkey || '.com/products/k' || s_nationkey ELSE 'https://s' || s_suppkey || '.com/w/k' || s_nationkey END AS product_url FROM supplier""")
def s13_catalog_products(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    o, k = F.concat(F.lit("https://s"), "s_suppkey", F.lit(".com")), F.concat(F.lit("k"), "s_nationkey")
    kind = F.get(F.array(F.lit("magento"), F.lit("shopify"), F.lit("woocommerce")), (F.col("s_suppkey") % 3).cast("int"))
    body = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"data":{"products":{"items":[{"url_key":"'), k, F.lit('"}]}}}'))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('{"products":[{"handle":"'), k, F.lit('"}]}'))).otherwise(F.concat(F.lit('[{"permalink":"'), o, F.lit("/w/"), k, F.lit('"}]')))
    rows = s.select(kind.alias("platform"), o.alias("origin"), body.alias("body"))
    return L.catalog_products(rows.unionByName(rows.withColumn("body", F.lit("<html>"))))


# sinks ------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT 'a' AS provider, 'v' || p_size % 4 AS list_id, p_brand AS domain, min(p_partkey) AS rank FROM part WHERE p_size % 4 >= 2 GROUP BY 1, 2, 3) SELECT provider, list_id, count(*) AS row_count, list_id = 'v3' AS active FROM e GROUP BY 1, 2""")
def k1_list_versions(spark, sf_dir):
    """Four versions of a list loaded one after another; two are kept, the last is active."""
    p = table(spark, sf_dir, "part")
    path = scratch(spark, "lists")
    for i in range(4):
        entries = p.where(F.col("p_size") % 4 == i).select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("rank"))
        K.load_list_version(entries, {"provider": "a", "list_id": f"v{i}", "downloaded_at": datetime(2024, 1, 1 + i)}, path)
    return K.list_versions(spark, path).select("provider", "list_id", "row_count", "active")


@query("SELECT event_type AS source, count(*) AS n, count(DISTINCT user_id) AS n_domains FROM events GROUP BY 1")
def k2_observation_log(spark, sf_dir):
    """Observations appended in two runs and read back by source."""
    ev = table(spark, sf_dir, "events")
    rows = ev.select(F.col("user_id").cast("string").alias("domain"), F.col("event_type").alias("source"), F.lit("1").alias("source_version"), (F.col("event_id") % 2).cast("string").alias("run_id"), F.col("ts").alias("collected_at"), F.col("props").alias("payload"))
    path = scratch(spark, "observations")
    for run in ("0", "1"):
        K.append_observations(rows.where(F.col("run_id") == run), path)
    back = spark.read.parquet(path)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("n_domains"))


@query("SELECT event_type AS source, count(*) AS n, max(length(repeat('e', 600 + CAST(event_id % 900 AS INTEGER))[:1000])) AS longest_error FROM events GROUP BY 1")
def k3_collection_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    rows = ev.select(F.col("event_type").alias("source"), F.col("value").alias("duration_s"), F.col("ts").alias("finished_at"), F.repeat(F.lit("e"), (600 + F.col("event_id") % 900).cast("int")).alias("error"))
    path = scratch(spark, "log")
    K.append_collection_log(rows, path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("error")).cast("long").alias("longest_error"))


@query("SELECT v AS model_version, count(*) AS n FROM part, (VALUES ('heuristic_v1'), ('heuristic_v2')) t(v) GROUP BY 1")
def k4_estimates_written(spark, sf_dir):
    """K4, K5: both versions written, the second one again from the same observations; nothing doubles."""
    from .traffic import stored
    from ..operators import estimate as T

    (f, s), path = stored(spark, sf_dir), scratch(spark, "estimates")
    for v in ("heuristic_v1", "heuristic_v2", "heuristic_v2"):
        K.write_estimates(T.estimate(f, s, v), path)
    return spark.read.parquet(path).groupBy("model_version").agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS domain, DATE '2024-01-01' AS measurement_date, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS actual_monthly_visits, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS notes, DATE '2023-12-01' AS period_start FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), DATE '2024-01-01', p_retailprice * 2, 'new', DATE '2024-06-01' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0""")
def k6_ground_truth_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    day = lambda d: F.lit(d).cast("date")
    make = lambda rows, v, note, start: rows.select(F.col("p_partkey").cast("string").alias("domain"), F.lit("panel").alias("source"), day(date(2024, 1, 1)).alias("measurement_date"), v.alias("actual_monthly_visits"), F.lit(note).alias("notes"), day(start).alias("period_start"), day(start).alias("period_end"))
    stored = make(p.where("p_partkey % 3 <> 0"), F.col("p_retailprice"), "old", date(2023, 12, 1))
    new = make(p.where("p_partkey % 2 = 0"), F.col("p_retailprice") * 2, "new", date(2024, 6, 1))
    return K.upsert_ground_truth(stored, new, p.select(F.col("p_partkey").cast("string").alias("domain"))).drop("period_end", "source")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P'")
def k8_results_export(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    path = scratch(spark, "export")
    K.export_results(o, path)
    return spark.read.schema("id long, created_at timestamp").json(path)


@query("SELECT p_partkey, '{\"size\":' || p_size || '}' AS signals, 'brand=' || p_brand || ';type=' || p_type || ';' AS sources FROM part")
def k9_benchmark_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.create_map(F.lit("size"), F.col("p_size")).alias("signals"), F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand")).alias("sources"))
    return K.benchmark_rows(rows)


@query("""SELECT l_suppkey % 50 AS job_id, 'u' || l_partkey AS url, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, l_suppkey % 50 FROM lineitem WHERE l_linenumber <> 1) x WHERE (l_suppkey % 50, l_partkey) NOT IN (SELECT (l_suppkey % 50, l_partkey) FROM lineitem WHERE l_linenumber = 1) GROUP BY 1, 2 HAVING true""")
def k11_new_results(spark, sf_dir):
    """Later order lines as results, minus the (job, url) pairs that first lines have stored."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("job_id"), F.concat(F.lit("u"), "l_partkey").alias("url"), "l_linenumber", "l_suppkey")
    rows = li.withColumns({"links": F.array(F.lit("a")), "markdown": F.lit("m"), "html": F.lit("h"), "text": F.lit("t")})
    new = K.new_results(rows.where("l_linenumber <> 1"), rows.where("l_linenumber = 1"), ["markdown"])
    pairs = li.where("l_linenumber <> 1").select("job_id", "url", "l_suppkey").distinct().groupBy("job_id", "url").agg(F.count("*").alias("n"))
    return new.select("job_id", "url").join(pairs, ["job_id", "url"])


@query("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS job_id, event_type AS event FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY 1 LIMIT 500")
def k13_event_timeline(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("event"))
    path = scratch(spark, "timeline")
    K.append_events(ev, path)
    first = table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return K.read_events(spark, path, str(first))


# infrastructure ---------------------------------------------------------------------------


def tech_inputs(spark, sf_dir):
    """Pages with marks of technologies put in, by page number."""
    i = F.col("page_id")
    mark = F.when(i % 4 == 0, "/wp-content/ woocommerce add-to-cart").when(i % 4 == 1, "/_next/static/").when(i % 4 == 2, "cart/add").otherwise("")
    head = F.when(i % 3 == 0, F.create_map(F.lit("cf-ray"), F.lit("1"), F.lit("server"), F.lit("nginx"))).otherwise(F.create_map(F.lit("server"), F.lit("other")))
    return table(spark, sf_dir, "pages").select(i.cast("string").alias("domain"), F.concat("html", mark).alias("html"), head.alias("headers"), F.when(i % 5 == 0, F.array(F.lit("PHPSESSID"))).otherwise(F.array().cast("array<string>")).alias("cookies"))


_TECH = """(SELECT i, unnest(list_concat(list_concat(CASE i % 4 WHEN 0 THEN ['WordPress', 'WooCommerce', 'Wizzcommerce/Other cart'] WHEN 1 THEN ['Next.js'] WHEN 2 THEN ['Wizzcommerce/Other cart'] ELSE [] END, CASE WHEN i % 3 = 0 THEN ['Cloudflare', 'nginx'] ELSE [] END), CASE WHEN i % 5 = 0 THEN ['PHP'] ELSE [] END)) AS tech FROM (SELECT page_id AS i FROM pages))"""


@query(f"SELECT DISTINCT CAST(i AS VARCHAR) AS domain, tech FROM {_TECH}")
def j9_tech_detect(spark, sf_dir):
    return S.detect_technologies(tech_inputs(spark, sf_dir)).select("domain", "tech")


@query(f"""WITH t AS {_TECH}, a AS (SELECT * FROM t UNION SELECT i, unnest(CASE tech WHEN 'WordPress' THEN ['PHP'] WHEN 'WooCommerce' THEN ['WordPress', 'PHP'] WHEN 'Next.js' THEN ['React'] ELSE [] END) FROM t)
SELECT CAST(i AS VARCHAR) AS domain, CASE WHEN tech = 'Wizzcommerce/Other cart' THEN 'Generic shopping cart' ELSE tech END AS tech FROM a WHERE tech <> 'Wizzcommerce/Other cart' OR i % 4 <> 0""")
def j10_implied_and_demoted(spark, sf_dir):
    """J10 and J11 after J9."""
    return S.demote_generic_cart(S.add_implied(S.detect_technologies(tech_inputs(spark, sf_dir)))).select("domain", "tech")


@query(f"""WITH t AS {_TECH}, a AS (SELECT * FROM t UNION SELECT i, unnest(CASE tech WHEN 'WordPress' THEN ['PHP'] WHEN 'WooCommerce' THEN ['WordPress', 'PHP'] WHEN 'Next.js' THEN ['React'] ELSE [] END) FROM t),
  d AS (SELECT i, CASE WHEN tech = 'Wizzcommerce/Other cart' THEN 'Generic shopping cart' ELSE tech END AS tech FROM a WHERE tech <> 'Wizzcommerce/Other cart' OR i % 4 <> 0)
SELECT CAST(i AS VARCHAR) AS domain, coalesce(string_agg(tech, ',' ORDER BY tech) FILTER (WHERE tech = 'WordPress'), '') AS cms_names, coalesce(string_agg(tech, ',' ORDER BY tech) FILTER (WHERE tech = 'Cloudflare'), '') AS cdn_names,
  coalesce(string_agg(tech, ',' ORDER BY tech) FILTER (WHERE tech IN ('Next.js', 'React')), '') AS framework_names, min(tech) FILTER (WHERE tech = 'WordPress') AS cms,
  coalesce(min(tech) FILTER (WHERE tech = 'WooCommerce'), min(tech) FILTER (WHERE tech = 'Generic shopping cart')) AS ecommerce_platform, count(DISTINCT tech) AS n_technologies FROM d GROUP BY i""")
def a33_technology_summary(spark, sf_dir):
    t = S.demote_generic_cart(S.add_implied(S.detect_technologies(tech_inputs(spark, sf_dir))))
    rows = S.technology_summary(t, ["cms", "cdn", "framework"])
    return rows.withColumns({c: F.array_join(c, ",") for c in ("cms_names", "cdn_names", "framework_names")})


@query("""WITH r AS (SELECT *, row_number() OVER () AS o FROM (VALUES ('Cloudflare', 0, 65535), ('Hetzner', 0, 16777215), ('Fastly', 131072, 262143)) t(p, lo, hi)), i AS (SELECT DISTINCT l_suppkey, l_partkey, l_partkey * 97 % 400000 AS n FROM lineitem)
SELECT CAST(l_suppkey AS VARCHAR) AS domain, 5 || '.' || n // 65536 || '.' || (n // 256) % 256 || '.' || n % 256 AS ip, CASE WHEN n <= 65535 THEN 'Cloudflare' ELSE 'Hetzner' END AS provider, CASE WHEN n <= 65535 THEN 'cdn' ELSE 'hosting' END AS role FROM i""")
def j7_ip_ranges(spark, sf_dir):
    """Addresses made of part numbers against overlapping ranges; the first in feed order wins."""
    n = F.col("l_partkey") * 97 % 400_000
    ip = F.concat_ws(".", F.lit("5"), F.floor(n / 65536), F.floor(n / 256) % 256, n % 256)
    ips = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("domain"), ip.alias("ip"), "l_partkey")  # parts may share an address
    return S.ip_providers(ips, S.ranges_table(spark, [("Cloudflare", "5.0.0.0/16"), ("Hetzner", "5.0.0.0/8"), ("Fastly", "5.2.0.0/15")])).drop("l_partkey")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS domain, CASE WHEN c_nationkey % 2 = 0 THEN 'dns' ELSE 'parked' END AS role, CASE WHEN c_nationkey % 2 = 0 THEN 'Cloudflare' ELSE 'Sedo' END AS providers FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'email', CASE WHEN c_nationkey % 3 = 0 THEN 'Google' ELSE 'self-hosted/other' END FROM customer""")
def j8_record_providers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ns = F.when(F.col("c_nationkey") % 2 == 0, "ada.ns.cloudflare.com").otherwise("ns1.sedoparking.com")
    mx = F.when(F.col("c_nationkey") % 3 == 0, "aspmx.l.google.com").otherwise(F.concat(F.lit("mail.c"), "c_custkey", F.lit(".com")))
    row = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("name"))
    rec = c.select(F.col("c_custkey").cast("string").alias("domain"), F.explode(F.array(row("NS", ns), row("MX", mx))).alias("r")).select("domain", "r.*")
    patterns = [("NS", r"\.ns\.cloudflare\.com$", "Cloudflare", "dns"), ("NS", "sedoparking", "Sedo", "parked"), ("MX", r"google\.com$", "Google", "email")]
    return S.record_providers(rec, patterns).withColumn("providers", F.array_join("providers", ","))


@query(f"WITH p AS {_P} SELECT page_id, url, NOT (starts_with(path, '/en/') AND NOT starts_with(path, '/en/1')) AND NOT ends_with(path, '.html') AS allowed FROM p")
def j17_robots_screening(spark, sf_dir):
    """J17 on the page URLs against one robots body per host."""
    p = pages(spark, sf_dir)
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/ # most\nAllow: /en/1\nDisallow: /*.html\nCrawl-delay: 120\nSitemap: https://x.org/s.xml"
    rules, _ = S.robots_rules(p.select("host").distinct().withColumn("body", F.lit(body)), "loombot")
    return S.robots_allowed(p.select("page_id", "url"), rules).select("page_id", "url", "allowed")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS domain, '1995-01-01T00:00:00Z' AS registration_date, s_name AS registrar, CAST(s_nationkey AS VARCHAR) AS registrar_iana_id, 'ns1.x.com,ns2.x.com' AS nameservers, s_suppkey % 2 = 0 AS dnssec, date_diff('day', DATE '1995-01-01', DATE '2024-01-01') AS domain_age_days FROM supplier""")
def p24_registration(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    doc = F.concat(
        F.lit('{"events":[{"eventAction":"Registration","eventDate":"1995-01-01T00:00:00Z"}],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","'), "s_name",
        F.lit('"]]],"publicIds":[{"type":"IANA Registrar ID","identifier":"'), "s_nationkey", F.lit('"}]}],"status":["ok"],"nameservers":[{"ldhName":"NS2.x.com."},{"ldhName":"ns1.x.com"}],"secureDNS":{"delegationSigned":'),
        F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false"), F.lit("}}"),
    )
    rows = S.flatten_registration(s.select(F.col("s_suppkey").cast("string").alias("domain"), doc.alias("rdap")), F.lit(date(2024, 1, 1)))
    return rows.select("domain", "registration_date", "registrar", "registrar_iana_id", F.array_join("nameservers", ",").alias("nameservers"), "dnssec", F.col("domain_age_days").cast("long").alias("domain_age_days"))


@query("""SELECT 'c' || c_custkey || '.com' AS domain, c_nationkey % 4 <> 3 AS resolves, c_nationkey % 4 = 3 AS nxdomain, c_nationkey % 4 <> 3 AS has_spf, c_nationkey % 4 <> 3 AS has_mx, CASE WHEN c_nationkey % 4 <> 3 THEN 'google-site-verification' ELSE '' END AS tags FROM customer""")
def p25_dns_flags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    good = F.concat(F.lit('{"Status":0,"Answer":[{"type":1,"data":"1.2.3.'), F.col("c_nationkey"), F.lit('"},{"type":15,"data":"10 mx.x.com."},{"type":16,"data":"\\"v=spf1 -all\\""},{"type":16,"data":"\\"google-site-verification=abc\\""}]}'))
    d = F.concat(F.lit("c"), "c_custkey", F.lit(".com"))
    rows = c.select(d.alias("domain"), d.alias("qname"), F.when(F.col("c_nationkey") % 4 == 3, '{"Status":3}').otherwise(good).alias("dns"))
    return S.flatten_dns(rows).select("domain", "resolves", "nxdomain", "has_spf", "has_mx", F.array_join("verification_tags", ",").alias("tags"))


# brand ------------------------------------------------------------------------------------


def site_colours(spark, sf_dir):
    """Colours per part brand: hex of the part key, some as rgb(), weighted by size."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    hexed = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(k * 9973 % 16_777_216), 6, "0")))
    rgb = F.concat(F.lit("rgba("), k % 256, F.lit(", "), k * 7 % 256, F.lit(", "), k * 13 % 256, F.lit(", "), F.when(k % 2 == 0, "0.9").otherwise("0.2"), F.lit(")"))
    source = F.get(F.array(*[F.lit(x) for x in ("buttons", "logo", "header", "background", "links")]), (k % 5).cast("int"))
    return p.select(F.col("p_brand").alias("site"), source.alias("source"), F.when(k % 3 == 0, rgb).otherwise(hexed).alias("colour"), F.col("p_size").cast("double").alias("weight"), "p_partkey")


@query("""SELECT p_partkey, upper('#' || printf('%02x%02x%02x', r, g, b)) AS hex FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 256 ELSE (p_partkey * 9973 % 16777216) // 65536 END AS r,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7 % 256 ELSE (p_partkey * 9973 % 16777216) // 256 % 256 END AS g, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 13 % 256 ELSE (p_partkey * 9973 % 16777216) % 256 END AS b FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0)""")
def p31_colour_columns(spark, sf_dir):
    return B.colour_columns(site_colours(spark, sf_dir), "colour").select("p_partkey", "hex")


@query("""WITH s AS (SELECT p_brand AS site, ['buttons', 'logo', 'header', 'background', 'links'][1 + p_partkey % 5] AS source, p_size FROM part), w AS (SELECT site, source, p_size / sum(p_size) OVER (PARTITION BY site, source) AS w FROM s)
SELECT site, source, round(sum(w) * CASE source WHEN 'buttons' THEN 5 WHEN 'logo' THEN 4 WHEN 'header' THEN 2.5 WHEN 'background' THEN 2 WHEN 'links' THEN 2 END, 6) AS weight, count(*) AS n FROM w GROUP BY site, source""")
def a28_scaled_weights(spark, sf_dir):
    rows = B.scaled_weights(site_colours(spark, sf_dir))
    return rows.groupBy("site", "source").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))


@query()
def a29_colour_clusters(spark, sf_dir):
    c = B.colour_clusters(B.scaled_weights(B.colour_columns(site_colours(spark, sf_dir), "colour")))
    return c.select("site", "hex", F.round("weight", 6).alias("weight"), F.array_join("sources", "+").alias("sources"))


def brand_inputs(spark, sf_dir):
    """Colours per part brand from all sources of a page, with variables named after a brand or not."""
    k = F.col("p_partkey")
    kinds = ("buttons", "logo", "cssvar", "header", "links", "headings", "borders", "background", "footer", "theme", "screenshot", "text", "paragraphs", "body")
    source = F.get(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds)).cast("int"))
    name = F.get(F.array(*[F.lit(x) for x in ("--brand-1", "--gap", "--primary", "--accent", "--line")]), (k % 5).cast("int"))
    return site_colours(spark, sf_dir).withColumns({"source": source, "name": name, "position": k})


@query()
def a30_brand_roles(spark, sf_dir):
    rows = B.brand_colours(brand_inputs(spark, sf_dir))
    shown = F.transform("palette", lambda p: F.concat(p["hex"], F.lit("="), p["weight"], F.lit("="), F.array_join(p["sources"], "+")))
    return rows.withColumn("palette", F.array_join(shown, ","))


@query()
def w20_logo_ink(spark, sf_dir):
    rows = B.colour_columns(site_colours(spark, sf_dir).where("source = 'logo'"), "colour")
    share = F.col("weight") / F.sum("weight").over(B.Window.partitionBy("site"))
    return B.logo_ink(rows.withColumn("weight", share)).withColumn("colors", F.array_join("colors", ","))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Acme' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'ACME' || s_suppkey END AS site_name FROM supplier")
def p32_site_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    title = F.concat(F.lit("Best prices | "), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Acme"), k)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("ACME"), k)).otherwise("Acmé Shop"), F.lit(" | Home"))
    rows = s.select("s_suppkey", F.concat(F.lit("https://www.acme"), k, F.lit(".co.uk/")).alias("url"), title.alias("title"), F.array(F.lit("logo")).alias("texts"))
    return B.site_names(rows).select("s_suppkey", "site_name")


def page_icons(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    make = lambda rel, size, name: F.struct(F.lit(rel).alias("rel"), F.lit(size).alias("sizes"), F.lit(None).cast("string").alias("type"), F.concat(F.lit(f"/{name}-"), "page_id", F.lit(".png")).alias("url"))
    icons = F.when(F.col("page_id") % 3 == 0, F.array(make("icon", "16x16", "small"), make("icon", "48x48", "mid"), make("apple-touch-icon", None, "apple"))).when(F.col("page_id") % 3 == 1, F.array(make("apple-touch-icon", None, "apple"), make("mask-icon", None, "mask")))
    return p.select("page_id", F.explode(icons).alias("x")).select("page_id", "x.*")


@query(f"WITH p AS {_P} SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/mid-' || page_id || '.png' WHEN 1 THEN '/apple-' || page_id || '.png' ELSE lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) || '/favicon.ico' END AS icon, CASE WHEN page_id % 3 = 2 THEN 'default' ELSE 'link' END AS icon_source FROM p")
def w17_favicons(spark, sf_dir):
    return B.favicons(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url")), page_icons(spark, sf_dir)).select("page_id", "icon", "icon_source")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://cdn.x/logo-' || page_id || '-300x100.PNG' WHEN page_id % 4 = 1 THEN '/img/logo-' || page_id || '.png' ELSE CASE page_id % 3 WHEN 0 THEN '/apple-' || page_id || '.png' ELSE '/apple-' || page_id || '.png' END END AS url,
  CASE WHEN page_id % 4 = 0 THEN 'dom' WHEN page_id % 4 = 1 THEN 'json-ld' ELSE 'icon' END AS source, CASE WHEN page_id % 4 <= 1 THEN 'high' ELSE 'low' END AS confidence FROM pages WHERE page_id % 4 <= 1 OR page_id % 3 <> 2""")
def w21_logo_choice(spark, sf_dir):
    """A candidate for some pages, a declared logo for some, icons for the rest."""
    p = table(spark, sf_dir, "pages")
    cand = p.where("page_id % 4 <= 1").select("page_id", F.concat(F.lit("https://cdn.x/logo-"), "page_id", F.lit("-300x100.PNG")).alias("url"), F.when(F.col("page_id") % 4 == 0, 7).otherwise(4).alias("score"), F.lit(False).alias("strong"))
    declared = p.where("page_id % 4 <= 1").select("page_id", F.concat(F.lit("/img/logo-"), "page_id", F.lit(".png")).alias("url"))
    icons = page_icons(spark, sf_dir).where("rel <> 'mask-icon'")
    return B.choose_logo(cand, declared, icons)


# streams ----------------------------------------------------------------------------------


def page_stream(spark, sf_dir):
    """Events as page results in three parts, the last of which repeats the first."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("u"), F.col("event_id") % 40).alias("url"), J.utc_stamp("ts").alias("at"), "event_id", (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 50 + 1).alias("found")
    )
    path = scratch(spark, "stream")
    for i, part in enumerate((ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), ev.where("event_id % 2 = 0"))):
        part.write.mode("append").parquet(path)
    return J.read_stream(spark, path, files_per_trigger=64)


@query("SELECT job_id, url, count(*) AS n FROM (SELECT DISTINCT user_id AS job_id, 'u' || event_id % 40 AS url FROM events) GROUP BY 1, 2")
def t1_ingest_pages(spark, sf_dir):
    """The stream of page results, each (job, url) once."""
    sink = scratch(spark, "sink")
    J.ingest_pages(page_stream(spark, sf_dir), sink, scratch(spark, "ck"), ["job_id", "url"], "at").awaitTermination()
    return spark.read.parquet(sink).groupBy("job_id", "url").agg(F.count("*").alias("n"))


@query("SELECT user_id AS job_id, greatest(max(event_id % 50 + 1), count(*)) AS discovered, count(*) AS processed, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def t2_progress(spark, sf_dir):
    """T2 as a stream over the events in several batches; what stands after the last one."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), J.utc_stamp("ts").alias("at"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 50 + 1).alias("found"), "event_id")
    path, sink = scratch(spark, "progress"), scratch(spark, "sink")
    for odd in (1, 0):  # later events first
        ev.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(path)
    J.stream_progress(J.read_stream(spark, path, files_per_trigger=64), sink, scratch(spark, "ck"), "job_id", "at", "found", "success").awaitTermination()
    return J.latest_progress(spark, sink, "job_id").drop("last_at")


@query("""WITH r AS (SELECT user_id AS job_id, count(*) FILTER (WHERE event_type = 'purchase' AND user_id % 5 <> 0) AS s, count(*) FILTER (WHERE NOT (event_type = 'purchase' AND user_id % 5 <> 0)) AS f FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1), x AS (SELECT user_id AS job_id, count(*) AS x FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT job_id, coalesce(s, 0) AS succeeded, coalesce(f, 0) + coalesce(x, 0) AS failed, CASE WHEN coalesce(s, 0) > 0 THEN 'completed' ELSE 'failed' END AS status FROM r FULL JOIN x USING (job_id)""")
def t3_terminal_status(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("job_id", F.col("user_id"))
    results = ev.where("event_type in ('purchase', 'error')").withColumn("ok", (F.col("event_type") == "purchase") & (F.col("user_id") % 5 != 0))
    return J.terminal_status(results, ev.where("event_type = 'signup'"), "job_id", "ok")


@query("""WITH j AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'crawl' ELSE 'scrape' END AS kind, CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderkey % 4000 AS age, o_orderkey % 6 = 0 AS no_engine FROM orders)
SELECT o_orderkey, CASE WHEN status = 'queued' AND age > 15 THEN 'dispatch_again' WHEN kind = 'scrape' AND status = 'running' AND age > 30 + 60 THEN 'interrupted' WHEN kind = 'crawl' AND status = 'running' AND no_engine AND age > 120 THEN 'never_started'
  WHEN kind = 'crawl' AND status = 'running' AND age > 3600 THEN 'too_long' WHEN kind = 'crawl' AND status = 'running' AND age > 600 THEN 'engine_lost' END AS action FROM j WHERE action IS NOT NULL""")
def t4_overdue_jobs(spark, sf_dir):
    now = F.lit(datetime(2024, 1, 1, 12))
    at = now - F.make_dt_interval(secs=(F.col("o_orderkey") % 4000).cast("decimal(18,6)"))
    o = table(spark, sf_dir, "orders")
    jobs = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "crawl").otherwise("scrape").alias("kind"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"),
                    at.alias("created_at"), at.alias("started_at"), at.alias("updated_at"), F.lit(30).alias("timeout_s"), F.when(F.col("o_orderkey") % 6 != 0, "e").alias("engine_id"))
    return J.overdue_jobs(jobs, now).select("o_orderkey", "action")


_FAILED = "event_type IN ('error', 'view')"


@query(f"""WITH a AS (SELECT user_id, event_id, ts, {_FAILED} AS f, event_type = 'purchase' AS s FROM events WHERE {_FAILED} OR event_type = 'purchase'),
  r AS (SELECT *, sum(CAST(s AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
  k AS (SELECT *, sum(CAST(f AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r)
SELECT user_id, event_id, CAST(streak AS BIGINT) AS streak FROM k WHERE f AND streak % 3 = 0""")
def t5_failure_streaks(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return J.failure_alerts(ev, "user_id", ["ts", "event_id"], F.expr(_FAILED), F.col("event_type") == "purchase").select("user_id", "event_id", "streak")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_failed, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2")
def t6_hourly_attempts(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("at", J.utc_stamp("ts"))
    return _round(J.attempt_metrics(ev, "at", "event_type", "value", F.col("value") > 50))
