"""Queries over pages and documents: facts, links, grading, bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import pages as P
from .core import _DOMAIN, _HOST, _KIND, _P, _PATH, _round, page_domains, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def full_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("host", U.url_host(F.col("url"))).withColumn("path", U.url_path(F.col("url")))
    return U.registrable_domains(rows, "host", U.suffix_table(spark))


@query(r"""SELECT page_id, trim(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')) AS title, nullif(regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1), '') AS lang,
  len(regexp_extract_all(html, '<h1[ >]')) AS n_h1, len(regexp_extract_all(html, '<a [^>]*href="')) AS n_links, octet_length(encode(html)) AS html_bytes FROM pages""")
def p9_page_basics(spark, sf_dir):
    return P.basics(table(spark, sf_dir, "pages"))


@query()
def p9_page_facts(spark, sf_dir):
    """The full facts of each page, with length and digest of its whole visible text."""
    f = P.page_facts(table(spark, sf_dir, "pages"), extra=["page_id"])
    return f.select("page_id", "title", "lang", "n_h1", "n_images", "word_count", "html_bytes", F.size("links").alias("n_links"), F.array_join("schema_types", ",").alias("schema_types"), "inline_script_bytes", F.length("visible_text").alias("text_length"), F.sha2(F.col("visible_text").cast("binary"), 256).alias("text_sha256"))


_EDGE = f"""(WITH p AS {_P.replace('FROM pages', ', html FROM pages')}, l AS (SELECT page_id, url, domain, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM p),
  a AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || href AS dst FROM l WHERE starts_with(href, '/')),
  d AS (SELECT DISTINCT url AS src, domain, regexp_replace(dst, '#.*$', '') AS dst FROM a)
SELECT src, domain, dst, {_HOST.replace('url', 'dst')} AS dst_host FROM d)"""


@query(f"SELECT src, dst, dst_host, (dst_host = domain OR ends_with(dst_host, '.' || domain)) AS internal FROM {_EDGE}")
def j18_link_edges(spark, sf_dir):
    return P.link_edges(full_pages(spark, sf_dir), P.html_links(F.col("html")))


@query(f"""WITH c AS (SELECT {_HOST.replace('url', 'src')} AS host, lower(regexp_extract(dst, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS origin, count(*) AS n FROM {_EDGE} GROUP BY 1, 2)
SELECT host, origin, n FROM c QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, origin) = 1""")
def a31_dominant_origin(spark, sf_dir):
    edges = P.link_edges(full_pages(spark, sf_dir), P.html_links(F.col("html")))
    return P.dominant_origin(edges.withColumn("host", U.url_host(F.col("src"))), "host")


_GRADE = r"""(SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(bare, '\s+'), lambda w: regexp_matches(w, '(?i)[a-z]{2,}'))) AS words, lines, len(lines) AS n,
   len(list_filter(lines, lambda x: regexp_matches(x, '^[^0-9A-Za-z_]*\[[^\]]*\]\([^)]*\)[^0-9A-Za-z_]*$'))) AS ll FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'),
   '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#>*_`|\\-]+', ' ', 'g') AS bare, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS lines FROM documents))"""
_ISSUES = (
    "list_filter([CASE WHEN words < 50 THEN 'thin content (' || words || ' words)' WHEN words < 150 THEN 'low content (' || words || ' words)' END, "
    + ", ".join(f"CASE WHEN regexp_matches(lower(substr(text, 1, 3000)), '{p}') AND words < 400 THEN 'block/interstitial: {p}' END" for p in P.INTERSTITIAL)
    + ", "
    + ", ".join(f"CASE WHEN regexp_matches(lower(substr(text, 1, 3000)), '{p}') AND words < 200 THEN 'placeholder: {p}' END" for p in P.PLACEHOLDER)
    + ", CASE WHEN n > 10 AND ll / n > 0.6 THEN 'mostly links (' || ll || '/' || n || ' lines)' END, CASE WHEN n > 20 AND len(list_distinct(lines)) / n < 0.5 THEN 'heavy duplication' END], lambda x: x IS NOT NULL)"
)
_GRADED = f"(SELECT *, CASE WHEN words < 50 OR len(list_filter(issues, lambda i: starts_with(i, 'block'))) > 0 THEN 'BAD' WHEN len(issues) > 0 THEN 'CHECK' ELSE 'GOOD' END AS verdict FROM (SELECT *, {_ISSUES} AS issues FROM {_GRADE}))"
_SITE = f"CASE WHEN regexp_matches(substr(text, 1, 4000), '{P.PRIVATE_TEXT}') THEN 'private' WHEN regexp_matches(substr(text, 1, 4000), '{P.DEAD_TEXT}') THEN 'dead' WHEN regexp_matches(substr(text, 1, 4000), '{P.PARKED_TEXT}') THEN 'parked' WHEN doc_id % 7 = 3 AND words < 80 THEN 'blocked' WHEN doc_id % 7 = 4 AND words < 80 THEN 'dead' END"


def graded(spark, sf_dir):
    """Documents as page texts, with a status code by document number."""
    rows = P.grade(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    status = F.when(F.col("doc_id") % 7 == 3, 403).when(F.col("doc_id") % 7 == 4, 404).otherwise(200)
    issue = P.site_issue(F.concat(F.col("source"), F.lit(".example.org")), status, F.coalesce("text", F.lit("")), F.col("words"))
    return rows.withColumn("site_issue", F.when(F.col("verdict") != "GOOD", issue))


@query(f"SELECT doc_id, words, n AS lines, verdict, array_to_string(issues, '; ') AS issues FROM {_GRADED}")
def p13_content_grade(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "words", "lines", "verdict", F.array_join("issues", "; ").alias("issues"))


@query(f"SELECT doc_id, CASE WHEN verdict <> 'GOOD' THEN {_SITE} END AS site_issue FROM {_GRADED}")
def p14_site_issue(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "site_issue")


@query(f"""WITH g AS (SELECT verdict, CASE WHEN verdict <> 'GOOD' THEN {_SITE} END AS s FROM {_GRADED})
SELECT 'verdict' AS what, verdict AS label, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 'site_issue', coalesce(s, 'none'), count(*) FROM g WHERE verdict <> 'GOOD' GROUP BY 2""")
def a27_verdict_counts(spark, sf_dir):
    return P.verdict_counts(graded(spark, sf_dir))


@query(f"WITH p AS {_P.replace('FROM pages', ', html FROM pages')} SELECT page_id, (CASE WHEN (" + " + ".join(f"CAST(contains(lower(substr(html, 1, 80000)), '{m}') AS INTEGER)" for m in P.PARKED) + ") >= 2 THEN true ELSE false END) AS parked FROM p")
def p11_parked_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", P.parked(F.col("html"), F.size(P.visible_words(F.col("html"))), F.size(P.html_links(F.col("html")))).alias("parked"))


# written out again, so that a marker that is missing from either list shows
_BLOCK_MARKERS = (
    "just a moment|attention required|access denied|pardon our interruption|verify you are a human|are you a human|captcha|cf-challenge|challenge-platform|bot detection|"
    "request unsuccessful. incapsula|_incapsula_resource|perimeterx|px-captcha|ddos-guard|reference #18.|blocked by"
).split("|")


@query("WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'just a moment' ELSE '' END || lower(substr(html, 1, 60000)) AS h, [200, 403, 429, 503][1 + page_id % 4] AS s FROM pages) SELECT page_id, CASE WHEN page_id % 16 = 9 THEN 'cloudflare_challenge' "
       + " ".join(f"WHEN s <> 200 AND contains(h, '{m}') THEN 'http_' || s || ':{m}'" for m in _BLOCK_MARKERS) + " WHEN s IN (403, 429) THEN 'http_' || s END AS reason FROM p")
def p12_blocked_pages(spark, sf_dir):
    status = F.get(F.array(*[F.lit(x) for x in (200, 403, 429, 503)]), (F.col("page_id") % 4).cast("int"))
    mitigated = F.when(F.col("page_id") % 16 == 9, "challenge")
    html = F.concat(F.when(F.col("page_id") % 5 == 2, "Just a Moment").otherwise(""), "html")
    return table(spark, sf_dir, "pages").select("page_id", P.blocked_reason(status, mitigated, html).alias("reason"))


@query(r"""WITH p AS (SELECT page_id, url, html, [200, 403, 404, 204, 500][1 + page_id % 5] AS s, CASE WHEN page_id % 4 = 1 THEN 'The target host is NOT allowed. ' ELSE '' END || regexp_replace(html, '<[^>]*>', ' ', 'g') AS m,
    CASE WHEN page_id % 6 = 0 THEN ' Google ' ELSE regexp_extract(html, '<title>([^<]*)<', 1) END AS t FROM pages),
  o AS (SELECT *, s = 403 AND page_id % 4 = 1 AS denied, page_id % 6 = 0 AS bounce FROM p)
SELECT page_id, CASE WHEN denied THEN 'BLOCKED_URL' WHEN bounce THEN 'EXTRACTION_FAILED' WHEN s >= 400 THEN 'HTTP_ERROR' END AS error_code, NOT denied AND NOT bounce AND s < 400 AS success, t AS title, 1::BIGINT AS n_metadata,
  CASE WHEN NOT denied AND NOT bounce THEN length(m) END AS n_markdown FROM o""")
def p16_page_outcome(spark, sf_dir):
    """P16 on pages with statuses, denial texts and titles of search engines put in."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    status = F.get(F.array(*[F.lit(x) for x in (200, 403, 404, 204, 500)]), (i % 5).cast("int"))
    title = F.when(i % 6 == 0, " Google ").otherwise(F.regexp_extract("html", "<title>([^<]*)<", 1))
    text = F.concat(F.when(i % 4 == 1, "The target host is NOT allowed. ").otherwise(""), F.regexp_replace("html", "<[^>]*>", " "))
    docs = p.select("page_id", "url", status.alias("status_code"), F.array(title).alias("title"), text.alias("markdown"), "html", F.create_map(F.lit("viewport"), F.lit("x"), F.lit("lang"), F.lit("y")).alias("metadata"))
    return P.page_outcome(docs).select("page_id", "error_code", "success", "title", F.size("metadata").cast("long").alias("n_metadata"), F.length("markdown").cast("long").alias("n_markdown"))


@query("SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"long\":' || repeat('x', 0) || '\"' || repeat('ab', 500) || '\"}' AS metadata FROM events")
def p17_metadata_bound(spark, sf_dir):
    """P17 on event properties, with a value and a key that are too long."""
    props = F.from_json("props", "map<string,string>")
    more = F.create_map(F.lit("long"), F.repeat(F.lit("ab"), 700), F.repeat(F.lit("k"), 101), F.lit("gone"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(P.bound_metadata(F.map_concat(props, more))).alias("metadata"))


@query()
def p18_size_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.col("text").alias("html"), F.col("text").alias("text"), F.upper("text").alias("markdown"), F.split("text", " ").alias("links"), F.lit("data:").alias("logo"))
    out = P.fit_budget(rows, 6000)
    return out.select("doc_id", "truncated", "content_bytes", F.length("html").alias("n_html"), F.length("text").alias("n_text"), F.length("markdown").alias("n_markdown"), F.size("links").alias("n_links"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'shopify' WHEN page_id % 3 = 1 THEN 'woocommerce' END AS platform FROM pages")
def p22_store_platform(spark, sf_dir):
    """P22 on page markup with a platform's mark put in."""
    mark = F.when(F.col("page_id") % 3 == 0, "<script src='//cdn.shopify.com/a.js'>").when(F.col("page_id") % 3 == 1, "<body class='WooCommerce'>").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", P.store_platform(F.concat("html", mark)).alias("platform"))


@query(f"""WITH p AS {_P} SELECT page_id, '{{"Server":"' || repeat('s', 200) || '"}}' AS headers, page_id % 4 = 0 AS redirected_away FROM p""")
def p33_response_projection(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    final = F.when(F.col("page_id") % 4 == 0, F.lit("https://elsewhere.dev/")).otherwise(F.concat(U.url_origin(F.col("url")), F.lit("/moved")))
    rows = p.select("page_id", "url", final.alias("final_url"), F.create_map(F.lit("Server"), F.repeat(F.lit("s"), 300), F.lit("x-other"), F.lit("1")).alias("headers"))
    return P.response_projection(rows, U.suffix_table(spark)).select("page_id", F.to_json("headers").alias("headers"), "redirected_away")


@query("SELECT page_id, '{\"ga\":[\"G-' || upper(substr(md5(CAST(page_id AS VARCHAR)), 1, 8)) || '\"],\"gtm\":[\"GTM-AB' || page_id % 10 || 'D\"]}' AS ids FROM pages")
def p34_tag_ids(spark, sf_dir):
    """P34 on page markup with two ids put in, one of them twice."""
    i = F.col("page_id").cast("string")
    ga = F.concat(F.lit(" G-"), F.upper(F.substring(F.md5(i), 1, 8)), F.lit(" "))
    html = F.concat("html", ga, ga, F.lit(" GTM-AB"), F.col("page_id") % 10, F.lit("D"))
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(P.tag_ids(html)).alias("ids"))


@query(f"""WITH p AS {_P}, k AS (SELECT *, {_KIND} AS kind, regexp_extract(path, '^/(en|fr|de|es)/', 1) AS l FROM p)
SELECT domain, count(DISTINCT CASE WHEN l <> '' THEN l END) AS n_languages, count(DISTINCT CASE WHEN host NOT IN (domain, 'www.' || domain) THEN host END) AS n_subdomains,
  2 * count(*) FILTER (WHERE kind = 'product') AS n_product, 2 * count(*) FILTER (WHERE kind = 'article') AS n_article, 2 * count(*) FILTER (WHERE kind = 'category') AS n_category, 2 * count(*) FILTER (WHERE kind = 'page') AS n_page FROM k GROUP BY 1""")
def a5_site_structure(spark, sf_dir):
    rows = page_domains(spark, sf_dir)
    return P.site_structure(rows, rows.select("domain").distinct().withColumn("factor", F.lit(2.0)))


@query()
def a6_page_averages(spark, sf_dir):
    facts = P.page_facts(full_pages(spark, sf_dir), extra=["domain"])
    return P.page_averages(facts, "domain")
