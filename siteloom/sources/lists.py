"""Readers of landed files: ranked lists, captures, sitemaps, reference data, URL lists, feeds, catalogs.

Every list reader returns a part of one schema (see :func:`read_lists`); text stays
in Spark's own readers, but the files of list providers come by the ``ranked_list`` source (:mod:`list_files`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.relational import first_wins, union_entries
from .list_files import list_file

ENTRY = "domain string, rank long, score double, pr_rank long, n_hosts long, ref_domains long, ref_subnets long, ref_ips long"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain, gzip or zip files (first member of a zip that is no folder, read as a stream)."""
    return list_file(spark, "lines", path) if path.lower().endswith(".zip") else spark.read.text(path)


def _entries(df: DataFrame, domain: Column, rank: Column, **more: Column) -> DataFrame:
    out = df.select(U.list_domain(domain).alias("domain"), rank.try_cast("long").alias("rank"), *[v.alias(k) for k, v in more.items()])
    return out.where("domain is not null and rank is not null and rank <> 0")


def ranked_lines(lines: DataFrame) -> DataFrame:
    """Headerless ``rank,domain``, split at the first comma."""
    parts = F.split("value", ",", 2)
    return _entries(lines, F.get(parts, F.lit(1)), F.trim(F.get(parts, F.lit(0))))


def majestic(csv: DataFrame) -> DataFrame:
    """GlobalRank, Domain, RefSubNets, RefIPs."""
    return _entries(csv, F.col("Domain"), F.col("GlobalRank"), ref_subnets=F.col("RefSubNets").try_cast("long"), ref_ips=F.col("RefIPs").try_cast("long"))


def open_page_rank(csv: DataFrame) -> DataFrame:
    """S3: headers in any case and of either spelling; rank and domain must be there."""
    names = {c.strip().lower(): c for c in csv.columns}
    if "rank" not in names or "domain" not in names:
        raise ValueError(f"unexpected header: {csv.columns}")
    one = lambda *ks: next((F.col(f"`{names[k]}`") for k in ks if k in names), F.lit(None))
    return _entries(csv, one("domain"), one("rank"), score=one("open page rank", "open_page_rank").try_cast("double"), ref_domains=one("referring domains", "referring_domains").try_cast("long"))


def origin_buckets(csv: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(origin, rank bucket) to the best bucket per registrable domain."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim("origin")), "^.*?://", ""), "/.*$", "")
    rows = U.registrable_domains(csv.select(host.alias("host"), F.col("rank").try_cast("long").alias("rank")), "host", suffixes)
    return rows.where("domain is not null and rank is not null and rank <> 0").groupBy("domain").agg(F.min("rank").alias("rank"))


def web_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, rank, pr_rank, n_hosts) of tab-separated graph ranks, and the count of skipped lines."""
    p = F.split("value", "\t")
    num = lambda i: F.get(p, F.lit(i)).try_cast("long")
    rows = lines.where(~F.col("value").startswith("#")).select(U.reverse_domain(F.get(p, F.lit(4))).alias("domain"), num(0).alias("rank"), num(2).alias("pr_rank"), F.get(p, F.lit(5)).alias("_n"), num(5).alias("n_hosts"))
    rows = rows.withColumn("n_hosts", F.when(F.col("_n").isNull(), 0).otherwise(F.least("n_hosts", F.lit(2**32 - 1))))
    good = F.col("domain").isNotNull() & F.col("rank").isNotNull() & F.col("pr_rank").isNotNull() & F.col("n_hosts").isNotNull()
    return rows.where(good).drop("_n"), rows.agg(F.count_if(~good).alias("skipped"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tranco": lambda s, p: ranked_lines(list_file(s, "tranco", p)),
    "majestic": lambda s, p: majestic(list_file(s, "majestic", p)),
    "openpagerank": lambda s, p: open_page_rank(list_file(s, "openpagerank", p)),
    "crux_top": lambda s, p: origin_buckets(list_file(s, "crux_top", p), U.suffix_table(s)),
    "cc_webgraph": lambda s, p: web_graph(list_file(s, "cc_webgraph", p))[0],
}


def read_lists(spark: SparkSession, files: dict[str, tuple[str, str]]) -> DataFrame:
    """Entries of all providers {provider: (list_id, path)} in one schema; readers are registered in READERS."""
    empty = spark.createDataFrame([], "provider string, list_id string, " + ENTRY)
    frames = [READERS[p](spark, path).withColumn("provider", F.lit(p)).withColumn("list_id", F.lit(i)) for p, (i, path) in files.items()]
    return union_entries(empty, *frames)


def captures(lines: DataFrame, truncated: Column | None = None) -> DataFrame:
    """Capture index lines; blank, foreign, malformed and url-less ones go, a cut last line with them."""
    schema = "url string, timestamp string, status string, mime string, `mime-detected` string, digest string, _bad string"
    rows = lines.where(F.col("value").startswith("{")).withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("_r._bad is null and _r.url is not null")
    keep = [c for c in lines.columns if c != "value"]
    return rows.select(*keep, "_r.url", "_r.timestamp", "_r.status", F.coalesce("_r.`mime-detected`", "_r.mime", F.lit("?")).alias("mime"), "_r.digest")


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """(url, kind, loc, lastmod, langs) of sitemap indexes, URL sets and plain text; anything else gives no rows."""
    b = F.col("body")
    head = F.lower(F.substring(b, 1, 2000))
    kind = F.when(head.contains("<sitemapindex"), "index").when(head.contains("<urlset"), "urls").when(head.rlike(r"^\s*https?://"), "text")
    rows = bodies.withColumn("kind", kind).where("kind is not null")
    xml = rows.where("kind <> 'text'").withColumn("_e", F.explode(F.regexp_extract_all(b, F.lit(r"(?is)<(?:[a-z]+:)?(?:url|sitemap)>(.*?)</(?:[a-z]+:)?(?:url|sitemap)>"), F.lit(1))))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("_e", rf"(?is)<(?:[a-z]+:)?{t}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</", 1)), F.lit(""))
    xml = xml.select("url", "kind", F.replace(tag("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), tag("lastmod").alias("lastmod"), F.regexp_extract_all("_e", F.lit(r'(?i)hreflang="([^"]+)"'), F.lit(1)).alias("langs"))
    text = rows.where("kind = 'text'").select("url", "kind", F.explode(F.split(b, r"\s+")).alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.array().cast("array<string>").alias("langs"))
    return xml.unionByName(text.where(F.col("loc").rlike("^https?://"))).where("loc is not null")


def reference_rows(csv: DataFrame, domain: str, website: str, visits: str, suffixes: DataFrame, position: str, keep_zero: bool = True) -> DataFrame:
    """(domain, visits, ...) of a reference file, first row of a domain wins; grouped digits are read, non-finite and negative values are null."""
    raw = F.coalesce(F.nullif(F.trim(domain), F.lit("")), F.col(website))
    rows = U.normalize_domains(csv.withColumn("_raw", raw), "_raw", suffixes)
    v = F.translate(F.trim(visits), ",_", "").try_cast("double")
    good = ~F.isnan(v) & (F.abs(v) != float("inf")) & ((v >= 0) if keep_zero else (v > 0))
    return first_wins(rows.where("name is not null").select(F.col("name").alias("domain"), position, F.when(good, v).alias("visits")), "domain", position, "visits")


GROUND_TRUTH = "domain string, actual_monthly_visits double, source string, measurement_date date, period_start date, period_end date, notes string"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Measured visits, one JSON object per line."""
    return spark.read.schema(GROUND_TRUTH).json(path).withColumn("source", F.coalesce("source", F.lit("other_legitimate")))


def url_list(lines: DataFrame) -> DataFrame:
    """Distinct http(s) URLs of free text; wrapping punctuation goes, ``www.`` gets a scheme."""
    words = lines.select(F.explode(F.split("value", r"[\s,]+")).alias("w"))
    rows = words.select(F.regexp_replace("w", r"""^[<>"'()\[\]]+|[<>"'()\[\].;]+$""", "").alias("w"))
    url = F.when(F.col("w").rlike("(?i)^www\\."), F.concat(F.lit("https://"), F.col("w"))).otherwise(F.col("w"))
    return rows.select(url.alias("url")).where(F.col("url").rlike(r"(?i)^https?://[^/?#\s]*\.[^/?#\s]+")).distinct()


def ip_feed(bodies: DataFrame) -> DataFrame:
    """(provider, cidr) of text lists and of JSON feeds with prefixes or addresses."""
    schema = "prefixes array<struct<ip_prefix:string,ipv4Prefix:string,ipv6Prefix:string>>, ipv6_prefixes array<struct<ipv6_prefix:string>>, addresses array<string>, ipv6_addresses array<string>"
    j = bodies.withColumn("_j", F.from_json("body", schema))
    is_json = F.trim("body").startswith("{")
    none = F.array().cast("array<string>")
    found = F.concat(
        F.coalesce(F.transform("_j.prefixes", lambda p: F.coalesce(p["ip_prefix"], p["ipv4Prefix"], p["ipv6Prefix"])), none), F.coalesce(F.transform("_j.ipv6_prefixes", lambda p: p["ipv6_prefix"]), none),
        F.coalesce("_j.addresses", none), F.coalesce("_j.ipv6_addresses", none),
    )
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(x)), lambda x: x.contains("/"))
    return j.select("provider", F.explode(F.when(is_json, found).otherwise(lines)).alias("cidr")).where("cidr is not null")


def catalog_products(bodies: DataFrame) -> DataFrame:
    """(site, product_url) of store catalog pages (platform, origin, body); a bad body gives no rows."""
    m = F.from_json("body", "data struct<products:struct<items:array<struct<url_key:string,url_suffix:string>>>>")
    s = F.from_json("body", "products array<struct<handle:string>>")
    w = F.from_json("body", "array<struct<permalink:string>>")
    o = F.col("origin")
    url = (
        F.when(F.col("platform") == "magento", F.transform(m["data"]["products"]["items"], lambda i: F.concat(o, F.lit("/"), i["url_key"], F.coalesce(i["url_suffix"], F.lit(".html")))))
        .when(F.col("platform") == "shopify", F.transform(s["products"], lambda i: F.concat(o, F.lit("/products/"), i["handle"]))).when(F.col("platform") == "woocommerce", F.transform(w, lambda i: i["permalink"]))
    )
    return bodies.select(o.alias("site"), F.explode(url).alias("product_url")).where(F.col("product_url").rlike("^https?://")).distinct()


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """The landed page table."""
    return spark.read.parquet(path)
