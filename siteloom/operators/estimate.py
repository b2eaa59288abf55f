"""Traffic estimates from signals: features, status, curves, caps, confidence and ranges, for all domains at once.

Configurations are small dictionaries that become expressions on the row: a chain reads
the features once and meets the status, summed up per domain, in one join.  Time and
configuration enter as parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import BUCKETS, bucket

POPULARITY_SOURCES = ["tranco", "crux_top", "cc_webgraph", "majestic", "openpagerank"]
_GRAPH = [(0, 10.5), (3, 7.4), (4, 6.5), (5, 5.6), (6, 4.7), (7, 3.9), (8, 3.2), (8.2, 3.0)]
# Signal, normalised feature, weight, kind, curve of (log10 value, log10 visits).
SIGNALS_V2 = [
    ("tranco", "log_tranco_rank", 3.0, "popularity", [(0, 10.9), (1, 9.6), (2, 8.6), (3, 7.6), (4, 6.6), (5, 5.6), (6, 4.5), (6.66, 3.8)]),
    ("crux", "log_crux_bucket", 4.0, "popularity", [(3, 8.1), (3.7, 7.3), (4, 6.8), (4.7, 6.3), (5, 5.8), (5.7, 5.3), (6, 4.7)]),
    ("cc_webgraph", "log_ccg_harmonic_rank", 1.0, "popularity", _GRAPH),
    ("cc_webgraph_pagerank", "log_ccg_pagerank_rank", 1.0, "links", _GRAPH),
    ("majestic", "log_majestic_rank", 1.0, "popularity", [(0, 10.5), (3, 7.4), (4, 6.5), (5, 5.6), (6, 4.6)]),
    ("openpagerank", "log_opr_rank", 1.0, "popularity", [(0, 10.5), (3, 7.4), (4, 6.5), (5, 5.6), (6, 4.6), (7, 3.8)]),
    ("referring_domains", "log_opr_ref_domains", 1.5, "links", [(0, 2.5), (1, 3.3), (2, 4.0), (3, 4.8), (4, 5.6), (5, 6.5), (6, 7.5)]),
    ("commoncrawl_pages", "log_cc_url_count", 0.7, "size", [(0, 2.8), (1, 3.4), (2, 4.0), (3, 4.7), (4, 5.4), (5, 6.2)]),
    ("sitemap_pages", "log_sitemap_pages", 0.7, "size", [(0, 2.8), (1, 3.0), (2, 3.5), (3, 4.0), (4, 4.6), (5, 5.3), (6, 6.0)]),
]
V2 = {
    "signals": SIGNALS_V2, "no_popularity_cap": 4.3,
    "absence_caps": [{"source": "tranco", "size": "tranco_list_size", "signal": "tranco", "tolerance": 0.5, "unless_present": ["crux_top"]}],
    "caps": {"parked": 2.3, "unregistered": 1.5, "nxdomain": 2.0}, "shifts": {"unreachable": -0.4, "blocked": 0.0, "analytics": 0.05, "advertising": 0.1, "ecommerce": 0.0},
    "range": {"base": 0.5, "missing": 0.5, "disagreement": 0.8, "max": 1.5},
    "confidence": {"coverage": 0.55, "agreement": 0.35, "bonus": 0.10, "scale": 1.0, "high": 0.70, "medium": 0.40},
    "source_weights": {"tranco": 2.0, "crux_top": 2.0, "cc_webgraph": 1.5, "majestic": 1.0, "openpagerank": 1.0, "commoncrawl": 1.0, "crawl": 1.5, "dns": 0.5},
}
V1 = V2 | {
    "signals": [(n, f, 2.0 if n == "cc_webgraph" else w, k, c) for n, f, w, k, c in SIGNALS_V2 if n != "cc_webgraph_pagerank"],
    "absence_caps": [], "range": V2["range"] | {"base": 0.3, "max": 1.3},
}
CONFIGS = {"heuristic_v1": V1, "heuristic_v2": V2}

# Normalised name, how, inputs.  A missing input stays null, never zero.
LOG10 = {"log_tranco_rank": "tranco_rank", "log_majestic_rank": "majestic_rank", "log_opr_rank": "opr_rank", "log_crux_bucket": "crux_rank_bucket",
         "log_ccg_harmonic_rank": "ccg_harmonic_rank", "log_ccg_pagerank_rank": "ccg_pagerank_rank"}
LOG1P = {"log_majestic_ref_subnets": "majestic_ref_subnets", "log_majestic_ref_ips": "majestic_ref_ips", "log_opr_ref_domains": "opr_ref_domains", "log_ccg_n_hosts": "ccg_n_hosts",
         "log_cc_url_count": "commoncrawl_url_count", "log_cc_unique_paths": "commoncrawl_unique_paths", "log_cc_subdomains": "commoncrawl_unique_subdomains",
         "log_dns_a_count": "dns_a_count", "log_dns_verification_tags": "dns_verification_tag_count", "log_domain_age_days": "domain_age_days"}
CRAWL_LOG1P = {"log_product_count": "product_count", "log_article_count": "article_count", "log_category_count": "category_count", "log_language_count": "language_count",
               "log_subdomain_count": "subdomain_count", "log_avg_word_count": "avg_word_count", "log_homepage_word_count": "homepage_word_count",
               "log_homepage_internal_links": "homepage_internal_links", "log_homepage_external_links": "homepage_external_links", "log_technology_count": "technology_count",
               "log_marketing_tags": "marketing_tag_count"}
FLAGS = ["crawl_reachable", "crawl_blocked", "crawl_parked", "dns_resolves", "dns_nxdomain", "dns_has_mx", "dns_has_spf", "dns_parked"]
CRAWL_FLAGS = {"sitemap_found": "sitemap_found", "analytics_detected": "analytics_detected", "advertising_detected": "advertising_tags_detected", "has_search": "has_search",
               "jsonld_present": "jsonld_present", "og_present": "og_present"}
SHARES = {"cc_crawl_share": ("commoncrawl_crawl_count", "commoncrawl_crawls_queried")}
TYPES = {
    "crawl_reachable": "boolean", "crawl_blocked": "boolean", "crawl_parked": "boolean", "dns_resolves": "boolean", "dns_nxdomain": "boolean", "dns_has_mx": "boolean", "dns_has_spf": "boolean",
    "dns_parked": "boolean", "sitemap_found": "boolean", "analytics_detected": "boolean", "advertising_tags_detected": "boolean", "has_search": "boolean", "jsonld_present": "boolean",
    "og_present": "boolean", "ecommerce_platform": "string", "cms": "string", "rdap_status": "string", "schema_product": "boolean", "schema_article": "boolean", "has_rss": "boolean",
}


def extract_features(latest: DataFrame, fields: dict[str, tuple[str, str]], types: dict[str, str] | None = None) -> DataFrame:
    """One typed column per feature out of the latest JSON payload per (domain, source).

    ``fields`` maps a feature to (source, JSON path); payloads are picked with one
    aggregation, so there is one exchange by domain.  What a payload lacks is null.
    """
    types = types or TYPES
    sources = sorted({s for s, _ in fields.values()})
    # dealt first: payloads picked where they are read would be sorted by domain there, however few tasks read them
    wide = latest.repartition("domain").groupBy("domain").agg(*[F.max(F.when(F.col("source") == s, F.col("payload"))).alias(f"_{s}") for s in sources])
    cols = [F.get_json_object(F.col(f"_{s}"), path).try_cast(types.get(name, "double")).alias(name) for name, (s, path) in fields.items()]
    return wide.select("domain", *cols)


_LIST = "status string, rank double, list_date string, list_size double, ref_subnets double, ref_ips double, score double, ref_domains double, pr_rank double, n_hosts double"
_STRINGS = "array<string>"
#: What is read of each source's payload.
PAYLOADS = {s: _LIST for s in POPULARITY_SOURCES} | {
    "commoncrawl": "url_count double, unique_paths_max_crawl double, unique_subdomains_max_crawl double, crawl_count double, crawls_queried double, first_seen string, last_seen string, html_share double, limit_hit boolean",
    "crawl": (
        "reachable boolean, blocked boolean, requests double, homepage struct<status: double, redirected_to_other_domain: boolean, page: struct<schema_types: array<string>>>, "
        "signals struct<parked: boolean, homepage_word_count: double, homepage_internal_links: double, homepage_external_links: double, has_rss: boolean, has_search: boolean, og_present: boolean, jsonld_present: boolean, title: string, html_lang: string>, "
        "sitemaps struct<fetched: array<string>, url_count: double, url_count_estimated: double, kinds: map<string,double>, lastmod_buckets: map<string,double>, lastmod_max: string, truncated: boolean>, "
        "structure struct<page_count_from_sitemap: double, product_count: double, article_count: double, category_count: double, language_count: double, subdomain_count: double>, "
        "pages struct<fetched: double, ok: double, avg_word_count: double, avg_internal_links: double, schema_types: map<string,double>>, "
        f"tech struct<technologies: array<struct<name: string>>, cms: string, ecommerce_platform: string, frameworks: {_STRINGS}, cdn: {_STRINGS}, hosting: {_STRINGS}, analytics: {_STRINGS}, advertising: {_STRINGS}, marketing: {_STRINGS}, payments: {_STRINGS}>"
    ),
    "dns": (
        f"resolves boolean, nxdomain boolean, has_mx boolean, has_spf boolean, records map<string,{_STRINGS}>, infra struct<cdn: {_STRINGS}, hosting: {_STRINGS}, dns_provider: {_STRINGS}, email_provider: {_STRINGS}, parked_provider: string>, "
        f"verification_tags {_STRINGS}, rdap struct<status: string, registration_date: string, domain_age_days: double, expiration_date: string, registrar: string>"
    ),
}
PRODUCT_TYPES = ["Product", "ProductGroup", "Offer", "AggregateOffer"]
ARTICLE_TYPES = ["Article", "NewsArticle", "BlogPosting", "TechArticle"]
ORGANISATION_TYPES = ["Organization", "Corporation", "LocalBusiness", "Store"]


def feature_vector(latest: DataFrame) -> DataFrame:
    """The 92 typed features of each domain out of its latest JSON payloads ``latest(domain, source, payload)``.

    Each payload is parsed once, with the schema of its source.  Numbers are null where they were not observed; flags
    that a payload lacks are false, but null without the payload; a crawl's site features are null unless it was reachable.
    """
    # a payload of any JSON kind but an object counts as an empty one
    picked = [F.max(F.when(F.col("source") == s, F.coalesce("payload", F.lit("{}")))).alias(s) for s in PAYLOADS]
    wide = latest.repartition("domain").groupBy("domain").agg(*picked)  # dealt first, as in extract_features
    wide = wide.select("domain", *[F.when(F.col(s).isNotNull(), F.coalesce(F.from_json(s, t), F.from_json(F.lit("{}"), t))).alias(s) for s, t in PAYLOADS.items()])
    c = F.col
    whole = lambda path: c(path).cast("long")
    false = lambda x: F.coalesce(x, F.lit(False))
    have = lambda source, x: F.when(c(source).isNotNull(), x)
    listed = lambda source, field: F.when((c(f"{source}.status") == "present") & c(f"{source}.rank").isNotNull(), c(f"{source}.{field}"))
    up = lambda x: F.when(c("crawl.reachable"), x)
    strings = lambda path: F.coalesce(c(path), F.array().cast(_STRINGS))
    counted = lambda path, key: F.coalesce(c(path)[key], F.lit(0.0)).cast("long")
    types = F.array_union(F.coalesce(F.map_keys("crawl.pages.schema_types"), F.array().cast(_STRINGS)), strings("crawl.homepage.page.schema_types"))
    any_of = lambda names: F.arrays_overlap(types, F.array(*[F.lit(x) for x in names]))
    names = F.transform(F.filter(F.coalesce("crawl.tech.technologies", F.array()), lambda t: t.isNotNull()), lambda t: t["name"])
    out = {
        "tranco_rank": listed("tranco", "rank").cast("long"), "tranco_list_date": c("tranco.list_date"), "tranco_list_size": whole("tranco.list_size"), "majestic_rank": listed("majestic", "rank").cast("long"),
        "majestic_ref_subnets": listed("majestic", "ref_subnets").cast("long"), "majestic_ref_ips": listed("majestic", "ref_ips").cast("long"), "opr_rank": listed("openpagerank", "rank").cast("long"),
        "opr_score": listed("openpagerank", "score"), "opr_ref_domains": listed("openpagerank", "ref_domains").cast("long"), "crux_rank_bucket": listed("crux_top", "rank").cast("long"),
        "ccg_harmonic_rank": listed("cc_webgraph", "rank").cast("long"), "ccg_pagerank_rank": listed("cc_webgraph", "pr_rank").cast("long"), "ccg_n_hosts": listed("cc_webgraph", "n_hosts").cast("long"),
    }
    for name, field in {"url_count": "url_count", "unique_paths": "unique_paths_max_crawl", "unique_subdomains": "unique_subdomains_max_crawl", "crawl_count": "crawl_count", "crawls_queried": "crawls_queried"}.items():
        out[f"commoncrawl_{name}"] = whole(f"commoncrawl.{field}")
    out |= {f"commoncrawl_{k}": c(f"commoncrawl.{k}") for k in ("first_seen", "last_seen", "html_share")} | {"commoncrawl_limit_hit": have("commoncrawl", false(c("commoncrawl.limit_hit")))}
    out |= {f"crawl_{k}": have("crawl", false(c(f"crawl.{k}"))) for k in ("reachable", "blocked")}
    out |= {
        "crawl_parked": have("crawl", false(c("crawl.signals.parked"))), "crawl_redirected_elsewhere": have("crawl", false(c("crawl.homepage.redirected_to_other_domain"))),
        "crawl_homepage_status": whole("crawl.homepage.status"), "crawl_requests": whole("crawl.requests"), "sitemap_found": up(F.size(strings("crawl.sitemaps.fetched")) > 0),
        "sitemap_url_count": up(whole("crawl.sitemaps.url_count")), "sitemap_page_count": up(whole("crawl.sitemaps.url_count_estimated")),
    }
    out |= {f"sitemap_{k}_count": up(counted("crawl.sitemaps.kinds", k)) for k in ("product", "article", "category")} | {f"sitemap_lastmod_{k}": up(counted("crawl.sitemaps.lastmod_buckets", k)) for k in ("30d", "90d", "365d", "older")}
    out |= {"sitemap_lastmod_max": up(c("crawl.sitemaps.lastmod_max")), "sitemap_truncated": up(false(c("crawl.sitemaps.truncated")))}
    out |= {k: up(whole(f"crawl.structure.{k}")) for k in ("page_count_from_sitemap", "product_count", "article_count", "category_count", "language_count", "subdomain_count")}
    out |= {k: up(whole(f"crawl.pages.{f}")) for k, f in {"pages_fetched": "fetched", "pages_ok": "ok", "avg_word_count": "avg_word_count", "avg_internal_links": "avg_internal_links"}.items()}
    out |= {f"homepage_{k}": up(whole(f"crawl.signals.homepage_{k}")) for k in ("word_count", "internal_links", "external_links")} | {k: up(false(c(f"crawl.signals.{k}"))) for k in ("has_rss", "has_search", "og_present", "jsonld_present")}
    out |= {"schema_product": up(any_of(PRODUCT_TYPES)), "schema_article": up(any_of(ARTICLE_TYPES)), "schema_organization": up(any_of(ORGANISATION_TYPES)), "title": up(c("crawl.signals.title")), "html_lang": up(c("crawl.signals.html_lang"))}
    seen = lambda path: F.coalesce(up(strings(path)), F.array().cast(_STRINGS))
    out |= {"technology_count": up(F.size(names).cast("long")), "technologies": F.coalesce(up(names), F.array().cast(_STRINGS)), "cms": up(c("crawl.tech.cms")), "ecommerce_platform": up(c("crawl.tech.ecommerce_platform"))}
    out |= {k: seen(f"crawl.tech.{f}") for k, f in {"frameworks": "frameworks", "cdn": "cdn", "hosting": "hosting", "analytics_tags": "analytics", "advertising_tags": "advertising", "payment_providers": "payments"}.items()}
    out |= {"analytics_detected": up(F.size(strings("crawl.tech.analytics")) > 0), "advertising_tags_detected": up(F.size(strings("crawl.tech.advertising")) > 0), "marketing_tag_count": up(F.size(strings("crawl.tech.marketing")).cast("long"))}
    out |= {f"dns_{k}": have("dns", false(c(f"dns.{k}"))) for k in ("resolves", "nxdomain", "has_mx", "has_spf")} | {f"dns_{k.lower()}_count": have("dns", F.size(F.coalesce(c("dns.records")[k], F.array().cast(_STRINGS))).cast("long")) for k in ("A", "NS")}
    out |= {name: strings(f"dns.infra.{f}") for name, f in {"dns_cdn": "cdn", "dns_hosting": "hosting", "dns_provider": "dns_provider", "dns_email_provider": "email_provider"}.items()}
    ok = lambda field: F.when(c("dns.rdap.status") == "ok", c(f"dns.rdap.{field}"))
    out |= {
        "dns_parked": have("dns", false(c("dns.infra.parked_provider") != "")), "dns_verification_tag_count": have("dns", F.size(strings("dns.verification_tags")).cast("long")), "domain_creation_date": ok("registration_date"),
        "domain_age_days": ok("domain_age_days").cast("long"), "domain_expiration_date": ok("expiration_date"), "registrar": ok("registrar"), "rdap_status": c("dns.rdap.status"),
    }
    return wide.select("domain", *[v.alias(k) for k, v in out.items()])


def source_status(domains: DataFrame, observed: DataFrame, sources: list[str]) -> DataFrame:
    """(domain, source, status): what the latest observation says, else ``missing``.

    ``observed(domain, source, found, blocked, reachable)``; a found payload is
    present, one without a find absent; the crawl may be blocked or unreachable.
    Both sides are dealt by domain before anything is gathered, so that a task holds its share of the domains
    however few files they come from, and sources are listed on the row.
    """
    seen = observed.repartition("domain").groupBy("domain").agg(F.collect_list(F.struct("source", "found", "blocked", "reachable")).alias("_seen"))
    grid = domains.select("domain").join(seen.hint("merge"), "domain", "left").withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    own = F.filter(F.coalesce("_seen", F.array()), lambda x: x["source"] == F.col("source"))
    rows = grid.select("domain", "source", F.explode_outer(own).alias("_x")).select("domain", "source", "_x.found", "_x.blocked", "_x.reachable")
    crawl = F.col("source") == "crawl"
    status = F.when(F.col("found").isNull(), "missing").when(crawl & F.col("blocked"), "blocked").when(crawl & ~F.col("reachable"), "unreachable").when(F.col("found"), "present").otherwise("absent")
    return rows.select("domain", "source", status.alias("status"))


def _log10(c: Column) -> Column:
    return F.round(F.log10(F.when(c > 0, c)), 4)


def _log1p(c: Column) -> Column:
    return F.round(F.log10(F.when(c >= 0, c + 1)), 4)


def normalized_columns(features: DataFrame) -> dict[str, Column]:
    """Doubles by name; log10, log10(1 + v), flags 0 / 1, shares; crawl-derived ones null unless reachable."""
    have = set(features.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast(TYPES.get(n, "double"))
    up = F.coalesce(c("crawl_reachable"), F.lit(False))
    flag = lambda x: x.cast("int").cast("double")
    crawl = lambda x: F.when(up, x)
    out = {k: _log10(c(v)) for k, v in LOG10.items()} | {k: _log1p(c(v)) for k, v in LOG1P.items()} | {k: crawl(_log1p(c(v))) for k, v in CRAWL_LOG1P.items()}
    out |= {k: flag(c(k)) for k in FLAGS} | {k: crawl(flag(c(v))) for k, v in CRAWL_FLAGS.items()} | {k: F.round(F.try_divide(c(a), F.nullif(c(b), F.lit(0))), 4) for k, (a, b) in SHARES.items()}
    false = lambda x: F.coalesce(x, F.lit(False))
    out["log_sitemap_pages"] = F.when(up & false(c("sitemap_found")), _log1p(c("sitemap_page_count")))
    out["has_cms"] = crawl(flag(false(c("cms") != "")))
    out["is_ecommerce"] = crawl(flag(false(c("ecommerce_platform") != "") | false(c("schema_product"))))
    out["is_publisher"] = crawl(flag(false(c("schema_article")) | false(c("has_rss"))))
    return out


def normalize(features: DataFrame) -> DataFrame:
    """P28 as a table: domain and the normalised features."""
    return features.select("domain", *[v.alias(k) for k, v in normalized_columns(features).items()])


def curve_sql(x: str, points: list[tuple[float, float]]) -> str:
    """SQL of the curve through ``points`` at the expression ``x``: straight between two of them, flat beyond both ends, null at null."""
    n = lambda v: f"{float(v)!r}D"
    parts = [f"WHEN {x} < {n(b[0])} THEN {n(a[1])} + {n(b[1] - a[1])} * ({x} - {n(a[0])}) / {n(b[0] - a[0])}" for a, b in zip(points, points[1:])]  # noqa: B905
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {n(points[0][0])} THEN {n(points[0][1])} {' '.join(parts)} ELSE {n(points[-1][1])} END"


def signal_list(columns: dict[str, str], config: dict) -> Column:
    """J12 on the row: the structs (signal, kind, weight, log10_estimate) of the signals that it has, by their curves.
    ``columns`` names the column of each normalised feature."""
    out = []
    for name, feature, weight, kind, points in config["signals"]:
        if feature in columns:
            value = f"round({curve_sql(f'`{columns[feature]}`', points)} + 1e-9D, 3)"
            out.append(f"CASE WHEN `{columns[feature]}` IS NOT NULL THEN named_struct('signal', '{name}', 'kind', '{kind}', 'weight', {float(weight)!r}D, 'log10_estimate', {value}) END")
    return F.expr(f"array_compact(array({', '.join(out)}))" if out else "CAST(array() AS array<struct<signal:string,kind:string,weight:double,log10_estimate:double>>)")


def signal_estimates(normalized: DataFrame, config: dict) -> DataFrame:
    """(domain, signal, kind, weight, log10_estimate) of the signals a domain has."""
    return normalized.select("domain", F.inline(signal_list({c: c for c in normalized.columns}, config)))


def combine_signals(signals: DataFrame, scale: float = 1.0) -> DataFrame:
    """A10 and A8 of the long form: what ``with_combined`` gives, per domain with a signal."""
    rows = signals.groupBy("domain").agg(F.collect_list(F.struct("signal", "kind", "weight", "log10_estimate")).alias("_list"))
    return with_combined(rows, "_list", scale).drop("_list")


def with_combined(rows: DataFrame, listed: str, scale: float = 1.0) -> DataFrame:
    """A10 and A8 on the row: the weighted mean of the list of signals, and agreement with its deviation over the popularity
    signals, else all.  Adds mean, n_popularity, n_signals, signals, agreement and stddev; without a signal all but the counts are null."""
    added = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda a, r: a + f(r))
    v = lambda r: r["log10_estimate"]
    popular = F.filter(listed, lambda r: r["kind"] == "popularity")
    rows = rows.withColumn("n_signals", F.size(listed).cast("long")).withColumn("n_popularity", F.size(popular).cast("long"))
    rows = rows.withColumn("_judged", F.when(F.col("n_popularity") > 0, popular).otherwise(F.col(listed))).withColumn("_n", F.size("_judged"))
    rows = rows.withColumn("_m", F.try_divide(added(F.col("_judged"), v), F.col("_n")))
    rows = rows.withColumn("_sd", F.sqrt(F.try_divide(added(F.col("_judged"), lambda r: (v(r) - F.col("_m")) * (v(r) - F.col("_m"))), F.col("_n"))))
    pairs = F.array_sort(F.transform(listed, lambda r: F.struct(r["signal"].alias("signal"), v(r).alias("log10_estimate"))))
    some = F.col("n_signals") > 0
    rows = rows.withColumn("mean", F.try_divide(added(F.col(listed), lambda r: r["weight"] * v(r)), added(F.col(listed), lambda r: r["weight"])))
    rows = rows.withColumn("signals", F.when(some, F.map_from_entries(pairs)))
    agree = F.when(F.col("_n") < 2, 0.6).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("_sd") / scale)), 4))
    return rows.withColumn("agreement", F.when(some, agree)).withColumn("stddev", F.when(F.col("_n") >= 2, F.round(F.col("_sd") + 1e-9, 4))).drop("_judged", "_n", "_m", "_sd")


def _evidence(status: DataFrame, weights: dict[str, float], caps: list[dict]) -> DataFrame:
    """One row per domain of ``status``: A7, and ``may_cap_i`` where the i-th absence cap applies."""
    s, is_ = F.col("source"), lambda x: F.col("status") == x
    credit = F.when(is_("present"), 1.0).when(is_("absent"), 0.8).when(is_("unreachable"), 0.5).when(is_("blocked"), 0.3).otherwise(0.0)
    w = F.lit(None).cast("double")
    for name, weight in weights.items():
        w = F.when(s == name, float(weight)).otherwise(w)
    live = F.when(~is_("disabled"), w)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = [(any_((s == c["source"]) & is_("absent")) & ~any_(s.isin(c["unless_present"]) & is_("present"))).alias(f"may_cap_{i}") for i, c in enumerate(caps)]
    return status.groupBy("domain").agg(
        F.round(F.try_divide(F.sum(live * credit), F.sum(live)), 4).alias("coverage"), F.count_if(live.isNotNull() & is_("present") & s.isin(POPULARITY_SOURCES)).alias("n_present"),
        any_(live.isNotNull() & (s == "crawl") & is_("blocked")).alias("crawl_blocked_status"), F.count(live).alias("n_weighed"), *flags,
    )


def evidence_coverage(status: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted credit of each domain's sources; disabled ones are left out, unlisted ones count nothing."""
    return _evidence(status, weights, []).where("n_weighed > 0").drop("n_weighed")


def confidence(coverage: Column, agreement: Column, n_present: Column, blocked: Column, cfg: dict) -> tuple[Column, Column]:
    """Label and score."""
    raw = cfg["coverage"] * coverage + cfg["agreement"] * agreement + F.when(n_present >= 2, cfg["bonus"]).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(blocked, F.least(raw, F.lit(0.65))).otherwise(raw))), 2)
    return F.when(score >= cfg["high"], "high").when(score >= cfg["medium"], "medium").otherwise("low"), score


def _cap(features: DataFrame, config: dict) -> Column:
    """The least of the caps that apply to a row with the flags ``may_cap_i``; null without one."""
    curves = {name: points for name, _, _, _, points in config["signals"]}
    caps = []
    for i, spec in enumerate(config["absence_caps"]):
        if spec["size"] in features.columns and spec["signal"] in curves:
            x = f"log10(CASE WHEN `{spec['size']}` > 0 THEN `{spec['size']}` END)"
            caps.append(F.when(F.col(f"may_cap_{i}"), F.round(F.expr(curve_sql(x, curves[spec["signal"]])) + spec["tolerance"], 2)))
    return F.array_min(F.array(*caps)) if caps else F.lit(None).cast("double")


def absence_caps(features: DataFrame, status: DataFrame, config: dict) -> DataFrame:
    """(domain, cap): a complete list that lacks the domain bounds it at the curve's value for the list's size
    plus a tolerance, unless one of some other sources has the domain."""
    rows = features.join(_evidence(status, {}, config["absence_caps"]).hint("merge"), "domain")
    return rows.select("domain", _cap(features, config).alias("cap")).where("cap is not null")


def apply_modifiers(rows: DataFrame, config: dict) -> DataFrame:
    """Caps, fallbacks and shifts in their fixed order, with notes; adds ``est``.

    ``rows`` has mean, n_popularity, cap and the features that the rules read.
    """
    have = set(rows.columns)
    is_ = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in have else F.lit(False)
    up, resolves, nx = is_("crawl_reachable"), is_("dns_resolves"), is_("dns_nxdomain")
    caps, shifts, top = config["caps"], config["shifts"], config["no_popularity_cap"]
    free = F.col("mean").isNotNull() & (F.coalesce("n_popularity", F.lit(0)) == 0) & (F.col("mean") > top)
    est = F.when(free, top).when(F.col("mean").isNotNull(), F.col("mean")).when(up, 3.0).when(resolves, 2.5).otherwise(2.0)
    rdap = F.coalesce(F.col("rdap_status") == "not_found", F.lit(False)) if "rdap_status" in have else F.lit(False)
    unregistered = rdap & nx
    saw = up & (~F.coalesce("crawl_parked", F.lit(True)) if "crawl_parked" in have else F.lit(False))
    parked = is_("crawl_parked") | (is_("dns_parked") & ~saw)
    down = (~F.coalesce("crawl_reachable", F.lit(True)) if "crawl_reachable" in have else F.lit(False)) & resolves
    shop = F.coalesce(F.col("ecommerce_platform") != "", F.lit(False)) if "ecommerce_platform" in have else F.lit(False)
    rows = rows.withColumn("_0", est)
    rows = rows.withColumn("_1", F.when(unregistered, F.least("_0", F.lit(caps["unregistered"]))).when(nx, F.least("_0", F.lit(caps["nxdomain"]))).otherwise(F.col("_0")))
    rows = rows.withColumn("_2", F.when(parked, F.least("_1", F.lit(caps["parked"]))).otherwise(F.col("_1")))
    moved = F.col("_2")
    for cond, name in ((down, "unreachable"), (is_("crawl_blocked"), "blocked"), (is_("analytics_detected"), "analytics"), (is_("advertising_tags_detected"), "advertising"), (shop, "ecommerce")):
        moved = moved + F.when(cond, shifts[name]).otherwise(0.0)
    rows = rows.withColumn("_3", moved)
    capped = F.col("cap").isNotNull() & (F.col("_3") > F.col("cap"))
    notes = F.array_compact(F.array(
        F.when(free, "no popularity signal: capped"), F.when(F.col("mean").isNull(), F.when(up, "reachable site assumed small").when(resolves, "resolves, no page").otherwise("no evidence")),
        F.when(unregistered, "unregistered").when(nx, "does not resolve"), F.when(parked, "parked"), F.when(down, "unreachable"), F.when(is_("crawl_blocked"), "crawl blocked"), F.when(capped, "absent from a complete list: capped"),
    ))
    final = F.greatest(F.lit(0.0), F.when(capped, F.col("cap")).otherwise(F.col("_3")))
    return rows.withColumn("notes", notes).withColumn("est", final).drop("_0", "_1", "_2", "_3")


def with_range(rows: DataFrame, cfg: dict, buckets: list[tuple[str, float]] = BUCKETS) -> DataFrame:
    """Visits, lower, upper and bucket from est, coverage and stddev."""
    spread = F.least(cfg["base"] + cfg["missing"] * (1 - F.coalesce("coverage", F.lit(0.0))) + cfg["disagreement"] * F.coalesce("stddev", F.lit(0.0)), F.lit(cfg["max"]))
    power = lambda x: F.bround(F.pow(F.lit(10.0), x)).cast("long")
    rows = rows.withColumn("spread", spread).withColumn("visits", power(F.col("est")))
    rows = rows.withColumn("lower", power(F.greatest(F.lit(0.0), F.col("est") - F.col("spread")))).withColumn("upper", power(F.col("est") + F.col("spread")))
    return rows.withColumn("bucket", bucket(F.col("visits"), buckets))


def heuristic(version: str | dict) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The estimator of a version or of a configuration (X2), (features, status) -> estimates."""
    config = CONFIGS[version] if isinstance(version, str) else version
    version = version if isinstance(version, str) else config["model_version"]

    def run(features: DataFrame, status: DataFrame) -> DataFrame:
        used = {f for _, f, *_ in config["signals"]}
        inputs = {k: v for k, v in normalized_columns(features).items() if k in used}
        rows = features.withColumns({f"_{k}": v for k, v in inputs.items()})  # named once, as a curve reads its input at each bend
        rows = rows.withColumn("_list", signal_list({k: f"_{k}" for k in inputs}, config)).drop(*[f"_{k}" for k in inputs])
        rows = with_combined(rows, "_list", config["confidence"]["scale"]).drop("_list")
        rows = rows.join(_evidence(status, config["source_weights"], config["absence_caps"]).hint("merge"), "domain", "left").withColumn("cap", _cap(features, config))
        rows = with_range(apply_modifiers(rows, config), config["range"], config.get("buckets", BUCKETS))
        label, score = confidence(F.coalesce("coverage", F.lit(0.0)), F.coalesce("agreement", F.lit(0.3)), F.coalesce("n_present", F.lit(0)), F.coalesce("crawl_blocked_status", F.lit(False)), config["confidence"])
        return rows.select(
            "domain", "visits", "lower", "upper", "bucket", label.alias("confidence"), score.alias("score"), F.lit(version).alias("model_version"), "notes",
            F.struct(F.round(F.col("est") + 1e-9, 3).alias("log10_estimate"), "signals", F.round(F.col("spread") + 1e-9, 3).alias("spread"), "coverage", "agreement", "stddev").alias("details"),
        )

    return run


ESTIMATORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {v: heuristic(v) for v in CONFIGS}


def estimate(features: DataFrame, status: DataFrame, version: str | dict = "heuristic_v2") -> DataFrame:
    """Estimates by a version's name or a configuration of ``read_config``."""
    if isinstance(version, dict):
        return heuristic(version)(features, status)
    if version not in ESTIMATORS:
        raise ValueError(f"unknown model version {version!r}")
    return ESTIMATORS[version](features, status)


def compare_models(reference: DataFrame, run_status: DataFrame, features: DataFrame, status: DataFrame, versions: list[str | dict]) -> DataFrame:
    """Each reference domain under each version (names or configurations); an estimate only where the run completed."""
    out = None
    for v in versions:
        est = estimate(features, status, v).select("domain", F.col("visits").alias("estimate"), "lower", "upper", "bucket", "confidence")
        done = run_status.where("run_status = 'completed'").select("domain")
        rows = reference.join(run_status, "domain", "left").withColumn("run_status", F.coalesce("run_status", F.lit("not_submitted")))
        rows = rows.join(est.join(done, "domain", "left_semi"), "domain", "left").withColumn("model_version", F.lit(v if isinstance(v, str) else v["model_version"]))
        out = rows if out is None else out.unionByName(rows)
    return out


def type_flags(types: Column) -> dict[str, Column]:
    """Product, article and organisation flags of a page's structured-data types."""
    sets = {"schema_product": PRODUCT_TYPES, "schema_article": ARTICLE_TYPES, "schema_organization": ORGANISATION_TYPES}
    return {k: F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(x) for x in v])), F.lit(False)) for k, v in sets.items()}
