"""Jobs over landed pages: facts, outcomes, grading, links, site structure."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

# Markers and patterns.
PARKED = [
    "this domain is for sale", "domain for sale", "buy this domain", "is parked free", "parked domain", "sedoparking", "parkingcrew", "domain is parked",
    "this web page is parked", "hugedomains", "dan.com", "afternic", "godaddy.com/domainsearch", "namecheap.com/domains/registration", "expired domain", "renew your domain",
]
BLOCKED = [
    "just a moment", "attention required", "access denied", "pardon our interruption", "verify you are a human", "are you a human", "captcha", "cf-challenge", "challenge-platform",
    "bot detection", "request unsuccessful. incapsula", "_incapsula_resource", "perimeterx", "px-captcha", "ddos-guard", "reference #18.", "blocked by",
]
INTERSTITIAL = [
    r"just a moment\.\.\.", "checking your browser", "attention required", "cf-browser-verification", "access denied", "request blocked", "are you a robot", "verify you are human",
    "performing security verification", "complete the security check", "enable javascript", "please turn javascript on", "pardon our interruption", "403 forbidden",
    "site can.t be reached", "this site is currently unavailable", "domain (is )?for sale", "account (has been )?suspended",
]
PLACEHOLDER = ["coming soon", "under construction", "parked", "lorem ipsum"]
SOCIAL = r"(?i)(^|\.)(instagram|facebook|fb|tiktok|linkedin|twitter|x|yelp|pinterest|youtube)\.com$"
BOOKING = r"(?i)(^|\.)(vagaro|booksy|glossgenius|squareup|square\.site|mindbodyonline|schedulicity|fresha|boulevard|janeapp)\."
PRIVATE_TEXT = r"(?i)private site|password protected|enter (the )?password"
DEAD_TEXT = r"(?i)connectyourdomain|domain (is )?not connected|site (is )?(not|no longer) (available|published)|this site can.t be reached|website (is )?(expired|unavailable)|account (has been )?suspended"
PARKED_TEXT = r"(?i)/lander\b|domain (is )?for sale|buy this domain|parked (free|domain)|this domain may be for sale"
PLATFORMS = [("magento", r"(?i)/static/version\d+/frontend/|mage/cookies|Magento_"), ("shopify", r"(?i)cdn\.shopify\.com|Shopify\.theme"), ("woocommerce", r"(?i)woocommerce|wc-ajax")]
TAG_IDS = {"ga": r"\b(G-[A-Z0-9]{6,12}|UA-\d{4,10}-\d{1,3})\b", "gtm": r"\b(GTM-[A-Z0-9]{4,10})\b", "google_ads": r"\b(AW-\d{6,12})\b", "meta_pixel": r"fbq\(\s*['\"]init['\"]\s*,\s*['\"](\d{8,20})['\"]"}
DENIAL_TEXT = r"(?i)(destination|target) (address|host) is not allowed|blocked by egress policy"
KEPT_HEADERS = [
    "server", "x-powered-by", "content-type", "cf-ray", "cf-mitigated", "x-vercel-id", "x-nf-request-id", "via", "x-served-by", "x-cache", "x-shopify-stage", "x-shopid", "x-wix-request-id",
    "x-akamai-transformed", "x-amz-cf-id", "x-generator", "x-drupal-cache", "x-aspnet-version", "x-kinsta-cache", "x-pantheon-styx-hostname", "x-azure-ref", "x-magento-cache-debug",
    "x-bc-apicontext", "x-fastly-request-id", "x-varnish", "last-modified",
]

FACTS = (
    "url string, title string, description string, lang string, canonical string, robots string, noindex boolean, generator string, n_h1 int, n_h2 int, n_h3 int, og map<string,string>, "
    "hreflang array<string>, n_feeds int, scripts array<string>, inline_script_bytes int, n_images int, n_forms int, search_form boolean, word_count int, html_bytes int, text string, visible_text string, "
    "schema_types array<string>, links array<string>"
)
_SILENT = {"script", "style", "noscript", "template", "svg"}
#: Tags that part words of the visible text; other tags may stand within a word.
_BLOCK = set("address article aside blockquote body br button caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())


class _Facts(HTMLParser):
    """One pass over a page's markup; keeps what page_facts returns."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.f: dict = dict(title=None, description=None, lang=None, canonical=None, robots=None, generator=None, og={}, hreflang=[], scripts=[], links=[], types=set())
        self.n = dict.fromkeys(("h1", "h2", "h3", "img", "form", "feeds", "inline"), 0)
        self.search, self.words, self.shown, self.inside, self.silent, self.ld = False, [], [], "", 0, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in self.n:
            self.n[tag] += 1
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK:
            self.shown.append(" ")
        if tag == "html":
            self.f["lang"] = a.get("lang") or None
        elif tag == "title":
            self.inside = "title"
        elif tag == "style":
            self.inside = "style"
        elif tag == "a" and a.get("href"):
            self.f["links"].append(a["href"])
        elif tag == "script":
            if a.get("src"):
                self.f["scripts"].append(a["src"].lower())
            self.inside, self.ld = "script", [] if "ld+json" in a.get("type", "") else None
        elif tag == "input" and (a.get("type") == "search" or a.get("name") in ("q", "s", "search")):
            self.search = True
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if rel == "canonical":
                self.f["canonical"] = a.get("href")
            elif rel == "alternate" and a.get("hreflang"):
                self.f["hreflang"].append(a["hreflang"].lower())
            elif rel == "alternate" and ("rss" in a.get("type", "") or "atom" in a.get("type", "")):
                self.n["feeds"] += 1
        elif tag == "meta":
            name, value = (a.get("name") or a.get("property") or "").lower(), a.get("content", "")
            if name.startswith("og:") and len(self.f["og"]) < 20:
                self.f["og"].setdefault(name, value[:200])
            elif name in ("description", "robots", "generator") and self.f[name] is None:
                self.f[name] = value
        if a.get("itemtype"):
            self.f["types"].add(a["itemtype"].rstrip("/").rsplit("/", 1)[-1])

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag in _BLOCK:
            self.shown.append(" ")
        if tag == "script" and self.ld is not None:
            try:
                self.walk(json.loads("".join(self.ld)))
            except ValueError:
                pass
            self.ld = None
        if tag in ("title", "script", "style"):
            self.inside = ""

    def walk(self, root) -> None:
        stack = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                kinds = x.get("@type")
                self.f["types"].update(k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str))
                stack += x.values()
            elif isinstance(x, list):
                stack += x

    def handle_data(self, data):
        if self.inside == "title":
            self.f["title"] = (self.f["title"] or "") + data
        elif self.inside == "script":
            self.n["inline"] += len(data.encode("utf-8", "replace"))
            if self.ld is not None:
                self.ld.append(data)
        elif self.inside != "style":
            self.shown.append(data)
            if not self.silent:
                self.words += data.split()


def html_facts(url: str | None, html: str | None) -> tuple:
    p = _Facts()
    p.feed(html or "")
    p.close()
    f, n = p.f, p.n
    title = " ".join((f["title"] or "").split()) or None
    return (
        url, title and title[:300], f["description"] and f["description"][:500], f["lang"], f["canonical"], f["robots"], "noindex" in (f["robots"] or "").lower(), f["generator"], n["h1"], n["h2"], n["h3"],
        list(f["og"].items()), f["hreflang"][:50], n["feeds"], f["scripts"], n["inline"], n["img"], n["form"], p.search, len(p.words), len((html or "").encode("utf-8", "replace")), " ".join(p.words)[:2000],
        " ".join("".join(p.shown).split()),
        sorted(f["types"])[:20], f["links"],
    )


#: Pages whose facts a Python task holds at once, however many come in an Arrow batch.
FACT_ROWS = 64


def page_facts(pages: DataFrame, url: str = "url", html: str = "html", extra: list[str] | None = None) -> DataFrame:
    """Title, meta, headings, links, scripts, structured-data types and text of each page.

    ``text`` is P9's sample of 2,000 characters; ``visible_text`` (P15) is all that is not script or style.
    The html is read here and goes no further; ``extra`` columns are kept.
    """
    extra = extra or []
    schema = pages.select(*extra).schema
    out = schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, FACT_ROWS) for whole in batches for at in range(0, whole.num_rows, FACT_ROWS)):
            rows = [html_facts(u, h) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
            yield pa.record_batch([*b.columns[2:], *(pa.array(c, t) for c, t in zip(cols, _ARROW.values(), strict=True))], names=[*extra, *_ARROW])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) if out else ""
    return pages.select(url, html, *extra).mapInArrow(run, ", ".join(x for x in (ddl, FACTS) if x))


_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
_ARROW = {x.strip().split(" ")[0]: _TYPES[x.strip().split(" ")[1]] for x in FACTS.split(", ")}


def visible_words(html: Column) -> Column:
    """Native word list of the visible text, for jobs that need no other fact."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def basics(pages: DataFrame) -> DataFrame:
    """The native subset of P9: title, language, counts of h1 and links, bytes of html."""
    h = F.col("html")
    one = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    return pages.select(
        "page_id", F.trim(one(r"<title>([^<]*)</title>")).alias("title"), one(r'<html[^>]*\blang="([^"]*)"').alias("lang"), F.regexp_count(h, F.lit(r"<h1[ >]")).cast("long").alias("n_h1"),
        F.regexp_count(h, F.lit(r'<a [^>]*href="')).cast("long").alias("n_links"), F.octet_length(h).cast("long").alias("html_bytes"),
    )


def without_dots(path: Column) -> Column:
    """A URL path whose ``.`` and ``..`` segments are worked in; ``..`` at the root is dropped."""
    parts = F.split(path, "/", -1)

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(x == ".", done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    slash = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(folded, "/"), slash)).otherwise(path)


def resolved(url: Column, href: Column) -> Column:
    """``href`` on the page ``url`` as an absolute http(s) URL without fragment; null for fragments only, other schemes and nothing."""
    origin, path = U.url_origin(url), F.when(U.url_path(url) == "", "/").otherwise(U.url_path(url))
    rest, query = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"\?[^#]*", 0)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    scheme = href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    absolute = (
        F.when(href.rlike(r"(?i)^https?://"), href).when(scheme | href.startswith("#") | (href == ""), None)
        .when(href.startswith("//"), F.concat(F.regexp_extract(origin, "^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(origin, without_dots(rest), query))
        .when(rest == "", F.concat(origin, U.url_path(url), query)).otherwise(F.concat(origin, without_dots(F.concat(folder, rest)), query))
    )
    return F.regexp_replace(absolute, "#.*$", "")


def link_edges(pages: DataFrame, links: Column, domain: str = "domain", url: str = "url", sample: int = 300) -> DataFrame:
    """(src, dst, dst_host, internal) of each page's anchors, resolved (relative, dot-segment and query-only
    ones too), without fragments; other schemes go; up to ``sample`` different targets per page, in page order."""
    rows = pages.select(F.col(url).alias("src"), url, domain, F.posexplode(links).alias("_pos", "_href")).withColumn("dst", resolved(F.col(url), F.trim("_href")))
    first = rows.where("dst is not null").groupBy("src", domain, "dst").agg(F.min("_pos").alias("_pos"))
    first = first.withColumn("_rn", F.row_number().over(Window.partitionBy("src").orderBy("_pos"))).where(F.col("_rn") <= sample)
    first = first.withColumn("dst_host", U.url_host(F.col("dst")))
    return first.select("src", "dst", "dst_host", F.coalesce(U.same_site(F.col("dst_host"), F.col(domain)), F.lit(False)).alias("internal"))


def html_links(html: Column) -> Column:
    """The targets of all anchors, quoted in either way or not at all."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    return F.transform(raw, lambda x: F.regexp_replace(x, """^["']|["']$""", ""))


def dominant_origin(edges: DataFrame, site: str) -> DataFrame:
    """The origin most of a site's own links use; ties to the smaller origin."""
    counts = edges.where("internal").groupBy(site, U.url_origin(F.col("dst")).alias("origin")).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("origin", "n"), F.struct(-F.col("n"), F.col("origin"))).alias("_b")
    return counts.groupBy(site).agg(best).select(site, "_b.origin", "_b.n")


def _hits(text: Column, markers: list[str]) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + text.contains(m).cast("int")
    return out


def parked(html: Column, words: Column, internal_links: Column) -> Column:
    """Two markers in the first 80,000 characters, or one on a page with few words and links."""
    n = _hits(F.lower(F.substring(html, 1, 80_000)), PARKED)
    return (n >= 2) | ((n == 1) & (words < 400) & (internal_links < 5))


def blocked_reason(status: Column, mitigated: Column, body: Column) -> Column:
    """Challenge header, a marker under a refusing status, or 403 / 429 alone."""
    head = F.lower(F.substring(body, 1, 60_000))
    first = F.get(F.filter(F.array(*[F.lit(m) for m in BLOCKED]), lambda m: F.contains(head, m)), F.lit(0))
    code = F.concat(F.lit("http_"), status.cast("string"))
    refusing = status.isin(401, 403, 406, 429, 503)
    return F.when(mitigated == "challenge", "cloudflare_challenge").when(refusing & first.isNotNull(), F.concat(code, F.lit(":"), first)).when(status.isin(403, 429), code)


def _branding_issues(pages: DataFrame) -> list[Column]:
    """Of a ``branding`` struct (logo and colours with confidence; favicon with source), if there is one."""
    if "branding" not in pages.columns:
        return []
    b, has = F.col("branding"), F.col("branding").isNotNull()
    failed = F.concat(F.lit("branding failed: "), F.coalesce("branding_error", F.lit("unknown"))) if "branding_error" in pages.columns else F.lit("branding failed: unknown")
    logo, colours = b["logo"], b["colors"]
    return [
        F.when(~has, failed), F.when(has & logo.isNull(), "no logo").when(logo["confidence"] == "low", F.concat(F.lit("logo low confidence ("), logo["source"], F.lit(")"))),
        F.when(has & (b["favicon"].isNull() | (b["favicon"]["source"] == "default")), "favicon not declared (guessed /favicon.ico)"),
        F.when(has & colours["primary"].isNull(), "no primary color").when(colours["confidence"] == "low", F.concat(F.lit("colors low confidence ("), colours["basis"], F.lit(")"))),
    ]


def grade(pages: DataFrame, text: str = "markdown", success: Column | None = None) -> DataFrame:
    """Words, lines, issues and the verdict GOOD, CHECK or BAD of each page's text.

    Where ``pages`` has them, ``error_code`` and ``status_code`` tell of a failure, ``url`` and ``final_url``
    of a redirect to another host, and ``branding`` of what a brand lacks.
    """
    have = set(pages.columns)
    bare_host = lambda c: F.regexp_replace(U.url_host(F.col(c)), r"^www\.", "")
    off = F.when(bare_host("url") != bare_host("final_url"), F.concat(F.lit("redirected off-host to "), U.url_host(F.col("final_url")))) if {"url", "final_url"} <= have else None
    code = F.coalesce("error_code", F.lit("unknown")) if "error_code" in have else F.lit("unknown")
    failure = F.concat_ws(" ", F.concat(F.lit("failed: "), code), F.col("status_code").cast("string") if "status_code" in have else F.lit(None).cast("string"))
    ok = F.lit(True) if success is None else success
    md = F.coalesce(F.col(text), F.lit(""))
    linked = md.contains("](")  # no link or image without it
    bare = F.when(linked, F.regexp_replace(F.regexp_replace(md, r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")).otherwise(md)
    # a word is counted at its first two letters in a row and passed over to its end; marks end a word as blanks do
    rows = pages.withColumn("_w", F.regexp_count(bare, F.lit(r"[A-Za-z]{2}[^\s#>*_`|\\-]*")).cast("long"))
    rows = rows.withColumn("_n", F.regexp_count(md, F.lit(r"[^ \t\r\x0b\x0c\n][^\n]*")).cast("long"))
    lines = F.filter(F.transform(F.split(md, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")
    rows = rows.withColumn("_l", F.when(F.col("_n") > 10, lines))
    link_line = F.filter("_l", lambda x: x.rlike(r"^\W*\[[^\]]*\]\([^)]*\)\W*$"))
    rows = rows.withColumn("_ll", F.when(F.col("_l").isNotNull() & linked, F.size(link_line)).otherwise(0))
    rows = rows.withColumn("_head", F.when(F.col("_w") < 400, F.lower(F.substring(md, 1, 3000))))
    w, n, head, link_lines = F.col("_w"), F.col("_n"), F.col("_head"), F.col("_ll")
    says = lambda p: head.contains(p) if p.replace(" ", "").replace("-", "").isalnum() else head.rlike(p)
    issue = lambda cond, label: F.when(cond, F.lit(label))
    issues = [
        F.when(~ok, failure), F.when(w < 50, F.concat(F.lit("thin content ("), w, F.lit(" words)"))).when(w < 150, F.concat(F.lit("low content ("), w, F.lit(" words)"))),
        *(issue((w < 400) & says(p), f"block/interstitial: {p}") for p in INTERSTITIAL), *(issue((w < 200) & says(p), f"placeholder: {p}") for p in PLACEHOLDER),
        F.when((n > 10) & (link_lines / n > 0.6), F.concat(F.lit("mostly links ("), link_lines, F.lit("/"), n, F.lit(" lines)"))), issue((n > 20) & (F.size(F.array_distinct("_l")) / n < 0.5), "heavy duplication"),
        *([off] if off is not None else []), *_branding_issues(pages),
    ]
    rows = rows.withColumn("words", w).withColumn("lines", n).withColumn("images", F.when(linked, F.regexp_count(md, F.lit(r"!\[[^\]]*\]\("))).otherwise(0).cast("long")).withColumn("issues", F.array_compact(F.array(*issues)))
    bad = ~ok | (F.col("words") < 50) | F.exists("issues", lambda i: i.startswith("block"))
    verdict = F.when(bad, "BAD").when(F.size("issues") > 0, "CHECK").otherwise("GOOD")
    return rows.withColumn("verdict", verdict).drop("_w", "_n", "_l", "_ll", "_head")


def site_issue(host: Column, status: Column, text: Column, words: Column) -> Column:
    """Social, private, dead, parked, blocked or booking-platform; first match wins."""
    head = F.substring(text, 1, 4000)
    return (
        F.when(host.rlike(SOCIAL), "social").when((status == 401) | head.rlike(PRIVATE_TEXT), "private").when(head.rlike(DEAD_TEXT), "dead").when(head.rlike(PARKED_TEXT), "parked")
        .when(status.isin(403, 429, 503) & (words < 80), "blocked").when((status == 404) & (words < 80), "dead").when(host.rlike(BOOKING), "booking-platform")
    )


def verdict_counts(graded: DataFrame) -> DataFrame:
    """Verdicts, and site issues among what is not GOOD."""
    label = lambda what, value: F.struct(F.lit(what).alias("what"), value.alias("label"))
    both = F.array_compact(F.array(label("verdict", F.col("verdict")), F.when(F.col("verdict") != "GOOD", label("site_issue", F.coalesce("site_issue", F.lit("none"))))))
    return graded.select(F.explode(both).alias("x")).groupBy("x.what", "x.label").agg(F.count("*").alias("n"))


def page_outcome(docs: DataFrame) -> DataFrame:
    """Success, error code and content of engine documents (url, status_code, title array or string as array, markdown, html, metadata)."""
    denied = (F.col("status_code") == 403) & F.coalesce(F.col("markdown"), F.col("html"), F.lit("")).rlike(DENIAL_TEXT)
    bounce = F.get("title", F.lit(0)).rlike(r"(?i)^\s*(google|bing|duckduckgo)\s*$") & ~U.url_host(F.col("url")).rlike(r"(^|\.)(google|bing|duckduckgo)\.")
    code = F.when(denied, "BLOCKED_URL").when(bounce, "EXTRACTION_FAILED").when(F.col("status_code") >= 400, "HTTP_ERROR")
    keep = ~F.coalesce(denied, F.lit(False)) & ~F.coalesce(bounce, F.lit(False))
    noisy = ["viewport", "theme-color", "favicon", "scrapeId", "proxyUsed", "cacheState"]
    return docs.withColumn("error_code", code).withColumn("success", F.col("error_code").isNull()).withColumns({
        "markdown": F.when(keep, F.col("markdown")), "html": F.when(keep, F.col("html")), "title": F.get("title", F.lit(0)),
        "metadata": F.map_filter("metadata", lambda k, _: ~k.isin(noisy)),
    })


def bound_metadata(metadata: Column) -> Column:
    """P17 on string maps: the first 40 entries with keys of at most 100 characters, values cut to 1000."""
    kept = F.slice(F.filter(F.map_entries(metadata), lambda e: F.length(e["key"]) <= 100), 1, 40)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], F.substring(e["value"], 1, 1000))))


def bound_json_metadata(metadata: Column) -> Column:
    """P17 on JSON objects, as a map of JSON values: strings cut to 1000 characters, numbers, booleans and nulls as
    they are, of arrays the first 20 strings, each cut; other values and arrays without a string go.  40 entries at most."""
    kind = lambda v: F.schema_of_variant(v)
    cut = lambda x: F.substring(x, 1, 1000)

    def bounded(v: Column) -> Column:
        texts = F.slice(F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: kind(x) == "STRING"), lambda x: cut(F.try_variant_get(x, "$", "string"))), 1, 20)
        plain = kind(v).isin("BIGINT", "DOUBLE", "BOOLEAN", "VOID") | kind(v).startswith("DECIMAL")
        return (
            F.when(kind(v) == "STRING", F.to_json(F.to_variant_object(F.array(cut(F.try_variant_get(v, "$", "string"))))).substr(F.lit(2), F.greatest(F.length(F.to_json(F.to_variant_object(F.array(cut(F.try_variant_get(v, "$", "string")))))) - 2, F.lit(0))))
            .when(plain, F.to_json(v)).when(kind(v).startswith("ARRAY") & (F.size(texts) > 0), F.to_json(texts))
        )

    entries = F.map_entries(F.from_json(metadata, "map<string,variant>"))
    made = F.transform(F.filter(entries, lambda e: F.length(e["key"]) <= 100), lambda e: F.struct(e["key"].alias("key"), bounded(e["value"]).alias("value")))
    return F.map_from_entries(F.slice(F.filter(made, lambda e: e["value"].isNotNull()), 1, 40))


def fit_budget(content: DataFrame, budget: int) -> DataFrame:
    """Content whose JSON fits ``budget`` bytes stays as it is.  Else links are cut to 1000, then the logo image,
    html, text, markdown and links give way, in this order, as far as needed; ``truncated`` tells which rows that were.

    A text loses the bytes that are too many and 64 more, and a character that is cut in two goes whole.
    """
    size = lambda: F.octet_length(F.to_json(F.struct("html", "text", "markdown", "links", "logo"), {"ignoreNullFields": "false"}))
    rows = content.withColumn("_s", size()).withColumn("truncated", F.col("_s") > budget)
    over = F.col("_s") > budget
    cut = F.when(F.col("truncated") & (F.size("links") > 1000), F.slice("links", 1, 1000)).otherwise(F.col("links"))
    rows = rows.withColumn("links", cut).withColumn("_s", size())
    rows = rows.withColumn("logo", F.when(~over, F.col("logo"))).withColumn("_s", size())
    for c in ("html", "text", "markdown"):
        room = F.greatest(F.octet_length(c) - (F.col("_s") - budget) - 64, F.lit(0)).cast("int")
        short = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), F.lit(1), room).cast("string")), "\ufffd+$", "")
        rows = rows.withColumn(c, F.when(over & (F.length(c) > 0), short).otherwise(F.col(c))).withColumn("_s", size())
    rows = rows.withColumn("links", F.when(over, F.array().cast("array<string>")).otherwise(F.col("links"))).withColumn("_s", size())
    return rows.withColumn("content_bytes", F.col("_s").cast("long")).drop("_s")


def store_platform(html: Column) -> Column:
    """Magento, shopify or woocommerce by markup, first match wins."""
    out = F.when(html.rlike(PLATFORMS[0][1]), PLATFORMS[0][0])
    for name, pattern in PLATFORMS[1:]:
        out = out.when(html.rlike(pattern), name)
    return out


def response_projection(pages: DataFrame, suffixes: DataFrame) -> DataFrame:
    """A listed subset of headers cut to 200 characters, and whether the final URL left the registrable domain."""
    kept = F.transform_values(F.map_filter("headers", lambda k, _: F.lower(k).isin(KEPT_HEADERS)), lambda _, v: F.substring(v, 1, 200))
    rows = pages.withColumn("headers", kept).withColumn("_a", U.url_host(F.col("url"))).withColumn("_b", U.url_host(F.col("final_url")))
    rows = U.registrable_domains(U.registrable_domains(rows, "_a", suffixes, "_da"), "_b", suffixes, "_db")
    return rows.withColumn("redirected_away", F.coalesce(F.col("_da") != F.col("_db"), F.lit(False))).drop("_a", "_b", "_da", "_db")


def tag_ids(html: Column) -> Column:
    """Map of kind to the first five public tag ids, sorted and distinct."""
    found = lambda p: F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(p), F.lit(1)))), 1, 5)
    pairs = [F.lit(x) if isinstance(x, str) else x for k, p in TAG_IDS.items() for x in (k, found(p))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def site_structure(pages: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """A5: languages, subdomains (neither apex nor www) and kind counts per domain, scaled where ``scale(domain, factor)`` says so."""
    sub = F.when((F.col("host") != F.col("domain")) & (F.col("host") != F.concat(F.lit("www."), F.col("domain"))), F.col("host"))
    rows = pages.withColumn("_k", U.path_kind(F.col("path"))).withColumn("_l", U.language_prefix(F.col("path")))
    counts = [F.count_if(F.col("_k") == k).alias(f"n_{k}") for k in ("product", "article", "category", "page")]
    out = rows.groupBy("domain").agg(F.count_distinct("_l").alias("n_languages"), F.count_distinct(sub).alias("n_subdomains"), *counts)
    if scale is None:
        return out
    out = out.join(scale, "domain", "left")
    f = F.coalesce("factor", F.lit(1.0))
    return out.withColumns({f"n_{k}": F.floor(F.col(f"n_{k}") * f) for k in ("product", "article", "category", "page")}).drop("factor")


def page_averages(facts: DataFrame, site: str) -> DataFrame:
    """Averages cut to whole numbers, and signals that any page shows."""
    avg = lambda c: F.floor(F.avg(c)).alias(f"avg_{c}")
    return facts.groupBy(site).agg(avg("word_count"), avg("html_bytes"), F.bool_or(F.col("n_feeds") > 0).alias("has_rss"), F.bool_or("search_form").alias("has_search"), F.count_if("noindex").alias("n_noindex"))
