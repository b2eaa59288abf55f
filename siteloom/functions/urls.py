"""Columns and jobs over URLs, hosts and domains.

All are native expressions; only a host with letters beyond ASCII meets Python
(an Arrow UDF for its IDN form, called on those rows alone).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Path kinds in order, first match wins.
PATH_KINDS = [
    ("media", r"(?i)\.(jpe?g|png|gif|webp|svg|avif|mp4|mp3|pdf|zip|css|js|ico|woff2?|xml)$"),
    ("product", r"(?i)(^|/)(products?|produkte?|produits?|prodotti|productos|shop|store|item|items|p|sku|dp)(/|$)"),
    ("product", r"(?i)/(dp|gp/product|p)/[A-Za-z0-9]+|-p-\d+|/pd/|/product-|/sku-"),
    ("article", r"(?i)(^|/)(blog|blogs|news|article|articles|post|posts|story|stories|press|insights|journal|magazine|artikel|noticias|actualites|nachrichten|guides?|resources?|knowledge|learn|wiki)(/|$)"),
    ("article", r"/20\d{2}/\d{1,2}(/\d{1,2})?/"),
    ("category", r"(?i)(^|/)(category|categories|collections?|catalog|kategorie|categoria|categorie|tag|tags|topics?|brands?|c)(/|$)"),
]
# ISO 639-1 codes, and those that need a region to count as a language.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd "
    "gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh "
    "mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su "
    "sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
AMBIGUOUS = "id my to no so or as is it be an am pa co ie ta".split()

# Blocked names, suffixes and address ranges of the URL screening.
BLOCKED_NAMES = ["localhost", "metadata", "metadata.google.internal", "instance-data"]
BLOCKED_SUFFIXES = [".localhost", ".local", ".localdomain", ".internal", ".intranet", ".lan", ".home.arpa", ".corp", ".svc", ".cluster.local"]
BLOCKED_RANGES = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24",
    "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
ALLOWED_PORTS = [80, 443, 8080, 8443]
MAX_URL = 2048


def url_host(url: Column) -> Column:
    """Lower-case host without trailing dots; null where the URL has none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(".")), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment; empty where the URL stops at the host."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_path_query(url: Column) -> Column:
    """Path and query; an empty path is ``/``."""
    path, query = url_path(url), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(F.when(path == "", "/").otherwise(path), query)


def url_origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def path_kind(path: Column) -> Column:
    """home, media, product, article, category or page; the first match wins (null path: home)."""
    out = F.when(path.isNull() | path.isin("", "/"), "home")
    for kind, pattern in PATH_KINDS:
        out = out.when(path.rlike(pattern), kind)
    return out.otherwise("page")


def language_prefix(path: Column) -> Column:
    """``xx`` or ``xx-yy`` of the first path segment where it is a language; ambiguous codes need a region."""
    pattern = r"(?i)^/([a-z]{2})(-[a-z]{2})?(/|$)"
    code, region = F.lower(F.regexp_extract(path, pattern, 1)), F.lower(F.regexp_extract(path, pattern, 2))
    return F.when(code.isin(LANGUAGES) & ((region != "") | ~code.isin(AMBIGUOUS)), F.concat(code, region))


def same_site(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def reverse_domain(name: Column) -> Column:
    """example.com -> com.example, and back."""
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")


def list_domain(raw: Column) -> Column:
    """The cleaning of ranked lists: trimmed, lower-case, without outer dots; null unless it is a dotted name."""
    s = F.btrim(F.lower(F.trim(raw)), F.lit("."))
    return F.when(s.rlike(r"^[a-z0-9.-]{3,253}$") & s.contains("."), s)


def url_key(url: Column) -> Column:
    """Identity of a page: host without www, path and query; no fragment."""
    return F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), url_path_query(url))


def modified_age(lastmod: Column, today: Column) -> Column:
    """Age bucket of a last-modified date: 30d (future too), 90d, 365d, older; null for a bad date."""
    days = F.date_diff(today, F.try_to_date(F.substring(F.trim(lastmod), 1, 10), "yyyy-MM-dd"))
    return F.when(days <= 30, "30d").when(days <= 90, "90d").when(days <= 365, "365d").when(days > 365, "older")


def _ascii_name(host: str | None) -> str | None:
    if host is None:
        return None
    import idna

    try:
        return idna.encode(host, uts46=True).decode("ascii")
    except idna.IDNAError:
        return None


_idna = F.udf(_ascii_name, T.StringType(), useArrow=True)
_SHIPPED = "com.google.thirdparty.publicsuffix.PublicSuffixPatterns"


@cache
def shipped_suffixes(spark) -> list[str]:
    """The whole public-suffix list, private names too, that the session's Java libraries carry: ``*.`` rules and ``!`` exceptions in its own notation."""
    lists = spark._jvm.java.lang.Class.forName(_SHIPPED)
    names = lambda field: [x.split("=")[0] for x in lists.getField(field).get(None).toString().strip("{}").split(", ")]
    return [*names("EXACT"), *(f"*.{x}" for x in names("UNDER")), *(f"!{x}" for x in names("EXCLUDED"))]


def suffix_table(spark, suffixes: list[str] | None = None) -> DataFrame:
    """(suffix, rule) from a public-suffix list, the shipped one by default: rule ``=``, ``*`` (one more label) or ``!`` (exception)."""
    kind = lambda s: s[0] if s[0] in "!*" else "="
    rows = {(_ascii_name(s.removeprefix("!").removeprefix("*.")), kind(s)) for s in suffixes or shipped_suffixes(spark)}
    return spark.createDataFrame(sorted(rows), "suffix string, rule string")


def read_suffixes(spark, path: str) -> DataFrame:
    """``suffix_table`` of a public-suffix file: a rule a line, up to white space; ``//`` begins a comment; IDN rules take their ASCII form."""
    rules = spark.read.text(path).select(F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1)).alias("r")).where("r <> '' and not startswith(r, '//')")
    name = F.regexp_replace("r", r"^(!|\*\.)", "")
    kind = F.when(F.col("r").startswith("!"), "!").when(F.col("r").startswith("*."), "*").otherwise("=")
    return rules.select(F.when(name.rlike(r"[^\x00-\x7F]"), _idna(name)).otherwise(name).alias("suffix"), kind.alias("rule")).distinct()


def registrable_domains(hosts: DataFrame, host: str, suffixes: DataFrame, out: str = "domain") -> DataFrame:
    """Add ``out``: the label before the longest public suffix, and that suffix; null without one.

    The rules become hashed sets of literals by kind and number of labels.  A host's last
    labels are looked up in them, most labels first, so that a row costs a few lookups however
    long the list is, and no row is exploded, joined or shuffled.  Wildcard rules take one more
    label; exceptions, tried first, one less.
    """
    sets: dict[tuple[str, int], list[str]] = {}
    for r in suffixes.collect():  # its size is that of the list, not of the data
        sets.setdefault((r["rule"], r["suffix"].count(".") + 1), []).append(r["suffix"])
    last = lambda n: f"substring_index(h, '.', -{n})"
    among = lambda rule, n: _in_set(last(n), sets.get((rule, n), []))
    more = lambda n: f"({last(n)} <> {last(n - 1)} AND NOT startswith({last(n)}, '.'))"
    most = max([n + (rule == "*") for rule, n in sets], default=0)
    exact = [f"WHEN {among('!', n)} THEN {last(n)}" for n in range(most, 0, -1) if ("!", n) in sets]
    known = [f"WHEN {among('=', n)} OR ({among('*', n - 1)} AND {more(n)}) THEN CASE WHEN {more(n + 1)} THEN {last(n + 1)} END" for n in range(most, 0, -1)]
    if not most:
        return hosts.withColumn(out, F.lit(None).cast("string"))
    # the host is the variable of a lambda: it is worked out once a row, wherever the optimizer moves the lookup
    sql = f"transform(array(_suffixed), h -> CASE {' '.join(exact + known)} END)[0]"
    return hosts.withColumn("_suffixed", F.rtrim(F.lower(F.col(host)), F.lit("."))).withColumn(out, F.expr(sql)).drop("_suffixed")


def _in_set(sql: str, names: list[str]) -> str:
    """Whether an expression is one of many literals, as SQL that is parsed at once; Spark makes a hashed set of them."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{sql} IN ({', '.join(map(text, names))})" if names else "false"


def normalize_domains(raw: DataFrame, col: str, suffixes: DataFrame) -> DataFrame:
    """Add name (registrable domain), host and error of anything a user may paste.

    Scheme, path, credentials, port and trailing dots go; addresses, bad labels, bare
    suffixes and unknown top-level names keep a reason in ``error``.
    """
    s = F.lower(F.trim(F.col(col)))
    bare = F.regexp_replace(F.regexp_replace(s, r"[/?#].*$", ""), r"^.*@", "")
    with_scheme = s.contains("://")
    host = F.when(with_scheme, F.regexp_extract(s, r"://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)).otherwise(F.regexp_replace(bare, r":.*$", ""))
    ip = (~with_scheme & (bare.startswith("[") | (F.length(bare) - F.length(F.replace(bare, F.lit(":"), F.lit(""))) > 1))) | host.rlike(r"^\[")
    rows = raw.withColumn("_ip", ip).withColumn("_h", F.rtrim(F.trim(host), F.lit(".")))
    h = F.col("_h")
    foreign = h.rlike(r"[^\x00-\x7F]")  # Python is given every row, so that plain hosts go in as nulls
    rows = rows.withColumn("host", F.when(foreign, _idna(F.when(foreign, h))).otherwise(h))
    label = F.exists(F.split("host", r"\."), lambda x: ~x.rlike(r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"))
    early = (
        F.when(F.col("_ip"), "ip addresses are not domains")
        .when(h.isNull() | (h == ""), "empty").when(h.rlike(r"^[0-9.]+$"), "ip addresses are not domains")
        .when(F.col("host").isNull(), "invalid international domain").when(F.length("host") > 253, "too long")
        .when(~F.col("host").contains("."), "a registrable domain needs at least two labels").when(label, "invalid label")
    )
    rows = registrable_domains(rows.withColumn("_early", early), "host", suffixes, "name")
    suffix_only = F.expr(_in_set("host", [r["suffix"] for r in suffixes.collect()]))
    late = F.when(F.col("name").isNull(), F.when(suffix_only, "a public suffix is not a registrable domain").otherwise("unknown top-level domain"))
    rows = rows.withColumn("error", F.coalesce("_early", late))
    good = F.col("error").isNull()
    return rows.withColumn("name", F.when(good, F.col("name"))).withColumn("host", F.when(good, F.col("host"))).drop("_ip", "_h", "_early")


def in_scope(url: Column, domain: Column, subdomains: Column | bool) -> Column:
    """The allowed domain, its www host, or (if allowed) any subdomain; false for what is no URL."""
    host, d = url_host(url), F.regexp_replace(F.lower(domain), r"^www\.", "")
    return F.coalesce((host == d) | (host == F.concat(F.lit("www."), d)) | (F.lit(subdomains) & F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def matches_patterns(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include (if there are some) and no exclude matches path and query; false for what is no URL."""
    path, out = url_path_query(url), url_host(url).isNotNull()
    if include:
        hit = path.rlike(include[0])
        for p in include[1:]:
            hit = hit | path.rlike(p)
        out = out & hit
    for p in exclude:
        out = out & ~path.rlike(p)
    return F.coalesce(out, F.lit(False))


def ip4_number(text: Column) -> Column:
    """A dotted address as a long; null for anything else."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.try_cast("bigint"))
    good = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(parts, lambda x: x > 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))


def range_bounds(cidr: str) -> tuple[int, int]:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def screen_url(url: Column, trusted: list[str] | None = None, ports: list[int] | None = None) -> Column:
    """INVALID_URL, UNSUPPORTED_URL, BLOCKED_URL or null, by syntax, scheme, credentials, port, name and address."""
    s = F.trim(url)
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.coalesce(F.regexp_replace(url_host(s), r"^\[|\]$", ""), F.lit(""))
    port = F.coalesce(F.regexp_extract(authority, r":(\d+)$", 1).try_cast("int"), F.when(scheme == "https", 443).otherwise(80))
    trust = host.isin(trusted or [""]) & (host != "")
    number = ip4_number(host)
    private = F.lit(False)
    for lo, hi in map(range_bounds, BLOCKED_RANGES):
        private = private | number.between(lo, hi)
    six = host.contains(":")
    inner_six = six & ~host.rlike(r"^[23][0-9a-f]{3}:") & ~host.rlike(r"^64:ff9b::")
    named = host.isin(BLOCKED_NAMES) | host.rlike("(" + "|".join(x.replace(".", r"\.") for x in BLOCKED_SUFFIXES) + ")$") | ~host.contains(".")
    blocked = F.when(number.isNotNull(), private).when(six, inner_six).otherwise(named)
    return (
        F.when(s.isNull() | (s == "") | (F.length(url) > MAX_URL) | (scheme == ""), "INVALID_URL")
        .when(~scheme.isin("http", "https"), "UNSUPPORTED_URL").when(host == "", "INVALID_URL").when(authority.contains("@"), "UNSUPPORTED_URL")
        .when(~trust & (~port.isin(ports or ALLOWED_PORTS) | blocked), "BLOCKED_URL")
    )
