"""Colours, names, icons and logos of sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import top_k_per_key

# Weights of colour sources, carriers of a brand, thresholds in Lab distance, palette values that page builders ship.
SOURCE_WEIGHTS = {"buttons": 5.0, "logo": 4.0, "cssvar": 3.0, "header": 2.5, "links": 2.0, "headings": 2.0, "borders": 1.0, "background": 2.0, "footer": 1.5, "theme": 2.0, "screenshot": 1.5}
CARRIERS = ["buttons", "logo", "header", "cssvar"]
MERGE, DISTINCT_ROLE = 12.0, 20.0
BUILDER_DEFAULTS = [
    "#6EC1E4", "#54595F", "#7A7A7A", "#61CE70",
    "#0170B9", "#3A3A3A", "#4B4F58", "#F5F5F5", "#0274BE", "#046BD2", "#045CB4", "#1E293B", "#334155", "#F9FAFB", "#E2E8F0", "#CBD5E1", "#94A3B8",
    "#2B6CB0", "#3B3B3B", "#215387",
]
BRAND_VARIABLE, PRIMARY_VARIABLE = "primary|secondary|accent|brand|theme|global-color-0|palette1", "primary|global-color-0|palette1"


def colour_columns(df: DataFrame, colour: str) -> DataFrame:
    """R, g, b, hue, saturation, lightness, Lab and the neutral and tint flags of CSS colour text.

    Hex of 3, 4, 6 or 8 digits and rgb() / rgba(); what is mostly transparent or anything else goes.
    """
    s = F.lower(F.trim(colour))
    digits = F.regexp_extract(s, "^#([0-9a-f]{3,8})$", 1)
    wide = F.when(F.length(digits).isin(3, 4), F.regexp_replace(F.substring(digits, 1, 3), "(.)", "$1$1")).when(F.length(digits).isin(6, 8), digits)
    byte = lambda i: F.conv(F.substring(wide, i, 2), 16, 10).cast("int")
    parts = F.filter(F.split(F.regexp_extract(s, r"^rgba?\(([^)]+)\)$", 1), "[ ,/]+"), lambda x: x != "")
    num = lambda i: F.regexp_replace(F.get(parts, F.lit(i)), "%$", "").try_cast("double") * F.when(F.get(parts, F.lit(i)).endswith("%"), 2.55).otherwise(1.0)
    seen = (F.length(wide) < 8) | (byte(7) >= 128)
    alpha = F.coalesce(F.get(parts, F.lit(3)).try_cast("double"), F.lit(1.0))
    chan = lambda i: F.when(wide.isNotNull(), F.when(seen, byte(1 + 2 * i))).when((F.size(parts) >= 3) & (alpha >= 0.5), F.least(F.lit(255), F.greatest(F.lit(0), F.round(num(i)))).cast("int"))
    rows = df.withColumns({"r": chan(0), "g": chan(1), "b": chan(2)}).where("r is not null and g is not null and b is not null")
    n = lambda c: F.col(c) / 255.0
    hi, lo = F.greatest(n("r"), n("g"), n("b")), F.least(n("r"), n("g"), n("b"))
    d, light = hi - lo, (hi + lo) / 2
    sat = F.when(d == 0, 0.0).otherwise(d / F.when(light > 0.5, 2 - hi - lo).otherwise(hi + lo))
    hue = F.when(d == 0, 0.0).when(hi == n("r"), (n("g") - n("b")) / d + F.when(F.col("g") < F.col("b"), 6.0).otherwise(0.0)).when(hi == n("g"), (n("b") - n("r")) / d + 2).otherwise((n("r") - n("g")) / d + 4) * 60
    lin = lambda c: F.when(n(c) <= 0.04045, n(c) / 12.92).otherwise(F.pow((n(c) + 0.055) / 1.055, F.lit(2.4)))
    mix = lambda a, b, c: lin("r") * a + lin("g") * b + lin("b") * c
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    x, y, z = f(mix(0.4124, 0.3576, 0.1805) / 0.95047), f(mix(0.2126, 0.7152, 0.0722)), f(mix(0.0193, 0.1192, 0.9505) / 1.08883)
    rows = rows.withColumns({"h": hue, "s": sat, "l": light, "lab_l": 116 * y - 16, "lab_a": 500 * (x - y), "lab_b": 200 * (y - z)})
    neutral = (F.col("l") > 0.94) | (F.col("l") < 0.08) | (F.col("s") < 0.14) | ((F.col("s") < 0.25) & ((F.col("l") < 0.2) | (F.col("l") > 0.88)))
    return rows.withColumn("neutral", neutral).withColumn("tint", ~neutral & (F.col("l") >= 0.85)).withColumn("hex", F.upper(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in "rgb"])))


def scaled_weights(df: DataFrame, *keys: str, totals: dict[str, float] = SOURCE_WEIGHTS) -> DataFrame:
    """Weights scaled to each source's fixed total (1 where ``totals`` lacks it) within ``keys`` (site); sources without weight go."""
    total = F.sum("weight").over(Window.partitionBy(*(keys or ("site",)), "source"))
    table = F.create_map(*[F.lit(x) for kv in totals.items() for x in kv])
    return df.withColumn("_t", total).where("_t > 0").withColumn("weight", F.col("weight") / F.col("_t") * F.coalesce(F.element_at(table, F.col("source")), F.lit(1.0))).drop("_t")


def merge_colours(lab: np.ndarray, weight: np.ndarray, key: list, threshold: float) -> np.ndarray:
    """For each colour the row of its cluster's representative: heaviest first (ties by key), each joins the first within reach."""
    order = sorted(range(len(weight)), key=lambda i: (-weight[i], key[i]))
    heads: list[int] = []
    out = np.zeros(len(weight), int)
    for i in order:
        d = np.sqrt(((lab[heads] - lab[i]) ** 2).sum(axis=1)) if heads else np.zeros(0)
        near = np.flatnonzero(d < threshold)
        out[i] = heads[near[0]] if len(near) else i
        if not len(near):
            heads.append(i)
    return out


CLUSTERS = "site string, pool string, hex string, weight double, sources array<string>, place int, h double, s double, l double, neutral boolean, tint boolean, lab_l double, lab_a double, lab_b double"


def colour_clusters(weighted: DataFrame, threshold: float = MERGE) -> DataFrame:
    """Greedy clusters per site (and ``pool``, where the rows have one) of ``colour_columns`` rows, ties by the order of sources, then ``position`` (where the rows have one), then hex.

    ``place`` is a cluster's place by the weight of its representative, and breaks ties of clusters.  Equal colours of a source are summed first, so that what a site's task holds is bounded by its different colours (at most 2^24 a source).
    """
    missing = {"pool": F.lit(""), "position": F.lit(0)}
    weighted = weighted.withColumns({c: v for c, v in missing.items() if c not in weighted.columns})
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    out = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CLUSTERS.split(", ")])
    names = [f.name for f in out if f.name not in ("sources", "place")]
    sums = weighted.groupBy("site", "pool", "source", "hex").agg(F.sum("weight").alias("weight"), F.coalesce(F.min("position"), F.lit(0)).cast("long").alias("position"), *[F.first(c).alias(c) for c in names[4:]])
    order = {s: i for i, s in enumerate(SOURCE_WEIGHTS)}

    def run(t: pa.Table) -> pa.Table:
        d = t.to_pydict()
        lab = np.array([d["lab_l"], d["lab_a"], d["lab_b"]]).T
        key = [(order.get(s, len(order)), at, x) for s, at, x in zip(d["source"], d["position"], d["hex"])]
        head = merge_colours(lab, np.array(d["weight"]), key, threshold)
        rows = []
        for place, h in enumerate(sorted(np.unique(head), key=lambda i: (-d["weight"][i], key[i]))):
            own = np.flatnonzero(head == h)
            rows.append({**{k: d[k][h] for k in names}, "weight": float(sum(sorted(d["weight"][i] for i in own))), "sources": sorted({d["source"][i] for i in own}), "place": place})
        return pa.Table.from_pylist(rows, schema=out)

    return sums.select(*names, "source", "position").groupBy("site", "pool").applyInArrow(run, CLUSTERS)


def colour_pools(inputs: DataFrame) -> DataFrame:
    """Weighted colours of ``inputs(site, source, name, colour, weight, position)`` by what they decide.

    ``colours``: all that carries a brand.  Of CSS variables (source ``cssvar``, in the order of ``position``) only those
    named after a brand count, each value once, and none that a page builder ships.  ``ground``: background, screenshot and body;
    ``body``; ``text``: paragraphs, or source ``text`` where a site has none; ``variable``: the first variable named primary.
    """
    counts = inputs.withColumn("_paragraphs", F.max(F.col("source") == "paragraphs").over(Window.partitionBy("site")))
    rows = colour_columns(counts, "colour")
    own = rows.where(~F.coalesce(F.col("source") == "cssvar", F.lit(False)))
    named = rows.where((F.col("source") == "cssvar") & ~F.col("hex").isin(BUILDER_DEFAULTS))
    first_of = lambda df, *keys: df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("position", "name")).alias("_v")).select(*keys, "_v.*")
    brand = first_of(named.where(F.col("name").rlike(BRAND_VARIABLE)), "site", "colour").withColumn("weight", F.lit(1.0))
    first = first_of(named.where(F.col("name").rlike(PRIMARY_VARIABLE)), "site")
    pool = lambda df, name: df.withColumn("pool", F.lit(name))
    is_text = (F.col("source") == "paragraphs") | ((F.col("source") == "text") & ~F.col("_paragraphs"))
    parts = [
        scaled_weights(pool(own.where(F.col("source").isin(list(SOURCE_WEIGHTS))).unionByName(brand), "colours")),
        scaled_weights(pool(own.where(F.col("source").isin("background", "screenshot", "body")), "ground"), totals={"screenshot": 0.3, "body": 0.1}),
        pool(own.where("source = 'body'"), "body"), scaled_weights(pool(own.where(is_text), "text")), pool(first, "variable"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brand_colours(inputs: DataFrame) -> DataFrame:
    """A28 to A30 for all sites of ``inputs`` (see :func:`colour_pools`); a site without a readable colour has nulls, an empty palette and low confidence."""
    roles = brand_roles(colour_clusters(colour_pools(inputs)))
    rows = inputs.select("site").distinct().join(roles, "site", "left")
    none = F.array().cast(roles.schema["palette"].dataType)
    return rows.withColumns({"palette": F.coalesce("palette", none), "basis": F.coalesce("basis", F.lit("none")), "confidence": F.coalesce("confidence", F.lit("low"))})


def _heaviest(items: Column) -> Column:
    return F.get(F.array_sort(F.transform(items, lambda c: F.struct((-c["weight"]).alias("o"), c["place"].alias("place"), c["hex"].alias("hex"), c["lab_l"].alias("lab_l"), c["lab_a"].alias("lab_a"), c["lab_b"].alias("lab_b")))), F.lit(0))


def brand_roles(clusters: DataFrame) -> DataFrame:
    """Primary, secondary, accent, background and text of each site, a palette of eight, the basis and confidence.

    Scores are columns; roles that must differ are picked from each site's ranked clusters (ties by weight, then place).  Clusters without pools
    (``colour_clusters`` of plain rows) give the background from their own neutral or tinted surfaces and no text.
    """
    table = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])
    delta = lambda a, b: F.hypot(F.hypot(a["lab_l"] - b["lab_l"], a["lab_a"] - b["lab_a"]), a["lab_b"] - b["lab_b"])
    by_weight = lambda s: F.transform(F.array_sort(F.transform(s, lambda x: F.struct((-F.coalesce(F.element_at(table, x), F.lit(0.0))).alias("o"), x.alias("s")))), lambda x: x["s"])
    surface = lambda c: c["neutral"] | c["tint"]
    support = lambda c: F.size(F.array_remove(c["sources"], "screenshot"))
    names = [x.split()[0] for x in CLUSTERS.split(", ")[1:]]
    rows = clusters.groupBy("site").agg(F.collect_list(F.struct(*names)).alias("_all"))
    pool = lambda *p: F.filter("_all", lambda c: c["pool"].isin(*p))
    plain = F.filter(pool(""), lambda c: surface(c) & F.array_contains(c["sources"], "background"))
    ground = F.coalesce(_heaviest(F.filter(pool("ground"), surface)), _heaviest(pool("body")), _heaviest(plain))
    rows = rows.select("site", pool("", "colours").alias("_own"), ground.alias("_ground"), _heaviest(pool("text"))["hex"].alias("text"), _heaviest(pool("variable")).alias("_variable"))

    def score(c: Column) -> Column:
        has = lambda s: F.array_contains(c["sources"], s)
        carrier = F.arrays_overlap(c["sources"], F.array(*[F.lit(x) for x in CARRIERS]))
        role = (
            F.when(support(c) == 0, 0.0).when(~surface(c), F.when((support(c) >= 2) | has("buttons") | has("logo"), 1.0).otherwise(0.5))
            .when(c["tint"], F.when(carrier, 0.7).otherwise(0.3)).when((c["l"] < 0.4) & (has("buttons") | has("cssvar") | has("logo")), 0.45)
            .when(carrier & c["l"].between(0.4, 0.85), 0.25).otherwise(0.0)
        )
        hidden = F.coalesce((delta(c, F.col("_ground")) < 6) & ~has("buttons"), F.lit(False))
        named = F.coalesce(delta(c, F.col("_variable")) < MERGE, F.lit(False))
        return c["weight"] * role * F.when(hidden, 0.5).otherwise(1.0) * F.when(named, 1.5).otherwise(1.0)

    scored = F.transform("_own", lambda c: F.struct((-score(c)).alias("o"), (-c["weight"]).alias("w"), c["place"].alias("at"), *[c[n].alias(n) for n in names[1:]], support(c).alias("support")))
    rows = rows.withColumn("_scored", F.array_sort(scored)).withColumn("_good", F.filter("_scored", lambda c: c["o"] < 0)).withColumn("_p", F.get("_good", F.lit(0)))

    def distinct(a: Column, b: Column) -> Column:
        turn = F.abs(a["h"] - b["h"])
        return (delta(a, b) >= DISTINCT_ROLE) & ((a["neutral"] != b["neutral"]) | (F.least(turn, 360 - turn) >= 30) | (F.abs(a["l"] - b["l"]) >= 0.3))

    p, q = F.col("_p"), F.col("_q")
    rows = rows.withColumn("_others", F.filter("_good", lambda c: (c["hex"] != p["hex"]) & distinct(c, p)))
    coloured = F.filter("_others", lambda c: ~c["neutral"] & (c["o"] <= p["o"] * 0.15))
    rows = rows.withColumn("_q", F.coalesce(F.get(coloured, F.lit(0)), F.get("_others", F.lit(0))))
    accent = F.get(F.filter("_others", lambda c: ~c["neutral"] & (c["hex"] != q["hex"]) & distinct(c, q)), F.lit(0))
    margin = F.coalesce(F.try_divide(p["o"], F.get("_good", F.lit(1))["o"]), F.lit(3.0))
    strong = (p["support"] >= 3) | (F.array_contains(p["sources"], "buttons") & F.array_contains(p["sources"], "logo"))
    level = F.when(p.isNull(), "low").when(strong & (margin >= 1.2), "high").when(p["support"] >= 2, "medium").otherwise("low")
    heavy = F.filter("_own", lambda c: (support(c) >= 1) | (c["weight"] > 0.3))
    heavy = F.slice(F.array_sort(F.transform(heavy, lambda c: F.struct((-c["weight"]).alias("o"), c["place"].alias("place"), c["hex"].alias("hex"), c["sources"].alias("sources")))), 1, 8)
    palette = F.transform(heavy, lambda c: F.struct(c["hex"].alias("hex"), F.round(-c["o"], 2).alias("weight"), by_weight(c["sources"]).alias("sources")))
    return rows.select(
        "site", p["hex"].alias("primary"), q["hex"].alias("secondary"), accent["hex"].alias("accent"), F.col("_ground.hex").alias("background"), "text", palette.alias("palette"),
        F.coalesce(F.array_join(by_weight(p["sources"]), "+"), F.lit("none")).alias("basis"), level.alias("confidence"),
    )


@F.arrow_udf(T.StringType())
def _compatible(text: pa.Array) -> pa.Array:
    """Compatibility decomposition, which Spark has no expression for."""
    import unicodedata

    return pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in text.to_pylist()], pa.string())


def name_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def site_names(pages: DataFrame) -> DataFrame:
    """The title segment or logo text whose letters and digits spell the site's label or domain; mixed case beats all capitals.

    ``pages(url, title, texts)``; only non-ASCII texts meet Python.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), r"^www\d*\.", "")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    at = F.when((n >= 3) & F.get(labels, n - 2).isin("co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go", "gob"), n - 3).otherwise(n - 2)
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"(?i)\s*(official\s+)?(logo|home(page)?)$", ""), r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", ""))
    parts = F.concat(F.coalesce("texts", F.array().cast("array<string>")), F.split(F.coalesce("title", F.lit("")), r"\s*[|·»•]\s*|\s+[-–—]\s+|:\s+"))
    joined = F.array_join(F.transform(parts, clean), "\n")
    rows = pages.withColumn("_c", joined).withColumn("_d", F.when(joined.rlike(r"[^\x00-\x7F]"), _compatible(joined)).otherwise(joined))
    rows = rows.withColumn("_keys", F.filter(F.array(name_key(F.get(labels, at)), name_key(F.array_join(F.slice(labels, at + 1, n), ""))), lambda k: F.length(k) >= 3))
    pairs = F.zip_with(F.split("_c", "\n"), F.split("_d", "\n"), lambda c, d: F.struct(c.alias("c"), name_key(d).alias("k")))
    keys = F.col("_keys")
    rows = rows.withColumn("_ok", F.transform(F.filter(pairs, lambda x: F.length(x["c"]).between(2, 60) & F.array_contains(keys, x["k"])), lambda x: x["c"]))
    return rows.withColumn("site_name", F.coalesce(F.get(F.filter("_ok", lambda c: c.rlike(r"\p{Ll}")), F.lit(0)), F.get("_ok", F.lit(0)))).drop("_c", "_d", "_keys", "_ok")


def icon_size() -> Column:
    svg = F.coalesce(F.col("type").contains("svg"), F.lit(False)) | F.col("url").rlike(r"(?i)\.svg(\?|$)")
    return F.when(svg, 512).when(F.col("sizes").rlike(r"(?i)\d+x\d+"), F.regexp_extract("sizes", r"(?i)(\d+)x\d+", 1).cast("int")).when(F.col("rel").contains("apple-touch"), 180).otherwise(32)


def favicons(pages: DataFrame, icons: DataFrame) -> DataFrame:
    """One icon per page: tab icons before others, 32 to 64 pixels nearest 48, then larger, then small; a default without any."""
    s = icon_size()
    tab = F.col("rel").rlike(r"(^|\s)icon(\s|$)|shortcut") & ~F.col("rel").contains("apple") & ~F.col("rel").contains("mask")
    score = F.when(s.between(32, 64), 1000.0 - F.abs(s - 48)).when(s >= 64, 500 - s / 10).otherwise(s)
    pool = icons.where(~F.col("rel").contains("mask")).withColumn("_tab", tab).withColumn("_score", score)
    best = top_k_per_key(pool, "page_id", 1, F.desc("_tab"), F.desc("_score"), F.asc("url"))
    found = best.select("page_id", F.col("url").alias("icon"), F.lit("link").alias("icon_source"))
    default = F.concat(F.lower(F.regexp_extract("page_url", r"^([A-Za-z]+://[^/?#]+)", 1)), F.lit("/favicon.ico"))
    return pages.join(found, "page_id", "left").withColumn("icon", F.coalesce("icon", default)).withColumn("icon_source", F.coalesce("icon_source", F.lit("default")))


def logo_ink(palette: DataFrame) -> DataFrame:
    """Tone and up to four colours of a logo's ink (rows of ``colour_columns`` with site and weight)."""
    chroma = (F.col("s") > 0.3) & (F.col("l") > 0.15) & (F.col("l") < 0.85)
    rows = palette.withColumn("_c", chroma)
    share = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
    tones = rows.groupBy("site").agg(share(F.col("_c")).alias("c"), share(~F.col("_c") & (F.col("l") < 0.4)).alias("d"), share(~F.col("_c") & (F.col("l") > 0.75)).alias("w"))
    tones = tones.select("site", F.when(F.col("c") >= 0.3, "color").when(F.col("d") >= F.col("w"), "dark").otherwise("light").alias("tone"))
    merged = colour_clusters(palette.withColumn("source", F.lit("logo")), 18.0).withColumn("_c", chroma)
    merged = merged.where(F.col("weight") >= F.when(F.col("_c"), 0.03).otherwise(0.08))
    rank = F.when(F.col("_c"), F.col("weight") * 3).when((F.col("l") < 0.3) | (F.col("l") > 0.9), F.col("weight")).otherwise(F.col("weight") * 0.5)
    top = top_k_per_key(merged.withColumn("_r", rank), "site", 4, F.desc("_r"), F.asc("hex"))
    lists = top.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "hex"))), lambda x: x["hex"]).alias("colors"))
    return tones.join(lists, "site", "left")


def asset_key(url: Column) -> Column:
    """The file of a URL without host, size suffix and case."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]*:?//[^/?#]*", ""), r"[?#].*$", "")
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"-\d+x\d+(?=\.)", ""))


def choose_logo(candidates: DataFrame, declared: DataFrame, icons: DataFrame) -> DataFrame:
    """Per page the best candidate by score, else the declared logo, else the largest icon; a declared
    logo that is the same asset raises confidence.  ``candidates(page_id, url, score, strong)``, ``declared(page_id, url)``."""
    known = declared.groupBy("page_id").agg(F.min("url").alias("declared"), F.collect_set(asset_key(F.col("url"))).alias("assets"))
    best = candidates.groupBy("page_id").agg(F.max_by(F.struct("url", "score", "strong"), F.struct("score", F.col("url"))).alias("c"))
    largest = icons.groupBy("page_id").agg(F.max_by("url", F.struct(icon_size(), F.col("url"))).alias("icon"))
    rows = best.join(known, "page_id", "full").join(largest, "page_id", "full")
    dom = F.coalesce((F.col("c.score") >= 5) | ((F.col("c.score") >= 3) & F.col("declared").isNull()), F.lit(False))
    source = F.when(dom, "dom").when(F.col("declared").isNotNull(), "json-ld").when(F.col("icon").isNotNull(), "icon")
    rows = rows.withColumn("source", source).withColumn("url", F.when(dom, F.col("c.url")).otherwise(F.coalesce("declared", "icon")))
    own = F.when(dom, F.when((F.col("c.score") >= 9) & F.col("c.strong"), "high").when(F.col("c.score") >= 6, "medium").otherwise("low")).when(F.col("source") == "json-ld", "medium").otherwise("low")
    agreed = F.coalesce(F.array_contains("assets", asset_key(F.col("url"))), F.lit(False))
    return rows.select("page_id", "url", "source", F.when(agreed, "high").otherwise(own).alias("confidence")).where("source is not null")
