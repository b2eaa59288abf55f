"""Secrets in texts: fixed patterns, and character Markov models of random strings.

Positions come from the lengths of matches and of the text between them, all in
Spark's own expressions.  Long tokens outside the fixed patterns' spans are
scored by the log-likelihood ratio of two first-order Markov chains, one of random
strings and one of ordinary identifiers, trained from labelled samples.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text

# Kinds in order, their patterns, and the least characters (of group 2 for assign).
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same spans as AKIA[A-Z0-9]+ of 18 and more characters
HEX = r"[0-9a-f]{16,}"  # the same spans as [0-9a-f]+ of 16 and more characters
ASSIGN_LEAST = 12
#: Tokens that the models judge, and the characters they are made of.
TOKEN, TOKEN_LEAST = "[A-Za-z0-9+/_=-]", 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents that the model of ordinary strings is trained on (about so many, chosen by hash of the id;
#: that of random strings learns from all), and the ratio asked for.
TRAIN_DOCS = 5_000
THRESHOLD, PER_PAIR = 12.0, 0.5
#: Samples made by rule that join those of the corpus, so that no class is empty in a corpus without secrets.
LABELLED_EACH = 2_000
#: Items of a list that are summed up together.
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def with_prefix(df: DataFrame, items: str, out: str, value, combine) -> DataFrame:
    """Add ``out``: for each item of the array column ``items`` what ``combine`` makes of 0 and the ``value`` of
    all items before it.

    An array that grows item by item would be copied each time, so the items are taken in blocks: a block's
    result, then those of the blocks before each block, then within a block.
    """
    part, before, n = f"{out}_part", f"{out}_before", F.lit(BLOCK)
    fold = lambda xs, zero: F.aggregate(xs, zero, lambda a, x: combine(a, value(x)))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int") + F.when(F.size(items) == 0, 1).otherwise(0))
    df = df.withColumn(part, F.transform(blocks, lambda k: fold(F.slice(items, k * n + 1, n), F.lit(0))))
    df = df.withColumn(before, F.transform(part, lambda _, k: F.aggregate(F.slice(part, F.lit(1), k), F.lit(0), combine)))
    each = F.transform(items, lambda _, i: fold(F.slice(items, i - i % n + 1, i % n), F.get(before, F.floor(i / n).cast("int"))))
    # named twice, a column is worked out once, not again for each item
    return df.withColumn(out, F.when(F.size(before) > 0, each)).drop(part, before)


def with_spans(df: DataFrame, text: str, out: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> DataFrame:
    """Add ``out``: leftmost non-overlapping matches as array<struct<start, kind, end, value>>, positions in code
    points; matches whose ``group`` has fewer than ``least`` characters are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sized = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("size"), v.alias("value")))
    # one gap more than matches: the last pair has no match
    parts = F.filter(F.zip_with(sized, F.split(text, pattern, -1), lambda m, g: F.struct(F.coalesce(F.length(g), F.lit(0)).alias("gap"), m["size"].alias("size"), m["value"].alias("value"))), lambda m: m["size"].isNotNull())
    found, at = f"{out}_found", f"{out}_at"
    df = df.withColumn(found, F.when(F.col(text).rlike(pattern), parts).otherwise(F.array().cast("array<struct<gap:int,size:int,value:string>>")))
    df = with_prefix(df, found, at, lambda m: m["gap"] + m["size"], lambda a, x: a + x)
    one = lambda m, p: F.struct((p + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (p + m["gap"] + m["size"]).alias("end"), m["value"].alias("value"))
    return df.withColumn(out, F.filter(F.zip_with(found, at, one), lambda m: F.length(m["value"]) >= least).cast(SPAN)).drop(found, at)


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``_assign``, ``_access`` and ``_hex``, the spans of the fixed kinds."""
    df = with_spans(df, text, "_assign", ASSIGN, 0, 2, ASSIGN_LEAST)
    return with_spans(with_spans(df, text, "_access", ACCESS, 1), text, "_hex", HEX, 2)


def with_apart(df: DataFrame, base: str, tokens: str, out: str) -> DataFrame:
    """Add ``out``: of the spans ``tokens``, which do not overlap one another, those that overlap no span of ``base``.

    In the sorted list of both, fixed spans that start before a token are known by how far they reach; one
    that starts within it is the next item.
    """
    both, reach = f"{out}_both", f"{out}_reach"
    df = df.withColumn(both, F.when((F.size(base) > 0) & (F.size(tokens) > 0), F.array_sort(F.concat(base, tokens))).otherwise(F.array().cast(SPAN)))
    df = with_prefix(df, both, reach, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0), lambda a, x: F.greatest(a, x))
    items = F.zip_with(F.transform(both, lambda x, i: F.struct(x.alias("x"), F.get(both, i + 1)["start"].alias("next"))), reach, lambda m, r: F.struct(m["x"].alias("x"), m["next"].alias("next"), r.alias("reach")))
    free = F.filter(items, lambda m: (m["x"]["kind"] == 3) & (m["reach"] <= m["x"]["start"]) & (m["next"].isNull() | (m["next"] >= m["x"]["end"])))
    return df.withColumn(out, F.when(F.size(both) > 0, F.transform(free, lambda m: m["x"])).when(F.size(base) == 0, F.col(tokens)).otherwise(F.array().cast(SPAN))).drop(both, reach)


def base_values(text: Column) -> Column:
    """The values of all base spans, without their places."""
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.concat(F.filter(found(ASSIGN, 2), lambda v: F.length(v) >= ASSIGN_LEAST), found(ACCESS, 0), found(HEX, 0))


def train_markov(samples: DataFrame, smooth: float = 0.5) -> list[float] | None:
    """Log-likelihood ratios of character pairs from ``samples(value, random)``; None, with a warning, without both kinds.

    Spark counts the pairs; what is fetched is bounded by the alphabet squared.
    Pairs with a character outside the alphabet are passed over.
    """
    chars = F.split("value", "")
    pairs = samples.where("value is not null and random is not null and length(value) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(0), F.length("value") - 2), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1)))).alias("pair"))
    inside = pairs.where(F.col("pair").rlike(f"^{TOKEN}{{2}}$"))
    counts = {(r["random"], r["pair"]): r["count"] for r in inside.groupBy("random", "pair").count().collect()}
    if missing := {True, False} - {k[0] for k in counts}:
        names = " and ".join("random" if kind else "ordinary" for kind in sorted(missing, reverse=True))
        warnings.warn(f"no Markov models: there are no {names} strings to learn from, only the fixed patterns are used", stacklevel=2)
        return None
    table = []
    for a in ALPHABET:
        sums = {kind: sum(counts.get((kind, a + b), 0) + smooth for b in ALPHABET) for kind in (True, False)}
        table += [math.log((counts.get((True, a + b), 0) + smooth) / sums[True]) - math.log((counts.get((False, a + b), 0) + smooth) / sums[False]) for b in ALPHABET]
    return [round(x, 6) for x in table]


def likelihood_ratio(value: Column, table: list[float]) -> Column:
    """The sum of the table's entries over the character pairs of ``value``."""
    ratios, k = F.array(*[F.lit(x) for x in table]), len(ALPHABET)
    places = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    acc = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    more = lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.when((a["last"] > 0) & (x > 0), F.get(ratios, (a["last"] - 1) * k + x - 1)).otherwise(0.0)).alias("sum"))
    return F.aggregate(F.filter(places, lambda x: x > 0), acc, more, lambda a: a["sum"])


def corpus_samples(docs: DataFrame, about: int = TRAIN_DOCS) -> DataFrame:
    """Labelled samples (value, random): what the fixed patterns find in any document is random, other
    words of six and more letters and digits, of about ``about`` documents, are ordinary."""
    n = docs.count()
    random = docs.select(F.explode(base_values(as_text("text"))).alias("value"), F.lit(True).alias("random"))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // about))) == 0).select(as_text("text").alias("text"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = some.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9_-]{6,}"), F.lit(0))).alias("value"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


#: Parts of ordinary identifiers.
WORDS = (
    "get set user account name value index list item count page view model table column row query result error message event handler config option "
    "request response client server session cache buffer stream file path image color width height style class element node parent child update create delete insert "
    "select filter sort order group total number string object array function method return default public private static async callback listener render component layout "
    "button input form label title header footer content body text font border margin background animation frame device browser window document screen network memory process thread "
    "queue task job worker service factory builder manager controller provider resource template context state action reducer store module package version release"
).split()


def labelled_samples(spark: SparkSession, each: int = LABELLED_EACH) -> DataFrame:
    """Samples (value, random) made by rule: ``each`` digests in base64, its letters and digits only, and hex, and
    ``each`` identifiers of two to five words in camel case, with ``_`` or ``-`` between, or run together."""
    ids = spark.range(each)
    key = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    code = F.base64(F.unhex(key))
    random = ids.select(F.explode(F.array(code, F.translate(code, "+/=", ""), F.substring(key, 1, 40))).alias("value"), F.lit(True).alias("random"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = F.transform(F.sequence(F.lit(0), 1 + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(4)).cast("int")), lambda i: F.get(words, F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))).cast("int")))
    camel = F.array_join(F.transform("w", lambda w, i: F.when(i > 0, F.initcap(w)).otherwise(w)), "")
    joined = [camel, F.initcap(F.array_join("w", "")), *(F.array_join("w", x) for x in ("_", "-", "")), F.upper(F.array_join("w", "_"))]
    ordinary = ids.select("id", pick.alias("w")).select(F.explode(F.array(*joined)).alias("value"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def scan(docs: DataFrame, table: list[float] | None) -> DataFrame:
    """Per document the counts of fixed kinds, the digest of their spans, and all spans.

    Null text counts as empty.  Without a table only the fixed patterns are used.
    Tokens that overlap a fixed span are not judged again.  Repeated rows have a row each, an empty
    table none.  The work on a text is in proportion to its length and number of matches (sorted once),
    however long it is.
    """
    rows = docs.select(F.col("doc_id").cast("long"), as_text("text").alias("_t"))
    rows = with_base_spans(rows, "_t")
    rows = rows.withColumn("_base", F.flatten(F.array("_assign", "_access", "_hex")))
    more = F.array().cast(SPAN)
    if table is not None:
        need = lambda c: F.greatest(F.lit(THRESHOLD), PER_PAIR * (F.length(c["value"]) - 1))
        rows = with_spans(rows, "_t", "_token", f"{TOKEN}{{{TOKEN_LEAST},}}", 3)
        rows = with_apart(rows, "_base", "_token", "_apart")
        more = F.filter("_apart", lambda c: likelihood_ratio(c["value"], table) >= need(c))
    rows = rows.withColumn("_more", more)
    return rows.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("_base", "_more")).alias("spans"),
    )
