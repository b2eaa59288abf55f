"""Quality rules: native text statistics, and decision lists learned from labelled ones.

A rule is a conjunction of thresholds on statistics that rejects a document; the
list is tried in order and what no rule rejects is kept.  Rules are found by
sequential covering: each is grown on one part of the labelled rows by the gain
in information about rejected rows, pruned on the other part, and its rows are set
aside before the next.  Learning reads counts of binned statistics, which Spark
groups; the list is emitted as one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Workspace, as_text, free_names

#: Labelled rows that a list is learned from, at most, and thresholds tried per statistic and label.
MAX_LABELLED = 20_000
CUTS = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.995, 1.0]
STATISTICS = ["n_words", "word_length", "n_symbols", "symbol_rate", "n_marks", "n_bars", "caps_rate", "n_caps", "n_adjacent", "n_repeat_words", "repeat_rate", "n_dup_lines"]
WINDOW = 8


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the statistics, each named with ``prefix``, of the whole text (null: empty) as columns.

    Words are runs of characters other than ASCII white space.  Windows of
    repeated words are found by 64-bit hashes within the text; only texts that hold
    an equal pair sort theirs.
    """
    _t, _w, _h, _v, _s, _p, _l = free_names(docs, "_t", "_w", "_h", "_v", "_s", "_p", "_l")
    t, n = F.col(_t), F.size(_w)
    out = docs.withColumn(_t, as_text(text))
    trimmed = F.btrim(_t, F.lit(" \t\n\x0b\x0c\r"))
    out = out.withColumn(_w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK}]+")))
    out = out.withColumn(_h, F.transform(_w, lambda w: F.xxhash64(w)))
    h = F.col(_h)
    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    out = out.withColumn(_v, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    ordered = F.array_sort(F.transform(_v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(_s, F.when(F.size(F.array_distinct(_v)) < F.size(_v), ordered))
    s = F.col(_s)
    again = F.filter(_s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
    out = out.withColumn(_p, F.array_sort(F.transform(again, lambda x: x["i"])))
    p = F.col(_p)
    covered = F.transform(_p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1), x + WINDOW) - x))
    lines = F.filter(F.split(_t, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    out = out.withColumn(_l, lines)
    same = F.filter(F.transform(_h, lambda x, i: F.get(h, i + 1) == x), lambda x: x)
    without = lambda x: F.octet_length(_t) - F.octet_length(F.replace(t, F.lit(x), F.lit("")))
    values = {
        "n_words": n, "word_chars": F.length(_t) - F.regexp_count(_t, F.lit(f"[{BLANK}]")), "n_symbols": F.regexp_count(_t, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(_l) - F.size(F.array_distinct(_l)), "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)),
        "n_marks": without("!"), "n_bars": without("|"), "n_caps": F.regexp_count(_t, F.lit("[A-Z]")), "n_adjacent": F.size(same),
    }
    out = out.withColumns({prefix + k: v.cast("long") for k, v in values.items()}).drop(_t, _w, _h, _v, _s, _p, _l)
    c = lambda k: F.col(prefix + k)
    rates = {"word_length": c("word_chars") / F.greatest(c("n_words"), F.lit(1)), "symbol_rate": c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
             "caps_rate": c("n_caps") / F.greatest(c("word_chars"), F.lit(1)), "repeat_rate": c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1))}
    return out.withColumns({prefix + k: v.cast("double") for k, v in rates.items()})


@dataclass(frozen=True)
class Term:
    """``statistic > bound`` or ``statistic <= bound``."""

    statistic: str
    above: bool
    bound: float

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.statistic)
        return c > self.bound if self.above else c <= self.bound


def learn_cells(cells: np.ndarray, bad: np.ndarray, good: np.ndarray, max_terms: int = 4, max_rules: int = 16, precision: float = 0.95) -> list[list[tuple[int, bool, int]]]:
    """Sequential covering over cells (bin numbers per statistic) with counts of rejected and kept
    rows, column 0 to grow and column 1 to prune.  Terms are (statistic, above, bin)."""
    bad, good, rules = bad.astype(float), good.astype(float), []
    bins = [np.unique(cells[:, j]) for j in range(cells.shape[1])] if len(cells) else []
    live = np.ones(len(cells), bool)
    holds = lambda term: cells[:, term[0]] > term[2] if term[1] else cells[:, term[0]] <= term[2]
    while len(rules) < max_rules and bad[live, 0].sum() > 0:
        inside, terms = live.copy(), []
        while len(terms) < max_terms and good[inside, 0].sum() > 0:
            p0, n0 = bad[inside, 0].sum(), good[inside, 0].sum()
            best, gain = None, 1e-9
            for j, values in enumerate(bins):
                for v in values[:-1].tolist():
                    side = cells[:, j] > v
                    for above in (True, False):
                        now = inside & (side if above else ~side)
                        p, n = bad[now, 0].sum(), good[now, 0].sum()
                        if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = (j, above, v), g
            if best is None:
                break
            terms.append(best)
            inside &= holds(best)
        if not terms:
            break

        def worth(kept: list) -> float:
            now = live.copy()
            for t in kept:
                now &= holds(t)
            p, n = bad[now, 1].sum(), good[now, 1].sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms = terms[:-1]
        inside = live.copy()
        for t in terms:
            inside &= holds(t)
        p, n = bad[inside].sum(), good[inside].sum()
        if p < 2 or p / (p + n) < precision:
            break
        rules.append(terms)
        live &= ~inside
    return rules


def learn(ws: Workspace, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[list[Term]]:
    """An ordered list of reject rules from ``labels.quality``; empty without labels of both kinds.

    At most ``limit`` label rows, in hash order, are read, with their whole texts.
    """
    told = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_q")).where("_id is not null and _q in (0, 1)")
    told = told.orderBy(F.xxhash64("_id"), "_id", "_q").limit(limit)
    known = docs.select("doc_id", "text").join(F.broadcast(told), F.col("doc_id") == F.col("_id")).select("_id", "_q", "text")
    rows = ws.save(with_statistics(known).drop("text").withColumn("_part", (F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(3)) == 0).cast("int")), "labelled")
    marks = rows.groupBy("_q").agg(*[F.percentile_approx(F.col(s).cast("double"), CUTS, 1000).alias(s) for s in STATISTICS]).collect()
    if len(marks) < 2:
        return []
    cuts = {s: sorted({float(v) for r in marks for v in r[s]}) for s in STATISTICS}
    binned = [sum((F.when(F.col(s) > v, 1).otherwise(0) for v in cuts[s]), F.lit(0)).alias(s) for s in STATISTICS]
    grouped = rows.select(*binned, "_part", "_q").groupBy(*STATISTICS, "_part", "_q").count().collect()
    grouped.sort(key=tuple)
    at: dict[tuple, int] = {}
    for r in grouped:
        at.setdefault(tuple(r[s] for s in STATISTICS), len(at))
    counts = np.zeros((2, len(at), 2))
    for r in grouped:
        counts[r["_q"], at[tuple(r[s] for s in STATISTICS)], r["_part"]] += r["count"]
    found = learn_cells(np.array(list(at)), counts[0], counts[1])
    # a bin number b counts the cuts below a value: "b > v" is "value > cuts[v]", "b <= v" is "value <= cuts[v]"
    return [[Term(STATISTICS[j], above, cuts[STATISTICS[j]][v]) for j, above, v in rule] for rule in found]


def verdict(rules: list[list[Term]], prefix: str = "") -> Column:
    """True where no rule rejects: the ordered list as one conditional expression."""
    out = None
    for rule in rules:
        hit = rule[0].column(prefix)
        for term in rule[1:]:
            hit = hit & term.column(prefix)
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(ws: Workspace, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Per document the base statistics, base_failed, and kept by base rules and learned list."""
    rules = learn(ws, docs, labels, limit)
    rows = with_statistics(docs.select(F.col("doc_id").cast("long"), "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
