"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source form one stream, cut into equal blocks.  A source's target
is a quota of blocks.  A binary tree splits the quotas among output shards: at
each node the left half's share of every source is one multivariate
hypergeometric draw, seeded by the node, so that each shard can walk down on its
own.  Within a source the blocks of each pass are put in a keyed permutation and
a shard takes the next positions, so shards draw disjoint blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, as_text, free_names, quoted, running_start

#: A mix names weights per source, so sources are a small dimension; more than this is an error.
MAX_SOURCES = 100_000
#: Blocks in an output shard.
SHARD_BLOCKS = 1_024
SEGMENTS = "row_id long, source_no int, pass_no int, start long, length long, position long, window long"


@dataclass
class Quota:
    """One source's share: its stream of ``words`` in ``blocks`` of ``block`` words; ``quota`` blocks are drawn."""

    source: str | None
    words: int
    target: float
    block: int
    blocks: int
    quota: int


def share_targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Split ``total`` by weight; no share above ``most`` times its size, the excess reshared."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def quotas(words: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[Quota]:
    """Sources by code point, null last, weigh ``weights`` in turn."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    sizes = [words[s] for s in names]
    targets = share_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)
    coarse = max(1024, -(-sum(sizes) // 250_000_000))
    out = []
    for s, n, t in zip(names, sizes, targets, strict=True):
        block = min(coarse, max(1, n // 256))
        blocks = -(-n // block)
        full = int(most * blocks)
        out.append(Quota(s, n, t, block, blocks, full if t >= most * n else min(round(t / block), full)))
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): four Feistel rounds, walked until back within range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out, todo = np.uint64((1 << half) - 1), i.astype(np.uint64).copy(), np.arange(len(i))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            z = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + r) * 0xD1B54A32D192ED03 % 2**64)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z >> np.uint64(32)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def split_tree(have: np.ndarray, shards: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, blocks) of each source in shard ``k``: the walk from the root, whose node has the
    quotas ``have``, down to leaf k.  A node's left half is one multivariate hypergeometric draw."""
    lo, hi, at, own, total = 0, shards, np.zeros_like(have), have, int(have.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        slots = total * mid // shards - total * lo // shards
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, slots, method="marginals")
        if k < mid:
            hi, own = mid, left
        else:
            lo, at, own = mid, at + left, own - left
    return at, own


def shard_plan(spark, quota: list[Quota], shards: int, seed: int, width: list[int]) -> DataFrame:
    """(s, shard, lo, hi, w): the positions [lo, hi) of each source that each shard takes, a row
    for each window of ``width`` positions that they touch."""
    have, wide = np.array([q.quota for q in quota], np.int64), np.array(width, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at, own = split_tree(have, shards, k, seed)
                s = np.flatnonzero(own)
                lo, hi = at[s], (at + own)[s]
                first = lo // wide[s]
                many = (hi - 1) // wide[s] - first + 1
                i = np.repeat(np.arange(len(s)), many)
                w = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                cols = s[i].astype(np.int32), np.full(len(i), k), lo[i], hi[i], w
                yield pa.record_batch([pa.array(c) for c in cols], names=["s", "shard", "lo", "hi", "w"])

    tasks = min(shards, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "s int, shard long, lo long, hi long, w long")


def word_counts(docs: DataFrame, out: str = "size") -> DataFrame:
    """Documents with ``out``, the number of words (null text: 0)."""
    return docs.withColumn(out, F.regexp_count(as_text("text"), F.lit(WORD)).cast("long"))


def plan_mix(ws: Workspace, sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> tuple[DataFrame, list[Quota]]:
    """The mix of a saved table ``sized(row_id, doc_id, source, size)``, row_id unique.

    Returns rows (row_id, source_no, pass_no, start, length, shard, slot) -- words
    [start, start + length) of a document at a place in a shard, shuffled within
    the shard -- and the quotas.  A source with a large share of all rows is dealt to
    many buckets and blocks.  Documents without words are never drawn.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    quota = quotas({r["source"]: r["n"] or 0 for r in totals}, weights, share, most)
    shards = max(1, -(-sum(q.quota for q in quota) // shard_blocks))
    number = {q.source: i for i, q in enumerate(quota)}
    width = [max(1, -(-q.quota // shards)) for q in quota]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        for batch in batches:
            row, start, size = (batch.column(i).to_numpy() for i in (0, 2, 3))
            who = np.array([number[s] for s in batch.column(1).to_pylist()], np.int64)
            for s in np.unique(who):
                q, own = quota[s], np.flatnonzero(who == s)
                a, n = start[own], size[own]
                first, many = a // q.block, (a + n - 1) // q.block - a // q.block + 1
                at = np.repeat(np.arange(len(own)), many)
                block = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                lo, hi = np.maximum(block * q.block, a[at]), np.minimum((block + 1) * q.block, (a + n)[at])
                for p in range(-(-q.quota // max(q.blocks, 1))):
                    place = p * q.blocks + permuted(block, q.blocks, seed * 1_000_003 + int(s) * 64 + p)
                    got = place < q.quota
                    cols = row[own][at][got], np.full(got.sum(), s, np.int32), np.full(got.sum(), p, np.int32), (lo - a[at])[got], (hi - lo)[got], place[got], place[got] // width[s]
                    yield pa.record_batch([pa.array(c) for c in cols], names=names)

    placed = running_start(sized.where("size > 0"), "source", F.col("size"), ["doc_id", "size", "row_id"], "at", deal=["doc_id", "size"])
    drawn = placed.select("row_id", "source", "at", "size").mapInArrow(segments, SEGMENTS)
    plan = shard_plan(ws.spark, quota, shards, seed, width)
    hit = (F.col("source_no") == F.col("s")) & (F.col("window") == F.col("w")) & (F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "source_no", "position"), "source_no", "position", "row_id")
    mixed = drawn.join(plan, hit).withColumn("slot", F.row_number().over(local) - 1)
    return mixed.select("row_id", "source_no", "pass_no", "start", "length", "shard", "slot"), quota


def mix_summary(ws: Workspace, docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, its source's size and target, the words that the mix takes, and ``places``,
    where they go: (shard, slot, start, length) of each run of words, in the order of shards and slots.

    Null text and texts without words have no place; repeated rows are rows of their own; an empty
    table gives no rows.
    """
    thin = word_counts(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")).select("doc_id", "source", "size")
    sized = ws.save(thin.withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    mixed, quota = plan_mix(ws, sized, **options)
    taken = mixed.groupBy("row_id").agg(F.sum("length").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "slot", "start", "length"))).alias("places"))
    table = ws.spark.createDataFrame([(q.source, q.words, float(q.target)) for q in quota], "s string, source_size long, target double")
    rows = sized.join(taken, "row_id", "left").join(F.broadcast(table), sized["source"].eqNullSafe(table["s"]), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("places", F.array()).alias("places"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def take_words(text: str, parts: list[tuple[int, int]]) -> str:
    """The words of the given (start, length) runs with the white space between them."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    if sum(n for _, n in parts) == len(at) - 1:
        return text
    return "".join(text[at[a] : at[a + n]] for a, n in sorted(parts))


def mix_documents(ws: Workspace, docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``, shard by shard in the order of slots.

    A row holds the words of a document that one pass puts into one shard, so a document's
    rows repeat if it is taken twice or its words fall into several shards.  A shard is the work of
    one task, and its size is bounded.
    """
    mark = ws.mark()
    size, row, runs, shard, slot = free_names(docs, "_mix_size", "_mix_row", "_mix_runs", "_mix_shard", "_mix_slot")
    own = ws.save(word_counts(docs, size).withColumn(row, F.monotonically_increasing_id()), "numbered")
    thin = own.select(F.col(row).alias("row_id"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col(size).alias("size"))
    mixed, _ = plan_mix(ws, thin, **options)
    parts = mixed.groupBy("row_id", "pass_no", "shard").agg(F.collect_list(F.struct("start", "length")).alias(runs), F.min("slot").alias(slot))
    parts = parts.select(F.col("row_id").alias(row), runs, F.col("shard").alias(shard), slot)

    @F.udf("string", useArrow=True)
    def slice_text(text: str, runs: list) -> str:
        return take_words(text, [(r["start"], r["length"]) for r in runs])

    taken = own.join(parts, row).withColumn("text", slice_text(as_text("text"), runs))
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.length("text").cast("long"))
    taken = ws.save(taken.select(*quoted(docs), shard, slot), "taken")
    ws.release(mark, taken)
    placed = taken.repartition(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), shard).sortWithinPartitions(shard, slot)
    return placed.select(*quoted(docs))
