"""SimHash near-duplicates: fingerprints, and exact pairs by a forest of vantage-point trees.

Two fingerprints within ``limit`` bits agree to within ``limit // slices`` bits on
at least one of ``slices`` bit slices.  Each slice has a vantage-point tree over
the Hamming distance on that slice: a level has one vantage point and a radius;
a fingerprint goes inside or outside by its distance, and also outside where the
triangle inequality cannot rule out a partner there (inside, but within the
slice's tolerance of the radius).  The leaves are the shards, which overlap at the
boundaries.  Every linked pair so meets in a shard, where distances to a local vantage
point bound which pairs need their exact distance.

With 3 slices and a limit of 4 the tolerance is one bit: about 17 of 100 fingerprints
lie at a boundary, so a level leaves 0.585 of a node in each child.  That grows more
slowly in copies than one tree of tolerance 4, where 68 of 100 lie there, and unlike
more slices (tolerance 0) it has no greatest number of shards short of 2 to the 21.

``keep_one`` groups by Jaccard similarity, which fingerprints alone meet only in
part, and so takes a second set of shards: buckets of MinHash bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, as_text, blocked_links, components, free_names, linked_groups, quoted

SEED = 42
#: Fingerprints that the trees' vantage points and radii are fitted on, at most.
FIT_SAMPLE = 4096
#: Slices of a fingerprint, rows aimed at in a shard, and the share of a node that each child gets.
SLICES, LEAF_ROWS, SHRINK = 3, 64, 0.585
#: MinHash bands of ``keep_one`` and values in each: two sets of Jaccard similarity 0.8 share a bucket
#: with probability 1 - (1 - 0.8**5)**20 = 0.9996; fingerprints in a bucket are linked within so many bits.
BANDS, ROWS, BAND_LIMIT = 20, 5, 22
_rng = np.random.default_rng(SEED)
_MULT = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; none for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The number whose bits are those that more than half of ``h`` have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(h)))


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), as_text("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def least_values(h: np.ndarray) -> np.ndarray:
    """MinHash values of the shingle hashes ``h``, of which there is at least one."""
    v, out = (h >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(v), 1 << 13):
        low = (v[None, at : at + (1 << 13)] * _MULT + _ADD).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def bucket_ids(least: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket ids of ``least``, a row of MinHash values per document."""
    parts = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    ids = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        ids = (ids ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        ids = ids ^ (ids >> np.uint64(29))
    return ids.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, buckets) of the different word shingles; a text without words has fp 0 and no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            fps = np.array([majority(h) for h in sets], dtype=np.uint64).view(np.int64)
            least = [least_values(h) for h in sets if len(h)]
            ids = bucket_ids(np.array(least, np.uint32).reshape(-1, BANDS * ROWS)).ravel()
            ends = np.concatenate([[0], np.cumsum([BANDS * (len(h) > 0) for h in sets])]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.array(fps), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "fp", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), as_text("text").alias("text")).mapInArrow(run, "doc_id long, fp long, buckets array<long>")


def fit_forest(sample: np.ndarray, depth: int, slices: int, seed: int = 1) -> list[tuple[int, list[tuple[int, int]]]]:
    """Per slice (mask, [(vantage, radius) per level]), chosen for even shards on the sample."""
    rng, sample = np.random.default_rng(seed), sample.view(np.uint64)
    edges, forest = np.linspace(0, 64, slices + 1).round().astype(int), []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        mask = np.uint64(((1 << int(hi - lo)) - 1) << int(lo))
        codes, levels = np.zeros(len(sample), np.int64), []
        for _ in range(depth):
            best = None
            for v in rng.integers(0, 2**64, 12, dtype=np.uint64):
                d = np.bitwise_count((sample ^ v) & mask)
                r = int(np.median(d))
                for radius in (r - 1, r):
                    new = 2 * codes + (d > radius)
                    cost = int((np.unique(new, return_counts=True)[1].astype(np.int64) ** 2).sum())
                    if best is None or cost < best[0]:
                        best = (cost, int(v), radius, new)
            levels.append(best[1:3])
            codes = np.unique(best[3], return_inverse=True)[1]
        forest.append((int(mask), levels))
    return forest


def tree_depth(n: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels after which a shard of ``n`` fingerprints has about ``leaf_rows``."""
    return min(48, max(0, math.ceil(math.log(max(n, 1) / leaf_rows) / -math.log(SHRINK))))


def shards(fps: DataFrame, forest: list, tolerance: int) -> DataFrame:
    """(tree, leaf, fp): the shards that each distinct fingerprint visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for tree, (mask, levels) in enumerate(forest):
                at, leaf = np.arange(len(fp)), np.zeros(len(fp), np.int64)
                for vantage, radius in levels:
                    d = np.bitwise_count((fp[at] ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)
                    both = (d <= radius) & (d > radius - tolerance)
                    leaf = np.concatenate([2 * leaf + (d > radius), 2 * leaf[both] + 1])
                    at = np.concatenate([at, at[both]])
                yield pa.record_batch([pa.array(np.full(len(at), tree, np.int32)), pa.array(leaf), pa.array(fp[at].view(np.int64))], names=["tree", "leaf", "fp"])

    return fps.select("fp").mapInArrow(run, "tree int, leaf long, fp long")


def star_links(fp: np.ndarray, limit: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (centre, member) of each component of one shard's links.

    Pairs whose distances to the shard's vantage point differ by more than
    ``limit`` are passed over.  Members that a centre's component has reached are
    not compared again, so a dense group costs no pair list.
    """
    fp = np.unique(fp.view(np.uint64))
    d = np.bitwise_count(fp ^ fp[0])
    order = np.argsort(d, kind="stable")
    fp, d = fp[order], d[order].astype(np.int64)
    linked = np.zeros(len(fp), bool)
    for i in range(0, len(fp), rows):
        end = int(np.searchsorted(d, d[min(i + rows, len(fp)) - 1] + limit, "right"))
        near = np.bitwise_count(fp[i : i + rows, None] ^ fp[None, i:end]) <= limit
        near &= np.arange(end - i)[None, :] > np.arange(near.shape[0])[:, None]
        linked[i : i + rows] |= near.any(axis=1)
        linked[i:end] |= near.any(axis=0)
    left, a, b = fp[linked], [], []
    while len(left):
        centre, left = left[0], left[1:]
        front = np.array([centre], np.uint64)
        while len(front) and len(left):
            near = (np.bitwise_count(left[None, :] ^ front[:64, None]) <= limit).any(axis=0)
            got, left, front = left[near], left[~near], front[64:]
            a.append(np.full(len(got), centre))
            b.append(got)
            front = np.concatenate([front, got])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(a).view(np.int64), join(b).view(np.int64)


def links(ws: Workspace, fps: DataFrame, limit: int = 4, slices: int = SLICES, leaf_rows: int = LEAF_ROWS, block_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps(fp)`` that span the components of all
    pairs within ``limit`` bits; exact, no pair that would join two components is missed.

    A shard beyond ``block_rows`` is split into blocks, and each two blocks meet in
    a group of their own, so that no group grows with a dense region.
    """
    n = fps.count()
    depth = tree_depth(n, leaf_rows)
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(FIT_SAMPLE).collect()], np.int64)
    visits = shards(fps, fit_forest(sample, depth, slices), limit // slices)
    if n > block_rows:
        visits = ws.save(visits, "visits")
        large = visits.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / block_rows).alias("blocks")).where("blocks > 1")
        visits = visits.join(large, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks"))
        visits = visits.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        visits = visits.select("tree", "leaf", "fp", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    else:
        visits = visits.select("tree", "leaf", "fp", F.lit(0).alias("b1"), F.lit(0).alias("b2"))

    def run(t: pa.Table) -> pa.Table:
        a, b = star_links(t.column("fp").to_numpy(), limit)
        return pa.table({"a": a, "b": b})

    return visits.groupBy("tree", "leaf", "b1", "b2").applyInArrow(run, "a long, b long")


def bucket_links(ws: Workspace, visits: DataFrame, limit: int = BAND_LIMIT, block_rows: int = 20_000) -> DataFrame:
    """Links (a, b) that span the components of fingerprints within ``limit`` bits in each bucket of ``visits(bucket, fp)``.

    A row stays if a neighbour in its bucket differs, so that equal ones leave two at most; a bucket beyond ``block_rows`` is split as in :func:`links`.
    """
    w = Window.partitionBy("bucket").orderBy("fp")
    near = visits.withColumn("a", F.lag("fp").over(w)).withColumn("b", F.lead("fp").over(w))
    found = ws.save(near.where("a <> fp or b <> fp").select("bucket", "fp"), "buckets")
    large = found.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / block_rows).alias("blocks")).where("blocks > 1")
    dealt = found.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "fp")

    def linked(grp: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(grp)]]))
        first = np.repeat(fp[starts], sizes)
        close = np.bitwise_count((fp ^ first).view(np.uint64)) <= limit
        star = np.logical_and.reduceat(close, starts)
        some = np.repeat(star, sizes) & (fp != first)
        a, b = [first[some]], [fp[some]]
        for i in np.flatnonzero(~star & (sizes > 2)):
            x, y = star_links(fp[starts[i] : starts[i] + sizes[i]], limit)
            a.append(x)
            b.append(y)
        return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            grp, fp = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((grp, fp)))
            cut = int(np.searchsorted(grp, grp[-1])) if len(grp) else 0  # the last group may go on in the next batch
            if cut:
                yield linked(grp[:cut], fp[:cut])
                grp, fp = grp[cut:], fp[cut:]
        if len(grp):
            yield linked(grp, fp)

    dealt = dealt.repartition(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), "grp").sortWithinPartitions("grp", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(ws: Workspace, docs: DataFrame, limit: int = 4, width: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable by links).

    Null and wordless texts have fingerprint zero, which links like any other.
    Copies meet in one distinct fingerprint before any comparison.  A null doc_id
    keeps its row; it never is a component's id unless the component has no other.
    """
    fps = ws.save(fingerprints(docs, width), "fingerprints")
    reps = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(ws, ws.save(links(ws, reps, limit), "links"))
    linked = reps.join(roots, reps["fp"] == roots["node"])
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.select("fp", "root").join(ids, "root").select(F.col("fp").alias("f"), "component_id")
    found = reps.join(joined, reps["fp"] == joined["f"], "left").select(F.col("fp").alias("f"), F.coalesce("component_id", "least").alias("component_id"))
    found = ws.save(found, "component_ids")
    return fps.join(found, fps["fp"] == found["f"]).select("doc_id", "fp", "component_id")


def word_shingles(text: str, width: int = 5) -> set[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def keep_one(ws: Workspace, docs: DataFrame, limit: int = 4, width: int = 5) -> DataFrame:
    """Documents, with the columns of ``docs``, of which one stays of each group of near copies.

    Candidates are components of fingerprints within ``limit`` bits, and of those within
    ``BAND_LIMIT`` bits that share a MinHash bucket, which meets the pairs at the threshold
    that lie further apart; within these, documents are grouped by exact Jaccard similarity of 0.8 or more on word shingles.
    The document with the smallest doc_id (nulls last) stays.  Exact copies meet by
    digest before anything else; texts without words are one group.
    """
    mark = ws.mark()
    (name,) = free_names(docs, "_sim_row")
    own = ws.save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    thin = own.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text"))
    marked = ws.save(sketches(thin.select(F.col("row").alias("doc_id"), "text"), width), "fingerprints").withColumnRenamed("doc_id", "frow")
    digests = thin.select("row", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    units = digests.groupBy("digest").agg(first).select("first", F.col("first.row").alias("id"))
    units = ws.save(units.join(marked, F.col("id") == F.col("frow")).select("id", "first", "fp", "buckets"), "units")
    fps = ws.save(units.select("fp").distinct(), "distinct")
    shared = bucket_links(ws, units.select(F.explode("buckets").alias("bucket"), "fp"))
    roots = components(ws, ws.save(links(ws, fps, limit).unionByName(shared), "near"))
    grouped = units.join(roots, F.col("fp") == F.col("node"), "left").select("id", F.coalesce("root", "fp").alias("grp"))
    grouped = ws.save(grouped, "groups")
    several = grouped.groupBy("grp").count().where("count > 1").select("grp")
    members = ws.save(grouped.join(several, "grp"), "members")
    texts = ws.save(thin.select(F.col("row").alias("id"), "text").join(members.select("id").hint("shuffle_hash"), "id", "left_semi"), "texts")
    same = components(ws, ws.save(blocked_links(ws, members, texts, linked_groups(lambda t: word_shingles(t, width))), "links"))
    linked = units.select("id", "first").join(same, F.col("id") == F.col("node"))
    best = linked.groupBy("root").agg(F.min("first").alias("kept")).select("root", F.col("kept.row").alias("kept"))
    gone = linked.join(best, "root").where("id <> kept").select(F.col("id").alias("gone"))
    kept = ws.save(units.join(gone, F.col("id") == F.col("gone"), "left_anti").select(F.col("id").alias(name)), "kept")
    ws.release(mark, own, kept)
    return own.join(kept.hint("shuffle_hash"), name, "left_semi").select(*quoted(docs))


def hex_fingerprint(fp: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
