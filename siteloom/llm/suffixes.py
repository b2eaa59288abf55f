"""Removal of byte strings that repeat across documents, by sorting suffixes.

Any two equal strings of ``length`` bytes hold an equal anchor, the k-mer with the
least hash within them, at the same place, so the suffixes to sort are those that
start at anchors; suffixes with an equal anchor are dealt to one shard, which is the
first step of the sort.  In a shard the suffixes, and the reversed prefixes before
them, are put in order by deep-shallow sorting: multikey quicksort, eight bytes a
word, to a shallow depth, then a blind trie for each group that still ties.  Common-prefix lengths of neighbours then tell which strings around an anchor
are equal, and the smallest doc_id that has each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_text

LENGTH, ANCHOR = 50, 20
#: Depth in bytes that multikey quicksort goes to before blind tries take over.
SHALLOW = 16
#: Bytes worked on at once: arrays of this many longs stay in a core's cache.
_PIECE = 1 << 17
#: Common anchors (a long each) that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))
_MULT = _mixed(np.arange(1001, 1129, dtype=np.uint64)) | _U(1)


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers, built from those of half the length."""
    h, have, done, at = _BYTES[data], 1, None, 0
    while have <= k:
        if k & have:
            n = len(data) - at - have + 1
            done, at = (h[:n].copy() if done is None else done[:n] * _MULT[64 + have] + h[at : at + n]), at + have
        if 2 * have > k:
            break
        n = len(h) - have
        h, have = h[:n] * _MULT[have] + h[have:], 2 * have
    done ^= done >> _U(32)
    done *= _U(0xBF58476D1CE4E5B9)
    return done ^ (done >> _U(29))


def _piece_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, position, hash, first, last) of the anchors of texts that lie at [starts, ends) of ``data``."""
    width, n = length - k + 1, len(data) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5
    h = kmer_hashes(data, k)
    low = (h & _U(~0xFFFFFF & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: have - width], low[width - have :])
    at = (low & _U(0xFFFFFF)).astype(np.int64)[:n]
    many = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), many)
    s = np.arange(len(text)) + np.repeat(starts - (np.cumsum(many) - many), many)
    at = at[s]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])[: len(at)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    own = starts[text[first]]
    return text[first], at[first] - own, h[at[first]].view(np.int64), s[first] - own, s[last] - own


def anchors(texts: list[bytes], length: int = LENGTH, k: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks (text number, position, hash, first, last): the strings of ``length`` bytes of a text that
    start in [first, last] have the k-mer at the position as their least (the leftmost of equal ones)."""
    held: list[int] = []
    size = 0

    def work() -> tuple[np.ndarray, ...]:
        lens = np.array([len(texts[i]) for i in held])
        ends = np.cumsum(lens)
        text, *rest = _piece_anchors(np.frombuffer(b"".join(texts[i] for i in held), np.uint8), ends - lens, ends, length, k)
        return np.array(held)[text], *rest

    for i, t in enumerate(texts):
        if len(t) > 8 * _PIECE:  # in parts that overlap by all but the first byte of a string
            for a in range(0, len(t) - length + 1, 4 * _PIECE):
                part = np.frombuffer(t, np.uint8)[a : a + 4 * _PIECE + length - 1]
                text, at, h, first, last = _piece_anchors(part, np.array([0]), np.array([len(part)]), length, k)
                yield text + i, at + a, h, first + a, last + a
        elif len(t) >= length:
            held.append(i)
            size += len(t)
            if size > _PIECE:
                yield work()
                held, size = [], 0
    if held:
        yield work()


def blind_trie_order(strings: list[bytes], skip: int = 0) -> list[int]:
    """The order of different byte strings that agree in their first ``skip`` bytes.

    Nodes keep only the place where they branch; a string goes down by the bytes at
    these places, is compared once with the leaf it meets, and is put where it parts.
    """
    root: list | int = 0
    for new in range(1, len(strings)):
        s, node = strings[new], root
        while isinstance(node, list):
            at, kids = node
            node = kids.get(s[at] if at < len(s) else -1)
            if node is None:
                node = next(iter(kids.values()))
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        t, part = strings[node], skip
        end = min(len(s), len(t))
        while part < end and s[part] == t[part]:
            part += 1
        up, node = None, root
        while isinstance(node, list) and node[0] < part:
            up, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        own = s[part] if part < len(s) else -1
        if isinstance(node, list) and node[0] == part:
            node[1][own] = new
            continue
        made = [part, {(t[part] if part < len(t) else -1): node, own: new}]
        if up is None:
            root = made
        else:
            up[1][s[up[0]] if up[0] < len(s) else -1] = made
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def multikey_quicksort(words: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order rows by ``group`` and then by their first ``depth`` words, and where rows still tie:
    (order, starts, sizes) of the runs of two and more rows that agree in all of these.

    Three-way partition as in a quicksort of strings: a segment's rows are dealt by one word to
    less, equal and greater than a pivot (the median of three); the equal ones go on with the next word.  All
    segments are partitioned together, pass by pass.
    """
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    start, size = cuts, np.diff(np.concatenate([cuts, [len(order)]]))
    level, ties = np.zeros(len(start), np.int64), []
    while True:
        done = (level >= depth) & (size > 1)
        ties.append((start[done], size[done]))
        more = (level < depth) & (size > 1)
        start, size, level = start[more], size[more], level[more]
        if not len(start):
            break
        first = np.cumsum(size) - size  # of each segment among the rows of this pass
        seg = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(seg)) + (start - first)[seg]
        rows = order[place]
        word = words[rows, level[seg]]
        a, b, c = word[first], word[first + size // 2], word[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        less, same = word < pivot, word == pivot
        n_less, n_same = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(same, first, dtype=np.int64)
        more = ~(less | same)
        rank = lambda hit: np.cumsum(hit) - np.concatenate([[0], np.cumsum(hit)[first[1:] - 1]])[seg] - 1
        to = np.where(less, rank(less), np.where(same, n_less[seg] + rank(same), (n_less + n_same)[seg] + rank(more)))
        order[start[seg] + to] = rows
        start = np.concatenate([start, start + n_less, start + n_less + n_same])
        size = np.concatenate([n_less, n_same, size - n_less - n_same])
        level = np.concatenate([level, level + 1, level])
    start, size = (np.concatenate(x) for x in zip(*ties, strict=True))
    return order, start, size


def deep_shallow_order(strings: np.ndarray, group: np.ndarray | None = None, shallow: int = SHALLOW) -> np.ndarray:
    """The order, within each ``group``, of the rows of a byte matrix whose width is a multiple of eight:
    multikey quicksort to ``shallow`` bytes, blind tries for the different strings of what ties."""
    words = strings.view(">u8").astype(np.uint64)
    group = np.zeros(len(strings), np.int64) if group is None else group
    order, start, size = multikey_quicksort(words, group, min(shallow // 8, words.shape[1]))
    for a, n in zip(start.tolist(), size.tolist(), strict=True):
        rows, same = order[a : a + n], {}
        for r in rows.tolist():
            same.setdefault(strings[r].tobytes(), []).append(r)
        if len(same) > 1:
            keys = list(same)
            order[a : a + n] = [r for i in blind_trie_order(keys, shallow) for r in same[keys[i]]]
        else:
            order[a : a + n] = next(iter(same.values()))
    return order


def _neighbours(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order within groups, and the common prefix of each row with the one before it in that order
    (-1 where a group begins)."""
    order = deep_shallow_order(strings, group)
    equal = strings[order[1:]] == strings[order[:-1]]
    common = np.where(equal.all(axis=1), strings.shape[1], equal.argmin(axis=1)) if len(equal) else np.zeros(0, np.int64)
    common = np.where(group[order][1:] == group[order][:-1], common, -1)
    return order, np.concatenate([[-1], common])


def smaller_owners(left: np.ndarray, right: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context of a shard the runs (d1, d2) of distances before its anchor at which the string
    that starts there also has a smaller owner.

    ``left`` holds reversed bytes before the anchor, ``right`` bytes from it on, ``group``
    the anchor's number; lo and hi bound the distances that are the anchor's own.
    """
    n = len(owner)
    parts = []
    for side in (right, left):
        parts.append(_neighbours(side, group))
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    open_ = np.full(n, -1)
    for d in range(int(lo.min()), int(hi.max()) + 2):
        covered = np.zeros(n, bool)
        rows = np.flatnonzero((lo <= d) & (d <= hi))
        if len(rows):
            ids = []
            for (order, common), need in zip(parts, (length - d, d), strict=True):
                run = np.empty(n, np.int64)
                run[order] = np.cumsum(common < need)
                ids.append(run)
            key = (ids[0] * (n + 1) + ids[1])[rows]
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            least = np.minimum.reduceat(owner[rows][order], starts)
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            covered[rows[order]] = np.repeat(least, sizes) < owner[rows][order]
        for r in np.flatnonzero(covered & (open_ < 0)).tolist():
            open_[r] = d
        for r in np.flatnonzero(~covered & (open_ >= 0)).tolist():
            out[r].append((int(open_[r]), d - 1))
            open_[r] = -1
    return out


def contexts(t: pa.Table, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrices (reversed bytes before the anchor, bytes from it on) of ``ctx``, whose first ``before``
    bytes stand before the anchor; filled with zeros to a multiple of eight."""
    width, n = -(-length // 8) * 8, t.num_rows
    left, right = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
    for i, (c, hi) in enumerate(zip(t.column("ctx").to_pylist(), t.column("before").to_pylist(), strict=True)):
        b = np.frombuffer(c, np.uint8)
        left[i, :hi] = b[:hi][::-1]
        right[i, : len(b) - hi] = b[hi:]
    return left, right


def distinct_contexts(t: pa.Table) -> pa.Table:
    """Of equal contexts (g, h, sid, lo) the one with the smallest owner, sorted by these."""
    keys = [t.column(c).to_numpy() for c in ("owner", "lo", "sid", "h", "g")]
    order = np.lexsort(keys)
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys[1:]], axis=0)])
    return t.take(pa.array(order[new]))


def decide_shard(t: pa.Table, length: int = LENGTH) -> pa.Table:
    """Of contexts (g, h, sid, ctx, before, lo, hi, owner), g the group that may hold equal strings, each
    different one once: its smallest owner, ``first``, and ``runs``, distances with a smaller owner still."""
    t = distinct_contexts(t)
    left, right = contexts(t, length)
    group = np.unique(t.column("g").to_numpy(), return_inverse=True)[1]
    runs = smaller_owners(left, right, group, t.column("lo").to_numpy(), t.column("hi").to_numpy(), t.column("owner").to_numpy(), length)
    flat = pa.array([[x for r in one for x in r] for one in runs], pa.list_(pa.int32()))
    return pa.table({"h": t.column("h"), "sid": t.column("sid"), "first": t.column("owner"), "runs": flat})


def distinct_texts(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, units): thin rows (doc_id, key), and each different text once as (u, key, owner, data),
    owner its smallest doc_id (null if it has none).  Copies are collapsed map-side by digest."""
    body = F.encode(as_text("text"), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long"), body.alias("data")).withColumn("key", F.unhex(F.md5("data")))
    units = rows.groupBy("key").agg(F.min("doc_id").alias("owner"), F.first("data").alias("data"))
    units = ws.save(units.withColumn("u", F.monotonically_increasing_id()), "texts")
    return ws.save(rows.select("doc_id", "key"), "rows"), units


def repeated_strings(ws: Workspace, units: DataFrame, length: int = LENGTH, k: int = ANCHOR, shard_rows: int = 20_000) -> DataFrame:
    """(u, cuts): per text the byte ranges [start, end, ...] covered by a string of ``length`` bytes
    that also starts in a text with a smaller owner.

    Anchors held by one text only cannot matter.  The others are found by a
    map-side aggregated least and greatest text per hash, which is joined back (a very
    common anchor is split by the adaptive skew join).  Equal contexts of a batch are
    one row before the shuffle and one in the sort, however many texts hold them.
    """
    owned = units.where(f"owner is not null and octet_length(data) >= {length}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(0).to_numpy()
            for text, at, h, _, _ in anchors(batch.column(1).to_pylist(), length, k):
                yield pa.record_batch([pa.array(u[text]), pa.array(h), pa.array(at.astype(np.int32))], names=["u", "h", "at"])

    found = owned.select("u", "data").mapInArrow(find, "u long, h long, at int")
    shared = found.groupBy("h").agg(F.min("u").alias("a"), F.max("u").alias("b")).where("a <> b").select("h")
    shared = ws.save(shared, "shared-anchors")
    places = found.join(shared, "h").groupBy("u").agg(F.sort_array(F.collect_list("at")).alias("places"))
    placed = ws.save(places, "places")
    ws.drop(shared)
    places = placed.withColumnRenamed("u", "pu")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, owner, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            wide = max([0, *map(len, texts)]) + 1
            places = batch.column(3)
            wanted = np.sort(np.repeat(np.arange(len(u)), pc.list_value_length(places).to_numpy()) * wide + places.flatten().to_numpy())
            parts, ctx = [], []
            for text, at, h, first, last in anchors(texts, length, k):
                mark = text * wide + at
                keep = wanted[np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)] == mark
                text, at, h, first, last = text[keep], at[keep], h[keep], first[keep], last[keep]
                ctx += [texts[i][a:b] for i, a, b in zip(text.tolist(), first.tolist(), (last + length).tolist(), strict=True)]
                parts.append((text, at, h, (at - last).astype(np.int32), (at - first).astype(np.int32)))
            if not ctx:
                continue
            text, at, h, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
            seeds = ((lo.astype(np.int64) << 8) + hi).tolist()
            sid = np.array([xxhash.xxh3_64_intdigest(c, x) for c, x in zip(ctx, seeds, strict=True)], np.uint64).view(np.int64)
            # of equal contexts of a batch only the one with the smallest owner carries the bytes
            order = np.lexsort((owner[text], sid, h))
            first = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (sid[order][1:] != sid[order][:-1])])
            mute = np.ones(len(ctx), bool)
            mute[order[first]] = False
            cols = [u[text], owner[text], at, h, sid, lo, hi]
            body = pa.array([None if m else c for m, c in zip(mute.tolist(), ctx, strict=True)], pa.binary())
            yield from pa.table([*map(pa.array, cols), body], names=["u", "owner", "at", "h", "sid", "lo", "hi", "ctx"]).to_batches(50_000)

    schema = "u long, owner long, at long, h long, sid long, lo int, hi int, ctx binary"
    marked = owned.select("u", "owner", "data").join(places.hint("shuffle_hash"), F.col("u") == F.col("pu")).select("u", "owner", "data", "places")
    marked = ws.save(marked.mapInArrow(cut, schema), "contexts")
    ws.drop(placed)
    different = marked.where("ctx is not null").select("h", "sid", "lo", "hi", "ctx", "owner")
    n = marked.count()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of about ``shard_rows`` together; of a larger one only its different contexts are held."""
        held, rows, most = [], 0, shard_rows
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > most:
                t = pa.concat_tables(held)
                g = t.column("g").to_numpy()
                end = int(np.searchsorted(g, g[-1], "left"))
                if end:
                    yield from decide_shard(t.slice(0, end), length).to_batches()
                t = distinct_contexts(t.slice(end)).combine_chunks()
                held, rows, most = [t], t.num_rows, max(shard_rows, 2 * t.num_rows)
        if rows:
            yield from decide_shard(pa.concat_tables(held), length).to_batches()

    parts = max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (8 * shard_rows)))
    # an anchor with very many contexts is dealt by more of the string: by what follows it for
    # starts near the anchor, by what precedes it for the others
    near = (length - k) // 2
    common = ws.save(marked.groupBy("h").count().where(F.col("count") > shard_rows).select(F.col("h").alias("ch")), "common-anchors")
    common = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    many, hi = F.col("ch").isNotNull(), F.col("hi")
    after = F.struct(F.xxhash64("h", F.lit(1), F.substring(F.col("ctx"), hi + 1, F.lit(length - near))).alias("g"), F.col("lo").alias("lo"), F.least(hi, F.lit(near)).alias("hi"))
    before = F.struct(F.xxhash64("h", F.lit(2), F.substring(F.col("ctx"), hi - near, F.lit(near + 1 + k))).alias("g"), F.greatest("lo", F.lit(near + 1)).alias("lo"), hi.alias("hi"))
    halves = F.filter(F.array(after, before), lambda x: x["lo"] <= x["hi"])
    dealt = different.join(common, F.col("h") == F.col("ch"), "left").withColumn("part", F.explode(F.when(many, halves).otherwise(F.array(F.struct(F.col("h").alias("g"), "lo", "hi")))))
    shards = dealt.select("part.g", "h", "sid", "ctx", hi.alias("before"), "part.lo", "part.hi", "owner").repartition(parts, "g").sortWithinPartitions("g")
    told = ws.save(shards.mapInArrow(decide, "h long, sid long, first long, runs array<int>"), "decisions")
    told = told.select(F.col("h").alias("th"), F.col("sid").alias("ts"), "first", "runs")
    rows = marked.select("u", "owner", "at", "h", "sid", "lo", "hi").join(told, (F.col("h") == F.col("th")) & (F.col("sid") == F.col("ts")))
    runs = F.when(F.col("owner") > F.col("first"), F.array("lo", "hi")).otherwise(F.col("runs"))
    ranges = rows.select("u", "at", runs.alias("runs")).where("size(runs) > 0")
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), lambda i: F.struct((F.col("at") - F.get("runs", i + 1)).alias("a"), (F.col("at") - F.get("runs", i) + length).alias("b")))
    return ranges.select("u", F.explode(pairs).alias("r")).groupBy("u").agg(F.sort_array(F.collect_list("r")).alias("cuts"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted byte ranges, those that touch put together."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def removal_summary(ws: Workspace, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty; texts shorter than ``length`` lose nothing.  A row with a
    null doc_id loses nothing and is no one's source.  Rows with equal doc_id aren't
    compared with each other; a copy of a text with a smaller doc_id goes whole.
    """
    rows, units = distinct_texts(ws, docs)
    cuts = ws.save(repeated_strings(ws, units, length), "cuts").withColumnRenamed("u", "cu")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, ranges in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                data, spans = data.as_py(), merged([(r["a"], r["b"]) for r in ranges or []])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), hashlib.sha256(data).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            names = ["key", "owner", "n_bytes", "n_removed", "n_spans", "kept_sha256", "whole"]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    texts = units.select("u", "key", "owner", "data").join(cuts.hint("shuffle_hash"), F.col("u") == F.col("cu"), "left")
    schema = "key binary, owner long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, whole string"
    told = ws.save(texts.select("key", "owner", "data", "cuts").mapInArrow(run, schema), "told").withColumnRenamed("key", "k")
    copy = (F.col("doc_id") > F.col("owner")) & (F.col("n_bytes") >= length)
    none = F.col("doc_id").isNull()
    pick = lambda own, null, again: F.when(none, null).when(copy, again).otherwise(own)
    return rows.join(told, rows["key"] == told["k"]).select(
        "doc_id", "n_bytes",
        pick(F.col("n_removed"), F.lit(0), F.col("n_bytes")).cast("long").alias("n_removed"),
        pick(F.col("n_spans"), F.lit(0), F.lit(1)).cast("long").alias("n_spans"),
        pick(F.col("kept_sha256"), F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
    )
