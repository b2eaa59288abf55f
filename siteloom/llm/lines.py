"""Fuzzy line deduplication by MinHash over character shingles.

Lines become shingle signatures, bands of the signature make buckets, lines that
share a bucket are compared by exact Jaccard similarity, and components of similar
lines keep one line.  Long lines take one-permutation signatures, short ones a
permutation per entry; lines near the border take both, so that similar lines
always share a family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SIMILAR, Workspace, as_text, blocked_links, components, free_names, linked_groups, quoted

SHINGLE = 6
BANDS, ROWS = 12, 5
ENTRIES = BANDS * ROWS
#: Distinct shingles from which a line has a one-permutation signature.
LONG = 150
_CHUNK = 1 << 20
_LINES = "row_id long, doc_id long, line_no int, k1 long, k2 long"
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MULT = _mixed(np.arange(1, ENTRIES + 1, dtype=np.uint64)) | _U(1)
_ADD = _mixed(np.arange(1001, ENTRIES + 1001, dtype=np.uint64))
_MULT32, _ADD32 = (_MULT >> _U(32)).astype(np.uint32) | np.uint32(1), (_ADD >> _U(32)).astype(np.uint32)
_P = _U(0x9E3779B97F4A7C15)


def _banded(signature: np.ndarray, family: int) -> np.ndarray:
    parts = (signature.reshape(-1, BANDS, ROWS) * _MULT[:ROWS]).sum(axis=2, dtype=np.uint64)
    return _mixed(parts + _mixed(np.arange(BANDS, dtype=np.uint64) + _U(1 + family * BANDS))).view(np.int64)


def _line_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, 43-bit hash) of the distinct shingles, sorted; shorter lines are filled up with zeros."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    two = chars[:-1] * _P + chars[1:]
    four = (two[:-2] * _P) ^ two[2:]
    h = (four[:-2] * _P) ^ two[4:]
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    # a signature must not depend on a line's neighbours, so the widths are fixed; callers give under 2**21 lines
    keys = np.repeat(np.arange(len(lines), dtype=np.uint64) << _U(43), sizes)[: len(h)] | (h >> _U(21))
    valid = np.ones(len(h), bool)
    for i in range(1, SHINGLE):
        valid[ends[:-1] - i] = False
    keys = np.sort(keys[valid])
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> _U(43)).astype(np.int64), keys & _U((1 << 43) - 1)


def band_families(lines: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(line numbers, bucket ids by band) of the short and of the long family; lines must not be empty."""
    line, value = _line_shingles(lines)
    many = np.bincount(line, minlength=len(lines))
    out = []
    short = np.flatnonzero(many * SIMILAR <= LONG)
    if len(short):
        own = (many * SIMILAR <= LONG)[line]
        v = (value[own] >> _U(11)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(many[short])[:-1]])
        sig = np.stack([np.minimum.reduceat(v * _MULT32[k] + _ADD32[k], starts) for k in range(ENTRIES)], axis=1)
        out.append((short, _banded(sig.astype(np.uint64), 0)))
    long = np.flatnonzero(many >= LONG)
    if len(long):
        place = np.full(len(lines), -1)
        place[long] = np.arange(len(long))
        at = place[line][::-1]
        own = at >= 0
        v, at = value[::-1][own], at[own]
        entry = ((v & _U(0xFFFFF)) * _U(ENTRIES) >> _U(20)).astype(np.int64)
        sig = np.zeros(len(long) * ENTRIES, np.uint64)
        sig[at * ENTRIES + entry] = v | _U(1)  # values fall, so the least of an entry is written last
        sig, turn = sig.reshape(-1, ENTRIES), 0
        filled = sig > 0
        while not filled.all():
            # an empty entry takes the value of one at a keyed distance, another distance each turn
            turn += 1
            other = (np.arange(ENTRIES) * (2 * turn + 1) + 17 * turn * turn + turn) % ENTRIES
            fill = ~filled & filled[:, other]
            sig = np.where(fill, sig[:, other] + _U(turn * int(_P) % 2**64), sig)
            if turn > 60:
                fill = ~filled
                sig = np.where(fill, sig.max(axis=1, keepdims=True), sig)
            filled |= fill
        out.append((long, _banded(sig, 1)))
    return out


def band_hashes(lines: list[str]) -> list[np.ndarray]:
    """For each line the bucket ids of its bands, of one family or both."""
    out: list[list[np.ndarray]] = [[] for _ in lines]
    for which, bands in band_families(lines):
        for i, b in zip(which.tolist(), bands, strict=True):
            out[i].append(b)
    return [np.concatenate(x) for x in out]


def line_keys(text: str) -> list[tuple[int, str]]:
    """(number, line without outer blanks) of each line that holds another character than ASCII white space."""
    return [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip(" \t\r\x0b\x0c"))]


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))


def _halves(keys: list[bytes]) -> list[pa.Array]:
    """The two halves of each key, as longs."""
    both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row per line of ``docs(row_id, doc_id, text)`` with the halves of its key, and one with line_no -1
    and no key per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, number, keys = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                who.append(i)
                number.append(-1)
                for no, line in line_keys(text):
                    who.append(i)
                    number.append(no)
                    keys.append(line_key(line))
            at, no = pa.array(who, pa.int64()), np.array(number, np.int32)
            place = np.cumsum(no >= 0) - 1  # of each line among the keys
            own = pa.array(place, mask=no < 0)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(no), *(h.take(own) for h in _halves(keys))], names=["row_id", "doc_id", "line_no", "k1", "k2"])

    return docs.select("row_id", F.col("doc_id").cast("long"), as_text("text").alias("text")).mapInArrow(run, _LINES)


def _different(batch: pa.RecordBatch) -> dict[bytes, str]:
    return {line_key(x): x for t in batch.column(0).to_pylist() for _, x in line_keys(t)}


def banded_lines(docs: DataFrame) -> DataFrame:
    """(k1, bands) of each different line of a batch, k1 the first half of its key, a row per family it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, held = [], [], 0
            todo = list(_different(batch).items())
            for i, (key, line) in enumerate(todo):
                keys.append(key)
                lines.append(line)
                held += len(line)
                if held > _CHUNK or i == len(todo) - 1:
                    half = _halves(keys)[0]
                    for which, bands in band_families(lines):
                        ends = pa.array(np.arange(len(which) + 1, dtype=np.int32) * BANDS)
                        yield pa.record_batch([half.take(pa.array(which)), pa.ListArray.from_arrays(ends, pa.array(bands.ravel()))], names=["k1", "bands"])
                    keys, lines, held = [], [], 0

    return docs.select(as_text("text").alias("text")).mapInArrow(run, "k1 long, bands array<long>")


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _exact_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """(distinct shingles of all lines as numbers, sorted line by line; where each line's end), or None
    where the lines have too many different characters for six of them and a line number in 64 bits."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[chars] = True
    bits, line_bits = max(1, int(used.sum() - 1).bit_length()), max(1, (len(lines) - 1).bit_length())
    if SHINGLE * bits + line_bits > 64:
        return None
    codes = (np.cumsum(used, dtype=np.uint64) - _U(1))[chars]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    n = len(codes) - SHINGLE + 1
    keys = np.repeat(np.arange(len(lines), dtype=np.uint64) << _U(SHINGLE * bits), sizes)[:n]
    for i in range(SHINGLE):
        keys |= codes[i : i + n] << _U(bits * (SHINGLE - 1 - i))
    valid = np.ones(n, bool)
    ends = np.cumsum(sizes)[:-1]
    for i in range(1, SHINGLE):
        valid[ends - i] = False
    keys = np.sort(keys[valid])
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    line = (keys >> _U(SHINGLE * bits)).astype(np.int64)
    return keys & _U((1 << SHINGLE * bits) - 1), np.cumsum(np.bincount(line, minlength=len(lines)))


def group_links(groups: list[tuple[list[int], list[str]]]) -> list[tuple[int, int]]:
    """(centre, member) pairs that span the components of similar lines of each group, by exact Jaccard
    similarity of their shingles.

    Every group puts up one centre a round, which all its lines that no component has
    reached meet; the lines it reaches are centres later.  The rounds of all groups go together.
    """
    exact = _exact_shingles([x for _, lines in groups for x in lines]) if groups else None
    if exact is None:
        return linked_groups(shingles)(groups)
    codes, ends = exact
    starts = np.concatenate([[0], ends[:-1]])
    many = ends - starts
    ids = np.array([i for own, _ in groups for i in own], np.int64)
    sizes = np.array([len(own) for own, _ in groups])
    group = np.repeat(np.arange(len(groups)), sizes)
    last = np.cumsum(sizes)
    at = last - sizes  # of each group the next line to look at for a new component
    left, fronts, live = np.ones(len(ids), bool), [[] for _ in groups], range(len(groups))
    shift, out = int(codes.max()).bit_length(), []
    wide = shift + len(groups).bit_length() > 64
    while live:
        centres = []
        for g in live:
            if fronts[g]:
                centres.append(fronts[g].pop())
                continue
            while at[g] < last[g] and not left[at[g]]:
                at[g] += 1
            if at[g] < last[g]:
                left[at[g]] = False
                centres.append(int(at[g]))
        if wide:
            centres = centres[:1]
        f = np.array(centres, np.int64)
        turn = np.full(len(groups), -1)
        turn[group[f]] = np.arange(len(f))
        other = np.flatnonzero(left & (turn[group] >= 0)) if len(f) else f
        mine = turn[group[other]]
        a, b = many[other], many[f][mine]
        some = np.minimum(a, b) >= SIMILAR * np.maximum(a, b)
        other, mine, a, b = other[some], mine[some], a[some], b[some]
        if len(other):
            known = _spread(codes, starts[f], many[f]) | (np.repeat(np.arange(len(f), dtype=np.uint64), many[f]) << _U(shift) if not wide else _U(0))
            asked = _spread(codes, starts[other], a) | (np.repeat(mine.astype(np.uint64), a) << _U(shift) if not wide else _U(0))
            hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(a) - a)
            near = both >= SIMILAR * (a + b - both)
            left[other[near]] = False
            for x, c in zip(other[near].tolist(), f[mine[near]].tolist(), strict=True):
                out.append((int(ids[c]), int(ids[x])))
                fronts[group[x]].append(x)
        waiting = np.add.reduceat(left, last - sizes) if len(left) else left
        live = [g for g in live if waiting[g]]
    return out


def _spread(values: np.ndarray, starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The runs [start, start + many) of ``values`` after one another."""
    return values[np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)]


def candidate_buckets(ws: Workspace, banded: DataFrame, numbers: DataFrame) -> DataFrame:
    """(grp, id): the different lines of ``banded(k1, bands)`` that share a bucket, by their number in
    ``numbers(h1, h2, lid)``, those of all buckets with the same first line together.  Rows are dealt by bucket
    once, and a row stays if a neighbour in its bucket differs; only such rows meet their numbers.  Half a key is
    enough here: it takes 64 equal bits of two similar lines to lose their link, and lines that share it are all numbered."""
    rows = banded.select(F.explode("bands").alias("bucket"), "k1")
    w = Window.partitionBy("bucket").orderBy("k1")
    near = rows.withColumn("a", F.lag("k1").over(w)).withColumn("b", F.lead("k1").over(w)).where("a <> k1 or b <> k1").select("bucket", "k1")
    found = ws.save(near.join(numbers.hint("shuffle_hash"), F.col("k1") == F.col("h1")).select("bucket", "lid"), "buckets")
    firsts = found.groupBy("bucket").agg(F.min("lid").alias("grp")).withColumnRenamed("bucket", "b")
    return found.join(firsts, F.col("bucket") == F.col("b")).select("grp", F.col("lid").alias("id")).distinct()


def line_links(ws: Workspace, docs: DataFrame, firsts: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """Links (a, b) between the numbers of different similar lines, ``firsts(k1, k2, lid, ...)``, that share a bucket.

    Only lines in such buckets have their text fetched, once each.
    """
    numbers = firsts.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "lid")
    found = ws.save(candidate_buckets(ws, banded_lines(docs), numbers), "candidates")
    wanted = ws.save(numbers.join(found.select(F.col("id").alias("lid")).distinct(), "lid").select("h1", "h2", "lid"), "wanted")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _different(batch)
            yield pa.record_batch([*_halves(list(own)), pa.array(list(own.values()), pa.string())], names=["k1", "k2", "line"])

    all_lines = docs.select(as_text("text").alias("text")).mapInArrow(texts, "k1 long, k2 long, line string")
    fetched = all_lines.join(wanted.hint("shuffle_hash"), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))).groupBy("lid").agg(F.min("line").alias("text")).withColumnRenamed("lid", "id")
    fetched = ws.save(fetched, "lines")
    return blocked_links(ws, found, fetched, group_links, block_rows)


def dropped_lines(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Per row of the saved table ``docs(row_id, doc_id, text)``: row_id, doc_id, n_lines (with a
    character other than white space) and ``dropped``, of each line to leave out its line_no and the
    document and line (kept_doc, kept_line) that keep its component.

    Equal and similar lines of all documents are one component through any chain;
    of each the line with the smallest (doc_id, row_id, line_no), null ids last,
    stays.  Blank lines stay and are not counted.
    """
    lines = ws.save(hashed_lines(docs), "hashed")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id", "line_no")
    firsts = lines.where("k1 is not null").groupBy("k1", "k2").agg(F.min(place).alias("first"))
    firsts = ws.save(firsts.withColumn("lid", F.monotonically_increasing_id()), "firsts")
    roots = components(ws, ws.save(line_links(ws, docs, firsts), "links"))
    linked = firsts.select("lid", "first").join(roots, F.col("lid") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("first").alias("kept")).select(F.col("root").alias("r"), "kept")
    better = linked.join(least, F.col("root") == F.col("r")).select(F.col("lid").alias("l"), "kept")
    kept = firsts.join(better, F.col("lid") == F.col("l"), "left").select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.coalesce("kept", "first").alias("kept"))
    kept = ws.save(kept.select("h1", "h2", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.row_id").alias("kept_row"), F.col("kept.line_no").alias("kept_line")), "kept")
    told = lines.join(kept, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    gone = (F.col("kept_row") != F.col("row_id")) | (F.col("kept_line") != F.col("line_no"))
    out = F.when(gone, F.struct("line_no", "kept_doc", "kept_line"))
    return told.groupBy("row_id", "doc_id").agg(F.count("k1").alias("n_lines"), F.array_sort(F.collect_list(out)).alias("dropped"))


def numbered(ws: Workspace, docs: DataFrame) -> DataFrame:
    """The thin table that :func:`dropped_lines` takes, saved."""
    return ws.save(docs.select(F.col("doc_id").cast("long"), as_text("text").alias("text")).withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines of the given numbers."""
    keep = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(dropped, i))
    return F.when(F.size(dropped) > 0, F.array_join(keep, "\n")).otherwise(text)


def dedup_lines(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Documents, with the columns of ``docs``, whose texts lack the dropped lines (null text: empty).

    Documents that lose all their lines go; those without any line from the start stay.
    """
    mark = ws.mark()
    row, n, out = free_names(docs, "_line_row", "_line_n", "_line_out")
    own = ws.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    thin = own.select(F.col(row).alias("row_id"), F.col("doc_id").cast("long"), "text")
    found = ws.save(dropped_lines(ws, thin), "dropped")
    ws.release(mark, own, found)
    told = found.select(F.col("row_id").alias(row), F.col("n_lines").alias(n), F.col("dropped.line_no").alias(out))
    rows = own.join(told.hint("shuffle_hash"), row).where((F.col(n) == 0) | (F.size(out) < F.col(n)))
    rows = rows.withColumn("text", without_lines(as_text("text"), F.col(out)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*quoted(docs))
