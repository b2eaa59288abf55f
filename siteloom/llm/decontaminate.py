"""Benchmark decontamination by Wu-Manber search over words.

Benchmark items become windows of ten words (shorter items one window), and documents are
searched for all windows at once.  The letters of the search are words and its blocks are two
words: a shift table says how far the window's end may move on past a block, most places are
never looked at; a block that ends some window selects the bucket of windows with that end, and
a direct comparison of all words confirms one.

Windows are dealt to parts of a bounded number of bytes.  The documents pass through the search
of one part after the other, each broadcast as its tables, so memory does not grow with the
benchmark; documents are not shuffled, and with one part nothing is written either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_text

WINDOW = 10
#: Bytes of windows and item ids that a part holds; its tables take about 25 times as much in Python.
PART_BYTES = 4 << 20
_CHUNK = 1 << 22
#: Bytes to words: A-Z become lower case, and every other ASCII character than a-z and 0-9 a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_STATE = "doc_id long, text string, hit binary, items array<string>"
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class WindowSearch:
    """Wu-Manber tables of windows, one set for each length that occurs.

    ``windows`` are (words, item id) pairs; the id may be None.
    """

    def __init__(self, windows: Iterable[tuple[tuple[bytes, ...], str | None]]) -> None:
        self.tables: dict[int, tuple[dict, dict]] = {}
        for words, item in windows:
            m = len(words)
            shifts, buckets = self.tables.setdefault(m, ({}, {}))
            block = words[-2:]
            found = buckets.setdefault(block, {}).setdefault(words, [])
            if item is not None and item not in found:
                found.append(item)
            shifts[block] = 0
            for end in range(2, m):  # blocks inside the window keep its end at a distance
                inside = words[end - 2 : end]
                if m - end < shifts.get(inside, m):
                    shifts[inside] = m - end

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(begin, end) of all occurrences, and the ids of their items."""
        spans, items = [], set()
        for m, (shifts, buckets) in self.tables.items():
            if m == 1:  # no blocks of two words
                for i, w in enumerate(words):
                    if (w,) in buckets:
                        spans.append((i, i + 1))
                        items.update(buckets[(w,)][(w,)])
                continue
            shift_of, most, i, n = shifts.get, m - 1, m - 1, len(words)
            while i < n:
                block = (words[i - 1], words[i])
                shift = shift_of(block, most)
                if shift:
                    i += shift
                    continue
                found = buckets[block].get(tuple(words[i - m + 1 : i + 1]))
                if found is not None:
                    spans.append((i - m + 1, i + 1))
                    items.update(found)
                i += 1
        return spans, items


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id string, window) of ``items(item_id, text)``: windows as words joined by one space, no row twice."""
    folded = F.translate(as_text("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    at = cut.select("item_id", "w", F.explode(starts).alias("s"))
    return at.select("item_id", F.array_join(F.slice("w", F.col("s"), WINDOW), " ").alias("window")).distinct()


def _state(batch: pa.RecordBatch, search: WindowSearch | None, last: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        names = [x.split()[0] for x in (_OUT if last else _STATE).split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()] if last else [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string())]
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for doc_id, text, hit, items in zip(*(batch.column(i) for i in range(4)), strict=True):
        doc_id, text, hit, items = doc_id.as_py(), text.as_py(), hit.as_py(), set(items.as_py())
        words = words_of(text)
        if search:
            spans, more = search.find(words)
            items |= more
            if spans:
                marks = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(words)) if hit else np.zeros(len(words), np.uint8)
                for a, b in spans:
                    marks[a:b] = 1
                hit = np.packbits(marks).tobytes()
        if last:
            n_hit = int.from_bytes(hit).bit_count()
            rows.append((doc_id, len(words), n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0))
        else:
            rows.append((doc_id, text, hit, sorted(items)))
        held += len(text)
        if held >= _CHUNK:
            yield made()
            rows.clear()
            held = 0
    if rows:
        yield made()


def contamination(ws: Workspace, docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document the words that lie in a window of an item, and the items whose windows it holds.

    ``items_sha256`` is of the ids of these items, as text, sorted by code point and comma-joined.  Null and
    empty texts have no word: nothing is hit, and the digest is of nothing; such an item has no window.
    An item without an id marks words but is not counted.  Rows of the same item_id are one item; repeated
    documents give a row each, a null doc_id stays null, other columns are not read.  With no items, no document is
    contaminated.  Whole texts are searched however long; a task holds one part's tables and 4 million characters, or a longer text.
    """
    windows = ws.save(item_windows(items), "windows")
    weight = F.octet_length("window") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 64
    n_parts = max(1, -(-(windows.agg(F.sum(weight)).first()[0] or 0) // part_bytes))
    part = F.pmod(F.xxhash64("window", "item_id"), F.lit(n_parts))
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text"), F.lit(b"").alias("hit"), F.array().cast("array<string>").alias("items")
    )
    saved = None
    for p in range(n_parts):
        found = windows.where(part == p).select("window", "item_id").toArrow()  # one part, bounded by part_bytes
        pairs = zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)
        search = ws.spark.sparkContext.broadcast(WindowSearch((tuple(w.encode().split(b" ")), i) for w, i in pairs))
        last = p == n_parts - 1

        def run(batches, search=search, last=last):
            for batch in batches:
                yield from _state(batch, search.value, last)

        state = state.mapInArrow(run, _OUT if last else _STATE)
        if not last:
            before, saved = saved, ws.save(state, "searched")
            state = saved
            search.destroy()
            if before is not None:
                ws.drop(before)
    return state
