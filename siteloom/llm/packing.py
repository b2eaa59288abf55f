"""Packing token pieces into fixed-length sequences, shortest pack first.

Documents become ids, are cut into pieces of at most half a sequence or a whole
one, and the histogram of piece lengths is packed on the driver (it has at most
one row per length): lengths are placed longest first, each into the pack with
the most room, and only counts of packing patterns are updated.  The patterns
go back to the pieces by a join on length and rank.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_text, running_start

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SEQUENCE = 1024
#: Beyond these letters, or where a text holds a special token, the tokenizer itself is asked.
_ODD = re.compile(r"[^\x00-ɏ‐-›]|<\|")


@cache
def _encoders(json_path: str, ranks_path: str | None):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    if not ranks_path:
        return whole, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return whole, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, json_path: str, ranks_path: str | None = None) -> list[int]:
    """The tokenizer's ids.  With ``ranks_path`` (the same vocabulary as ranks), plain
    Latin text takes a faster encoder that gives the same ids."""
    whole, fast = _encoders(json_path, ranks_path)
    if fast is None or _ODD.search(text):
        return whole.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(n: int, size: int = SEQUENCE) -> list[int]:
    """Piece lengths for ``n`` ids: whole sequences, then a half and what is left of it."""
    out = [size] * (n // size)
    left, half = n % size, size // 2
    if left > half:
        out.append(half)
        left -= half
    return out + [left] * (left > 0)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row per piece of each document's ids (null text: empty) followed by ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(text, json_path, ranks_path), end_id], dtype="<u4")
                at = 0
                for k in cut(len(ids), size):
                    rows.append((doc, at, k, zlib.crc32(ids[at : at + k].tobytes()), len(ids)))
                    at += k
            cols = list(zip(*rows, strict=True)) or [()] * 5
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("long"), as_text("text").alias("text")).mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first over a histogram {length: count}: rows (packs, lengths in each pack)."""
    room: dict[int, list[list]] = {}  # room left -> [count, lengths]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            best = max(room, default=0)
            if best < length:
                room.setdefault(size - length, []).append([left, (length,)])
                break
            pack = room[best].pop()
            if not room[best]:
                del room[best]
            used = min(left, pack[0])
            if pack[0] > used:
                room.setdefault(best, []).append([pack[0] - used, pack[1]])
            room.setdefault(best - length, []).append([used, (*pack[1], length)])
            left -= used
    return [(n, lengths) for free in sorted(room) for n, lengths in room[free]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank end, first sequence, offset): where a length's pieces go by rank."""
    out, ranks, base = [], {}, 0
    for n, lengths in patterns:
        at = 0
        for length in lengths:
            r = ranks.get(length, 0)
            out.append((length, r, r + n, base, at))
            ranks[length], at = r + n, at + length
        base += n
    return out


def pack(ws: Workspace, cut_pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...), saved or recomputable.

    The slot table has a few rows per length, so its broadcast is bounded by
    ``size``, not by the data.  Equal rows are packed once each; no rows, no sequences.
    """
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    table = slots(pack_histogram(counts, size))
    spark = cut_pieces.sparkSession
    where = spark.createDataFrame(table, "slot_length long, lo long, hi long, base long, offset long")
    ranked = running_start(cut_pieces, "length", F.lit(1), ["doc_id", "start", "ids_crc32"], "rank")
    hit = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(where), hit).select(
        *cut_pieces.columns, (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )


def pack_documents(ws: Workspace, docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Cut, rank and pack whole documents; see :func:`pieces` and :func:`pack`."""
    return pack(ws, ws.save(pieces(docs, json_path, ranks_path, size), "pieces"), size)
