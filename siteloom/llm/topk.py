"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

A vector's components, less the middle of their dimension, are postings (zeros are none), and the
impact of a posting is its size.  Impacts are quantised; the postings of one dimension and level
are a segment, a list of rows and values.  A block of queries weighs the dimensions, takes the
segments by descending weight times impact, and adds up scores.  What a row still lacks is
bounded by the norm of its postings to come, so a query stops at the segment that proves that all
but a few rows cannot reach its k best; these possible members are scored exactly.

Shards are cells around pivots.  A query first asks the shard it lies in, whose k-th
score is its threshold everywhere else; cells whose ball cannot reach the threshold are
not asked at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Levels of quantised impact, and the shares of the weighted squared norm still to come at which proof is tried.
LEVELS, PROOFS = 16, (0.5, 0.3, 0.15, 0.07, 0.03, 0.0)
#: A query passes on to exact scores once so small a share of the rows is possible.
FEW = 1 / 16
SHARD_ROWS, QUERY_ROWS, CHUNK = 8_192, 32_768, 128
#: Pivots are drawn from at most so many rows; every row is indexed.
MAX_CELLS = 4_096


class ImpactIndex:
    """The posting segments of one shard of integer vectors (rows of ``x``): row numbers and values by dimension and level of impact.

    ``read`` counts the postings that searches have read.
    """

    def __init__(self, x: np.ndarray, levels: int = LEVELS) -> None:
        self.x = x.astype(np.int64)
        self.middle = np.median(self.x, axis=0).astype(np.int64)
        e = self.x - self.middle
        self.row, dim = np.nonzero(e)  # zeros are no postings
        value = e[self.row, dim]
        impact = np.abs(value)
        # level 0 has the greatest impacts
        level = levels - 1 - impact * levels // (int(impact.max(initial=0)) + 1)
        order = np.lexsort((-impact, level, dim))
        self.row, dim, level, value = self.row[order], dim[order], level[order], value[order].astype(float)
        self.value, self.energy = value.astype(np.float32), value**2
        self.begin = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (level[1:] != level[:-1])]) if len(dim) else np.zeros(0, int)
        self.dim, self.top = dim[self.begin], np.abs(value[self.begin])
        self.end = np.r_[self.begin[1:], len(dim)].astype(int)
        self.norm = float(np.sqrt((e.astype(float) ** 2).sum(axis=1).max(initial=0)))
        self.read = 0

    def order(self, weight: np.ndarray) -> np.ndarray:
        """The segments by descending impact times the queries' weight of their dimension; those without weight are not read."""
        impact = weight[self.dim] * self.top
        order = np.argsort(-impact, kind="stable")
        return order[impact[order] > 0]

    def search(self, q: np.ndarray, k: int, own: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all that can be among the k best of each query (rows of ``q``).

        ``own`` is the row that a query may not find, or -1; rows that score under a
        query's ``threshold`` (-inf: none) may be left out.
        """
        n, dims = self.x.shape
        q = q.astype(np.int64)
        real = q.astype(float)
        weight = np.sqrt((real**2).mean(axis=0)) if len(q) else np.zeros(dims)
        share = np.divide(1.0, weight, out=np.zeros(dims), where=weight > 0)
        # what a row still lacks is at most the norm of its postings to come, plain or weighted, times the query's
        size, sized = (np.sqrt((v**2).sum(axis=1)) for v in (real, real * share))
        # what single precision may be off by
        off = (dims + 8) * 2.0**-22 * size * self.norm + 1e-3
        need, asked, free = threshold - (q @ self.middle).astype(float) - off, np.arange(len(q)), np.isneginf(threshold)
        acc, wide = np.zeros((n, len(q)), np.float32), q.T.astype(np.float32)
        mine = np.flatnonzero(own >= 0)
        acc[own[mine], mine] = -np.inf
        order = self.order(weight)
        scaled = self.energy * np.repeat(weight[self.dim] ** 2, self.end - self.begin)
        left, lefted = np.bincount(self.row, self.energy, n), np.bincount(self.row, scaled, n)
        to_come = np.add.reduceat(scaled, self.begin)[order] if len(order) else np.zeros(0)
        to_come = 1 - np.cumsum(to_come) / (to_come.sum() or 1.0)
        proofs = {int(np.argmax(to_come <= p)) for p in PROOFS[:-1]} if len(order) else set()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at, s in enumerate([*order.tolist(), None]):
            if s is not None:
                seg = slice(self.begin[s], self.end[s])
                rows = self.row[seg]
                acc[rows] += self.value[seg, None] * wide[self.dim[s]]
                left[rows] -= self.energy[seg]
                lefted[rows] -= scaled[seg]
                self.read += len(rows)
                if at not in proofs:
                    continue
            rest = np.zeros((n, 1)) if s is None else np.minimum(size * np.sqrt(np.maximum(left, 0))[:, None], sized * np.sqrt(np.maximum(lefted, 0))[:, None]) * (1 + 1e-5)
            rest = (rest + off * (s is not None)).astype(np.float32)
            if n > k and free.any():  # no threshold from elsewhere: the k-th of what is sure
                need = np.maximum(need, np.partition(acc - rest, n - k, axis=0)[n - k] - 2 * off)
            member = acc + rest >= need.astype(np.float32) - np.abs(need).astype(np.float32) * np.float32(2.0**-22)
            member &= acc > -np.inf
            ready = np.full(len(asked), True) if s is None else member.mean(axis=0) <= FEW
            if ready.any():
                row, who = np.nonzero(member[:, ready])
                found.append((asked[ready][who], row))
                stay = ~ready
                asked, acc, wide, need, size, sized, off, free = asked[stay], np.ascontiguousarray(acc[:, stay]), np.ascontiguousarray(wide[:, stay]), need[stay], size[stay], sized[stay], off[stay], free[stay]
            if not len(asked):
                break
        who, row = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in (0, 1))
        score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[a], self.x[b]) for a, b in ((who[i : i + 65_536], row[i : i + 65_536]) for i in range(0, len(who), 65_536)))])
        return who, row, score


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component); rows with a null vec_id, vector or component,
    or a component that isn't finite, take no part.  :func:`top_k` refuses vectors whose inner products may leave a long."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where("vec_id is not null and x is not null").where(~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """The lists of a column as rows, filled up with zeros."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    many = c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(c), dims), np.int64)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(np.arange(len(c)), many), at] = c.flatten().to_numpy()
    return out


_FOUND = "query_row long, query_id long, vec_id long, row_id long, score long"


def _best(index: ImpactIndex, asked: tuple[np.ndarray, ...], ids: np.ndarray, uid: np.ndarray, k: int) -> pa.Table:
    """The k best rows of one shard for each asked (row_id, vec_id, vector, threshold)."""
    row, query, q, threshold = asked
    order = np.argsort(uid)
    place = np.minimum(np.searchsorted(uid[order], row), len(uid) - 1)
    own = np.where(uid[order][place] == row, order[place], -1)
    out = []
    for i in range(0, len(row), CHUNK):
        who, at, score = index.search(q[i : i + CHUNK], k, own[i : i + CHUNK], threshold[i : i + CHUNK])
        best = np.lexsort((uid[at], ids[at], -score, who))
        first = np.searchsorted(who[best], who[best])
        best = best[np.arange(len(best)) - first < k]
        who, at, score = who[best] + i, at[best], score[best]
        out.append((row[who], query[who], ids[at], uid[at], score))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    return pa.table(dict(zip([x.split()[0] for x in _FOUND.split(", ")], cols, strict=True)))


def top_k(ws: Workspace, vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row of ``vectors(vec_id, v)`` where ``is_query``: rank, vec_id and score of its k best
    others by inner product, ties to the smaller vec_id.

    Repeated rows are rows of their own: a copy of the query's row is a candidate.  A
    shorter vector counts as padded with zeros.  A cell beyond ``shard_rows``, such as
    one of very many equal vectors, is dealt to several shards; queries meet a shard in
    blocks of ``query_rows``.  What is sent to all tasks is at most MAX_CELLS pivots.
    No rows or no queries give no rows.
    """
    rows = ws.save(vectors.withColumn("row_id", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))
    n, m, dims, largest = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), largest).first()
    if (dims or 0) * (largest or 0) ** 2 >= 2**62:
        raise ValueError("inner products must stay within a long")
    if not m:
        return ws.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, cells, blocks = max(1, dims or 0), min(MAX_CELLS, -(-n // shard_rows)), max(1, -(-m // query_rows))
    drawn = rows.orderBy(F.xxhash64("v"), "row_id").limit(cells).select("v").toArrow()
    pivots = _matrix(drawn.column("v"), dims).astype(np.float64)
    lengths = (pivots**2).sum(axis=1)

    def deal(batches):
        for b in batches:
            x = _matrix(b.column(1), dims).astype(np.float64)
            parts = []
            for i in range(0, len(x), 1024):
                d = lengths[None, :] - 2 * (x[i : i + 1024] @ pivots.T)
                parts.append((d.argmin(axis=1), d.min(axis=1) + (x[i : i + 1024] ** 2).sum(axis=1)))
            cell, d = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0))
            yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(np.maximum(d, 0)))], names=["vec_id", "v", "row_id", "asks", "cell", "away"])

    dealt = ws.save(rows.mapInArrow(deal, "vec_id long, v array<long>, row_id long, asks boolean, cell int, away double"), "cells")
    told = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    ws.drop(rows)
    parts, radius = np.zeros(cells, np.int64), np.full(cells, -1.0)
    for r in told:
        parts[r["cell"]], radius[r["cell"]] = -(-r["n"] // shard_rows), r["radius"]
    table = ws.spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "of int, parts long")
    dealt = dealt.join(F.broadcast(table), F.col("cell") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("row_id"), "parts").cast("int")).drop("of", "parts")

    def own(t: pa.Table) -> pa.Table:
        x, asks = _matrix(t.column("v"), dims), t.column("asks").to_numpy()
        ids, uid = t.column("vec_id").to_numpy(), t.column("row_id").to_numpy()
        return _best(ImpactIndex(x), (uid[asks], ids[asks], x[asks], np.full(asks.sum(), -np.inf)), ids, uid, k)

    near = ws.save(dealt.groupBy("cell", "part").applyInArrow(own, _FOUND), "nearest")
    # a query with fewer than k rows in its own shard has no threshold yet
    reached = near.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    asks = dealt.where("asks").join(reached.withColumnRenamed("query_row", "row_id"), "row_id", "left").select("vec_id", "v", "row_id", "cell", "part", "least")

    def choose(batches):
        """A query goes to every shard but its own whose ball reaches the threshold."""
        reach = np.repeat(np.arange(cells), parts)
        part = np.concatenate([np.arange(p) for p in parts]) if len(reach) else reach
        for b in batches:
            q = _matrix(b.column(1), dims).astype(np.float64)
            home, own_part = b.column(3).to_numpy(), b.column(4).to_numpy()
            least = b.column(5).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            for i in range(0, len(q), 256):
                some = slice(i, i + 256)
                size = np.sqrt((q[some] ** 2).sum(axis=1))
                bound = (q[some] @ pivots.T + size[:, None] * radius[None, :]) * (1 + 1e-9) + np.abs(q[some] @ pivots.T) * 1e-9 + 1
                hit = (bound >= least[some][:, None])[:, reach]
                hit &= ~((home[some][:, None] == reach[None, :]) & (own_part[some][:, None] == part[None, :]))
                who, to = np.nonzero(hit)
                at = pa.array(who + i)
                cols = [b.column(2).take(at), b.column(0).take(at), b.column(1).take(at), pa.array(least[who + i]), pa.array(reach[to].astype(np.int32)), pa.array(part[to].astype(np.int32))]
                yield pa.record_batch(cols, names=["row_id", "vec_id", "v", "least", "cell", "part"])

    sent = asks.mapInArrow(choose, "row_id long, vec_id long, v array<long>, least double, cell int, part int")
    sent = sent.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row_id"), F.lit(blocks)).cast("int"))
    kept = dealt.select("vec_id", "v", "row_id", "cell", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def others(q: pa.Table, x: pa.Table) -> pa.Table:
        ids, uid = x.column("vec_id").to_numpy(), x.column("row_id").to_numpy()
        asked = q.column("row_id").to_numpy(), q.column("vec_id").to_numpy(), _matrix(q.column("v"), dims), q.column("least").to_numpy()
        if not q.num_rows or not x.num_rows:
            return pa.table({c.split()[0]: np.zeros(0, np.int64) for c in _FOUND.split(", ")})
        return _best(ImpactIndex(_matrix(x.column("v"), dims)), asked, ids, uid, k)

    keys = "cell", "part", "block"
    far = sent.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInArrow(others, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
