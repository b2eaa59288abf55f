"""Shared pieces: tables written in the shared folder, running offsets, components."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a regex class body.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and
    the master is local (tests) is a temporary folder made for it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siteloom-"))
    return sc.getCheckpointDir()


class Workspace:
    """Parquet tables of one run in the shared folder; they cut lineage and survive executors.

    ``save`` writes a frame and reads it back; the shuffle files of the write are
    given up as soon as it ends, so that the disk holds one step's shuffle at a time.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[tuple[str, DataFrame]] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def writing(self):
        return _Setting(self.spark, _CLEANUP, "true")

    def open_writers(self, n: int):
        """A setting under which a task that writes folders by value keeps ``n`` files open before it sorts its rows."""
        return _Setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(n))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = self.path(name), df.schema
        with self.writing():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._tables.append((path, out))
        return out

    def mark(self) -> int:
        """Where an operator's own tables begin, for :meth:`release`."""
        return len(self._tables)

    def release(self, mark: int, *kept: DataFrame) -> None:
        """Delete the tables made by ``save`` since ``mark`` but ``kept``; no later step may read them."""
        stay = [x for x in self._tables[mark:] if any(x[1] is k for k in kept)]
        for path, df in self._tables[mark:]:
            if not any(df is k for k in kept):
                self.drop_path(path)
        self._tables[mark:] = stay

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``save`` that no later step reads."""
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if self.root.split(":", 1)[-1].lstrip("/") in f:
                self.drop_path(f)

    def drop_path(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class _Setting:
    def __init__(self, spark: SparkSession, key: str, value: str) -> None:
        self.conf, self.key, self.value = spark.conf, key, value

    def __enter__(self) -> None:
        self.was = self.conf.get(self.key, None)
        self.conf.set(self.key, self.value)

    def __exit__(self, *_: object) -> None:
        if self.was is None:
            self.conf.unset(self.key)
        else:
            self.conf.set(self.key, self.was)


def as_text(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that ``df`` has a column of already (case aside)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def quoted(df: DataFrame) -> list[Column]:
    """The columns of ``df``, also those with dots or other odd characters in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def running_start(
    df: DataFrame, key: str, weight: Column, order: list[str], out: str, bucket_rows: int = 1_000, deal: list[str] | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows that come earlier within ``key``.

    The order is a hash bucket of the ``deal`` columns (all of ``order`` if not given), then the ``order`` columns.  A
    key's rows are dealt to buckets of near ``bucket_rows``, or the square root of
    its rows if that is more, so that neither a bucket's rows nor the bucket totals
    of a key, which are summed in one place, grow with the whole key.
    ``df`` is read three times and should be a saved table.  Rows that agree in
    all ``order`` columns are interchangeable.  Null keys form a key of their own.
    """
    most = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-most // max(bucket_rows, math.isqrt(most))))
    dealt = df.withColumn("_w", weight.cast("long")).withColumn("_b", F.pmod(F.xxhash64(*(deal or order)), F.lit(n)).cast("int"))
    totals = dealt.groupBy(key, "_b").agg(F.sum("_w").alias("_t"))
    by_key = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_t").over(by_key), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_l", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    joined = local.join(starts, local[key].eqNullSafe(starts["_k"]) & (local["_b"] == starts["_kb"]), "left")
    return joined.withColumn(out, F.col("_s") + F.col("_l")).drop("_w", "_b", "_l", "_k", "_kb", "_s")


def components(ws: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node.

    Distributed union-find by alternating star rounds: a large-star round hangs
    each node's larger neighbours on its smallest one, a small-star round does the
    same for the smaller ones, until the edges are stars.  Minima are taken with
    map-side aggregation and joined back, so that a hub with a large share of
    all edges is split by the adaptive skew join.  Each round is a written table.
    Nodes without an edge don't appear; nulls and loops are dropped.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = ws.save(e, "edges")
    mark = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")
        )
        done, e = e, ws.save(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        ws.drop(done)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def by_group(batches, keys: int):
    """Tables of the rows that agree in the first ``keys`` columns, from batches sorted by them."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for i in range(keys):
            c = t.column(i).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(at, at[1:], strict=False):
            yield t.slice(a, b - a)
        held = t.slice(at[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


SIMILAR = 0.8


def alike(a: set, b: set, least: float = SIMILAR) -> bool:
    """Exact Jaccard similarity of at least ``least``; two empty sets are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


#: Up to so many different members, sets are compared as bit masks.
MASK_BITS = 1 << 16


def star_links(ids: list[int], sets: list[set]) -> list[tuple[int, int]]:
    """(centre, member) pairs that span each component of alike sets.

    A member that a centre's component has reached is not compared again, so a dense
    group costs few comparisons and no pair list.  In larger groups sets become bit
    masks over the group's members, which gives the same exact counts.
    """
    left, out = list(dict(zip(ids, sets, strict=True)).items()), []
    close = alike
    if len(left) > 4:
        place: dict = {}
        numbers = [(i, [place.setdefault(x, len(place)) for x in s]) for i, s in left]
        if len(place) <= MASK_BITS:
            left, close = [(i, (len(n), _mask(n, len(place)))) for i, n in numbers], _alike_masks
    while len(left) > 1:
        centre, *left = left
        front = [centre]
        while front and left:
            one, rest = front.pop(), []
            for other in left:
                if close(one[1], other[1]):
                    out.append((centre[0], other[0]))
                    front.append(other)
                else:
                    rest.append(other)
            left = rest
    return out


def _mask(numbers: list[int], width: int) -> int:
    bits = np.zeros(width, bool)
    bits[numbers] = True
    return int.from_bytes(np.packbits(bits).tobytes())


def _alike_masks(a: tuple[int, int], b: tuple[int, int]) -> bool:
    if min(a[0], b[0]) < SIMILAR * max(a[0], b[0]):
        return False
    both = (a[1] & b[1]).bit_count()
    return both >= SIMILAR * (a[0] + b[0] - both)


def linked_groups(shingles):
    """A linker of :func:`blocked_links` that compares sets of ``shingles(text)``, one group at a time."""

    def run(groups: list[tuple[list[int], list[str]]]) -> list[tuple[int, int]]:
        return [x for ids, texts in groups for x in star_links(ids, [shingles(t) for t in texts])]

    return run


def blocked_links(ws: Workspace, members: DataFrame, texts: DataFrame, linker, block_rows: int = 2_000, block_chars: int = 4_000_000) -> DataFrame:
    """Links (a, b) that span the components of alike texts within each group of ``members(grp, id)``.

    ``texts(id, text)``, a saved table of the members only, meets each group sorted; ``linker``
    takes a list of groups (ids, texts).  A group beyond ``block_rows`` rows or ``block_chars``
    characters is split into blocks, and each two blocks meet in a group of their own, so that
    what a task holds is bounded.
    """
    chars = texts.select(F.col("id").alias("tid"), F.length("text").alias("chars"))
    wide = members.join(chars, F.col("id") == F.col("tid")).groupBy("grp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.least("n", F.ceil(F.col("chars") / block_chars)))
    large = wide.select("grp", blocks.alias("blocks")).where("blocks > 1")
    dealt = members.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("blocks"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "id")

    def run(batches):
        def made() -> pa.RecordBatch:
            out = linker(held)
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        held, size = [], 0
        for t in by_group(batches, 1):
            if t.num_rows > 1:
                held.append((t.column("id").to_pylist(), t.column("text").to_pylist()))
                size += sum(map(len, held[-1][1])) + 64 * t.num_rows
            if size > 1 << 20:
                yield made()
                held, size = [], 0
        yield made()

    groups = dealt.join(texts, "id").select("grp", "id", "text")
    groups = groups.repartition(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), "grp").sortWithinPartitions("grp", "id")
    return groups.mapInArrow(run, "a long, b long")
