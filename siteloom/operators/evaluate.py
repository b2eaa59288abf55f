"""Agreement with a reference: errors in decades, correlations, fits, buckets and confusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch
from .relational import cols

# Traffic buckets by lower edge.
BUCKETS = [("<1K", 0), ("1K-10K", 1_000), ("10K-100K", 10_000), ("100K-1M", 100_000), ("1M-10M", 1_000_000), ("10M+", 10_000_000)]
LABELS = [b[0] for b in BUCKETS]


def bucket(visits: Column, buckets: list[tuple[str, float]] = BUCKETS) -> Column:
    """Half-open buckets by lower edge; null and negative fall in the first, anything beyond in the last."""
    out = F.lit(buckets[0][0])
    for label, edge in buckets[1:]:
        out = F.when(visits >= edge, label).otherwise(out)
    return out


def bucket_index(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), label) - 1


def nearest_rank(value: Column, share: float) -> Column:
    """The value at index floor(share * n), at most the last, of the sorted group."""
    v = F.array_sort(F.collect_list(value))
    return F.get(v, F.least(F.size(v) - 1, F.floor(F.size(v) * F.lit(share)).cast("int")))


def running_counts(df: DataFrame, keys: list[str], value: str, small: bool = False) -> DataFrame:
    """(keys, value, n, before, total): per different value its rows, those of smaller values, and all rows of the key.

    Equal values meet map-side.  The counts are then dealt to value ranges by one range exchange, whose partition numbers are
    written with them and the running sum inside the range, so that every later step sees the same ranges and a key with a large
    share of all values is in many of them: ``before`` is what the ranges before hold and what the range holds.  With ``small`` the caller says that no key has many
    values; a key is then one window and nothing is written.  Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    smaller = lambda w: F.coalesce(F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if small:
        key = Window.partitionBy(*keys)
        return counts.select(*keys, value, "n", smaller(key).alias("before"), F.sum("n").over(key).alias("total"))
    path, spark = scratch(df.sparkSession, "counts"), df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(ranges, *keys, value).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys, value)
    schema = T.StructType([*dealt.schema.fields, T.StructField("_before", T.LongType())])
    dealt.mapInArrow(_running, schema).write.parquet(path)
    dealt = spark.read.parquet(path)
    # a row per key and range that it lies in; the join takes the range too, so that no task reads a whole key
    held = dealt.groupBy("_part", *keys).agg(F.min("_before").alias("_from"), F.sum("n").alias("_n"))
    key = Window.partitionBy(*keys)
    held = held.select(*keys, F.col("_part").alias("_p"), (F.sum("_n").over(key.orderBy("_part")) - F.col("_n") - F.col("_from")).alias("_start"), F.sum("_n").over(key).alias("total"))
    ranks = dealt.join(_renamed(held, keys), (F.col("_part") == F.col("_p")) & _same(keys))
    return ranks.select(*keys, value, "n", (F.col("_start") + F.col("_before")).alias("before"), "total")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the sum of ``n`` over the rows of the partition before each row."""
    done = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = done + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], [*batch.schema.names, "_before"])
        done = int(ends[-1]) if len(n) else done


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def wide_ranks(df: DataFrame, keys: list[str], value: str, out: str, small: bool = False) -> DataFrame:
    """Average ranks like W6 for keys of any size, by :func:`running_counts`; rows without a value are left out."""
    ranks = running_counts(df, keys, value, small).select(*keys, F.col(value).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    joined = df.join(_renamed(ranks, keys), _same(keys) & (F.col(value) == F.col("_v")))
    return joined.drop("_v", *[f"_k{i}" for i in range(len(keys))])


def _middle(total: Column) -> list[Column]:
    return [F.floor((total + 1) / 2), F.floor(total / 2) + 1]


def _ninth_decile(total: Column) -> list[Column]:
    return [F.least(total, F.floor(total * F.lit(0.9)) + 1)]


def by_rank(df: DataFrame, keys: list[str], picks: dict[str, tuple], small: bool = False) -> DataFrame:
    """A column per pick, from name to (value column, ranks): the mean of the values at the ranks that ``ranks(total)`` names.

    All picks take one pass of :func:`running_counts`.
    """
    values = F.array(*[F.struct(F.lit(i).alias("what"), c.cast("double").alias("v")) for i, (c, _) in enumerate(picks.values())])
    ranked = running_counts(df.select(*keys, F.explode(values).alias("_x")).select(*keys, "_x.*"), [*keys, "what"], "v", small)
    at = lambda i, r: F.max(F.when((F.col("what") == i) & (F.col("before") < r) & (r <= F.col("before") + F.col("n")), F.col("v")))
    means = []
    for i, (name, (_, ranks)) in enumerate(picks.items()):
        found = [at(i, r) for r in ranks(F.col("total"))]
        means.append((sum(found[1:], found[0]) / len(found)).alias(name))
    return ranked.groupBy(*keys).agg(*means)


def error_summary(df: DataFrame, keys: str | list[str], error: str, small: bool = False, **more: tuple) -> DataFrame:
    """N, bias, median, MAE, RMSE, 90th percentile of |e|, and shares within 0.3, 0.5 and 1; then ``more`` picks of :func:`by_rank`.

    Median and percentile are picked by rank, so that no group is gathered or sorted in one task (with ``small``, a key is one window).
    """
    keys, e = cols(keys), F.col(error)
    plain = df.where(e.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        *[F.avg((F.abs(e) <= t).cast("double")).alias(f"within_{n}") for n, t in (("03", 0.3), ("05", 0.5), ("10", 1.0))],
    )
    picked = by_rank(df, keys, {"median": (e, _middle), "p90": (F.abs(e), _ninth_decile), **more}, small)
    out = plain.join(_renamed(picked, keys), _same(keys))
    return out.select(*keys, "n", "bias", "median", "mae", "rmse", "p90", "within_03", "within_05", "within_10", *more)


def pearson(x: str, y: str) -> Column:
    """Null under three pairs or without variance (``corr`` fails on constant input)."""
    spread = F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))
    return F.when(F.count("*") >= 3, F.try_divide(F.covar_pop(x, y), spread))


def spearman(df: DataFrame, keys: str | list[str], x: str, y: str, small: bool = False) -> DataFrame:
    """Pearson on average ranks, per key.

    ``small`` says that a key's rows fit a window (many small keys); otherwise keys may be of any size.
    """
    keys = cols(keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    if small:
        # a stated number of partitions is not merged again by their small shuffled size, which says little of what a sort holds
        rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        place = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
        rows = rows.select(*keys, place(x).alias("_rx"), place(y).alias("_ry"))
    else:
        rows = wide_ranks(wide_ranks(rows, keys, x, "_rx"), keys, y, "_ry")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), pearson("_rx", "_ry").alias("rho"))


def least_squares(df: DataFrame, keys: str | list[str], x: str, y: str) -> DataFrame:
    """Intercept and slope; null under three pairs or without variance."""
    fit = lambda c: F.when(F.count("*") >= 3, c)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*cols(keys)).agg(
        F.count("*").alias("n"), fit(F.regr_intercept(y, x)).alias("intercept"), fit(F.regr_slope(y, x)).alias("slope")
    )


def with_buckets(df: DataFrame, reference: str, estimate: str) -> DataFrame:
    """Bucket labels of both, their index difference, and the error in decades."""
    rows = df.withColumn("ref_bucket", bucket(F.col(reference))).withColumn("est_bucket", bucket(F.col(estimate)))
    rows = rows.withColumn("bucket_diff", bucket_index(F.col("est_bucket")) - bucket_index(F.col("ref_bucket")))
    safe = lambda c: F.log10(F.greatest(F.col(c), F.lit(1.0)))
    return rows.withColumn("error", safe(estimate) - safe(reference))


def group_metrics(df: DataFrame, keys: str | list[str], **picks: tuple) -> DataFrame:
    """The error summary, and shares with the exact bucket, within one, and reference in range."""
    keys = cols(keys)
    more = df.groupBy(*keys).agg(
        F.avg((F.col("bucket_diff") == 0).cast("double")).alias("bucket_exact"), F.avg((F.abs("bucket_diff") <= 1).cast("double")).alias("bucket_within_1"),
        F.avg(F.col("reference").between(F.col("lower"), F.col("upper")).cast("double")).alias("in_range"),
    )
    return error_summary(df, keys, "error", **picks).join(more, keys)


def overall_metrics(df: DataFrame) -> DataFrame:
    """Group metrics of all rows, and the error of always answering the median reference."""
    found = group_metrics(df.withColumn("all", F.lit("all")), "all", median_visits=(F.col("reference"), _middle))
    gap = F.avg(F.abs(F.log10(F.greatest("reference", F.lit(1.0))) - F.log10(F.greatest("median_visits", F.lit(1.0)))))
    base = df.crossJoin(F.broadcast(found.select("median_visits"))).agg(gap.alias("median_mae"))  # one row each
    return found.crossJoin(F.broadcast(base))


def confusion(df: DataFrame) -> DataFrame:
    """Rows per reference bucket, a column per estimate bucket, zero filled."""
    counts = df.groupBy("ref_bucket").agg(*[F.count_if(F.col("est_bucket") == label).alias(f"est_{i}") for i, label in enumerate(LABELS)])
    grid = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(LABELS)], "ref_bucket string, idx int")
    return grid.join(counts, "ref_bucket", "left").fillna(0)


def three_groupings(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Error count and MAE by three columns on their own, in one pass."""
    rows = df.groupingSets([[a], [b], [c]], a, b, c).agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.grouping_id().alias("_g"))
    which = F.when(F.col("_g") == 3, a).when(F.col("_g") == 5, b).otherwise(c)
    return rows.select(which.alias("grouping"), F.coalesce(F.col(a).cast("string"), F.col(b).cast("string"), F.col(c).cast("string")).alias("label"), "n", "mae")


def signal_metrics(scored: DataFrame, signals: str, reference: str) -> DataFrame:
    """Per signal its coverage, mean absolute error, rank correlation and fit against log10 of the reference."""
    total = scored.count()
    rows = scored.select(F.explode(signals).alias("signal", "x"), F.log10(reference).alias("y")).where("x is not null and y is not null")
    errors = rows.groupBy("signal").agg((F.count("*") / F.lit(total)).alias("coverage"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))
    return errors.join(spearman(rows, "signal", "x", "y").drop("n"), "signal").join(least_squares(rows, "signal", "x", "y").drop("n"), "signal")


def run_counts(rows: DataFrame, domain: str, reference: str, estimate: str, completed: Column) -> DataFrame:
    """One row of counts: all rows, those without a reference or an estimate, different domains, completed runs."""
    missing = lambda c, name: F.count_if(F.col(c).isNull()).alias(name)
    return rows.agg(F.count("*").alias("n"), missing(reference, "n_no_reference"), missing(estimate, "n_no_estimate"), F.count_distinct(domain).alias("n_domains"), F.count_if(completed).alias("n_completed"))


def source_statuses(rows: DataFrame, sources: str) -> DataFrame:
    """(source, status, n) over the maps source -> status; a row that lacks a source counts as ``none``."""
    said = rows.select(F.explode(sources).alias("source", "status")).groupBy("source", "status").agg(F.count("*").alias("n"))
    rest = said.groupBy("source").agg(F.sum("n").alias("_n")).crossJoin(rows.agg(F.count("*").alias("_all")))  # a row of totals
    return said.unionByName(rest.select("source", F.lit("none").alias("status"), (F.col("_all") - F.col("_n")).alias("n")).where("n > 0"))


def without_reference(rows: DataFrame, reference: str, estimate: str, below: float = 5_000) -> DataFrame:
    """(bucket, n, n_below) of the estimates of rows whose reference is missing or zero; no estimate counts as zero."""
    at = F.coalesce(F.col(estimate), F.lit(0))
    none = rows.where(F.coalesce(F.col(reference), F.lit(0)) == 0)
    return none.groupBy(bucket(at).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(at < below).alias("n_below"))


def load_statistics(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Rows, domains, duplicates, duplicates in conflict with the first row, invalid keys, and missing values."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, position).alias("_first"), F.count("*").alias("_n"))
    joined = df.join(first, key, "left")
    return joined.agg(
        F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_domains"), (F.count(key) - F.count_distinct(key)).alias("n_duplicates"),
        F.count_if(F.col(key).isNotNull() & ~F.col(value).eqNullSafe(F.col("_first"))).alias("n_conflicts"), F.count_if(F.col(key).isNull()).alias("n_invalid"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
    )
