"""Writes: versions of lists, observation and collection logs, features, estimates, results and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import with_buckets
from ..operators.pages import bound_json_metadata, fit_budget, verdict_counts
from ..operators.relational import lowest_rank, outdated_versions

#: What a collector hands in, and how K2 stores it.
OBSERVATION = "domain string, source string, source_version string, run_id string, collected_at timestamp, payload string"


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


VERSIONS = "provider string, list_id string, row_count long, active boolean, downloaded_at timestamp, path string"
_POINTER = "CURRENT"


def _files(spark: SparkSession, root: str):
    """The file context of a folder, and a maker of its paths."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(root).toUri(), conf), make


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """K1: the versions that the pointer file of ``root`` names; none before the first load."""
    files, path = _files(spark, root)
    if not files.util().exists(path(f"{root}/{_POINTER}")):
        return spark.createDataFrame([], VERSIONS)
    named = spark.read.text(f"{root}/{_POINTER}", wholetext=True).first()[0].strip()
    return spark.read.schema(VERSIONS).parquet(f"{root}/{named}")


def list_entries(spark: SparkSession, root: str, provider: str) -> DataFrame | None:
    """K1: the entries of a provider's active version, None without one."""
    active = list_versions(spark, root).where((F.col("provider") == provider) & F.col("active")).select("path").first()
    return spark.read.parquet(f"{root}/{active[0]}") if active else None


def load_list_version(entries: DataFrame, version: dict, root: str, keep: int = 2) -> tuple[DataFrame, DataFrame]:
    """K1: load the entries of one (provider, list_id), make it the active version, and prune what ``keep`` leaves no room for.

    Entries and the table of versions go to new folders; the pointer file, replaced last by one rename, makes both current at once,
    so that readers and a load that fails in between see the old version whole.  Loads of one ``root`` must not run at the same time.
    Returns (versions, pruned); the folders of pruned versions are deleted after the switch.
    """
    p, i, spark = version["provider"], version["list_id"], entries.sparkSession
    name = f"entries-{uuid.uuid4().hex}"
    rows = lowest_rank(entries.withColumn("provider", F.lit(p)).withColumn("list_id", F.lit(i)), ["provider", "list_id", "domain"], "rank")
    rows.write.parquet(f"{root}/{name}")
    n = spark.read.parquet(f"{root}/{name}").count()
    before = list_versions(spark, root)
    others = before.where(~((F.col("provider") == p) & (F.col("list_id") == i))).withColumn("active", (F.col("provider") != p) & F.col("active"))
    new = spark.createDataFrame([(p, i, n, True, version["downloaded_at"], name)], VERSIONS)
    now = others.unionByName(new)
    gone = outdated_versions(now, "provider", "active", "downloaded_at", keep)
    table = f"versions-{uuid.uuid4().hex}"
    now.join(gone.select("provider", "list_id"), ["provider", "list_id"], "left_anti").select(before.columns).coalesce(1).write.parquet(f"{root}/{table}")  # a row per version
    versions = spark.read.schema(VERSIONS).parquet(f"{root}/{table}")
    pruned = before.join(versions.select("path"), "path", "left_anti")
    old = pruned.collect()  # versions replaced or outdated by this load
    _switch(spark, root, table)
    files, path = _files(spark, root)
    for r in old:
        files.delete(path(f"{root}/{r['path']}"), True)
    return versions, spark.createDataFrame(old, pruned.schema)


def _switch(spark: SparkSession, root: str, table: str) -> None:
    """Name ``table`` in the pointer file, by a new file that takes its place in one rename."""
    files, path = _files(spark, root)
    jvm, fresh = spark._jvm, path(f"{root}/{_POINTER}-{uuid.uuid4().hex}")
    out = fresh.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fresh)
    out.write(bytearray(table, "ascii"))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, path(f"{root}/{_POINTER}"), options)


def append_observations(df: DataFrame, path: str) -> None:
    """K2: append-only log, one folder per source."""
    df.selectExpr(*[x.split()[0] for x in OBSERVATION.split(", ")]).write.mode("append").partitionBy("source").parquet(path)


def append_collection_log(attempts: DataFrame, path: str) -> None:
    """K3: attempts with the error cut to 1000 characters and the start told from the duration."""
    started = F.col("finished_at") - F.make_dt_interval(secs=F.col("duration_s").cast("decimal(18,6)"))
    attempts.withColumn("error", F.substring("error", 1, 1000)).withColumn("started_at", started).write.mode("append").parquet(path)


def write_estimates(estimates: DataFrame, path: str) -> None:
    """K4, K5: estimates by model version; a re-run from stored observations replaces its version only."""
    _overwrite(estimates.withColumn("details", F.to_json("details")), path, "model_version")


def upsert_ground_truth(stored: DataFrame, new: DataFrame, features: DataFrame) -> DataFrame:
    """K6: last import wins per (domain, source, date), but periods keep their first value; a domain without a feature snapshot is an error."""
    key = ["domain", "source", "measurement_date"]
    bare = new.join(features.select("domain").distinct(), "domain", "left_anti").select("domain").limit(5).collect()
    if bare:
        raise ValueError(f"no feature snapshot for {', '.join(r[0] for r in bare)}")
    a, b = stored.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, key, "full_outer")
    there = F.col("b._new").isNotNull()  # also where the imported value is null
    pick = lambda c: F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    first = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    return joined.select(*key, pick("actual_monthly_visits"), pick("notes"), first("period_start"), first("period_end"))


def export_ground_truth(df: DataFrame, path: str) -> None:
    """K7: JSON lines by domain and date."""
    dates = [c for c, t in df.dtypes if t == "date"]
    df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates}).orderBy("domain", "measurement_date").write.mode("overwrite").json(path)


def export_results(df: DataFrame, path: str) -> None:
    """K8: JSON lines in (created_at, id) order; order holds over the part files."""
    df.orderBy("created_at", "id").write.mode("overwrite").json(path)


def benchmark_rows(scored: DataFrame, features: list[str] | None = None, extra: str | None = None) -> DataFrame:
    """K9: one flat row per domain: signals as JSON, sources as ``k=v;``, the difference of the bucket indexes, the error in
    decades, whether the reference is in range, the feature columns by name and the keys of the map ``extra`` as ``ref_`` columns by name."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    rows = scored.withColumn("signals", F.to_json("signals")).withColumn("sources", pairs)
    last = sorted(features or [])
    if {"reference", "estimate"} <= set(scored.columns):
        rows = with_buckets(rows, "reference", "estimate").withColumnRenamed("error", "log10_error")
    if {"reference", "lower", "upper"} <= set(scored.columns):
        rows = rows.withColumn("in_range", F.col("reference").between(F.col("lower"), F.col("upper")))
    more = []
    if extra:
        names = sorted(r[0] for r in scored.select(F.explode(F.map_keys(extra))).distinct().collect())  # columns of the reference file
        more = [F.col(extra)[k].alias(f"ref_{k}") for k in names]
    return rows.select(*[c for c in rows.columns if c not in last and c != extra], *last, *more)


def write_benchmark_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_review(graded: DataFrame, path: str) -> None:
    """The verdict table, and the counts of verdicts and site issues beside it."""
    graded.withColumn("issues", F.array_join("issues", "; ")).write.mode("overwrite").parquet(f"{path}/verdicts")
    verdict_counts(graded).write.mode("overwrite").parquet(f"{path}/counts")


def markdown_table(metrics: DataFrame, order: str, most: int = 100_000) -> str:
    """Aggregated rows, all of them, as a Markdown table; more than ``most`` are no report and raise an error."""
    rows = metrics.orderBy(order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes aggregated rows: this table has more than {most}")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def benchmark_report(tables: dict[str, tuple[DataFrame, str]], most: int = 100_000) -> str:
    """A Markdown report, a heading and table for each (metrics, order) of ``tables``; metrics are aggregated rows."""
    return "\n\n".join(f"## {title}\n\n{markdown_table(df, order, most)}" for title, (df, order) in tables.items()) + "\n"


def new_results(pages: DataFrame, stored: DataFrame | None, formats: list[str], most_links: int = 5000, budget: int | None = None) -> DataFrame:
    """Results to append: one per (job, url), none that is stored, only the asked formats, links cut.

    With ``budget`` the content (with a ``logo`` column) is fitted into it (P18) and ``metadata``, a JSON object, is bounded (P17).
    """
    drop = [c for c in ("markdown", "html", "text") if c not in formats]
    rows = pages.dropDuplicates(["job_id", "url"]).withColumn("links", F.slice("links", 1, most_links)).withColumns({c: F.lit(None).cast("string") for c in drop})
    rows = rows if stored is None else rows.join(stored.select("job_id", "url"), ["job_id", "url"], "left_anti")
    if budget is None:
        return rows
    rows = fit_budget(rows if "logo" in rows.columns else rows.withColumn("logo", F.lit(None).cast("string")), budget)
    return rows.withColumn("metadata", bound_json_metadata(F.col("metadata"))) if "metadata" in rows.columns else rows


def append_events(df: DataFrame, path: str) -> None:
    """Job event timeline."""
    df.write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str, job_id: str, n: int = 500) -> DataFrame:
    return spark.read.parquet(path).where(F.col("job_id") == job_id).orderBy("id").limit(n)
