"""Incremental jobs: page ingestion, progress, terminal recount, stale jobs, failure alerts, attempt metrics."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def utc_stamp(col: str) -> Column:
    """Event time as TIMESTAMP; watermarks refuse the zone-less type."""
    return F.col(col).cast("timestamp")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _keyed_state(spark: SparkSession) -> None:
    """State with timers and time to live needs the RocksDB store; the session's later streams take it too."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: The keys of a batch are dealt to so many groups, each reduced by one call.
KEY_GROUPS = 1024


def _firsts(batches: Iterator[pa.RecordBatch], keys: list[str], at: str) -> Iterator[pa.RecordBatch]:
    """The first row of each key by ``at``, nulls last; what is held is a row per key and one batch."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        rows = rows.take(pc.sort_indices(rows[at], null_placement="at_end"))
        places = rows.select(keys).append_column("_place", pa.array(np.arange(rows.num_rows)))
        held = rows.take(places.group_by(keys, use_threads=False).aggregate([("_place", "min")])["_place_min"])
    yield from held.combine_chunks().to_batches()


def batch_firsts(stream: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first row of each key by ``at`` among the rows of a micro-batch, without state; keys are of plain types."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _firsts(batches, keys, at)

    groups = stream.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)))
    return groups.applyInArrow(firsts, stream.schema)


def first_rows(stream: DataFrame, keys: list[str], at: str, keep_s: int) -> DataFrame:
    """The first row of each key; repeats within ``keep_s`` seconds of processing time after a key's last row are dropped.

    Processing time is cut into periods of ``keep_s`` seconds.  A row marks its key in its own period and in the next one, and is
    new if the mark of its own period is.  Marks are keys of Spark's own deduplication, so no state is asked for from Python.  A key
    is forgotten when a whole period has passed without it: ``keep_s`` to twice ``keep_s`` seconds after its last row, never before.
    """
    _keyed_state(stream.sparkSession)
    period = F.floor(F.unix_seconds(F.current_timestamp()) / keep_s)  # of a batch, the same when it is replayed
    marks = F.array(*[F.struct(F.timestamp_seconds((period + i) * keep_s).alias("_period"), F.lit(i == 0).alias("_own")) for i in (0, 1)])
    rows = batch_firsts(stream, keys, at).select(F.struct("*").alias("_row"), F.explode(marks).alias("_mark"))
    rows = rows.select(*[F.col(f"_row.`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], "_mark.*", F.when(F.col("_mark._own"), F.col("_row")).alias("_row"))
    # the newest mark is a period ahead; with a second more no row is late if the clock goes back into the period before
    rows = rows.withWatermark("_period", f"{2 * keep_s + 1} seconds")
    return rows.dropDuplicates([*[f"_key{i}" for i in range(len(keys))], "_period"]).where("_own").select("_row.*")


def ingest_pages(stream: DataFrame, sink: str, checkpoint: str, keys: list[str], at: str, keep_s: int = 30 * 86_400):
    """Append rows that are new by ``keys``; the first one of a batch in order of ``at`` stays.

    What was stored is known from state, not from the sink, so a batch reads its own
    rows only however long the history is; to forget old marks Spark walks through the state once a batch.  The file sink's log makes
    a replayed batch change nothing; it must be read by Spark's own reader.  A key that no row comes of for ``keep_s`` seconds is
    forgotten before twice that time (:func:`first_rows`).  A checkpoint written with the Python state of before can't be continued.
    """
    rows, conf = first_rows(stream, keys, at, keep_s), stream.sparkSession.conf
    was = conf.get(_IDLE)
    conf.set(_IDLE, "false")  # time to live alone makes no batch: the run ends with its rows
    try:
        return _file_sink(rows, sink, checkpoint)
    finally:
        conf.set(_IDLE, was)


def _file_sink(rows: DataFrame, sink: str, checkpoint: str):
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def progress(pages: DataFrame, job: str, at: str, discovered: str, success: str) -> DataFrame:
    """Per job how much was found and done; never falls, as maxima and counts only grow.  Batch or stream."""
    done = F.count("*")
    return pages.groupBy(job).agg(F.greatest(F.max(discovered), done).alias("discovered"), done.alias("processed"), F.count_if(success).alias("succeeded"), F.count_if(~F.col(success)).alias("failed"), F.max(at).alias("last_at"))


def stream_progress(stream: DataFrame, sink: str, checkpoint: str, job: str, at: str, discovered: str, success: str):
    """T2 as a stream: after each batch the new progress of the jobs it touched, appended to ``sink`` with the batch's number.

    The state is one row of maxima and counts per job, kept by a streaming aggregation in update mode; a batch replaces its own
    folder, so that a replay changes nothing.  :func:`latest_progress` reads what stands now.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    rows = progress(stream, job, at, discovered, success)
    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, sink: str, job: str) -> DataFrame:
    """The last row of each job that :func:`stream_progress` wrote."""
    rows = spark.read.parquet(sink)
    names = [c for c in rows.columns if c not in (job, "batch")]
    return rows.groupBy(job).agg(F.max_by(F.struct(*names), "batch").alias("_r")).select(job, "_r.*")


def terminal_status(results: DataFrame, failures: DataFrame, job: str, success: str) -> DataFrame:
    """The recount at a job's end with extra failures and robots refusals; without a success it failed."""
    counts = results.groupBy(job).agg(F.count_if(success).alias("succeeded"), F.count_if(~F.col(success)).alias("_f"))
    rows = counts.join(failures.groupBy(job).agg(F.count("*").alias("_x")), job, "full").fillna(0, ["succeeded", "_f", "_x"])
    rows = rows.withColumn("failed", F.col("_f") + F.col("_x"))
    return rows.select(job, "succeeded", "failed", F.when(F.col("succeeded") > 0, "completed").otherwise("failed").alias("status"))


# Age limits in seconds.
QUEUED_S, SCRAPE_EXTRA_S, CRAWL_START_S, ENGINE_LOST_S = 15, 60, 120, 600


def overdue_jobs(jobs: DataFrame, now: Column, max_crawl_s: int = 3600) -> DataFrame:
    """T4: jobs that need an action: (kind, status, created_at, started_at, updated_at, timeout_s, engine_id)."""
    age = lambda c: F.unix_timestamp(now) - F.unix_timestamp(c)
    crawl = (F.col("kind") == "crawl") & (F.col("status") == "running")
    action = (
        F.when((F.col("status") == "queued") & (age("created_at") > QUEUED_S), "dispatch_again")
        .when((F.col("kind") == "scrape") & (F.col("status") == "running") & (age("started_at") > F.col("timeout_s") + SCRAPE_EXTRA_S), "interrupted")
        .when(crawl & F.col("engine_id").isNull() & (age("started_at") > CRAWL_START_S), "never_started").when(crawl & (age("started_at") > max_crawl_s), "too_long")
        .when(crawl & (age("updated_at") > ENGINE_LOST_S), "engine_lost")
    )
    return jobs.withColumn("action", action).where("action is not null")


def next_due(r: dict, max_crawl_s: int = 3600) -> tuple[float, str] | None:
    """When a job (a row of :func:`overdue_jobs`, times in seconds) is overdue if nothing more is heard of it, and the action then."""
    if r["status"] == "queued":
        return r["created_at"] + QUEUED_S, "dispatch_again"
    if r["status"] != "running":
        return None
    if r["kind"] == "scrape":
        return (r["started_at"] + r["timeout_s"] + SCRAPE_EXTRA_S, "interrupted") if r["started_at"] is not None else None
    due = []
    if r["started_at"] is not None:
        due.append((r["started_at"] + max_crawl_s, "too_long"))
        if r["engine_id"] is None:
            due.append((r["started_at"] + CRAWL_START_S, "never_started"))
    if r["updated_at"] is not None:
        due.append((r["updated_at"] + ENGINE_LOST_S, "engine_lost"))
    return min(due, default=None)


class JobTimers(StatefulProcessor):
    """T4 as a stream: the last row of each job is state, and a processing-time timer stands at the moment it would be overdue."""

    def __init__(self, max_crawl_s: int) -> None:
        self.max_crawl_s = max_crawl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at_ms long, action string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r["updated_at"]).asDict()
        seconds = {k: last[k].timestamp() if last[k] else None for k in ("created_at", "started_at", "updated_at")}
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        due = next_due({**last, **seconds}, self.max_crawl_s)
        if due:
            at_ms = max(int(1000 * due[0]) + 1, timerValues.getCurrentProcessingTimeInMs() + 1)
            self.due.update((at_ms, due[1]))
            self.handle.registerTimer(at_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            at_ms, action = self.due.get()
            self.due.clear()  # nothing more until the action shows as a new row of the job
            yield Row(job_id=key[0], action=action, due_at=datetime.fromtimestamp(at_ms / 1000))

    def close(self) -> None:
        pass


def stream_overdue_jobs(jobs: DataFrame, max_crawl_s: int = 3600) -> DataFrame:
    """T4 as a stream of job rows (job_id and the columns of :func:`overdue_jobs`): (job_id, action, due_at) when a job falls silent.

    Timers run on processing time, also while no row comes; each row of a job replaces its timer.
    """
    _keyed_state(jobs.sparkSession)
    schema = T.StructType([jobs.schema["job_id"], T.StructField("action", T.StringType()), T.StructField("due_at", T.TimestampType())])
    return jobs.groupBy("job_id").transformWithState(JobTimers(max_crawl_s), schema, "Append", "ProcessingTime")


def failure_alerts(attempts: DataFrame, source: str, order: list[str], failed: Column, success: Column, n: int = 3) -> DataFrame:
    """T5 as a batch: every n-th server failure in a row of a source; a success starts anew, other outcomes don't count."""
    by = Window.partitionBy(source).orderBy(*order)
    rows = attempts.withColumn("_f", failed).withColumn("_s", success).where("_f or _s")
    rows = rows.withColumn("_run", F.sum(F.col("_s").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(source, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", streak).where(F.col("_f") & (F.col("streak") % n == 0)).drop("_f", "_s", "_run")


def server_failure(status: int | None) -> bool:
    """No answer, 429 and 5xx; other 4xx say nothing of the server."""
    return status is None or status >= 500 or status == 429


class FailureAlerts(StatefulProcessor):
    """T5 as a stream: the streak of a source and the end of its cool-down are state, an event-time timer ends the cool-down."""

    def __init__(self, n: int, cooldown_ms: int) -> None:
        self.n, self.cooldown_ms = n, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "streak int, until_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        streak, until = self.held.get() if self.held.exists() else (0, 0)
        timer = until
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at = round(1000 * r["at"].timestamp())
            failed = server_failure(r["status"])
            if until and at >= until:  # before its timer, as the row came first
                yield self._row(key, "resume", until)
                until = 0
            if not failed and r["status"] >= 400:
                continue
            if not failed:
                if until:
                    yield self._row(key, "resume", at)
                streak, until = 0, 0
            elif not until:
                streak += 1
                if streak == self.n:
                    streak, until = 0, at + self.cooldown_ms
                    yield self._row(key, "cool_down", until)
        if timer != until:
            if timer:
                self.handle.deleteTimer(timer)
            if until:
                self.handle.registerTimer(until)
        if streak or until:
            self.held.update((streak, until))
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        streak, until = self.held.get() if self.held.exists() else (0, 0)
        if until == expiredTimerInfo.getExpiryTimeInMs():
            if streak:
                self.held.update((streak, 0))
            else:
                self.held.clear()
            yield self._row(key, "resume", until)

    def _row(self, key, what: str, ms: int) -> Row:
        return Row(source=key[0], event=what, at=datetime.fromtimestamp(ms / 1000))

    def close(self) -> None:
        pass


def stream_failure_alerts(attempts: DataFrame, n: int = 3, cooldown_s: int = 900, delay: str = "10 minutes") -> DataFrame:
    """T5: ``attempts(source, seq, at, status)`` -> (source, event, at): ``cool_down`` until a time, and ``resume``.

    ``n`` server failures in a row (no status, 429, 5xx) begin a cool-down, in which further failures are passed over; a
    success ends it and the streak, other answers below 500 change nothing, and after it the streak starts anew.  Rows of a
    source that come together are taken in order of (at, seq); rows later than ``delay`` are dropped.
    """
    _keyed_state(attempts.sparkSession)
    schema = T.StructType([attempts.schema["source"], T.StructField("event", T.StringType()), T.StructField("at", T.TimestampType())])
    rows = attempts.withWatermark("at", delay)
    return rows.groupBy("source").transformWithState(FailureAlerts(n, 1000 * cooldown_s), schema, "Append", "EventTime", eventTimeColumnName="at")


def attempt_metrics(attempts: DataFrame, at: str, source: str, value: str, failed: Column, delay: str | None = None) -> DataFrame:
    """Attempts, failures and the 95th percentile per source and hour; on a stream rows later than ``delay`` are dropped."""
    rows = attempts.withWatermark(at, delay) if delay else attempts
    p95 = F.percentile_approx(value, 0.95, 10_000) if delay else F.percentile(value, F.lit(0.95))
    out = rows.groupBy(F.window(at, "1 hour"), source).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), p95.alias("p95"))
    return out.select(F.col("window.start").alias("hour"), source, "n", "n_failed", "p95")
