"""Streams with state and timers against plain state machines."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siteloom.streaming import jobs as J

T0 = datetime(2024, 5, 1, 12)


@pytest.fixture
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


PAGE = "job_id long, url string, at timestamp, body string, n long"


def test_first_write_wins_over_batches_and_repeats(few_partitions, tmp_path):
    spark, rnd = few_partitions, random.Random(1)
    src, sink, ck = (f"{tmp_path}/{x}" for x in ("in", "sink", "ck"))
    rows = [(rnd.randrange(3), f"u{rnd.randrange(12)}", T0 + timedelta(seconds=rnd.randrange(99)), f"b{i}", None if i % 3 else 2**60 + i) for i in range(80)]
    want, read = {}, []
    for k in range(4):  # every batch repeats some old keys, the last one is old rows only
        batch = rows[20 * k : 20 * k + 20] if k < 3 else rows[:20]
        land(spark, batch, PAGE, src)
        q = J.ingest_pages(J.read_stream(spark, src), sink, ck, ["job_id", "url"], "at")
        q.awaitTermination(120)
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
        for key in {(r[0], r[1]) for r in batch} - set(want):
            want[key] = min((r for r in batch if (r[0], r[1]) == key), key=lambda r: r[2])[2]
    got = spark.read.parquet(sink).collect()
    assert {(r.job_id, r.url): r["at"] for r in got} == want and len(got) == len(want)
    assert all(r.n is None or r.n >= 2**60 for r in got)
    assert read == [20, 20, 20, 20]  # a batch reads its own rows, whatever is stored
    J.ingest_pages(J.read_stream(spark, src), sink, ck, ["job_id", "url"], "at").awaitTermination(120)  # nothing new: nothing changes
    assert spark.read.parquet(sink).count() == len(want)


def test_progress_never_falls(few_partitions, tmp_path):
    spark, rnd = few_partitions, random.Random(2)
    schema = "job string, at timestamp, found long, ok boolean"
    rows = [(f"j{rnd.randrange(3)}", T0 + timedelta(seconds=rnd.randrange(500)), rnd.randrange(60), rnd.random() < 0.7) for _ in range(90)]
    for k in range(3):
        land(spark, rows[30 * k : 30 * k + 30], schema, f"{tmp_path}/in")
    sink = f"{tmp_path}/sink"
    J.stream_progress(J.read_stream(spark, f"{tmp_path}/in"), sink, f"{tmp_path}/ck", "job", "at", "found", "ok").awaitTermination(120)
    plain = J.progress(spark.createDataFrame(rows, schema), "job", "at", "found", "ok")
    assert sorted(map(tuple, J.latest_progress(spark, sink, "job").select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    by_batch = spark.read.parquet(sink).orderBy("job", "batch").collect()
    assert len({r.batch for r in by_batch}) == 3
    for a, b in zip(by_batch, by_batch[1:]):
        if a.job == b.job:
            assert all(b[c] >= a[c] for c in ("discovered", "processed", "succeeded", "failed", "last_at"))


def test_a_silent_job_gets_its_action(few_partitions, tmp_path):
    spark = few_partitions
    now = datetime.now()
    ago = lambda s: now - timedelta(seconds=s)
    schema = "job_id string, kind string, status string, created_at timestamp, started_at timestamp, updated_at timestamp, timeout_s int, engine_id string"
    land(spark, [
        ("queued", "scrape", "queued", ago(10), None, ago(10), 30, None), ("slow", "scrape", "running", ago(90), ago(88), ago(88), 30, None),
        ("lost", "crawl", "running", ago(900), ago(800), ago(597), 30, "e"), ("fine", "crawl", "running", ago(5), ago(5), ago(5), 30, "e"),
        ("done", "crawl", "completed", ago(9000), ago(9000), ago(9000), 30, "e"), ("long", "crawl", "running", ago(9000), ago(9000), ago(1), 30, "e"),
        ("unstarted", "crawl", "running", ago(200), ago(119), ago(119), 30, None),
    ], schema, f"{tmp_path}/in")
    q = J.stream_overdue_jobs(J.read_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("overdue").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = {r.job_id: r.action for r in spark.table("overdue").collect()}
            if len(got) == 5:
                break
    finally:
        q.stop()
    assert got == {"queued": "dispatch_again", "slow": "interrupted", "lost": "engine_lost", "long": "too_long", "unstarted": "never_started"}
    rows = spark.read.parquet(f"{tmp_path}/in")
    batch = J.overdue_jobs(rows, F.lit(now + timedelta(seconds=20))).collect()
    assert {r.job_id: r.action for r in batch} == got


def cooled(rows, n=3, cool=900):
    """One source: (event, at) of rows (at, status), and the resumption that a timer gives at the end."""
    streak, until, out = 0, None, []
    for at, status in rows:
        if until is not None and at >= until:
            out.append(("resume", until))
            until = None
        if status is None or status >= 500 or status == 429:
            if until is None:
                streak += 1
                if streak == n:
                    streak, until = 0, at + timedelta(seconds=cool)
                    out.append(("cool_down", until))
        elif status < 400:
            if until is not None:
                out.append(("resume", at))
            streak, until = 0, None
    return out, until


def test_cool_down_equals_a_plain_machine(few_partitions, tmp_path):
    spark, rnd = few_partitions, random.Random(3)
    schema = "source string, seq long, at timestamp, status int"
    rows = [(f"s{rnd.randrange(4)}", i, T0 + timedelta(seconds=70 * i), rnd.choice([200, 404, 500, 503, 429, None, 500])) for i in range(240)]
    for k in range(6):
        batch = rows[40 * k : 40 * k + 40]
        rnd.shuffle(batch)
        land(spark, batch, schema, f"{tmp_path}/in")
    stream = J.read_stream(spark, f"{tmp_path}/in")
    q = J.stream_failure_alerts(stream, delay="0 seconds").writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.source, r["at"], r.event) for r in spark.table("cooled").collect())
    want = []
    for s in sorted({r[0] for r in rows}):
        events, left = cooled([(r[2], r[3]) for r in rows if r[0] == s])
        want += [(s, at, e) for e, at in events]
        if left and left <= rows[-1][2]:  # a timer, once the watermark is there
            want.append((s, left, "resume"))
    assert got == sorted(want) and len(want) > 8
