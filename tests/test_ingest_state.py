"""Page ingestion: marks in Spark's own state, told apart without Python, and forgotten in time."""

import json
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from siteloom.streaming import jobs as J

T0 = datetime(2024, 5, 1, 12)
PAGE = "job_id long, url string, at timestamp, body string"


@pytest.fixture
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)


def land(spark, rows, path):
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(path)


def ingest(spark, path, keep_s=86_400):
    q = J.ingest_pages(J.read_stream(spark, f"{path}/in"), f"{path}/sink", f"{path}/ck", ["job_id", "url"], "at", keep_s)
    q.awaitTermination(120)
    return q


def test_state_is_not_asked_for_from_python_by_key(few_partitions, tmp_path, monkeypatch):
    spark, keys = few_partitions, 300
    monkeypatch.setattr(J, "KEY_GROUPS", 8)
    rows = [(i % 7, f"u{i % keys}", T0 + timedelta(seconds=(i * 31) % 997), f"b{i}") for i in range(2 * 7 * keys)]
    land(spark, rows, f"{tmp_path}/in")
    q = ingest(spark, tmp_path)
    plan = q._jsq.explainInternal(False)
    assert "TransformWithState" not in plan and "StreamingDeduplicate" in plan
    best = {}
    for r in rows:
        best[r[:2]] = min(best.get(r[:2], r[2]), r[2])
    got = spark.read.parquet(f"{tmp_path}/sink").collect()
    assert len(got) == len(best) and {(r.job_id, r.url): r["at"] for r in got} == best


def test_null_keys_and_times(few_partitions, tmp_path):
    spark = few_partitions
    land(spark, [(1, None, None, "late"), (1, None, T0, "first"), (None, "u", None, "only"), (None, None, T0, "bare"), (None, None, None, "later")], f"{tmp_path}/in")
    ingest(spark, tmp_path)
    land(spark, [(1, None, T0 - timedelta(days=1), "again"), (None, "u", T0, "again"), (2, None, None, "new")], f"{tmp_path}/in")
    ingest(spark, tmp_path)
    got = {(r.job_id, r.url, r.body) for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    assert got == {(1, None, "first"), (None, "u", "only"), (None, None, "bare"), (2, None, "new")}


def test_a_hot_key_is_held_once():
    seen = []

    def batches():
        for i in range(50, 0, -1):
            seen.append(pa.total_allocated_bytes())
            yield pa.record_batch({"k": pa.array(["hot"] * 999 + [None]), "at": pa.array([i * 1000 + j for j in range(999)] + [None]), "body": pa.array(["x" * 1000] * 1000)})

    out = pa.Table.from_batches(list(J._firsts(batches(), ["k"], "at"))).to_pylist()
    assert sorted((r["k"] or "", r["at"]) for r in out) == [("", None), ("hot", 1000)]
    assert max(seen[2:]) - seen[0] < 5_000_000  # of 50 MB


def test_keys_are_forgotten_after_a_whole_period_without_them(few_partitions, tmp_path):
    spark, keep = few_partitions, 6
    for k, pause in enumerate((0, 0, 3, 13, 0)):
        time.sleep(pause)
        land(spark, [(1, "kept", T0, f"b{k}")] + [(2, f"v{i}", T0, f"b{k}") for i in range(100 * k, 100 * k + 100)], f"{tmp_path}/in")
        q = ingest(spark, tmp_path, keep)
    at = [json.loads((tmp_path / "ck" / "offsets" / str(k)).read_text().split("\n")[1])["batchTimestampMs"] for k in range(5)]
    want = [k for k in range(5) if k == 0 or at[k] // 1000 // keep - at[k - 1] // 1000 // keep > 1]
    rows = spark.read.parquet(f"{tmp_path}/sink").collect()
    assert sorted(int(r.body[1:]) for r in rows if r.url == "kept") == want and 3 in want
    assert all(at[k] - at[k - 1] > 1000 * keep for k in want[1:])  # never before keep_s
    assert len(rows) == 500 + len(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 2 * 501  # the first batches' marks are gone
