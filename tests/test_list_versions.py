"""Versions of lists switch at once."""

from datetime import datetime

import pytest

from siteloom.sources import sinks as K


def version(i, provider="a", day=None):
    return {"provider": provider, "list_id": f"v{i}", "downloaded_at": datetime(2024, 1, day or i + 1)}


def test_a_failed_load_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lists")
    rows = lambda i: spark.createDataFrame([(f"d{k}", 10 * i + k) for k in range(3)] + [("d0", 99)], "domain string, rank long")
    assert K.list_versions(spark, root).count() == 0 and K.list_entries(spark, root, "a") is None
    K.load_list_version(rows(1), version(1), root)
    K.load_list_version(rows(5), version(5, "b"), root)

    def fails(*_):
        raise OSError("stopped before the switch")

    with monkeypatch.context() as m:
        m.setattr(K, "_switch", fails)
        with pytest.raises(OSError):
            K.load_list_version(rows(2), version(2), root)
    ranks = lambda p: sorted((r["domain"], r["rank"]) for r in K.list_entries(spark, root, p).collect())
    assert [r["list_id"] for r in K.list_versions(spark, root).where("active and provider = 'a'").collect()] == ["v1"]
    assert ranks("a") == [("d0", 10), ("d1", 11), ("d2", 12)]
    held = K.list_entries(spark, root, "a")  # a reader that began before the switch
    K.load_list_version(rows(2), version(2), root)
    assert ranks("a") == [("d0", 20), ("d1", 21), ("d2", 22)] and ranks("b") == [("d0", 50), ("d1", 51), ("d2", 52)]
    assert held.count() == 3
    versions, pruned = K.load_list_version(rows(3), version(3), root)
    assert {(r["provider"], r["list_id"], r["active"]) for r in versions.collect()} == {("a", "v3", True), ("a", "v2", False), ("b", "v5", True)}
    assert [r["list_id"] for r in pruned.collect()] == ["v1"]
    again, replaced = K.load_list_version(rows(4), version(3, day=9), root)
    assert ranks("a") == [("d0", 40), ("d1", 41), ("d2", 42)] and [r["list_id"] for r in replaced.collect()] == ["v3"]
    assert again.where("provider = 'a'").count() == 2
