"""Exact ranks, medians and percentiles over many values, by key sizes, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteloom.operators import evaluate as E


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=120_000), 4)
    v[::7] = 0.5  # a value with a seventh of all rows
    v[:60_000] += np.arange(60_000) / 1e9  # and 60,000 that differ
    return v


def keyed(values, n_keys):
    return pd.DataFrame({"k": np.arange(len(values)) % n_keys, "v": values})


@pytest.mark.parametrize("n_keys, small", [(1, False), (3, False), (1000, False), (1000, True)])
def test_running_counts_of_many_values(spark, values, n_keys, small):
    df = keyed(values, n_keys)
    got = E.running_counts(spark.createDataFrame(df), ["k"], "v", small).toPandas().sort_values(["k", "v"])
    want = df.groupby(["k", "v"]).size().reset_index(name="n")
    want["before"] = want.groupby("k")["n"].cumsum() - want["n"]
    want["total"] = want.groupby("k")["n"].transform("sum")
    for c in ("k", "v", "n", "before", "total"):
        assert np.array_equal(got[c].to_numpy(), want[c].to_numpy()), c


@pytest.mark.parametrize("n_keys", [1, 3, 1000])
def test_medians_and_percentiles(spark, values, n_keys):
    df = keyed(values, n_keys)
    got = E.error_summary(spark.createDataFrame(df), "k", "v").toPandas().set_index("k").sort_index()
    for k, v in df.groupby("k")["v"]:
        a = np.sort(np.abs(v.to_numpy()))
        assert got["median"][k] == pytest.approx(np.median(v), abs=1e-12)
        assert got["p90"][k] == a[min(len(a) - 1, int(len(a) * 0.9))]


@pytest.mark.parametrize("n_keys, small", [(1, False), (1000, True), (1000, False)])
def test_rank_correlation(spark, values, n_keys, small):
    df = keyed(values, n_keys)
    df["w"] = np.round(df["v"] * 2 + np.sin(np.arange(len(df))), 2)
    got = E.spearman(spark.createDataFrame(df), "k", "v", "w", small).toPandas().set_index("k")
    ranks = df.groupby("k")[["v", "w"]].rank().assign(k=df["k"])
    for k, r in ranks.groupby("k"):
        assert got["rho"][k] == pytest.approx(np.corrcoef(r["v"], r["w"])[0, 1], abs=1e-9)


def test_keys_and_values_may_be_null(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for small in (False, True):
        got = {(r.k, r.v): (r.n, r.before, r.total) for r in E.running_counts(df, ["k"], "v", small).collect()}
        assert got == {(None, 1.0): (1, 0, 2), (None, 3.0): (1, 1, 2), ("a", 2.0): (1, 0, 1)}
    assert E.running_counts(df.where(F.lit(False)), ["k"], "v").collect() == []
