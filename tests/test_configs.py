"""Estimator configurations from YAML give the estimates of the shipped ones, and what they leave out its stated value."""

import pytest
from pyspark.sql import functions as F

from siteloom.operators import estimate as T
from siteloom.sources import configs as C

FEATURES = "domain string, tranco_rank double, tranco_list_size double, crawl_reachable boolean, crawl_parked boolean, dns_resolves boolean, dns_nxdomain boolean, rdap_status string, opr_ref_domains double"
ROWS = [("big", 100.0, 4e6, True, False, True, False, None, None), ("none", None, 4e6, False, False, False, True, "not_found", None), ("parked", 1000.0, 4e6, True, True, True, False, None, None), ("absent", None, 4.6e6, True, False, True, False, None, 1e5)]


def as_yaml(config: dict, version: str) -> str:
    """The shipped configuration in the shape of a file, with its keys in another order."""
    import yaml

    data = {
        "confidence": {"labels": {"high": config["confidence"]["high"], "medium": config["confidence"]["medium"]}, "source_weights": config["source_weights"], "coverage_weight": config["confidence"]["coverage"],
                       "agreement_weight": config["confidence"]["agreement"], "popularity_bonus": config["confidence"]["bonus"], "disagreement_scale": config["confidence"]["scale"]},
        "range": {"base": config["range"]["base"], "missing_evidence": config["range"]["missing"], "disagreement": config["range"]["disagreement"], "max": config["range"]["max"]},
        "modifiers": {f"{k}_cap": v for k, v in config["caps"].items()} | {f"{k}_shift": v for k, v in config["shifts"].items()},
        "absent_from_list_caps": {c["signal"]: {"source": c["source"], "list_size_feature": c["size"], "signal": c["signal"], "tolerance": c["tolerance"], "unless_present": c["unless_present"]} for c in config["absence_caps"]},
        "no_popularity_cap": config["no_popularity_cap"],
        "signals": {n: {"feature": f, "weight": w, "kind": k, "points": [list(p) for p in reversed(points)]} for n, f, w, k, points in config["signals"]},
        "model_version": version,
    }
    return yaml.safe_dump(data, sort_keys=False)


@pytest.fixture
def inputs(spark):
    features = spark.createDataFrame(ROWS, FEATURES)
    seen = spark.createDataFrame([("big", "tranco", True), ("absent", "tranco", False), ("parked", "tranco", True)], "domain string, source string, found boolean")
    return features, T.source_status(features, seen.withColumns({"blocked": F.lit(False), "reachable": F.lit(True)}), list(T.V2["source_weights"]))


@pytest.mark.parametrize("version", ["heuristic_v1", "heuristic_v2"])
def test_a_file_gives_the_shipped_estimates(spark, tmp_path, inputs, version):
    (tmp_path / "c.yaml").write_text(as_yaml(T.CONFIGS[version], version))
    config = C.read_config(spark, str(tmp_path / "c.yaml"))
    assert {k: v for k, v in config.items() if k in T.CONFIGS[version] and k != "signals"} == {k: v for k, v in T.CONFIGS[version].items() if k != "signals"}
    rows = lambda v: sorted(map(repr, T.estimate(*inputs, v).collect()))
    assert rows(config) == rows(version)


def test_buckets_and_curves_of_a_file_take_effect(spark, inputs):
    text = "model_version: own_v1\nsignals:\n  tranco: {feature: log_tranco_rank, kind: popularity, points: [[7, 2], [0, 9]]}\nbuckets:\n  - {label: much, min: 1000000, max: null}\n  - {label: little, min: 0, max: 1000000}\n"
    got = {r["domain"]: r for r in T.estimate(*inputs, C.parse_config(text)).collect()}
    assert got["big"]["details"]["log10_estimate"] == 7.0 and got["big"]["visits"] == 10**7 and got["big"]["bucket"] == "much" and got["big"]["model_version"] == "own_v1"
    assert got["parked"]["bucket"] == "little" and got["parked"]["details"]["log10_estimate"] == 2.3 and got["none"]["details"]["log10_estimate"] == 1.5
    both = T.compare_models(inputs[0].select("domain"), inputs[0].select("domain", F.lit("completed").alias("run_status")), *inputs, ["heuristic_v2", C.parse_config(text)])
    assert {(r["model_version"], r["domain"]) for r in both.collect()} == {(v, x[0]) for v in ("heuristic_v2", "own_v1") for x in ROWS}


def test_what_a_file_leaves_out_and_bad_files():
    config = C.parse_config("model_version: x")
    assert config["no_popularity_cap"] == 4.6 and config["range"]["max"] == 1.3 and config["shifts"]["unreachable"] == -0.4 and config["signals"] == [] and config["buckets"][0] == ("<1K", 0)
    for bad in ("- a", "", "signals: {a: {feature: f, points: []}}", "signals: {\"a'b\": {feature: f, points: [[0, 1]]}}", "no_popularity_cap: .inf", "range: 3", "signals: {a: {feature: f, points: [[0, x]]}}"):
        with pytest.raises(ValueError):
            C.parse_config(bad)
