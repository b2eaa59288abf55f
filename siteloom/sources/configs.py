"""Estimator configurations read from YAML files."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import SparkSession

from ..operators.evaluate import BUCKETS

# What a configuration that leaves a value out means.
DEFAULT_CAPS = {"parked": 2.3, "unregistered": 1.5, "nxdomain": 2.0}
DEFAULT_SHIFTS = {"unreachable": -0.4, "blocked": 0.0, "analytics": 0.0, "advertising": 0.0, "ecommerce": 0.0}
DEFAULT_RANGE = {"base": 0.3, "missing": 0.5, "disagreement": 0.8, "max": 1.3}
DEFAULT_CONFIDENCE = {"coverage": 0.55, "agreement": 0.35, "bonus": 0.1, "scale": 1.0, "high": 0.7, "medium": 0.4}
DEFAULT_NO_POPULARITY_CAP, DEFAULT_TOLERANCE = 4.6, 0.5

_NAME = re.compile(r"[A-Za-z0-9_.:-]+")


def _name(value: Any) -> str:
    if not isinstance(value, str) or not _NAME.fullmatch(value):
        raise ValueError(f"not a name: {value!r}")
    return value


def _number(value: Any, where: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError(f"{where}: not a number: {value!r}")
    out = float(value)
    if not math.isfinite(out):
        raise ValueError(f"{where}: not a finite number: {value!r}")
    return out


def _section(data: dict, key: str) -> dict:
    found = data.get(key)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{key}: a mapping is expected")
    return found or {}


def _values(data: dict, where: str, defaults: dict[str, float], spelled: dict[str, str]) -> dict[str, float]:
    """The numbers of ``defaults``, each taken from ``data`` by the key that ``spelled`` gives it (else its own) where it is there."""
    return {k: _number(data.get(spelled.get(k, k), v), f"{where}.{k}") for k, v in defaults.items()}


def parse_config(text: str) -> dict:
    """The configuration of a YAML document, in the form of ``estimate.V2``.

    What is left out takes the defaults above; curves are sorted by their first number; buckets are sorted by lower edge.
    Not a mapping, a curve without points, a value that is no finite number and a name with other characters than
    letters, digits and ``_.:-`` are errors.
    """
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading estimator configurations needs PyYAML") from e
    data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    signals = []
    for name, spec in _section(data, "signals").items():
        points = sorted((_number(a, name), _number(b, name)) for a, b in spec["points"])
        if not points:
            raise ValueError(f"signals.{name}: a curve needs points")
        signals.append((_name(name), _name(spec["feature"]), _number(spec.get("weight", 1.0), name), _name(spec.get("kind", "other")), points))
    caps = [
        {"source": _name(c["source"]), "size": _name(c["list_size_feature"]), "signal": _name(c["signal"]), "tolerance": _number(c.get("tolerance", DEFAULT_TOLERANCE), name), "unless_present": [_name(x) for x in c.get("unless_present") or []]}
        for name, c in _section(data, "absent_from_list_caps").items()
    ]
    modifiers, sure = _section(data, "modifiers"), _section(data, "confidence")
    flat = sure | _section(sure, "labels")
    return {
        "model_version": _name(data.get("model_version", "heuristic_v1")), "signals": signals,
        "no_popularity_cap": _number(data.get("no_popularity_cap", DEFAULT_NO_POPULARITY_CAP), "no_popularity_cap"), "absence_caps": caps,
        "caps": _values(modifiers, "modifiers", DEFAULT_CAPS, {k: f"{k}_cap" for k in DEFAULT_CAPS}),
        "shifts": _values(modifiers, "modifiers", DEFAULT_SHIFTS, {k: f"{k}_shift" for k in DEFAULT_SHIFTS}),
        "range": _values(_section(data, "range"), "range", DEFAULT_RANGE, {"missing": "missing_evidence"}),
        "confidence": _values(flat, "confidence", DEFAULT_CONFIDENCE, {"coverage": "coverage_weight", "agreement": "agreement_weight", "bonus": "popularity_bonus", "scale": "disagreement_scale"}),
        "source_weights": {_name(k): _number(v, k) for k, v in _section(sure, "source_weights").items()},
        "buckets": sorted(((str(b["label"]), _number(b["min"], "buckets")) for b in data["buckets"]), key=lambda b: b[1]) if data.get("buckets") else BUCKETS,
    }


def read_config(spark: SparkSession, path: str) -> dict:
    """The configuration in a YAML file of a few kilobytes, read wherever Spark reads."""
    return parse_config(spark.read.text(path, wholetext=True).first()[0])
