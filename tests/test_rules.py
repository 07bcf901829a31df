"""Classifier boundary table (C1-C16) with hand-computed rows."""

import pytest
from pyspark.sql import types as T

from transitlab.config import Thresholds
from transitlab.operators.classify import classify

SCHEMA = T.StructType(
    [T.StructField("object_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("koi_period", "koi_prad", "koi_teq", "koi_insol", "transit_depth", "duration_ratio")]
    + [T.StructField("koi_disposition", T.StringType())]
)

nan = float("nan")
# id, period, prad, teq, insol, depth, ratio, disposition -> category, score, flags
CASES = [
    ("gate", None, None, None, None, 0.9, 3.0, "CONFIRMED", "no_result", 0.0, "FLAG_NO_FEATURES"),
    ("gate_nan", nan, nan, None, None, None, None, None, "no_result", 0.0, "FLAG_NO_FEATURES"),
    ("conf", 5.0, 40.0, None, None, 0.9, None, " confirmed ", "confirmed_planet", 0.95, ""),
    ("fp", 5.0, 1.0, None, None, None, None, "false positive", "likely_false_positive", 0.9, ""),
    ("radius", 20.0, 31.0, 500.0, None, None, None, None, "anomalous_signal", 0.7, "FLAG_RADIUS_TOO_LARGE"),
    ("radius30", 20.0, 30.0, 500.0, None, None, None, None, "candidate", 0.5, ""),
    ("depth_eq", 20.0, 3.0, 500.0, None, 0.05, None, None, "super_earth_or_mini_neptune", 0.55, ""),
    ("depth_gt", 20.0, 3.0, 500.0, None, 0.0501, None, None, "anomalous_signal", 0.7, "FLAG_ANOMALOUS_DEPTH"),
    ("short", 20.0, 3.0, 500.0, None, None, 0.49, None, "super_earth_or_mini_neptune", 0.55, "FLAG_DURATION_TOO_SHORT"),
    ("ratio_lo", 20.0, 3.0, 500.0, None, None, 0.5, None, "super_earth_or_mini_neptune", 0.55, ""),
    ("ratio_hi", 20.0, 3.0, 500.0, None, None, 1.8, None, "super_earth_or_mini_neptune", 0.55, ""),
    ("long", 20.0, 3.0, 500.0, None, None, 1.81, None, "super_earth_or_mini_neptune", 0.55, "FLAG_DURATION_TOO_LONG"),
    ("cold", 20.0, 3.0, 79.0, None, 0.02, None, None, "anomalous_signal", 0.7, "FLAG_COLD_DEEP_TRANSIT"),
    ("cold80", 20.0, 3.0, 80.0, None, 0.02, None, None, "super_earth_or_mini_neptune", 0.55, ""),
    ("three", 20.0, 31.0, 70.0, None, 0.06, 2.0, None, "anomalous_signal", 0.9,
     "FLAG_RADIUS_TOO_LARGE;FLAG_ANOMALOUS_DEPTH;FLAG_DURATION_TOO_LONG;FLAG_COLD_DEEP_TRANSIT"),
    ("two", 20.0, 31.0, 500.0, None, 0.06, None, None, "anomalous_signal", 0.8, "FLAG_RADIUS_TOO_LARGE;FLAG_ANOMALOUS_DEPTH"),
    ("rocky_hab", 20.0, 1.9, 200.0, None, None, None, None, "rocky_candidate", 0.6, ""),
    ("rocky_both", 20.0, 1.9, 200.0, 1.0, None, None, None, "rocky_candidate", 0.7, ""),
    ("prad2", 20.0, 2.0, 500.0, None, None, None, None, "super_earth_or_mini_neptune", 0.55, ""),
    ("prad6", 5.0, 6.0, 500.0, None, None, None, None, "candidate", 0.5, ""),
    ("prad6_hab", 5.0, 6.0, 250.0, None, None, None, None, "habitable_zone_candidate", 0.55, ""),
    ("hot_p10", 10.0, 8.0, 500.0, None, None, None, None, "hot_jupiter_candidate", 0.65, ""),
    ("hot_teq", 11.0, 8.0, 1000.0, None, None, None, None, "hot_jupiter_candidate", 0.65, ""),
    ("not_hot", 11.0, 8.0, 999.0, None, None, None, None, "candidate", 0.5, ""),
    ("hot_hab", 5.0, 9.0, 250.0, 1.0, None, None, None, "hot_jupiter_candidate", 0.7, ""),
    ("hab180", 20.0, None, 180.0, None, None, None, None, "habitable_zone_candidate", 0.55, "FLAG_MISSING_PRAD"),
    ("hab310", 20.0, None, 310.0, None, None, None, None, "habitable_zone_candidate", 0.55, "FLAG_MISSING_PRAD"),
    ("hab_out", 20.0, None, 310.5, None, None, None, None, "candidate", 0.5, "FLAG_MISSING_PRAD"),
    ("ins05", None, None, None, 0.5, None, None, None, "habitable_zone_candidate", 0.55,
     "FLAG_MISSING_PRAD;FLAG_MISSING_PERIOD;FLAG_MISSING_TEQ"),
    ("ins20", None, None, None, 2.0, None, None, "CANDIDATE", "habitable_zone_candidate", 0.55,
     "FLAG_MISSING_PRAD;FLAG_MISSING_PERIOD;FLAG_MISSING_TEQ"),
    ("cand", None, None, None, 2.5, None, None, " candidate ", "candidate", 0.5,
     "FLAG_MISSING_PRAD;FLAG_MISSING_PERIOD;FLAG_MISSING_TEQ"),
]


@pytest.fixture(scope="module")
def result(spark):
    rows = [c[:8] for c in CASES]
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["object_id"]: r for r in classify(df).collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_rule(result, case):
    r = result[case[0]]
    assert (r["category"], r["score"], r["flags"]) == (case[8], case[9], case[10])


def test_comparison(result):
    assert result["conf"]["disposition_compare"] == "match"
    assert result["conf"]["is_disposition_match"] is True
    assert result["conf"]["color_hint"] == "black"
    assert result["gate"]["disposition_compare"] == "mismatch"
    assert result["gate"]["color_hint"] == "red"
    assert result["radius"]["disposition_compare"] == "missing"
    assert result["radius"]["is_disposition_match"] is None
    assert result["radius"]["color_hint"] == "green"
    assert result["cand"]["disposition_compare"] == "match"  # ' candidate ' -> candidate
    assert result["ins20"]["disposition_compare"] == "mismatch"


def test_total_and_bounded(spark, result):
    assert len(result) == len(CASES)
    assert all(0.0 <= r["score"] <= 1.0 for r in result.values())


def test_custom_thresholds(spark):
    df = spark.createDataFrame([("a", 20.0, 1.7, 500.0, None, None, None, None)], SCHEMA)
    th = Thresholds.load({"planet_radius": {"rocky_max": 1.5}})
    r = classify(df, th).first()
    assert r["category"] == "super_earth_or_mini_neptune"
    assert classify(df).first()["category"] == "rocky_candidate"
