"""Metric formulas (M1-M9) against hand-computed values."""

import math

import pytest
from pyspark.sql import types as T

from transitlab.functions.metrics import albedo_factor
from transitlab.operators.enrich import enrich

COLS = ("koi_period", "koi_prad", "koi_sma", "koi_teq", "koi_insol", "koi_smass", "koi_srad", "koi_steff",
        "koi_duration", "koi_impact")
SCHEMA = T.StructType([T.StructField("object_id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in COLS])


def row(oid, **kw):
    return (oid,) + tuple(kw.get(c) for c in COLS)


@pytest.mark.parametrize("a,expected", [(0.0, 1.0), (0.1, 0.9740), (0.3, 0.9147), (0.5, 0.8409), (0.7, 0.7401)])
def test_albedo_table(a, expected):
    assert round(albedo_factor(a), 4) == expected


def test_albedo_range():
    with pytest.raises(ValueError):
        albedo_factor(1.2)


@pytest.fixture(scope="module")
def enriched(spark):
    rows = [
        row("earth", koi_period=365.25, koi_smass=1.0, koi_srad=1.0, koi_steff=5772.0, koi_prad=109.0, koi_duration=10.0),
        row("given", koi_period=10.0, koi_sma=0.5, koi_teq=300.0, koi_insol=1.5, koi_srad=1.0, koi_steff=5000.0,
            koi_impact=1.2, koi_duration=3.0),
        row("neg", koi_period=-1.0, koi_prad=-2.0, koi_srad=0.0, koi_steff=1500.0),
        row("nan", koi_period=float("nan"), koi_smass=1.0, koi_srad=1.0, koi_steff=12000.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["object_id"]: r for r in enrich(df).collect()}


def test_kepler_and_derivations(enriched):
    e = enriched["earth"]
    assert e["koi_sma"] == pytest.approx(1.0, rel=1e-12)
    assert e["koi_teq"] == pytest.approx(5772.0 * math.sqrt(1.0 / 2.0) * 0.7 ** 0.25, rel=1e-12)
    assert e["koi_insol"] == pytest.approx(1.0, rel=1e-12)
    assert e["transit_depth"] == pytest.approx(1.0)
    exp = 24.0 * (365.25 / math.pi) * math.sqrt(1 - 0.25) * 1.0
    assert e["expected_duration_hours"] == pytest.approx(exp, rel=1e-12)
    assert e["duration_ratio"] == pytest.approx(10.0 / exp, rel=1e-12)
    assert e["soft_flags"] == ""


def test_fill_only_missing(enriched):
    g = enriched["given"]
    assert (g["koi_sma"], g["koi_teq"], g["koi_insol"]) == (0.5, 300.0, 1.5)
    assert g["expected_duration_hours"] == 0.0  # b >= 1 -> sqrt(max(0, 1-b^2)) = 0
    assert g["duration_ratio"] is None  # expected not > 0


def test_soft_flags_and_guards(enriched):
    n = enriched["neg"]
    assert n["soft_flags"] == ("SOFT_NEGATIVE_RADIUS;SOFT_NEGATIVE_STELLAR_RADIUS;SOFT_NEGATIVE_PERIOD;"
                               "SOFT_STELLAR_TEFF_OUT_OF_RANGE")
    assert n["koi_sma"] is None and n["transit_depth"] is None and n["expected_duration_hours"] is None
    m = enriched["nan"]
    assert m["koi_period"] is None  # NaN -> NULL on entry (D2)
    assert m["koi_sma"] is None
    assert m["soft_flags"] == "SOFT_STELLAR_TEFF_OUT_OF_RANGE"


def test_no_derive(spark):
    df = spark.createDataFrame([row("x", koi_period=365.25, koi_smass=1.0, koi_srad=1.0, koi_steff=5772.0)], SCHEMA)
    r = enrich(df, auto_derive=False).first()
    assert r["koi_sma"] is None and r["koi_teq"] is None and r["koi_insol"] is None
    assert "expected_duration_hours" in r.asDict()


def test_text_inputs(spark):
    df = spark.createDataFrame([("a", "1.5", " NA ", "abc", "1.5d")], "object_id string, koi_period string, koi_prad string, koi_teq string, koi_insol string")
    r = enrich(df).first()
    assert r["koi_period"] == 1.5
    assert r["koi_prad"] is None and r["koi_teq"] is None and r["koi_insol"] is None
