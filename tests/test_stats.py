"""Distributed exact median, mode and category list."""

import random
import statistics

import pytest

from pyspark.sql import functions as F

from transitlab.config import FeatureSpec
from transitlab.operators.features import fit, sparse_onehot
from transitlab.operators.stats import category_vocabulary, distinct_values, exact_medians, modes


@pytest.mark.parametrize("n,hot", [(1, False), (2, False), (1001, False), (20000, False), (20000, True)])
def test_exact_median_matches_python(spark, n, hot):
    rnd = random.Random(n)
    vals = [rnd.uniform(-1e3, 1e3) for _ in range(n)]
    if hot:  # a third of the rows share one value
        vals[: n // 3] = [42.0] * (n // 3)
    rows = [(v, None) for v in vals]
    df = spark.createDataFrame(rows, "x double, empty double").repartition(6)
    got = exact_medians(df, ["x", "empty"], accuracy=200)
    assert got["x"] == statistics.median(vals)
    assert got["empty"] is None


def test_median_of_a_coarse_sketch(spark):
    """A sketch too coarse for the data asks again with a finer one; there is no last round."""
    df = spark.range(50_001).select((F.col("id") * 7919 % 50_001).cast("double").alias("x"))
    assert exact_medians(df, ["x"], accuracy=2)["x"] == 25_000.0


def test_median_asks_no_quantile_buffer_of_the_whole_column(spark, monkeypatch):
    """The first pass over all values is a KLL sketch; where a pivot has the middle rank, no other follows."""
    rows = [(float(i % 7), i % 5, None) for i in range(700)] + [(float("inf"), None, None), (-float("inf"), None, None)]
    df = spark.createDataFrame(rows, "x double, whole int, empty double").repartition(4)

    def unwanted(*args):
        raise AssertionError("percentile_approx over the whole column")

    monkeypatch.setattr(F, "percentile_approx", unwanted)
    assert exact_medians(df, ["x", "whole", "empty"], accuracy=2000) == {"x": 3.0, "whole": 2.0, "empty": None}


def test_modes_and_distinct(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "s string")
    assert modes(df, ["s"]) == {"s": "a"}  # tie -> smallest
    assert [r["v"] for r in distinct_values(df, "s").collect()] == ["a", "b", "c"]


@pytest.fixture(scope="module")
def many(spark):
    """1,500 values, one of them twice, and a NULL."""
    return spark.range(1502).select(
        F.when(F.col("id") < 1501, F.concat(F.lit("v"), F.lpad((F.col("id") % 1500).cast("string"), 4, "0"))).alias("s")
    )


def test_vocabulary_at_any_cardinality(many):
    rows = category_vocabulary(many, "s").orderBy("index").collect()
    assert [tuple(r) for r in rows] == [(f"v{i:04}", i) for i in range(1500)]


def test_fit_impute_and_encode_many_categories(many):
    spec = lambda **how: FeatureSpec(categorical=({"name": "s", **how},))
    assert fit(many, spec(encoding="raw", impute="constant")).categorical[0]["fill"] == "UNK"
    raw = fit(many, spec(encoding="raw", impute="most_frequent"))
    assert raw.categorical[0]["fill"] == "v0000"
    assert raw.transform(many).where("s = 'v0000'").count() == 3
    assert len(fit(many, spec(encoding="onehot")).feature_names) == 1500
    vectors, size = sparse_onehot(many, "s")
    assert size == 1500
    got = {r["s"]: (r["s_vec"].size, r["s_vec"].indices.tolist()) for r in vectors.collect()}
    assert got["v0007"] == (1501, [7]) and got[None] == (1501, [1500])
