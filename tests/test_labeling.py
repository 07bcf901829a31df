"""Labelling queue: scoring, ranking, merge, apply, enqueue."""

from pyspark.sql import functions as F

from transitlab.config import LabelingConfig
from transitlab.operators import labeling

REPORT = "object_id string, category string, score double, flags string, koi_disposition string"


def test_score_and_boost(spark):
    df = spark.createDataFrame(
        [("a", "anomalous_signal", 0.7, "FLAG_ANOMALOUS_DEPTH;FLAG_MISSING_PRAD", None),
         ("b", "unknown_cat", None, "", "CONFIRMED"),
         ("c", " candidate ", 0.5, ";;FLAG_MISSING_PRAD;", None)], REPORT)
    cfg = LabelingConfig.load()
    got = {r[0]: r[1] for r in df.select("object_id", labeling.labeling_score(df, cfg)).collect()}
    assert got["a"] == 5.0 + 2 * 0.5 + (1 - abs(0.5 - 0.7) * 2) * 2
    assert got["b"] == 0.0 + 0.0 + (1 - 0.5 * 2) * 2
    assert got["c"] == 3.0 + 0.5 + 2.0


def test_uncertainty_column(spark):
    df = spark.createDataFrame([("a", 0.5, 1.7), ("b", 0.5, -0.2), ("c", 0.9, None), ("d", 0.9, float("nan"))],
                               "object_id string, score double, uncertainty double")
    got = {r[0]: r[1] for r in df.select("object_id", labeling.uncertainty_boost(df, LabelingConfig.load())).collect()}
    assert got["a"] == 2.0 and got["b"] == 0.0
    assert abs(got["c"] - (1 - 0.4 * 2) * 2) < 1e-12 and abs(got["d"] - got["c"]) < 1e-12  # D8


def test_queue_order_limit_and_plan(spark):
    rows = [(f"o{i}", cat, s, "", None) for i, (cat, s) in enumerate(
        [("rocky_candidate", 0.6), ("anomalous_signal", 0.9), ("candidate", 0.5), ("hot_jupiter_candidate", 0.65),
         ("anomalous_signal", 0.7), ("", None)])]
    df = spark.createDataFrame(rows, REPORT)
    q = labeling.build_queue(df, LabelingConfig.load(), limit=4)
    got = [(r["object_id"], r["suggested_label"], r["queue_pos"]) for r in q.orderBy("queue_pos").collect()]
    assert got[0][1] == "anomalous_signal" and got[1][1] == "anomalous_signal"
    assert got[0][0] == "o4"  # 0.7 is nearer 0.5 -> bigger boost -> first
    assert [g[2] for g in got] == [0, 1, 2, 3]
    assert {g[1] for g in got[2:]} == {"candidate"}  # '' becomes candidate
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_unlimited_queue_positions(spark):
    df = spark.range(0, 500, numPartitions=5).select(
        F.concat(F.lit("id"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("object_id"),
        F.lit("candidate").alias("category"), (F.col("id") % 7 / 10.0).alias("score"),
        F.lit("").alias("flags"), F.lit(None).cast("string").alias("koi_disposition"))
    q = labeling.build_queue(df, LabelingConfig.load(), limit=0).orderBy("queue_pos").collect()
    assert [r["queue_pos"] for r in q] == list(range(500))
    keys = [(-r["score_labeling"], r["object_id"]) for r in q]
    assert keys == sorted(keys)


def test_merge_apply_enqueue(spark):
    schema = "object_id string, suggested_label string, score_model double, score_labeling double, flags array<string>, queue_pos long"
    old = spark.createDataFrame([("a", "x", 0.1, 1.0, [], 0), ("b", "x", 0.1, 1.0, [], 1)], schema)
    new = spark.createDataFrame([("c", "y", 0.1, 1.0, [], 0), ("a", "y", 0.1, 1.0, [], 1), ("d", "y", 0.1, 1.0, [], 2)], schema)
    merged = labeling.merge_queues(old, new).orderBy("queue_pos").collect()
    assert [(r["object_id"], r["suggested_label"], r["queue_pos"]) for r in merged] == [
        ("a", "x", 0), ("b", "x", 1), ("c", "y", 2), ("d", "y", 3)]
    log = spark.createDataFrame([("b", "rocky_candidate", None, 1), ("b", "candidate", None, 2)],
                                "object_id string, label string, notes string, seq long")
    left = [r["object_id"] for r in labeling.apply_labels(old, log).collect()]
    assert left == ["a"]
    items = spark.createDataFrame([("z",), (None,), ("y",)], "object_id string")
    grown = labeling.enqueue(old, items).orderBy("queue_pos").collect()
    assert [(r["object_id"], r["queue_pos"]) for r in grown] == [("a", 0), ("b", 1), ("y", 2), ("z", 3)]


def test_exclusions(spark):
    df = spark.createDataFrame([("a", "no_result", 0.0, "", "CONFIRMED"), ("b", "candidate", 0.5, "", "confirmed_planet"),
                                ("c", "candidate", 0.5, "", None)], REPORT)
    parity = LabelingConfig.load()
    assert sorted(r[0] for r in labeling.exclude_rows(df, parity).collect()) == ["a", "c"]  # D11 parity
    norm = LabelingConfig.load({"exclude": {"labels": ["no_result"], "dispositions": ["confirmed_planet"]}},
                               normalize_dispositions=True)
    assert sorted(r[0] for r in labeling.exclude_rows(df, norm).collect()) == ["b", "c"]
