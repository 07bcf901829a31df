"""Stratified groups, rare classes, balance, index files and baselines."""

import json

import pytest
from pyspark.sql import functions as F

from transitlab.config import SplitConfig
from transitlab.operators import evaluate, splits


@pytest.fixture(scope="module")
def rows(spark):
    """Stars of one to four rows; the classes are of very different sizes."""
    label = F.when(F.col("star_id") % 50 == 0, "anomalous_signal").when(F.col("star_id") % 5 == 0, "rocky").otherwise("candidate")
    stars = spark.range(3000).select(F.col("id").alias("star_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 4)).alias("i"))
    return stars.select("star_id", F.concat_ws(".", "star_id", "i").alias("object_id"), label.alias("label")).repartition(5)


def test_stratified_groups(rows):
    out = splits.stratified_split(rows)
    assert out.count() == rows.count()
    assert out.groupBy("star_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    shares = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for label in ("candidate", "rocky", "anomalous_signal"):
        total = sum(n for (name, _), n in shares.items() if name == label)
        for split, want in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
            assert abs(shares[label, split] - want * total) <= 4  # one star
    again = splits.stratified_split(rows.repartition(2))
    assert out.select("object_id", "split").exceptAll(again.select("object_id", "split")).count() == 0


def config(**sections):
    return SplitConfig.load(sections)


def rare(strategy):
    return config(primary={"rare_classes": {"names": ["anomalous_signal"], "strategy": strategy, "oversample_factor": 3}})


def test_rare_classes(rows):
    s = splits.grouped_split(rows)
    kept = splits.rare_classes(s, rare("keep_together"))
    assert {r.split for r in kept.where("label = 'anomalous_signal'").collect()} == {"train"} and kept.count() == s.count()
    more = splits.rare_classes(s, rare("oversample_train"))
    in_train = s.where("label = 'anomalous_signal' and split = 'train'").count()
    assert more.count() == s.count() + 2 * in_train
    assert splits.rare_classes(s, rare("drop_if_too_small")).count() == s.count()
    few = s.where("label <> 'anomalous_signal' or split = 'train'")
    dropped = splits.rare_classes(few, rare("drop_if_too_small"))
    assert dropped.where("label = 'anomalous_signal'").count() == 0 and dropped.count() == s.where("label <> 'anomalous_signal'").count()
    with pytest.raises(ValueError):
        splits.rare_classes(s, rare("guess"))


def test_undersampling(rows):
    s = splits.grouped_split(rows)
    out = splits.balance(s, config(class_balance={"strategy": "undersample"}))
    n = {r.label: r["count"] for r in out.where("split = 'train'").groupBy("label").count().collect()}
    whole = {r.label: r["count"] for r in s.where("split = 'train'").groupBy("label").count().collect()}
    assert n["anomalous_signal"] == whole["anomalous_signal"]
    assert abs(n["candidate"] - 0.2 * whole["candidate"]) < 0.1 * whole["candidate"]
    assert out.where("split <> 'train'").count() == s.where("split <> 'train'").count()


def test_balance_strategies(rows):
    s = splits.grouped_split(rows)
    assert splits.balance(s).columns == s.columns
    assert "weight" in splits.balance(s, config(class_balance={"strategy": "weight"})).columns
    assert splits.balance(s, config(class_balance={"strategy": "oversample"})).count() > s.count()
    with pytest.raises(ValueError):
        splits.balance(s, config(class_balance={"strategy": "guess"}))


def test_index_files_and_manifest(spark, rows, tmp_path):
    s = splits.grouped_split(rows)
    written = splits.write_split(s, str(tmp_path))
    assert written.select("split", "object_id").exceptAll(s.select("split", "object_id")).count() == 0
    ids = spark.read.text(f"{tmp_path}/splits_v1.ids").where("split = 'val'")
    assert {r.value for r in ids.collect()} == {r.object_id for r in s.where("split = 'val'").collect()}
    part = next((tmp_path / "splits_v1.manifest").glob("*.json"))
    manifest = json.loads(part.read_text())
    assert manifest["rows"] == s.count() == sum(c["n"] for c in manifest["counts"]) and manifest["seed"] == 1337


@pytest.mark.parametrize("algorithm", evaluate.ALGORITHMS)
def test_baselines_learn_from_train_alone(spark, algorithm):
    data = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("label"),
        (F.col("id") % 3 + F.rand(1) * 0.5).alias("x"), F.rand(2).alias("noise"), (F.col("id") >= 450).alias("held"),
    )
    unseen = data.limit(20).withColumn("label", F.lit("unseen"))
    test = data.where("held").union(unseen)
    _, found = evaluate.train_baseline(data.where("not held"), test, ["x", "noise"], algorithm=algorithm)
    assert found.count() == 170
    known = found.where("label <> 'unseen'")
    assert known.where("label = prediction").count() >= 0.9 * known.count()  # trees split at binned values
    assert "unseen" not in {r.prediction for r in found.collect()}


def test_metrics_count_the_predictions_once(spark):
    from transitlab.operators import evaluate

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, prediction string")
    got = evaluate.macro_metrics(evaluate.confusion_matrix(rows.mapInArrow(counted, rows.schema))).first()
    assert seen.value == 3 and got.n_classes == 2 and abs(got.accuracy - 2 / 3) < 1e-12


def test_baselines_store_their_rows_once(spark, monkeypatch):
    from sample_paths import SF0001
    from transitlab.operators import evaluate
    from transitlab.plans import queries

    stored, cut = [], queries.cut_lineage
    monkeypatch.setattr(queries, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    monkeypatch.setattr(evaluate, "train_baseline", lambda train, test, names, algorithm: (None, test.selectExpr("label", "label as prediction")))
    assert len(queries.q_baseline_test_rows(spark, SF0001).collect()) == 9
    assert len(stored) == 1 and "category" not in stored[0] and "koi_prad" in stored[0]


def test_gaussian_smoothing_is_that_of_all_rows(spark):
    from transitlab.operators import bayes

    rows = [("a", 1.0, None), ("a", 5.0, None), ("b", 90.0, 2.0), ("b", None, 4.0), (None, 1e9, 1.0)]
    model = bayes.fit_gaussian(spark.createDataFrame(rows, "label string, x double, y double"), ["x", "y"])
    assert abs(model.classes["a"]["x"][1] - (4.0 + bayes.SMOOTHING * 5054 / 3)) < 1e-12  # of 1, 5 and 90
    assert model.classes["a"]["y"] == (None, None)
