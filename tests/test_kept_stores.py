"""Incremental fit, id indexes, pages, the kept queue and naive Bayes."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sample_paths import SF0001
from transitlab.config import FeatureSpec
from transitlab.operators import bayes, features, id_index, incremental, kept_queue, paging
from transitlab.plans.store_queries import _enriched, _needles, _report


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """Rows that each file scan gave, after the query has run."""
    df.collect()

    def walk(node):
        own = []
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            own.append(node.metrics().get("numOutputRows").get().value())
        children = node.children().iterator()
        while children.hasNext():
            own += walk(children.next())
        if node.nodeName().startswith("AdaptiveSpark"):
            own += walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            own += walk(node.plan())
        return own

    return walk(df._jdf.queryExecution().executedPlan())


# ----------------------------------------------------------------- incremental fit
def close(a, b):
    return a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9) or math.isnan(a) and math.isnan(b)))


@pytest.mark.parametrize("impute", [None, "mean", "zero"])
def test_summaries_give_the_fit_over_all_rows(spark, tmp_path, impute):
    rows, spec = _enriched(spark, SF0001), FeatureSpec.load()
    if impute:
        spec = FeatureSpec(
            features=tuple({**f, "impute": impute, "transform": "standardize"} for f in spec.features),
            derived=spec.derived, categorical=spec.categorical, target=spec.target,
        )
    whole = features.fit(rows, spec)
    for run in range(3):
        incremental.summarise(rows.where(F.col("star_id") % 3 == run), str(tmp_path), f"r{run}", spec)
    model = incremental.fit_from_summaries(spark, str(tmp_path), spec)
    for a, b in zip(whole.numeric, model.numeric):
        assert a["name"] == b["name"] and all(close(a.get(k), b.get(k)) for k in ("fill", "mean", "sd")), (a, b)
    assert whole.categorical == model.categorical and whole.feature_names == model.feature_names


def test_runs_are_overwritten_and_chosen(spark, tmp_path):
    spec = FeatureSpec(features=({"name": "x", "impute": "median", "transform": "standardize"},), categorical=({"name": "c"},))
    one = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, None)], "x double, c string")
    two = spark.createDataFrame([(10.0, "b"), (float("inf"), "b")], "x double, c string")
    for _ in range(2):
        incremental.summarise(one, str(tmp_path), "1", spec)
    incremental.summarise(two, str(tmp_path), "2", spec)
    model = incremental.fit_from_summaries(spark, str(tmp_path), spec, runs=["1"])
    assert model.numeric[0]["fill"] == 1.5 and close(model.numeric[0]["sd"], float(np.std([1, 2, 1.5], ddof=1)))
    assert model.categorical[0]["fill"] == "a" and model.categorical[0]["values"] == ["a", "b"]
    both = incremental.fit_from_summaries(spark, str(tmp_path), spec)
    whole = features.fit(one.union(two), spec)
    assert close(both.numeric[0]["fill"], whole.numeric[0]["fill"]) and close(both.numeric[0]["sd"], whole.numeric[0]["sd"])
    assert both.categorical == whole.categorical


def test_a_fit_of_nothing(spark, tmp_path):
    spec = FeatureSpec.load()
    model = incremental.fit_from_summaries(spark, str(tmp_path / "none"), spec)
    assert all(f["fill"] in (0.0, None) for f in model.numeric) and all(c["fill"] == "UNK" for c in model.categorical)
    empty = _enriched(spark, SF0001).where("false")
    incremental.summarise(empty, str(tmp_path), "0", spec)
    assert incremental.fit_from_summaries(spark, str(tmp_path), spec).categorical[0]["values"] == []


def test_sketches_are_near(spark, tmp_path):
    spec = FeatureSpec(features=({"name": "x", "impute": "median"},))
    df = spark.range(20_000).select((F.col("id") * 0.5).alias("x"))
    for run in range(2):
        incremental.summarise(df.where(F.col("x") % 2 == run), str(tmp_path), str(run), spec, exact=False)
    fill = incremental.fit_from_summaries(spark, str(tmp_path), spec).numeric[0]["fill"]
    assert abs(fill - 5_000) < 0.04 * 10_000


def test_medians_of_counted_values(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 301).astype(float)
    rows = [("a", float(v), 1) for v in values] + [("b", 4.0, 10**12), ("b", 9.0, 3), ("c", None, 5), ("d", 1.0, 1), ("d", 2.0, 1)]
    got = incremental.counted_medians(spark.createDataFrame(rows, "feature string, value double, n long").repartition(5))
    assert got == {"a": float(np.median(values)), "b": 4.0, "d": 1.5}


# ----------------------------------------------------------------- id indexes
def test_search_equals_contains(spark, tmp_path):
    ids = ["K1.1-22-3", "k1.1-22-30", "K77-x", "ab", "", "é漢字-K1", "aaaa", None, "K1.1-22-3"]
    path = str(tmp_path / "i")
    id_index.write_trigram_index(spark.createDataFrame([(i,) for i in ids], "object_id string").repartition(3), path)
    needles = ["-22-", "K1", "1.1-22-3", "zzz", "AAA", "漢字-", "b", "", None, "k1", "K1.1-22-30x", "é漢"]
    found = id_index.search_index(spark, path, spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = {(n.lower(), i) for n in needles if n for i in ids if i is not None and n.lower() in i.lower()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_search_reads_matching_postings_only(spark, tmp_path):
    path = str(tmp_path / "i")
    id_index.write_trigram_index(_report(spark, SF0001).select("object_id"), path)
    asked = spark.createDataFrame([("-10-",)], "gram string").select(F.explode(id_index.grams(F.col("gram"))).alias("gram"))
    postings = id_index.postings_of(spark, path, asked)
    plan = plan_of(postings)
    assert "PartitionFilters: [" in plan and "folder" in plan and "In(gram" in plan.replace("IN(gram", "In(gram") or "EqualTo(gram" in plan
    total = spark.read.parquet(f"{path}/postings").count()
    assert sum(scans(postings)) < total / 4
    listed = id_index.LISTED
    try:
        id_index.LISTED = 0
        joined = id_index.search_index(spark, path, _needles(spark, SF0001)).collect()
    finally:
        id_index.LISTED = listed
    assert sorted(map(tuple, joined)) == sorted(map(tuple, id_index.search_index(spark, path, _needles(spark, SF0001)).collect()))


def test_lookup_prunes_row_groups(spark, tmp_path):
    df = spark.range(40_000).select(F.concat(F.lit("K"), F.xxhash64("id").cast("string")).alias("object_id"), "id")
    path = str(tmp_path / "c")
    id_index.write_clustered(df, path, group_rows=1_000)
    near = df.orderBy("object_id").limit(1_000).select("object_id")
    found = id_index.lookup_objects(spark, path, near)
    assert found.count() == 1_000 and sum(scans(found)) <= 2_000
    absent = spark.range(500).select(F.concat(F.lit("K5"), F.xxhash64(F.col("id") + 10**9).cast("string"), F.lit("x")).alias("object_id"))
    nothing = id_index.lookup_objects(spark, path, absent)
    assert sum(scans(nothing)) < 4_000 and nothing.count() == 0  # the Bloom filters know
    many = df.where("id % 2 = 0").select("object_id")
    assert id_index.lookup_objects(spark, path, many.union(many)).count() == 20_000  # joined
    assert id_index.lookup_objects(spark, path, near.limit(0)).count() == 0


# ----------------------------------------------------------------- pages
def test_any_page_is_a_range(spark, tmp_path):
    df = spark.range(1_003).select(F.format_string("k%05d", F.col("id") * 7 % 1_003).alias("key"), "id").repartition(6)
    path = str(tmp_path / "p")
    paging.write_pages(df.union(spark.createDataFrame([(None, 5)], "key string, id long")), path, "key", 20)
    keys = sorted(r.key for r in df.collect())
    for page in (1, 2, 37, 51, 52, 0, -3):
        found = paging.read_pages(spark, path, "key", [page])
        first = (max(page, 1) - 1) * 20
        assert [r.key for r in found.collect()] == keys[first : first + 20]
    several = paging.read_pages(spark, path, "key", [51, 3, 3, 900])
    assert [(r.page, r.key) for r in several.collect()] == [(3, k) for k in keys[40:60]] + [(51, k) for k in keys[1000:]]
    assert "GreaterThanOrEqual(key" in plan_of(paging.read_pages(spark, path, "key", [37]))


# ----------------------------------------------------------------- kept queue
def queue(spark, *rows):
    return spark.createDataFrame([(i, f"l{p}", p) for p, i in rows], "object_id string, suggested_label string, queue_pos long")


def test_kept_queue_merge_and_append(spark, tmp_path):
    name, buckets = f"kept_{uuid.uuid4().hex}", 8
    kept_queue.keep_queue(queue(spark, (0, "a"), (1, "b"), (2, "a"), (5, None)), name, str(tmp_path / "q"), buckets)
    assert kept_queue.kept_buckets(spark, name) == buckets
    new = queue(spark, (0, "c"), (1, "a"), (2, "d"), (3, "c"), (4, ""), (7, "e"))
    merged = kept_queue.merge_into_kept(spark, name, new)
    want = [(0, "a", "l0"), (1, "b", "l1"), (5, "", "l5"), (6, "c", "l0"), (7, "d", "l2"), (8, "e", "l7")]
    assert [(r.queue_pos, r.object_id, r.suggested_label) for r in merged.orderBy("queue_pos").collect()] == want
    kept_queue.append_to_kept(spark, name, new)
    kept_queue.append_to_kept(spark, name, new)  # nothing is unseen now
    assert [(r.queue_pos, r.object_id, r.suggested_label) for r in spark.table(name).orderBy("queue_pos").collect()] == want
    spark.sql(f"DROP TABLE {name}")


def test_the_kept_side_is_not_moved(spark, tmp_path):
    name = f"kept_{uuid.uuid4().hex}"
    kept_queue.keep_queue(queue(spark, *[(i, f"k{i}") for i in range(200)]), name, str(tmp_path / "q"), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        unseen = kept_queue.unseen_items(spark, name, queue(spark, (0, "k7"), (1, "new")))
        unseen.collect()
        plan = plan_of(unseen).split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    indent = len(lines[scan]) - len(lines[scan].lstrip(" :+-*(0123456789)"))
    above = []
    for line in reversed(lines[:scan]):
        own = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if own < indent:
            above.append(line)
            indent = own
        if "SortMergeJoin" in line:
            break
    assert not any("Exchange" in line for line in above), plan
    spark.sql(f"DROP TABLE {name}")


# ----------------------------------------------------------------- naive Bayes
def test_gaussian_model_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, s, (80, 2)) for m, s in ((0, 1), (3, 0.5), (-2, 2))])
    y = np.repeat(["a", "b", "c"], 80)
    df = spark.createDataFrame([(float(u), float(v), str(c)) for (u, v), c in zip(x, y)], "u double, v double, label string")
    model = bayes.fit_gaussian(df, ("u", "v"))
    extra = 1e-9 * x.var(axis=0).max()
    scores = []
    for c in "abc":
        own = x[y == c]
        var = own.var(axis=0) + extra
        scores.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * var) + (x - own.mean(axis=0)) ** 2 / var).sum(axis=1))
    want = np.array(list("abc"))[np.argmax(scores, axis=0)]
    assert [r.prediction for r in model.predict(df).collect()] == want.tolist()
    assert (want == y).mean() > 0.85


def test_bayes_of_gaps_and_nothing(spark):
    rows = [(1.0, None, "a"), (1.0, None, "a"), (9.0, 2.0, "b"), (None, 3.0, None), (float("nan"), float("inf"), "b")]
    df = spark.createDataFrame(rows, "u double, v double, label string")
    model = bayes.fit_gaussian(df, ("u", "v"))
    assert model.rows == 4 and model.classes["a"]["v"] == (None, None)
    blank = spark.createDataFrame([(None, None)], "u double, v double")
    assert model.predict(blank).first().prediction == "b"  # equal priors: the class that sorts last
    none = bayes.fit_gaussian(df.where("false"), ("u", "v"))
    assert none.predict(blank).first().prediction is None
    with pytest.raises(ValueError):
        bayes.fit_gaussian(spark.range(300).select(F.lit(1.0).alias("u"), F.col("id").cast("string").alias("label")), ("u",))


def test_search_cuts_each_posting_once_whatever_the_number_of_needles(spark, tmp_path):
    path = str(tmp_path / "i")
    ids = [f"K{i}.1-{i % 100}-7" for i in range(2_000)] + ["ÄÄÄÄ-ÄÄÄ", "aaaa", "x😀yz😀", "ab", ""]
    id_index.write_trigram_index(spark.createDataFrame([(i,) for i in ids], "object_id string").repartition(3), path)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.select("gram").distinct().count() <= stored.count() < 5_000  # a row a gram and block, not one an id
    wanted = [f"-{i}-" for i in range(120)] + ["äää", "aaa", "aaaa", "aaaaa", "😀YZ", "b", "K1", "9.1-9", ".1-"]
    needles = spark.createDataFrame([(n,) for n in wanted], "needle string")
    expected = sorted((n.lower(), i) for n in wanted for i in ids if n.lower() in i.lower())
    for most in (id_index.BROADCAST_NEEDLES, 0):
        before, id_index.BROADCAST_NEEDLES = id_index.BROADCAST_NEEDLES, most
        try:
            assert sorted(map(tuple, id_index.search_index(spark, path, needles).collect())) == expected
        finally:
            id_index.BROADCAST_NEEDLES = before
