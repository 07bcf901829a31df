"""Registered queries: one per inventory operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the candidate fixture) over the
whole table; results are full, never sampled. Doubles that depend on
``pow``/``log1p`` or on summation order are rounded to 6 places with the same
IEEE steps the oracle SQL uses, so the two engines agree bit for bit.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureSpec, LabelingConfig, SplitConfig, Thresholds
from ..functions import metrics as M
from ..functions.numeric import round_half_away
from ..functions.rules import anomaly_conditions, color_hint_fallback, disposition_category, strong_hits
from ..operators import browse, evaluate, features, labeling, splits
from ..operators.classify import classify, rule_inputs, with_classification
from ..operators.enrich import enrich, typed_inputs
from ..operators.schema import mapping_frame, normalize_columns, resolve_mapping, with_ordinal_ids
from ..session import checkpoint_dir, cut_lineage
from ..sinks import reports
from ..sources import readers
from ..sources.fixtures import koi_alias, koi_fixture, koi_text, table
from ..streaming.file_drop import classified_stream, run_available_now
from .pipelines import category_summary

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: Column) -> Column:
    return round_half_away(c, 6)


def _koi(spark: SparkSession, sf: str) -> DataFrame:
    return koi_fixture(spark, sf).drop("discovery_date")


def _enriched(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return enrich(_koi(spark, sf), **kw)


def _rounded_echo(df: DataFrame) -> DataFrame:
    """Round the pow-derived echo columns (same steps as the oracle)."""
    return df.withColumns({c: r6(F.col(c)) for c in ("koi_teq", "koi_insol") if c in df.columns})


def _report(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return _rounded_echo(classify(_enriched(spark, sf, **kw)))


def _detail(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched rows with classification appended (all fixture columns kept)."""
    return with_classification(_enriched(spark, sf))


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/transitlab-{name}-{uuid.uuid4().hex[:12]}"


ENRICH_OUT = ("object_id", "koi_period", "koi_prad", "koi_srad", "koi_steff", "koi_sma", "koi_teq", "koi_insol",
              "transit_depth", "expected_duration_hours", "duration_ratio", "soft_flags")
ROUNDED = ("koi_sma", "koi_teq", "koi_insol", "expected_duration_hours", "duration_ratio")


def _enrich_view(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in ROUNDED else F.col(c) for c in ENRICH_OUT])


# ----------------------------------------------------------------- fixture, schema
def q_koi_fixture(spark, sf):
    return _koi(spark, sf)


def q_normalize_columns(spark, sf):
    out, _ = normalize_columns(koi_alias(spark, sf))
    return out


def q_mapping_suggest(spark, sf):
    """P3/J3 + per-column non-null counts of the uploaded table (one aggregate)."""
    df = koi_alias(spark, sf)
    mapping = mapping_frame(spark, resolve_mapping(df.columns))
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "detected", "non_null")
    return mapping.join(long, "detected")


# ----------------------------------------------------------------- metrics
def _typed(spark, sf):
    df = _koi(spark, sf)
    return df, typed_inputs(df)


def q_semi_major_axis(spark, sf):
    df, x = _typed(spark, sf)
    return df.select("object_id", r6(M.semi_major_axis(x["koi_period"], x["koi_smass"])).alias("semi_major_axis"))


def _a(x):
    return F.coalesce(x["koi_sma"], M.semi_major_axis(x["koi_period"], x["koi_smass"]))


def q_equilibrium_temp(spark, sf):
    df, x = _typed(spark, sf)
    v = M.equilibrium_temp(x["koi_steff"], x["koi_srad"], _a(x), 0.3)
    return df.select("object_id", r6(v).alias("equilibrium_temp"))


def q_insolation(spark, sf):
    df, x = _typed(spark, sf)
    return df.select("object_id", r6(M.insolation(x["koi_steff"], x["koi_srad"], _a(x))).alias("insolation"))


def q_transit_depth(spark, sf):
    df, x = _typed(spark, sf)
    return df.select("object_id", M.transit_depth(x["koi_prad"], x["koi_srad"]).alias("transit_depth"))


def q_expected_duration(spark, sf):
    df, x = _typed(spark, sf)
    v = M.expected_duration_hours(x["koi_period"], x["koi_srad"], _a(x), x["koi_impact"])
    return df.select("object_id", r6(v).alias("expected_duration"))


def q_duration_ratio(spark, sf):
    df, x = _typed(spark, sf)
    exp = M.expected_duration_hours(x["koi_period"], x["koi_srad"], _a(x), x["koi_impact"])
    return df.select("object_id", r6(M.duration_ratio(x["koi_duration"], exp)).alias("duration_ratio"))


def q_enrich(spark, sf):
    return _enrich_view(_enriched(spark, sf))


def q_enrich_no_derive(spark, sf):
    return _enrich_view(_enriched(spark, sf, auto_derive=False))


def q_enrich_albedo_05(spark, sf):
    return _enrich_view(_enriched(spark, sf, albedo=0.5))


def q_soft_flags(spark, sf):
    return _enriched(spark, sf, outputs=("object_id", "soft_flags"))


def q_habitability_flag(spark, sf):
    return _enriched(spark, sf, outputs=("object_id", "koi_teq")).select("object_id", splits.habitability_flag(F.col("koi_teq")).alias("habitability_flag"))


# ----------------------------------------------------------------- classifier
def q_anomaly_flags(spark, sf):
    df = _enriched(spark, sf)
    cond = anomaly_conditions(rule_inputs(df), Thresholds())
    names = {
        "FLAG_RADIUS_TOO_LARGE": "radius_too_large",
        "FLAG_ANOMALOUS_DEPTH": "anomalous_depth",
        "FLAG_DURATION_TOO_SHORT": "duration_too_short",
        "FLAG_DURATION_TOO_LONG": "duration_too_long",
        "FLAG_COLD_DEEP_TRANSIT": "cold_deep_transit",
    }
    return df.select("object_id", *[c.alias(names[k]) for k, c in cond.items()], strong_hits(cond).alias("strong_hits"))


def q_missing_flags(spark, sf):
    df = _enriched(spark, sf, outputs=("object_id", "koi_prad", "koi_period", "koi_teq"))
    x = rule_inputs(df)
    return df.select(
        "object_id",
        x.prad.isNull().alias("missing_prad"),
        x.period.isNull().alias("missing_period"),
        x.teq.isNull().alias("missing_teq"),
    )


def q_classify(spark, sf):
    return _report(spark, sf)


CUSTOM_THRESHOLDS = {
    "planet_radius": {"rocky_max": 1.5, "super_earth_max": 5.0, "hot_jupiter_min": 7.0},
    "orbital_period": {"hot_jupiter_max": 5},
    "temperature": {"habitable_min": 200, "habitable_max": 320, "hot_min": 900},
    "anomalous": {"max_depth": 0.03, "duration_ratio_high": 2.5, "teq_low": 100},
}


def q_classify_custom_thresholds(spark, sf):
    return _rounded_echo(classify(_enriched(spark, sf), Thresholds.load(CUSTOM_THRESHOLDS)))


def q_disposition_compare(spark, sf):
    r = _report(spark, sf)
    return r.select(
        "object_id", "koi_disposition", disposition_category(F.col("koi_disposition")).alias("disposition_category"),
        "category", "disposition_compare", "is_disposition_match", "color_hint",
    )


def q_color_hint_fallback(spark, sf):
    d = _detail(spark, sf)
    given = F.when(F.col("star_id") % 2 == 0, F.col("color_hint"))
    return d.select("object_id", color_hint_fallback(given, F.col("koi_disposition"), F.col("category")).alias("color_hint"))


def q_category_summary(spark, sf):
    return category_summary(_report(spark, sf))


# ----------------------------------------------------------------- filters, browse
QUEUE_EXCLUDE = LabelingConfig.load(
    {"exclude": {"labels": ["no_result"], "dispositions": ["confirmed_planet", "likely_false_positive"]}},
    normalize_dispositions=True,
)


def q_exclude_rows(spark, sf):
    return labeling.exclude_rows(_report(spark, sf), QUEUE_EXCLUDE).select("object_id", "category", "koi_disposition")


def q_search_id_regex(spark, sf):
    return browse.search_id_regex(_report(spark, sf), r"k1[0-9]*7\.1-").select("object_id", "category")


def q_search_id_literal(spark, sf):
    return browse.search_id_literal(_report(spark, sf), "K12").select("object_id", "category")


def q_filter_category(spark, sf):
    return browse.filter_category(_report(spark, sf), "habitable_zone_candidate")


def q_lookup_object(spark, sf):
    """The key is a scalar subquery over the id column alone: no job runs while the plan is built."""
    first_id = _koi(spark, sf).agg(F.min("object_id")).scalar()
    return browse.lookup_object(_report(spark, sf), first_id)


def q_page_results(spark, sf):
    r = _report(spark, sf)
    return browse.page(r, 3, 50, [F.col(c).asc_nulls_first() for c in r.columns])


def q_newest_first(spark, sf):
    k = koi_fixture(spark, sf)
    top = browse.newest_first(k.select("object_id", "discovery_date"), "discovery_date", 25, tie="object_id")
    return top.select("object_id", F.date_format("discovery_date", "yyyy-MM-dd").alias("discovery_day"))


def q_display_rounding(spark, sf):
    return browse.display_rows(_report(spark, sf))


def q_split_flags(spark, sf):
    r = _report(spark, sf)
    return r.select("object_id", F.explode(labeling.split_flags(F.col("flags"))).alias("flag"))


def q_flag_counts(spark, sf):
    return q_split_flags(spark, sf).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- labelling
def q_uncertainty_boost(spark, sf):
    d = _detail(spark, sf)
    return d.select("object_id", labeling.uncertainty_boost(d, LabelingConfig.load()).alias("boost"))


def q_labeling_score(spark, sf):
    r = _report(spark, sf)
    return r.select("object_id", labeling.labeling_score(r, LabelingConfig.load()).alias("score_labeling"))


def _queue_view(q: DataFrame) -> DataFrame:
    return q.select("object_id", "suggested_label", "score_model", "score_labeling",
                    F.concat_ws(";", "flags").alias("flags"), "queue_pos")


def q_label_queue_priority(spark, sf):
    return _queue_view(labeling.build_queue(_report(spark, sf), LabelingConfig.load()))


def q_label_queue_uncertainty(spark, sf):
    cfg = LabelingConfig.load({"batch": {"size": 50, "strategy": "uncertainty"}})
    return _queue_view(labeling.build_queue(_report(spark, sf), cfg))


def q_label_queue_random(spark, sf):
    cfg = LabelingConfig.load({"batch": {"size": 50, "strategy": "random"}})
    return _queue_view(labeling.build_queue(_report(spark, sf), cfg))


def _full_queue(spark, sf, strategy="priority", where: Column | None = None, rows: DataFrame | None = None) -> DataFrame:
    cfg = LabelingConfig.load({"batch": {"size": 0, "strategy": strategy}})
    rows = _report(spark, sf) if rows is None else rows
    if where is not None:
        rows = rows.where(where)
    return labeling.build_queue(rows, cfg, limit=0)


def q_queue_merge(spark, sf):
    existing = _full_queue(spark, sf, "priority", F.col("category").isin("anomalous_signal", "candidate"))
    new = _full_queue(spark, sf, "uncertainty")
    return labeling.merge_queues(existing, new).select("object_id", "suggested_label", "queue_pos")


def _label_log(spark, sf) -> DataFrame:
    """``label_log``: 'candidate' for partkey % 50 == 0, then a newer
    'rocky_candidate' event for partkey % 100 == 0."""
    li = table(spark, sf, "lineitem")
    oid = F.concat(
        F.lit("K"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"),
        F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"),
    )
    first = li.where(F.col("l_partkey") % 50 == 0).select(oid.alias("object_id"), F.lit("candidate").alias("label"),
                                                         F.lit(None).cast("string").alias("notes"), F.lit(1).alias("seq"))
    second = li.where(F.col("l_partkey") % 100 == 0).select(oid.alias("object_id"), F.lit("rocky_candidate").alias("label"),
                                                           F.lit("relabel").alias("notes"), F.lit(2).alias("seq"))
    return labeling.label_events(first.unionByName(second), seq_col="seq")


def q_queue_apply(spark, sf):
    q = _full_queue(spark, sf, "priority")
    return labeling.apply_labels(q, _label_log(spark, sf)).select("object_id", "queue_pos")


def q_queue_enqueue(spark, sf):
    top = labeling.build_queue(_report(spark, sf), LabelingConfig.load())
    items = _report(spark, sf).where(F.col("category") == "hot_jupiter_candidate").select("object_id")
    return labeling.enqueue(top, items).select("object_id", "queue_pos")


# ----------------------------------------------------------------- features
def _spec(numeric_impute=None, transform="none", categorical=True, numeric=True) -> FeatureSpec:
    base = FeatureSpec.load()
    feats = []
    if numeric:
        for f in base.features + base.derived:
            feats.append({"name": f["name"], "impute": numeric_impute or f.get("impute"), "transform": transform})
    cats = list(base.categorical) if categorical else []
    return FeatureSpec(features=tuple(feats), derived=(), categorical=tuple(cats), target="label")


def _features(spark, sf, spec: FeatureSpec) -> DataFrame:
    df, _ = features.build(_enriched(spark, sf), spec)
    return df.select(*[r6(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def q_impute_median(spark, sf):
    return _features(spark, sf, _spec("median", categorical=False))


def q_impute_mean(spark, sf):
    return _features(spark, sf, _spec("mean", categorical=False))


def q_impute_zero(spark, sf):
    return _features(spark, sf, _spec("zero", categorical=False))


def q_impute_mode(spark, sf):
    spec = FeatureSpec(categorical=({"name": "stellar_type", "encoding": "raw", "impute": "most_frequent"},))
    return _features(spark, sf, spec)


def q_log1p_transform(spark, sf):
    return _features(spark, sf, _spec("median", "log1p", categorical=False))


def q_standardize(spark, sf):
    return _features(spark, sf, _spec("median", "standardize", categorical=False))


def q_onehot(spark, sf):
    return _features(spark, sf, _spec(numeric=False))


def q_feature_table(spark, sf):
    return _features(spark, sf, FeatureSpec.load())


def q_latest_label_join(spark, sf):
    spec = FeatureSpec.load()
    two = FeatureSpec(features=tuple(f for f in spec.features if f["name"] in ("koi_period", "koi_prad")))
    feats = _features(spark, sf, two).select("object_id", "koi_period", "koi_prad")
    return splits.join_latest_labels(feats, _label_log(spark, sf))


# ----------------------------------------------------------------- reports, sources
def _write_runs(spark, sf) -> str:
    out = _scratch(spark, "runs")
    reports.write_report(_report(spark, sf), out, run_ts="20240101_000000")
    reports.write_report(_report(spark, sf, albedo=0.5), out, run_ts="20240201_000000", formats=("json",))
    return out


def q_report_roundtrip(spark, sf):
    out = _scratch(spark, "report")
    reports.write_report(_report(spark, sf), out, run_ts="20240101_000000")
    return reports.read_runs(spark, out, "csv").drop("run_ts")


def q_latest_run(spark, sf):
    return reports.read_latest(spark, _write_runs(spark, sf), "json")


def _text_csv(spark, sf, sep: str, files: int | None = None) -> str:
    """The text fixture as CSV: a file for each split of the scan, but at least ``files``."""
    path = _scratch(spark, "csv")
    df = koi_text(spark, sf)
    if files and df.select(F.spark_partition_id().alias("p")).distinct().count() < files:
        df = df.repartition(files, "star_id", "object_id")
    (df.write.option("header", True).option("sep", sep).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


TEXT_OUT = ("object_id", "star_id", "koi_period", "koi_prad", "koi_sma", "koi_smass", "koi_srad", "koi_slogg",
            "koi_steff", "koi_teq", "koi_insol", "koi_duration", "koi_impact", "koi_disposition", "stellar_type",
            "uncertainty", "remark")


def _typed_text(df: DataFrame) -> DataFrame:
    x = typed_inputs(df)
    cols = []
    for c in TEXT_OUT:
        if c in x:
            cols.append(x[c].alias(c))
        elif c in ("star_id",):
            cols.append(F.col(c).try_cast("bigint").alias(c))
        elif c == "uncertainty":
            cols.append(F.col(c).try_cast("double").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def q_csv_null_tokens(spark, sf):
    return _typed_text(readers.read_csv(spark, _text_csv(spark, sf, ",")))


def q_delimiter_vote(spark, sf):
    path = _text_csv(spark, sf, ";")
    return _typed_text(readers.read_csv(spark, path, sniff=True))


def q_nonfinite_to_null(spark, sf):
    li = table(spark, sf, "lineitem")
    pk = F.col("l_partkey")
    x = F.when(pk % 3 == 0, F.lit(float("nan"))).when(pk % 3 == 1, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    y = F.when(pk % 4 == 0, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    raw = li.select(
        F.col("l_orderkey"), F.col("l_linenumber"), x.alias("x"), F.array(x, y).alias("arr"),
        F.create_map(F.lit("a"), x, F.lit("b"), y).alias("m"), F.struct(x.alias("v"), y.alias("w")).alias("s"),
    )
    clean = reports.sanitize(raw)
    return clean.select(
        "l_orderkey", "l_linenumber", "x",
        F.col("arr")[0].alias("arr0"), F.col("arr")[1].alias("arr1"),
        F.col("m")["a"].alias("map_a"), F.col("m")["b"].alias("map_b"),
        F.col("s.v").alias("struct_v"), F.col("s.w").alias("struct_w"),
    )


def q_file_drop_stream(spark, sf):
    folder = _text_csv(spark, sf, ",", files=3)
    columns = spark.read.option("header", True).csv(folder).columns
    sink, ckpt = _scratch(spark, "stream-sink"), _scratch(spark, "stream-ckpt")
    stream = classified_stream(spark, folder, columns)
    run_available_now(stream, sink, ckpt)
    run_available_now(classified_stream(spark, folder, columns), sink, ckpt)  # restart: no duplicates
    return _rounded_echo(spark.read.parquet(sink))


# ----------------------------------------------------------------- splits, evaluation
def _labelled(spark, sf) -> DataFrame:
    return _detail(spark, sf).withColumn("label", F.col("category"))


def q_split_filter(spark, sf):
    return splits.split_filter(_labelled(spark, sf)).select("object_id", "label", "koi_period", "koi_prad")


def q_grouped_split(spark, sf):
    return splits.grouped_split(_labelled(spark, sf)).select("object_id", "star_id", "split")


def q_split_class_counts(spark, sf):
    return splits.split_class_counts(splits.grouped_split(splits.split_filter(_labelled(spark, sf))))


def q_kfold(spark, sf):
    return splits.kfold(_labelled(spark, sf)).select("object_id", "star_id", "fold")


def q_temporal_split(spark, sf):
    return splits.temporal_split(koi_fixture(spark, sf)).select("object_id", "split")


def q_class_weights(spark, sf):
    return splits.class_weights(_labelled(spark, sf)).select("label", "n_class", r6(F.col("weight")).alias("weight"))


def _rare(strategy: str) -> SplitConfig:
    cfg = SplitConfig.load()
    rare = cfg["primary"]["rare_classes"] | {"strategy": strategy}
    return SplitConfig.load({"primary": {"rare_classes": rare}})


def q_oversample(spark, sf):
    s = splits.grouped_split(_labelled(spark, sf))
    return splits.rare_classes(s, _rare("oversample_train")).select("object_id", "label", "split", "copy")


def q_keep_together(spark, sf):
    s = splits.grouped_split(_labelled(spark, sf))
    return splits.rare_classes(s).select("object_id", "label", "split", "copy")


def q_undersample(spark, sf):
    s = splits.grouped_split(_labelled(spark, sf))
    cfg = SplitConfig.load({"class_balance": {"strategy": "undersample"}})
    return splits.balance(s, cfg).select("object_id", "label", "split")


def q_stratified_split(spark, sf):
    return splits.stratified_split(_labelled(spark, sf)).select("object_id", "star_id", "label", "split")


def q_split_index(spark, sf):
    s = splits.grouped_split(splits.split_filter(_labelled(spark, sf)))
    return splits.split_index(splits.write_split(s, _scratch(spark, "splits")))


def q_ordinal_ids(spark, sf):
    """W1 over a shuffled table: how many ids there are, and the first and last number."""
    k = _koi(spark, sf).drop("object_id").repartition("star_id")
    n = F.regexp_extract("object_id", "([0-9]+)$", 1).cast("long")
    return with_ordinal_ids(k).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("object_id").alias("n_ids"), F.min(n).alias("first"), F.max(n).alias("last")
    )


def _confusion(spark, sf) -> DataFrame:
    r = _report(spark, sf).withColumn("label", disposition_category(F.col("koi_disposition")))
    return evaluate.confusion_matrix(r, "label", "category")


def q_confusion_matrix(spark, sf):
    return _confusion(spark, sf)


def q_macro_metrics(spark, sf):
    m = evaluate.macro_metrics(_confusion(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) if c != "n_classes" else F.col(c) for c in m.columns])


def _baseline(spark, sf) -> Iterator[tuple[str, DataFrame]]:
    """The confusion matrix of each algorithm, trained on the catalogue's dispositions of the train stars, scored on
    those of the test stars. The rows, with the columns of the features, are stored once for all algorithms."""
    spec = FeatureSpec.load()
    named = _enriched(spark, sf, outputs=("star_id", "koi_disposition", *features.input_columns(spec)))
    named = named.withColumn("label", disposition_category(F.col("koi_disposition"))).where("label is not null")
    split = cut_lineage(splits.grouped_split(named.drop("koi_disposition")))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    model = features.fit(train, spec)  # imputation and scales come from train alone
    train, test = model.transform(train, keep=("label",)), model.transform(test, keep=("label",))
    for algorithm in evaluate.ALGORITHMS:
        _, preds = evaluate.train_baseline(train, test, model.feature_names, algorithm=algorithm)
        yield algorithm, evaluate.confusion_matrix(preds)


def q_baseline_test_rows(spark, sf):
    """The row totals of the baselines' confusion matrices on the test stars, for all algorithms."""
    every = [cm.withColumn("algorithm", F.lit(a)) for a, cm in _baseline(spark, sf)]
    cm = every[0].unionByName(every[1]).unionByName(every[2])
    return cm.groupBy("algorithm", "label").agg(F.sum("n").alias("n"))


def q_baseline_model_metrics(spark, sf):
    """Macro metrics of all baselines on the test stars. Iterative training: checked on rows, not against SQL."""
    every = [evaluate.macro_metrics(cm).select(F.lit(a).alias("algorithm"), "*") for a, cm in _baseline(spark, sf)]
    return every[0].unionByName(every[1]).unionByName(every[2])


def registry() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
