"""End-to-end jobs composed from the operators (E9, K1-K8, section 3 flows).

* ``process``: load -> normalise -> enrich -> classify -> run-partitioned
  report. Stages 1-4 are one lazy narrow plan; the write is the only action.
* ``make_dataset``: load -> normalise -> enrich -> fit/transform features ->
  Parquet + manifest row.
* ``update_queue``: newest run -> exclusions -> score -> top-k -> queue table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureSpec, LabelingConfig, Thresholds
from ..operators.classify import classify
from ..operators.enrich import enrich
from ..operators.features import build, input_columns
from ..operators.labeling import LABEL_EVENT, apply_labels, build_queue, label_events
from ..operators.schema import MappingRow, normalize_columns
from ..sinks.feature_store import mapping_text, newest, spec_text
from ..sinks.reports import ROWS_CODEC, read_latest, run_timestamp, write_manifest, write_report, write_table
from ..sources.readers import load, path_exists


@dataclass
class ProcessResult:
    run_ts: str
    mapping: list[MappingRow]
    results: DataFrame


def classify_table(df: DataFrame, albedo: float = 0.3, auto_derive: bool = True, thresholds: Thresholds | None = None) -> tuple[DataFrame, list[MappingRow]]:
    """Normalise, enrich and classify any candidate DataFrame (lazy)."""
    normalized, mapping = normalize_columns(df)
    return classify(enrich(normalized, albedo=albedo, auto_derive=auto_derive), thresholds), mapping


def process(spark: SparkSession, path: str, out_dir: str, albedo: float = 0.3, thresholds: Thresholds | None = None, run_ts: str | None = None) -> ProcessResult:
    results, mapping = classify_table(load(spark, path), albedo=albedo, thresholds=thresholds)
    ts = write_report(results, out_dir, run_ts=run_ts, extras={"source_file": path, "albedo": str(albedo)})
    return ProcessResult(ts, mapping, results)


def make_dataset(
    spark: SparkSession,
    path: str,
    out_dir: str,
    spec: FeatureSpec | None = None,
    albedo: float = 0.3,
    feature_version: str = "v1",
    limit_rows: int | None = None,
) -> dict:
    """Features Parquet under ``out_dir/features/ts=<ts>`` + manifest row."""
    spec = spec or FeatureSpec.load()
    normalized, mapping = normalize_columns(load(spark, path, limit=limit_rows))
    enriched = enrich(normalized, albedo=albedo, outputs=input_columns(spec))
    features, meta = build(enriched, spec)
    ts = run_timestamp()
    features_file = f"{out_dir.rstrip('/')}/features/ts={ts}"
    write_table(features, features_file, codec=ROWS_CODEC)
    meta["row_count"] = rows = spark.read.parquet(features_file).count()  # answered from footers
    manifest = {
        "feature_version": feature_version,
        "source_file": path,
        "engine_loaded": "spark",
        "rows_loaded": rows,
        "features_file": features_file,
        "feature_specs": spec_text(spec),
        "schema_map": mapping_text(mapping),
        "albedo": float(albedo),
        "timestamp": ts,
        "feature_names": meta["features"],
    }
    write_manifest(spark, manifest, f"{out_dir.rstrip('/')}/manifests")
    return manifest


def replay_dataset(spark: SparkSession, manifests_dir: str, out_dir: str) -> dict:
    """Makes the newest manifest's dataset again from its source, specification and albedo; returns the new manifest."""
    old = newest(spark, manifests_dir)
    spec = FeatureSpec.load(json.loads(old["feature_specs"]))
    return make_dataset(spark, old["source_file"], out_dir, spec, old["albedo"], old["feature_version"])


def update_queue(spark: SparkSession, reports_dir: str, queue_path: str, cfg: LabelingConfig | None = None, limit: int | None = None) -> DataFrame:
    """Section 3.3: newest run -> ranked queue -> overwrite the queue table."""
    queue = build_queue(read_latest(spark, reports_dir), cfg, limit)
    write_table(queue, queue_path)
    return spark.read.parquet(queue_path)


def apply_label(spark: SparkSession, labels: DataFrame, label_log_path: str) -> None:
    """K8: append label events, numbered above the log's greatest; the queue view subtracts them."""
    after = -1
    if path_exists(spark, label_log_path):
        after = spark.read.parquet(label_log_path).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    label_events(labels, after=int(after)).write.mode("append").parquet(label_log_path)


def open_queue(spark: SparkSession, queue_path: str, label_log_path: str) -> DataFrame:
    """The queue minus labelled objects, in queue order. No log means no labels; a log that can't be read is an error."""
    queue = spark.read.parquet(queue_path)
    if path_exists(spark, label_log_path):
        queue = apply_labels(queue, spark.read.schema(LABEL_EVENT).parquet(label_log_path))
    return queue.orderBy("queue_pos")


def category_summary(results: DataFrame) -> DataFrame:
    """A1 over C*: rows per category x comparison outcome (the flagship query)."""
    return results.groupBy("category", "disposition_compare").agg(F.count(F.lit(1)).alias("n"))
