"""End-to-end jobs and file-level helpers (E9, K1-K8, S7-S11, J6, section 3 flows)."""

import json
import os

from pyspark.sql import functions as F

from sample_paths import SF0001
from transitlab.config import LabelingConfig
from transitlab.plans import pipelines
from transitlab.sinks import reports
from transitlab.sources import readers
from transitlab.sources.fixtures import koi_alias


def _csv(spark, tmp_path, name="upload.csv"):
    path = str(tmp_path / name)
    koi_alias(spark, SF0001).limit(500).coalesce(1).write.option("header", True).csv(path)
    return path


def test_process_make_dataset_queue(spark, tmp_path):
    src = _csv(spark, tmp_path)
    out = str(tmp_path / "out")
    res = pipelines.process(spark, src, out, run_ts="20240101_000000")
    assert res.run_ts == "20240101_000000"
    assert {m.status for m in res.mapping} >= {"alias", "ok", "unknown", "shadowed"}
    latest = reports.read_latest(spark, out, "json")
    assert latest.count() == 500
    assert latest.select("run_ts").distinct().collect()[0][0] == "20240101_000000"

    manifest = pipelines.make_dataset(spark, src, str(tmp_path / "fs"))
    assert manifest["rows_loaded"] == 500
    assert "stellar_type_G" in manifest["feature_names"]
    m = reports.latest_manifest(spark, str(tmp_path / "fs" / "manifests")).first()
    assert m["features_file"] == manifest["features_file"]

    qpath = str(tmp_path / "queue")
    q = pipelines.update_queue(spark, out, qpath, LabelingConfig.load(), limit=20)
    assert q.count() == 20
    first = q.orderBy("queue_pos").first()["object_id"]
    labels = spark.createDataFrame([(first, "candidate", "checked")], "object_id string, label string, notes string")
    pipelines.apply_label(spark, labels, str(tmp_path / "labels"))
    left = pipelines.open_queue(spark, qpath, str(tmp_path / "labels"))
    assert left.count() == 19 and first not in [r[0] for r in left.select("object_id").collect()]


def test_readers_and_listing(spark, tmp_path):
    src = _csv(spark, tmp_path)
    part = [f for f in os.listdir(src) if f.endswith(".csv")][0]
    prev = readers.preview_columns(spark, src)
    assert "kepoi_name" in prev["columns"] and prev["rows"] is None
    assert readers.detect_delimiter(spark, os.path.join(src, part)) == ","
    meta = readers.scan_meta(readers.load(spark, src, fmt="csv"), os.path.join(src, part))
    assert meta.rows == 500 and meta.format == "csv" and not meta.koi_disposition_present

    idx_path = tmp_path / "uploads_index.json"
    idx_path.write_text(json.dumps({"f_20240101_000000_abc": src, "f_20240201_000000_xyz": "/nowhere.csv"}))
    idx = readers.upload_index(spark, str(idx_path))
    assert [r["file_id"] for r in idx.collect()] == ["f_20240201_000000_xyz", "f_20240101_000000_abc"]
    assert readers.resolve_upload(idx, "f_20240101_000000_abc").first()["path"] == src

    names = spark.createDataFrame([("../evil name?.csv",), ("ok.parquet",), ("x.exe",)], "n string")
    got = names.select(readers.safe_filename(F.col("n")).alias("s"), readers.allowed_file(F.col("n")).alias("ok")).collect()
    assert got[0]["s"] == "evil name_.csv" and [r["ok"] for r in got] == [True, True, False]

    rep = tmp_path / "reports"
    rep.mkdir()
    for n in ("report_20240101_000000.csv", "report_20240101_000000.json", "report_20240201_000000.csv", "notes.txt"):
        (rep / n).write_text("x")
    pairs = {r["ts"]: (r["csv_path"] is not None, r["json_path"] is not None)
             for r in reports.pair_reports(reports.list_files(spark, str(rep))).collect()}
    assert pairs == {"20240101_000000": (True, True), "20240201_000000": (True, False)}


def test_json_document_and_sanitize(spark, tmp_path):
    doc = {"rows": [{"object_id": "a", "category": "candidate", "score": 0.5, "flags": ""},
                    {"object_id": "b", "category": "no_result", "score": 0.0, "flags": "FLAG_NO_FEATURES"}],
           "timestamp": "20240101_000000", "row_count": 2}
    path = tmp_path / "report_20240101_000000.json"
    path.write_text(json.dumps(doc, indent=2))
    rows = reports.read_report_json_document(spark, str(path)).orderBy("object_id").collect()
    assert [r["object_id"] for r in rows] == ["a", "b"] and rows[0]["run_ts"] == "20240101_000000"

    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {"k": float("-inf")})],
                               "x double, a array<double>, m map<string,double>")
    r = reports.sanitize(df).first()
    assert r["x"] is None and r["a"] == [1.0, None] and r["m"] == {"k": None}
