"""Report catalogue, counted writes, the stream's report sink and report documents."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from transitlab.sinks import catalogue, observed, reports
from transitlab.sources import report_documents
from transitlab.sources.report_documents import read_report_documents
from transitlab.streaming import report_sink

ROW = (
    "object_id string, koi_disposition string, category string, disposition_compare string, is_disposition_match boolean,"
    " color_hint string, score double, flags string, koi_period double, koi_prad double, koi_teq double, koi_insol double"
)


def rows(spark, n, first=0):
    made = [(f"K{i}", "CONFIRMED", "candidate", "match", True, "black", 0.5, "", 1.0 * i, 2.0, None, 1.5) for i in range(first, first + n)]
    return spark.createDataFrame(made, ROW)


# ----------------------------------------------------------------- catalogue
def test_catalogue_pairs_forms(spark, tmp_path):
    out = str(tmp_path / "runs")
    reports.write_report(rows(spark, 7).repartition(3), out, run_ts="20240101_000000")
    reports.write_report(rows(spark, 5), out, run_ts="20240102_000000", formats=("json",))
    reports.write_report(rows(spark, 4), out, run_ts="20240103_000000", formats=("csv",))
    reports.write_report(rows(spark, 0), out, run_ts="20240104_000000")
    found = {r.run_ts: r for r in catalogue.catalogue(spark, out).collect()}
    assert list(found) == sorted(found, reverse=True)  # newest first
    assert [found[k].state for k in sorted(found)] == ["paired", "json only", "csv only", "paired"]
    first = found["20240101_000000"]
    assert (first.csv_rows, first.json_rows) == (7, 7)
    on_disk = [f for f in os.listdir(f"{out}/csv/run_ts=20240101_000000") if f.startswith("part-")]
    assert first.csv_files == len(on_disk)
    assert first.csv_bytes == sum(os.path.getsize(f"{out}/csv/run_ts=20240101_000000/{f}") for f in on_disk)
    assert found["20240102_000000"].csv_rows is None and found["20240104_000000"].csv_rows == 0


def test_text_forms_are_compressed_and_cut_into_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "FILE_ROWS", 100)
    out = str(tmp_path / "runs")
    reports.write_report(rows(spark, 250).coalesce(1), out, run_ts="20240101_000000")
    for form in ("csv", "json"):
        files = [f for f in os.listdir(f"{out}/{form}/run_ts=20240101_000000") if f.startswith("part-")]
        assert len(files) == 3 and all(f.endswith(f".{form}.gz") for f in files)
        assert reports.read_latest(spark, out, form).drop("run_ts").exceptAll(rows(spark, 250)).isEmpty()
    found = catalogue.catalogue(spark, out).first()
    assert (found.csv_rows, found.json_rows, found.state) == (250, 250, "paired")


def test_catalogue_of_forms_that_differ_or_were_never_written(spark, tmp_path):
    out = str(tmp_path / "runs")
    reports.write_report(rows(spark, 3), out, run_ts="a", formats=("csv",))
    assert [r.state for r in catalogue.catalogue(spark, out).collect()] == ["csv only"]
    reports.report_rows(rows(spark, 2)).write.json(f"{out}/json/run_ts=a")
    assert [r.state for r in catalogue.catalogue(spark, out).collect()] == ["differs"]
    assert catalogue.catalogue(spark, str(tmp_path / "none")).collect() == []


def test_file_rows_read_no_columns(spark, tmp_path):
    out = str(tmp_path / "runs")
    reports.write_report(rows(spark, 9).repartition(4), out, run_ts="20240101_000000")
    files = catalogue.report_files(spark, out, "rows")
    assert sum(r.rows for r in files.collect()) == 9
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "FullOuter" not in plan


def test_run_names(spark):
    paths = ["/x/csv/run_ts=20240101_000000/part-0.csv", "/x/report_20240102_000000.json", "/x/other.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(catalogue.run_of(F.col("p")).alias("r"))
    assert [r.r for r in df.collect()] == ["20240101_000000", "20240102_000000", None]


# ----------------------------------------------------------------- counted writes
def test_write_counts_in_the_same_job(spark, tmp_path):
    made = rows(spark, 6).withColumn(
        "koi_teq", F.expr("case object_id when 'K0' then double('NaN') when 'K1' then double('-Infinity') when 'K2' then null else 3.0 end")
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    _, counts = observed.write_counted(made, str(tmp_path / "o"), "20240101_000000")
    jobs = tracker.getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 2  # the report and its one-row metadata
    by = {r.column: r for r in counts.collect()}
    assert (by["koi_teq"].rows, by["koi_teq"].nulls, by["koi_teq"].non_finite) == (6, 1, 2)
    assert (by["object_id"].nulls, by["object_id"].non_finite) == (0, 0)
    written = reports.read_runs(spark, str(tmp_path / "o"), "json")
    assert written.where("koi_teq is null").count() == 3
    assert reports.read_meta(spark, str(tmp_path / "o")).first().row_count == 6


@pytest.mark.parametrize("form", ["csv", "rows"])
def test_write_counts_of_no_rows(spark, tmp_path, form):
    _, counts = observed.write_counted(rows(spark, 0), str(tmp_path / "o"), "t", form)
    assert {(r.rows, r.nulls, r.non_finite) for r in counts.collect()} == {(0, 0, 0)}


# ----------------------------------------------------------------- the stream's sink
@pytest.mark.parametrize("form", ["json", "csv", "rows"])
def test_batches_that_run_again_overwrite_themselves(spark, tmp_path, form):
    drop, out, checkpoint = (str(tmp_path / x) for x in ("drop", "out", "ckpt"))
    for i in range(3):
        rows(spark, 4, 10 * i).coalesce(1).write.mode("append").parquet(drop)

    def stream():
        return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(drop)

    calls = []

    def stop(batch_id):
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        report_sink.run_report_stream(stream(), out, checkpoint, after_write=stop)
    assert report_sink.read_stream_report(spark, out, form).count() == 8  # written, not yet committed
    report_sink.run_report_stream(stream(), out, checkpoint, after_write=stop)
    found = report_sink.read_stream_report(spark, out, form)
    assert sorted(r.object_id for r in found.collect()) == sorted(f"K{10 * i + j}" for i in range(3) for j in range(4))
    assert calls == [0, 1, 1, 2]
    report_sink.run_report_stream(stream(), out, checkpoint)  # nothing new
    assert found.count() == 12


def test_a_batch_without_its_mark_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    report_sink.batch_writer(out)(rows(spark, 3), 0)
    reports.report_rows(rows(spark, 5)).write.json(f"{out}/json/batch=1")
    assert report_sink.read_stream_report(spark, out).count() == 3
    assert report_sink.done_batches(spark, str(tmp_path / "none")).count() == 0


# ----------------------------------------------------------------- documents
def document(n, bare=False, stamp_first=False):
    values = ['plain', 'a "quoted" one', 'ends in }, {', '"},{"rows": [{', "back\\slash\\", 'tab\t}"', "{[", "ünï 漢 }"]
    own = [{"object_id": f"K{i}", "flags": values[i % len(values)] * (1 + i % 3), "score": i / 4, "koi_period": None} for i in range(n)]
    whole = {"timestamp": "20240101_000000", "rows": own} if stamp_first else {"rows": own, "timestamp": "20240101_000000"}
    return own, json.dumps(own if bare else whole, indent=2 if stamp_first else None, ensure_ascii=bare)


@pytest.mark.parametrize("kind", [{}, {"bare": True}, {"stamp_first": True}])
@pytest.mark.parametrize("split", [64, 1_000, 1_000_000])
def test_documents_cut_anywhere(spark, tmp_path, kind, split):
    own, text = document(60, **kind)
    (tmp_path / "doc.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        texts = report_documents.pieces(spark, str(tmp_path))
        assert texts.select("block").distinct().count() > 5 if split < 1_000 else True
        found = read_report_documents(spark, str(tmp_path), reports.REPORT_SCHEMA).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    got = sorted((r.object_id, r.flags, r.score) for r in found)
    assert got == sorted((x["object_id"], x["flags"], x["score"]) for x in own)
    assert {r.run_ts for r in found} == {None if kind.get("bare") else "20240101_000000"}


def test_documents_without_rows_and_with_nested_values(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.json").write_text('{"rows": [], "timestamp": "x"}')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text('[{"m": {"k": "}"}, "l": [{"v": 1}, {"v": 2}]}, {"m": null, "l": []}]')
    schema = T.StructType.fromDDL("m map<string,string>, l array<struct<v: int>>")
    found = read_report_documents(spark, str(tmp_path), schema).collect()
    assert sorted((str(r.m), [x.v for x in r.l]) for r in found) == [("None", []), ("{'k': '}'}", [1, 2])]


def test_run_timestamp_form():
    assert reports.run_timestamp(dt.datetime(2024, 1, 2, 3, 4, 5)) == "20240102_030405"


# ----------------------------------------------------------------- what a larger table brings
def test_report_documents_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from transitlab.plans import store_queries
    from transitlab.sources.report_documents import read_report_documents as read

    from sample_paths import SF0001

    whole = read(spark, store_queries._documents(spark, SF0001), reports.REPORT_SCHEMA)
    monkeypatch.setattr(store_queries, "DOCUMENT_ROWS", 500)
    path = store_queries._documents(spark, SF0001)
    files = spark.read.text(path).select("_metadata.file_path").distinct().count()
    assert files > 4
    again = read(spark, path, reports.REPORT_SCHEMA)
    assert again.count() == whole.count() and again.exceptAll(whole).isEmpty()


def test_states_and_fragments_are_made_once(spark, tmp_path):
    text = json.dumps({"rows": [{"object_id": f"K{i}", "flags": 'a "}{[\\'} for i in range(300)], "timestamp": "t"})
    (tmp_path / "doc.json").write_text(text)
    crossing, inner = report_documents.document_texts(spark, str(tmp_path / "doc.json"))
    plan = crossing._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and crossing.count() + inner.count() == 301


def test_text_files_follow_the_scan(spark, tmp_path):
    from transitlab.plans.queries import _text_csv
    from transitlab.sources.fixtures import table

    from sample_paths import SF0001

    for parts, files in ((7, 7), (1, 3)):
        sf = str(tmp_path / str(parts))
        table(spark, SF0001, "lineitem").repartition(parts).write.parquet(f"{sf}/lineitem.parquet")
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a split a file
        try:
            folder = _text_csv(spark, sf, ",", files=3)
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len([f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("part-")]) == files


def test_documents_of_later_timestamps_are_compressed(spark):
    """the text of the documents took most of the disk."""
    from transitlab.plans import store_queries

    from sample_paths import SF0001

    path = store_queries._documents(spark, SF0001)
    files = {r.file_path.rsplit("/", 3)[-3]: r for r in spark.read.text(path).select("_metadata.file_path", "_metadata.file_size").distinct().collect()}
    assert sorted(files) == ["doc=0", "doc=1", "doc=2", "doc=3"]
    assert [files[f"doc={i}"].file_path.endswith(".gz") for i in range(4)] == [False, True, True, True]
    assert all(4 * files[f"doc={i}"].file_size < files["doc=0"].file_size for i in (1, 2, 3))


@pytest.mark.parametrize("split, batch", [(150, 3), (1_000_000, 1), (1_000_000, 7)])
def test_documents_cut_across_batches(spark, tmp_path, split, batch):
    import random

    rng = random.Random(split + batch)
    own = [{"object_id": f"K{i}", "flags": "".join(rng.choice('\\"}{[],: aü漢') for _ in range(rng.randint(0, 30)))} for i in range(150)]
    for i in range(3):
        part, named = own[50 * i : 50 * (i + 1)], bool(i)
        (tmp_path / f"{i}.json").write_text(json.dumps({"rows": part, "timestamp": f"t{i}"} if named else part, ensure_ascii=False))
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 1, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = read_report_documents(spark, str(tmp_path), reports.REPORT_SCHEMA).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((x["object_id"], x["flags"], None if i < 50 else f"t{i // 50}") for i, x in enumerate(own))
    assert sorted((r.object_id, r.flags, r.run_ts) for r in found) == want


def test_documents_keep_rows_without_an_id(spark, tmp_path):
    from transitlab.plans import store_queries
    from transitlab.sources.fixtures import table

    from sample_paths import SF0001

    sf = str(tmp_path / "sf")
    orders = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")).alias("l_orderkey")
    lineitem = table(spark, SF0001, "lineitem")
    lineitem.select(orders, *[c for c in lineitem.columns if c != "l_orderkey"]).write.parquet(f"{sf}/lineitem.parquet")
    without = lineitem.where("l_orderkey % 10 = 0").count()
    found = store_queries.q_report_documents(spark, sf)
    # they have no timestamp, and so a document without an end, whose last row is lost
    assert without > 1 and found.where("object_id is null and run_ts is null").count() == without - 1
    assert found.where("object_id is not null and run_ts is not null").count() == lineitem.count() - without
