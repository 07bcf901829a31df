"""Plan shape: row-local stages stay narrow, JVM-side and pruned."""

import pytest
from pyspark.sql import functions as F

from sample_paths import SF0001
from transitlab.operators import browse, splits
from transitlab.operators.classify import classify
from transitlab.operators.enrich import enrich
from transitlab.plans.queries import registry
from transitlab.sinks import reports
from transitlab.sources.fixtures import koi_fixture


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classify_is_narrow_and_jvm_side(spark):
    p = plan_of(classify(enrich(koi_fixture(spark, SF0001))))
    assert "Exchange" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "l_shipdate" not in p.split("ReadSchema")[-1].split("\n")[0]  # unused column pruned


def test_filters_reach_the_scan(spark, tmp_path):
    """Browsing filters over a stored report are pushed into its Parquet scan."""
    path = str(tmp_path / "rows")
    classify(enrich(koi_fixture(spark, SF0001))).write.parquet(path)
    rows = spark.read.parquet(path)
    assert "EqualTo(object_id,x)" in plan_of(browse.lookup_object(rows, "x"))
    assert "EqualTo(category,candidate)" in plan_of(browse.filter_category(rows, "candidate"))
    assert "Or(GreaterThan(score,0.5),And(EqualTo(score,0.5),GreaterThan(object_id,k)))" in plan_of(
        browse.page_after(rows, "score", (0.5, "k"))
    )


@pytest.mark.parametrize(
    "name, unused", [("soft_flags", "koi_duration"), ("missing_flags", "koi_duration"), ("habitability_flag", "koi_prad")]
)
def test_enrich_reads_what_is_asked_for(spark, tmp_path, name, unused):
    path = str(tmp_path / "wide")
    koi_fixture(spark, SF0001).write.parquet(path)
    outputs = {
        "soft_flags": ("object_id", "soft_flags"),
        "missing_flags": ("object_id", "koi_prad", "koi_period", "koi_teq"),
        "habitability_flag": ("object_id", "koi_teq"),
    }[name]
    plan = plan_of(enrich(spark.read.parquet(path), outputs=outputs))
    schema = plan.split("ReadSchema: ")[-1].split("\n")[0]
    assert unused not in schema and "koi_insol" not in schema and "object_id" in schema


def test_merge_and_labels_hash_aggregate(spark):
    queue = spark.createDataFrame([("a", "x", 0)], "object_id string, suggested_label string, queue_pos long")
    keyed = queue.withColumn("__key", F.col("object_id"))
    assert "SortAggregate" not in plan_of(keyed.groupBy("__key").agg(F.min("queue_pos")))
    log = spark.createDataFrame([("a", "x", 0)], "object_id string, label string, seq long")
    assert "SortAggregate" not in plan_of(splits.latest_labels(log))
    assert "SortAggregate" not in plan_of(registry()["queue_merge"](spark, SF0001))


def test_latest_run_reads_one_folder(spark, tmp_path):
    rows = classify(enrich(koi_fixture(spark, SF0001)))
    for ts in ("20240101_000000", "20240201_000000"):
        reports.write_report(rows, str(tmp_path), run_ts=ts, formats=("json",))
    latest = reports.read_latest(spark, str(tmp_path))
    assert all("run_ts=20240201_000000" in f for f in latest.inputFiles())


def test_text_rows_are_parsed_once_by_compiled_methods(spark, capsys):
    """enrich made text of its parsed numbers and parsed them again, in methods that HotSpot never compiles."""
    import re

    from transitlab.config import NUMERIC_INPUTS
    from transitlab.streaming.file_drop import text_schema

    text = spark.createDataFrame([], text_schema(["object_id", "koi_disposition", *NUMERIC_INPUTS]))
    found = reports.report_rows(classify(enrich(text)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan and "try_cast" in plan.lower()
    stored = spark.sql("select " + ", ".join(f"cast(id as string) {f}" for f in text.columns) + " from range(2)")
    reports.report_rows(classify(enrich(stored))).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_null_tokens_of_numbers_are_left_to_the_parser(spark, tmp_path):
    from transitlab.operators.schema import normalize_columns
    from transitlab.sources import readers
    from transitlab.streaming.file_drop import classified_stream, run_available_now

    for i, head in enumerate(("object_id,koi_disposition,koi_prad,koi_period", "koi_disposition,koi_prad,Orbital Period")):
        folder, out = tmp_path / f"in{i}", str(tmp_path / f"out{i}")
        folder.mkdir()
        cells = ["NA", " nan ", "", "1.5", " 2e1 ", "1.5d", "0x1p3", "inf", "-NaN", "<NA>", "+.5", "5.", "1e"]
        lines = [f"{'k,' if not i else ''}{cells[j]},{a},{b}" for j, a in enumerate(cells) for b in cells]
        (folder / "a.csv").write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")
        run_available_now(classified_stream(spark, str(folder), head.split(",")), out, str(tmp_path / f"ckpt{i}"))
        batch, _ = normalize_columns(readers.read_csv(spark, str(folder)))
        found, want = spark.read.parquet(out), classify(enrich(batch))
        assert found.count() == len(lines) and found.exceptAll(want).isEmpty()
        assert {r.koi_prad for r in found.select("koi_prad").collect()} == {None, 1.5, 20.0, float("inf"), 0.5, 5.0}
