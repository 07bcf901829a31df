"""CSV dialect, null words, encodings, report documents and file look-ups."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sample_paths import SF0001
from transitlab.operators.classify import classify
from transitlab.operators.enrich import enrich
from transitlab.operators.labeling import label_events
from transitlab.operators.splits import latest_labels
from transitlab.functions.rules import compare_columns, disposition_category
from transitlab.operators import browse
from transitlab.plans import pipelines
from transitlab.sinks import reports
from transitlab.sources import readers
from transitlab.sources.fixtures import koi_fixture


def write(tmp_path, text, name="t.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_quotes_separators_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, 'id,t\n1,"a ""b"", c"\n2,"x;y\tz"\n')
    assert [r.t for r in readers.read_csv(spark, path).orderBy("id").collect()] == ['a "b", c', "x;y\tz"]
    path = write(tmp_path, 'id,t\n1,"two\nlines, ""quoted"""\n2,plain\n', "m.csv")
    rows = readers.read_csv(spark, path, multi_line=True).orderBy("id").collect()
    assert [r.t for r in rows] == ['two\nlines, "quoted"', "plain"]


def test_null_words(spark, tmp_path):
    words = ["N/A", "n/a", "#N/A", "<NA>", "nan", "-nan", "NaN", "null", "None", "NULL", "NA", "1.#QNAN", " NA\t"]
    path = write(tmp_path, "id,t\n" + "".join(f"{i},{w}\n" for i, w in enumerate(words)) + "99,nano\n")
    rows = readers.read_csv(spark, path).collect()
    assert [r.t for r in rows if r.t is not None] == ["nano"]


def test_latin_1_is_the_second_try(spark, tmp_path):
    path = write(tmp_path, "id,t\n1,café\n", encoding="latin-1")
    assert readers.read_csv(spark, path, encoding="auto").first().t == "café"
    path = write(tmp_path, "id,t\n1,café\n", "u.csv")
    assert readers.read_csv(spark, path, encoding="auto").first().t == "café"


def test_vote_counts_all_lines_outside_quotes(spark, tmp_path):
    lines = ["a;b"] * 60 + ["x"] + ['"1;2;3;4";b'] * 5
    assert readers.detect_delimiter(spark, write(tmp_path, "\n".join(lines))) == ";"
    lines = ['"a,b,c";1'] * 80
    assert readers.detect_delimiter(spark, write(tmp_path, "\n".join(lines), "q.csv")) == ";"
    lines = ["a,b"] * 55 + ["a,b,c|d"] * 45  # what comes after the first lines counts
    assert readers.detect_delimiter(spark, write(tmp_path, "\n".join(lines), "l.csv")) == ","


def test_unknown_format_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="xlsx"):
        readers.load(spark, write(tmp_path, "a\n1\n"), fmt="xlsx")


def test_locate_upload(spark, tmp_path):
    (tmp_path / "up").mkdir()
    stored = write(tmp_path / "up", "a\n1\n", "x.csv")
    index = write(tmp_path, json.dumps({"f1": "/data/one.csv"}), "index.json")
    find = lambda ref, index=index: readers.locate_upload(spark, index, ref, str(tmp_path / "up"))
    assert find("f1") == "/data/one.csv"
    assert find(stored) == stored
    assert find("x.csv") == stored and find("x.csv", str(tmp_path / "none.json")) == stored
    with pytest.raises(FileNotFoundError):
        find("f2")


def test_listing_newest_first(spark, tmp_path):
    for i, name in enumerate(("b", "a", "c", "d")):
        os.utime(write(tmp_path, "x", name), (1_700_000_000 + i // 2, 1_700_000_000 + i // 2))
    names = [r.path.rsplit("/", 1)[-1] for r in reports.list_files(spark, str(tmp_path)).collect()]
    assert names == ["c", "d", "a", "b"]
    assert reports.list_files(spark, str(tmp_path), limit=2).count() == 2


def test_report_documents(spark, tmp_path):
    rows = [{"object_id": "a", "score": 0.5, "flags": ""}, {"object_id": "b", "score": None}]
    bare = write(tmp_path, "\n " + json.dumps(rows, indent=1), "bare.json")
    assert [r.object_id for r in reports.read_report_json_document(spark, bare).collect()] == ["a", "b"]
    whole = write(tmp_path, json.dumps({"timestamp": "t", "rows": rows}), "whole.json")
    found = reports.read_report_json_document(spark, whole).collect()
    assert [(r.object_id, r.run_ts) for r in found] == [("a", "t"), ("b", "t")]
    assert reports.read_report(spark, whole, "none.csv", limit=1).count() == 1


def test_report_forms_and_meta(spark, tmp_path):
    results = classify(enrich(koi_fixture(spark, SF0001)))
    ts = reports.write_report(results, str(tmp_path), run_ts="20240101_000000", extras={"albedo": "0.3"})
    n = results.count()
    meta = reports.read_meta(spark, str(tmp_path)).collect()
    assert [tuple(m) for m in meta] == [(ts, n, {"albedo": "0.3"})]
    csv_form = f"{tmp_path}/csv/run_ts={ts}"
    assert reports.read_report(spark, str(tmp_path / "no.json"), csv_form).count() == n
    for fmt in ("rows", "json", "csv"):
        assert reports.read_latest(spark, str(tmp_path), fmt).count() == n
    with pytest.raises(FileNotFoundError):
        reports.read_latest(spark, str(tmp_path / "none"))


def test_features_through_the_manifest(spark, tmp_path):
    src = str(tmp_path / "in.parquet")
    koi_fixture(spark, SF0001).drop("discovery_date").limit(120).write.parquet(src)
    made = pipelines.make_dataset(spark, src, str(tmp_path))
    assert made["rows_loaded"] == 120
    first = reports.read_features(spark, f"{tmp_path}/manifests", page_size=100).collect()
    second = reports.read_features(spark, f"{tmp_path}/manifests", page_no=2, page_size=100).collect()
    assert (len(first), len(second)) == (100, 20)
    one = reports.read_features(spark, f"{tmp_path}/manifests", object_id=second[0].object_id).collect()
    assert [r.object_id for r in one] == [second[0].object_id]


def test_label_log_grows(spark, tmp_path):
    log = str(tmp_path / "log")
    for label in ("first", "second", "third"):
        rows = [(f"o{i}", label) for i in range(30)] + [(None, label)]
        pipelines.apply_label(spark, spark.createDataFrame(rows, "object_id string, label string").repartition(4), log)
    events = spark.read.parquet(log)
    assert sorted(r.seq for r in events.collect()) == list(range(90))
    assert {r.label for r in latest_labels(events).collect()} == {"third"}


def test_label_time_orders_an_append(spark):
    rows = spark.createDataFrame(
        [("a", "late", "2024-02-01"), ("a", "early", "2024-01-01")], "object_id string, label string, labeled_at string"
    )
    assert latest_labels(label_events(rows.repartition(2))).first().label == "late"


def test_a_corrupt_log_is_an_error(spark, tmp_path):
    queue = str(tmp_path / "queue")
    spark.createDataFrame([("a", 0)], "object_id string, queue_pos long").write.parquet(queue)
    assert pipelines.open_queue(spark, queue, str(tmp_path / "none")).count() == 1
    (tmp_path / "log").mkdir()
    write(tmp_path / "log", "not a table", "part-0.parquet")
    with pytest.raises(Exception, match="part-0"):
        pipelines.open_queue(spark, queue, str(tmp_path / "log")).collect()


def test_white_space_of_any_kind(spark):
    rows = [("\tCONFIRMED\n",), (" candidate ",), ("\t",), (None,)]
    df = spark.createDataFrame(rows, "d string")
    got = df.select(
        disposition_category(F.col("d")).alias("c"), compare_columns(F.col("d"), F.lit("candidate"))["disposition_compare"].alias("m")
    ).collect()
    assert [tuple(r) for r in got] == [("confirmed_planet", "mismatch"), ("candidate", "match"), (None, "missing"), (None, "missing")]


def test_keyset_pages_serve_every_row_once(spark):
    rows = [(f"o{i}", [None, 1.0, 1.0, 2.0][i % 4]) for i in range(23)]
    df = spark.createDataFrame(rows, "object_id string, score double")
    seen, last = [], None
    while page := browse.page_after(df, "score", last, 5).collect():
        seen += [r.object_id for r in page]
        last = (page[-1].score, page[-1].object_id)
    assert sorted(seen) == sorted(r[0] for r in rows)


def test_newest_manifest_by_time(spark, tmp_path):
    for ts in ("20240201_000000", "20240101_000000"):
        reports.write_manifest(spark, {"timestamp": ts, "features_file": ts}, str(tmp_path / "m"))
        time.sleep(0.01)
    assert reports.latest_manifest(spark, str(tmp_path / "m")).first().features_file == "20240201_000000"


def test_text_fixture_stays_small_enough_to_be_compiled(spark, tmp_path, capsys):
    """HotSpot leaves methods over 8,000 bytes to its interpreter; the cells are those of a look-up for each column."""
    import datetime
    import re

    from transitlab.sources import fixtures

    keys = [*range(-120, 120), 10**12 + 3, None]
    rows = [(k, n % 23, n % 29, n % 7 + 1, 10.0 + n, 900.5 * n, 0.05, 0.02, "RNA"[n % 3], "OF"[n % 2], datetime.datetime(1995, 1, 1)) for n, k in enumerate(keys)]
    kinds = "bigint bigint bigint int double double double double string string timestamp_ntz".split()
    schema = ", ".join(f"{c} {t}" for c, t in zip(fixtures.LINEITEM_COLUMNS, kinds, strict=True))
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = fixtures.koi_text(spark, str(tmp_path))
    found.explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000

    tokens = F.array(*map(F.lit, ("NA", "None", "null", "NaN", "")))
    k = fixtures.koi_fixture(spark, str(tmp_path)).drop("discovery_date")
    want = []
    for i, c in enumerate(k.columns):
        key, text = F.col("star_id") + i, F.col(c).cast("string")
        if c not in ("object_id", "koi_disposition", "stellar_type"):
            text = F.when(key % 10 == 0, F.element_at(tokens, (key % 5 + 1).cast("int"))).when(key % 97 == 3, "abc").otherwise(text)
        want.append(text.alias(c))
    order = lambda rows: sorted(map(str, rows))
    assert order(found.drop("remark").collect()) == order(k.select(*want).collect())
