"""The label log as a stream, and its tie rules."""

import datetime as dt

from pyspark.sql import functions as F

from transitlab.operators.labeling import LABEL_EVENT
from transitlab.operators.splits import latest_labels
from transitlab.streaming import label_log

DAY = dt.datetime(2024, 3, 1)


def events(spark, *rows):
    made = [(oid, label, None, None if at is None else DAY + dt.timedelta(days=at), seq) for oid, label, at, seq in rows]
    return spark.createDataFrame(made, LABEL_EVENT)


def folders(tmp_path):
    return tuple(str(tmp_path / x) for x in ("log", "kept", "ckpt"))


def newest(spark, kept):
    return {r.object_id: r.label for r in label_log.newest_labels(spark, kept).collect()}


def test_late_and_repeated_events(spark, tmp_path):
    log, kept, checkpoint = folders(tmp_path)
    appends = [
        [("a", "one", 0, 1), ("b", "one", 0, 2)],
        [("a", "two", 1, 3), ("a", "one", 0, 1), ("c", "one", 2, 4)],  # newer, and a repeat
        [("b", "old", -3, 5), ("d", "late", -3, 6), ("c", "one", 2, 4)],  # late within the delay
    ]
    for i, append in enumerate(appends):
        label_log.append_events(events(spark, *append), log)
        label_log.run_label_stream(spark, log, kept, checkpoint, delay="10 days")
        assert newest(spark, kept)["a"] == ("one" if i == 0 else "two")
    assert newest(spark, kept) == {"a": "two", "b": "one", "c": "one", "d": "late"}
    whole = events(spark, *[e for append in appends for e in append])
    batch = whole.groupBy("object_id").agg(F.max(F.struct("labeled_at", "seq", "label")).alias("e")).collect()
    assert newest(spark, kept) == {r.object_id: r.e.label for r in batch}


def test_state_is_bounded_by_the_delay(spark, tmp_path):
    log, kept, checkpoint = folders(tmp_path)
    for day in (0, 40, 80):
        label_log.append_events(events(spark, *[(f"k{day}-{i}", "x", day, i) for i in range(20)]), log)
        query = label_log.run_label_stream(spark, log, kept, checkpoint, delay="2 days")
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 20 and len(newest(spark, kept)) == 60
    label_log.append_events(events(spark, ("k80-1", "too late", 1, 99)), log)
    query = label_log.run_label_stream(spark, log, kept, checkpoint, delay="2 days")
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)
    assert dropped == 1 and newest(spark, kept)["k80-1"] == "x"


def test_two_writers_with_one_number(spark, tmp_path):
    log, kept, checkpoint = folders(tmp_path)
    one, two = events(spark, ("a", "first", 0, 7)), events(spark, ("a", "second", 0, 7))
    for writer in (two, one):
        label_log.append_events(writer, log)
    label_log.run_label_stream(spark, log, kept, checkpoint)
    assert newest(spark, kept) == {"a": "second"}
    assert [tuple(r) for r in latest_labels(one.union(two)).collect()] == [("a", "second")]


def test_nulls_and_nothing(spark, tmp_path):
    log, kept, checkpoint = folders(tmp_path)
    assert label_log.newest_labels(spark, kept).count() == 0
    label_log.append_events(events(spark, (None, "x", 0, 1), ("a", None, 0, 2), ("b", "y", 0, 3)), log)
    label_log.run_label_stream(spark, log, kept, checkpoint)
    label_log.run_label_stream(spark, log, kept, checkpoint)  # nothing new
    assert newest(spark, kept) == {"b": "y"}


def test_queue_stream_without_labelled_items(spark, tmp_path):
    queue = spark.createDataFrame([("a", 0), ("b", 1), (None, 2)], "object_id string, queue_pos long")
    queue.write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(queue.schema).parquet(str(tmp_path / "q"))
    labels = spark.createDataFrame([("b",)], "object_id string")
    for _ in range(2):
        label_log.run_open_queue(stream, labels, str(tmp_path / "s"), str(tmp_path / "c"))
    assert sorted(r.queue_pos for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [0, 2]
