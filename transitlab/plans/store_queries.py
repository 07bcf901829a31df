"""Registered queries over what is kept between jobs: report runs, streams, logs, summaries, indexes and queues.

Each writes its kept form from the driver tables into a fresh folder under the
shared checkpoint folder and answers from there; results are full.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FeatureSpec
from ..functions.rules import disposition_category
from ..operators import bayes, evaluate, id_index, incremental, kept_queue, paging, splits
from ..sinks import catalogue, observed, reports
from ..sources.fixtures import table
from ..sources.readers import child_names
from ..sources.report_documents import read_report_documents
from ..streaming import label_log, report_sink
from ..streaming.file_drop import classified_stream
from .queries import _enriched, _full_queue, _report, _rounded_echo, _scratch, _text_csv, r6

NAN, INF = float("nan"), float("inf")


# ----------------------------------------------------------------- reports
def q_report_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs, one without CSV, one of fewer rows."""
    out = _scratch(spark, "catalogue")
    rows = _report(spark, sf)
    reports.write_report(rows, out, run_ts="20240101_000000")
    reports.write_report(rows, out, run_ts="20240201_000000", formats=("json",))
    reports.write_report(rows.where("category = 'candidate'"), out, run_ts="20240301_000000")
    found = catalogue.catalogue(spark, out)
    return found.select(
        "run_ts", "csv_rows", "json_rows", "state",
        (F.col("csv_bytes") > 0).alias("csv_has_bytes"), (F.col("json_bytes") > 0).alias("json_has_bytes"),
    )


def q_report_write_counts(spark, sf):
    """Rows, NULLs and non-finite values of each column, counted by the write itself."""
    digit = F.substring("object_id", -1, 1)
    teq = F.when(digit == "7", F.lit(NAN)).when(digit == "3", F.lit(INF)).otherwise(F.col("koi_teq"))
    _, counts = observed.write_counted(_report(spark, sf).withColumn("koi_teq", teq), _scratch(spark, "counted"), "20240101_000000")
    return counts


def q_stream_report_sink(spark, sf):
    """Stopped between the write and the commit of its second batch, then started again."""
    folder, out, checkpoint = _text_csv(spark, sf, ",", files=3), _scratch(spark, "report-sink"), _scratch(spark, "report-ckpt")
    columns = spark.read.option("header", True).csv(folder).columns
    files = sum(name.startswith("part-") for name in child_names(spark, folder))
    per_batch = -(-files // 3)  # three batches, or two
    stream = classified_stream(spark, folder, columns, max_files_per_trigger=per_batch)

    def stop(batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("stopped after the write")

    try:
        report_sink.run_report_stream(stream, out, checkpoint, after_write=stop)
    except StreamingQueryException:
        pass
    report_sink.run_report_stream(classified_stream(spark, folder, columns, max_files_per_trigger=per_batch), out, checkpoint)
    return _rounded_echo(report_sink.read_stream_report(spark, out).drop("batch"))


#: Text that looks like the end of a row and the beginning of the next, with an escaped quote.
TRICKY = ' "},{"rows": [{'


#: Rows of a report document, about: a document is one file, which one task writes.
DOCUMENT_ROWS = 500_000


def _documents(spark, sf) -> str:
    """Report documents with four timestamps, as many of each as the rows need, a file each with its rows in order.

    Those of the first timestamp are plain text, which the reader splits; the others are compressed, whole."""
    path = _scratch(spark, "documents")
    rows = _report(spark, sf).withColumn("flags", F.when(F.col("category") == "candidate", F.concat("flags", F.lit(TRICKY))).otherwise(F.col("flags")))
    doc = F.conv(F.substring(F.md5("object_id"), 1, 1), 16, 10).cast("int") % 4
    text = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    order = Window.partitionBy("doc", "part").orderBy("text")
    parts = -(-table(spark, sf, "lineitem").count() // (4 * DOCUMENT_ROWS)) or 1  # counted in the footers
    part = F.pmod(F.xxhash64("object_id"), F.lit(parts))
    lines = rows.select(doc.alias("doc"), part.alias("part"), text.alias("text"))
    first, last = F.lag("text").over(order).isNull(), F.lead("text").over(order).isNull()
    lines = lines.select(
        "doc", "part", "text",
        F.when(first, F.lit('{"rows": [')).otherwise(F.lit(", ")).alias("before"),
        F.when(last, F.concat(F.lit('], "timestamp": "20240101_00000'), "doc", F.lit('"}'))).otherwise(F.lit("")).alias("after"),
    )
    lines = lines.select("doc", "part", F.concat("before", "text", "after").alias("value"))
    plain = F.col("doc").eqNullSafe(0)
    lines.where(plain).write.partitionBy("doc", "part").text(path)
    compressed = lines.where(~plain).write.options(**{"compression": reports.TEXT_CODEC, "zlib.compress.level": "BEST_SPEED"})
    compressed.mode("append").partitionBy("doc", "part").text(path)
    return path


def q_report_documents(spark, sf):
    """Whole documents, split wherever the reader splits them."""
    return read_report_documents(spark, _documents(spark, sf), reports.REPORT_SCHEMA)


# ----------------------------------------------------------------- label log
def _events(spark, sf, every: int, rest: int, label: str, days: int, seq: int) -> DataFrame:
    """Events for the rows with ``l_partkey % every = rest``, a few hours apart, ``days`` after a fixed day."""
    li = table(spark, sf, "lineitem").where(F.col("l_partkey") % every == rest)
    oid = F.concat(
        F.lit("K"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"),
        F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"),
    )
    at = F.timestamp_seconds(F.lit(1_704_844_800) + F.col("l_linenumber") * 3_600 + days * 86_400)
    return li.select(
        oid.alias("object_id"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("notes"),
        at.alias("labeled_at"), F.lit(seq).cast("long").alias("seq"),
    )


def _label_stream(spark, sf) -> DataFrame:
    """The newest labels after three appends: labels, newer ones with repeats of the first, and late ones."""
    log, kept, checkpoint = (_scratch(spark, f"labels-{x}") for x in ("log", "kept", "ckpt"))
    appends = [
        [(50, 0, "candidate", 0, 1)],
        [(100, 0, "rocky_candidate", 1, 2), (200, 0, "candidate", 0, 1)],
        [(50, 0, "anomalous_signal", -5, 3), (150, 25, "candidate", -5, 3)],
    ]
    for append in appends:
        for every, rest, label, days, seq in append:
            label_log.append_events(_events(spark, sf, every, rest, label, days, seq), log)
        label_log.run_label_stream(spark, log, kept, checkpoint)
    return label_log.newest_labels(spark, kept)


def q_label_stream_latest(spark, sf):
    """The newest label of each object, kept by the stream."""
    return _label_stream(spark, sf).select("object_id", "label", "seq")


def q_label_stream_open_queue(spark, sf):
    """The queue as a stream against the labels that the other stream keeps."""
    path, sink, checkpoint = (_scratch(spark, f"open-{x}") for x in ("queue", "sink", "ckpt"))
    queue = _full_queue(spark, sf).select("object_id", "queue_pos")
    queue.write.parquet(path)
    stream = spark.readStream.schema(queue.schema).parquet(path)
    label_log.run_open_queue(stream, _label_stream(spark, sf), sink, checkpoint)
    return spark.read.parquet(sink)


# ----------------------------------------------------------------- features
def q_feature_table_incremental(spark, sf):
    """Fitted from the summaries of three runs; equals the fit over all rows."""
    store, spec, rows = _scratch(spark, "summaries"), FeatureSpec.load(), _enriched(spark, sf)
    for run in range(3):
        incremental.summarise(rows.where(F.col("star_id") % 3 == run), store, f"r{run}", spec)
    out = incremental.fit_from_summaries(spark, store, spec).transform(rows)
    double = {f.name for f in out.schema.fields if f.dataType.simpleString() == "double"}
    return out.select(*[r6(F.col(c)).alias(c) if c in double else F.col(c) for c in out.columns])


# ----------------------------------------------------------------- indexes and pages
def _needles(spark, sf) -> DataFrame:
    """Substrings to look for: part keys between dashes, beginnings of ids, one shorter than a trigram, one that nothing has."""
    part = table(spark, sf, "part").where("p_partkey % 40 = 0").select(F.concat(F.lit("-"), "p_partkey", F.lit("-")).alias("needle"))
    nation = table(spark, sf, "nation").where("n_nationkey >= 23").select(F.concat(F.lit("K"), "n_nationkey").alias("needle"))
    region = table(spark, sf, "region").where("r_regionkey = 4")
    return (
        part.union(nation)
        .union(region.select(F.concat(F.lit("k"), "r_regionkey").alias("needle")))
        .union(region.select(F.lit("no such id").alias("needle")))
    )


def q_search_id_index(spark, sf):
    """a batch of substrings through the trigram index."""
    path = _scratch(spark, "trigrams")
    id_index.write_trigram_index(_report(spark, sf).select("object_id"), path)
    return id_index.search_index(spark, path, _needles(spark, sf))


def _asked(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_orderkey % 20 = 0 and l_linenumber = 1")
    oid = F.concat(F.lit("K"), "l_orderkey", F.lit("."), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey")
    ids = li.select(oid.alias("object_id"))
    return ids.union(ids).union(ids.select(F.concat("object_id", F.lit("x"))))  # repeats, and ids that nothing has


def q_lookup_many_ids(spark, sf):
    """many ids at once, from rows clustered by id."""
    path = _scratch(spark, "clustered")
    id_index.write_clustered(_report(spark, sf), path, group_rows=10_000)
    return id_index.lookup_objects(spark, path, _asked(spark, sf))


def q_page_by_index(spark, sf):
    """Three pages of five ids, one of them the thousandth."""
    path = _scratch(spark, "pages")
    paging.write_pages(_report(spark, sf).select("object_id").distinct(), path, "object_id", page_size=5)
    return paging.read_pages(spark, path, "object_id", [1, 77, 1000])


# ----------------------------------------------------------------- kept queue
def q_queue_merge_kept(spark, sf):
    """The merge of ``queue_merge`` into a bucketed queue that stays where it is."""
    name = "kept_queue_" + _scratch(spark, "q").rsplit("-", 1)[-1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _scratch(spark, "queue-rows")  # both queues sort the same rows, and a sort reads its rows twice
    _report(spark, sf).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    existing = _full_queue(spark, sf, "priority", F.col("category").isin("anomalous_signal", "candidate"), rows)
    kept_queue.keep_queue(existing, name, _scratch(spark, "kept-queue"), buckets)
    merged = kept_queue.merge_into_kept(spark, name, _full_queue(spark, sf, "uncertainty", rows=rows))
    return merged.select("object_id", "suggested_label", "queue_pos")


# ----------------------------------------------------------------- naive Bayes
BAYES_FEATURES = ("koi_period", "koi_prad", "koi_teq", "koi_insol", "koi_srad", "koi_smass")


def _bayes_predictions(spark, sf) -> DataFrame:
    named = _enriched(spark, sf, outputs=("object_id", "star_id", "koi_disposition", *BAYES_FEATURES)).withColumn("label", disposition_category(F.col("koi_disposition"))).where("label is not null")
    split = splits.grouped_split(named)
    model = bayes.fit_gaussian(split.where("split = 'train'"), BAYES_FEATURES)
    return model.predict(split.where("split = 'test'"))


def q_naive_bayes_predictions(spark, sf):
    """Trained on the train stars, predictions for the test stars."""
    return _bayes_predictions(spark, sf).select("object_id", "label", "prediction")


def q_naive_bayes_confusion(spark, sf):
    return evaluate.confusion_matrix(_bayes_predictions(spark, sf))


def q_naive_bayes_metrics(spark, sf):
    m = evaluate.macro_metrics(evaluate.confusion_matrix(_bayes_predictions(spark, sf)))
    return m.select(*[r6(F.col(c)).alias(c) if c != "n_classes" else F.col(c) for c in m.columns])


def store_registry() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
