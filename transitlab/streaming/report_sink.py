"""A stream's report (T1, K1, K2): every batch writes its own folder, and a batch that runs again overwrites it.

A streaming query gives a batch the same id and the same rows when it runs again
after a failure, so ``batch=<id>`` makes the write idempotent: whether the query
stopped before, within or after the write, each row is there once. A small file in
``done`` is written last; readers take only batches that have one, so a batch half
written is never seen.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sinks.reports import REPORT_SCHEMA, ROWS_CODEC, TEXT_FORMS, _flags_text, _reader, report_rows, write_text
from ..sources.readers import path_exists

DONE_SCHEMA = "batch long, rows long"

#: Each batch writes all forms before the next one begins, so speed counts more than the last third of the size.
TEXT_LEVEL = "BEST_SPEED"


def batch_writer(out_dir: str, forms: Sequence[str] = ("csv", "json")) -> Callable[[DataFrame, int], None]:
    """Writes one batch: evaluated once into Parquet, its text forms from there, then its mark."""
    base = out_dir.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"batch={batch_id}"
        report_rows(batch).write.mode("overwrite").option("compression", ROWS_CODEC).parquet(f"{base}/rows/{own}")
        rows = spark.read.parquet(f"{base}/rows/{own}")
        for form in forms:
            if form not in TEXT_FORMS:
                raise ValueError(f"unknown form {form!r}; one of csv, json")
            write_text(rows, form, f"{base}/{form}/{own}", "overwrite", TEXT_LEVEL)
        mark = spark.createDataFrame([(batch_id, rows.count())], DONE_SCHEMA)  # the count comes from the footers
        mark.coalesce(1).write.mode("overwrite").parquet(f"{base}/done/{own}")

    return write


def run_report_stream(
    stream: DataFrame,
    out_dir: str,
    checkpoint: str,
    forms: Sequence[str] = ("csv", "json"),
    after_write: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Writes all that is available now and stops. ``after_write`` is called between a batch's write and its commit."""
    write = batch_writer(out_dir, forms)

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        if after_write:
            after_write(batch_id)

    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def done_batches(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch, rows) of the batches that are written in full."""
    path = f"{out_dir.rstrip('/')}/done"
    if not path_exists(spark, path):
        return spark.createDataFrame([], DONE_SCHEMA)
    return spark.read.schema(DONE_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def read_stream_report(spark: SparkSession, out_dir: str, form: str = "json") -> DataFrame:
    """The rows of all batches written in full, in one of the forms ('rows' is Parquet), with their ``batch``."""
    full = T.StructType(REPORT_SCHEMA.fields + [T.StructField("batch", T.LongType())])
    rows = _flags_text(_reader(spark, form, full).load(f"{out_dir.rstrip('/')}/{form}"))
    return rows.join(done_batches(spark, out_dir).select("batch"), "batch", "left_semi").select(*full.names)
