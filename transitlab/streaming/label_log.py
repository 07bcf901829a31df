"""The label log as a stream (K8, G11, J4): the newest label of each object, and the queue without labelled ones.

Events are appended as files, by any number of writers. The stream keeps the newest
event of each object and day of labelling, as state that the engine drops once the
watermark has passed the day: what it holds is bounded by the delay, not by the
log. Events that come late but within the delay count, repeated ones change
nothing, and those beyond the delay are dropped by the engine (its progress says how
many). Each batch writes the rows that changed to a folder of its own, so a batch
that runs again overwrites itself; the table of newest labels is the greatest event
of each object over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labeling import LABEL_EVENT
from ..sources.readers import path_exists

NEWEST = "object_id string, labeled_at timestamp, seq long, label string, notes string"


def append_events(events: DataFrame, log: str) -> None:
    """K8: adds events (see ``label_events``) to the log; nothing is read, so writers don't wait for one another."""
    columns = [x.split()[0] for x in LABEL_EVENT.split(", ")]
    events.select(*columns).write.mode("append").parquet(log)


def _newest(rows: DataFrame, *keys) -> DataFrame:
    """The greatest event by time, number and then label, so that the result doesn't depend on the order of arrival."""
    event = F.max(F.struct("labeled_at", "seq", "label", "notes")).alias("event")
    return rows.groupBy(*keys).agg(event).select("object_id", "event.*")


def newest_by_day(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """The newest event of each object and day; of a stream, the rows that changed in a batch."""
    dated = events.where("object_id is not null and label is not null").withWatermark("labeled_at", delay)
    return _newest(dated, "object_id", F.window("labeled_at", "1 day"))


def run_label_stream(spark: SparkSession, log: str, kept: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Takes what was appended to the log since the last run into the table of newest labels under ``kept``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{kept.rstrip('/')}/batch={batch_id}")

    events = spark.readStream.schema(LABEL_EVENT).parquet(log)
    query = (
        newest_by_day(events, delay)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def newest_labels(spark: SparkSession, kept: str) -> DataFrame:
    """(object_id, labeled_at, seq, label, notes), one row an object. No batches yet: no rows."""
    if not path_exists(spark, kept):
        return spark.createDataFrame([], NEWEST)
    rows = spark.read.schema(NEWEST).option("recursiveFileLookup", True).parquet(kept)
    return _newest(rows, "object_id")


def open_items(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """Queue items without a label. The queue may be a stream: its rows are held against the labels, without state."""
    return queue.join(labels.select("object_id"), "object_id", "left_anti")


def run_open_queue(queue: DataFrame, labels: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Streams queue items that have no label into a table; a queue file is taken once."""
    query = (
        open_items(queue, labels)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
