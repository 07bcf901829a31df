"""A queue that is kept as a bucketed, sorted table (O3, J5, U2): merging into it doesn't move it.

The kept queue holds each id once, dealt into buckets by id. New items are brought
to its buckets, those that it has are dropped there, and the rest follow its last
position. So a merge costs the new items' shuffle, whatever the size of the queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import with_positions


def _first_of_each(items: DataFrame, key: str) -> DataFrame:
    """One row an id: that with the least ``queue_pos``, which no two rows share. Combined before the shuffle."""
    first = items.groupBy(key).agg(F.min("queue_pos").alias("queue_pos"))
    return items.join(first, [key, "queue_pos"]).select(*items.columns)


def keep_queue(queue: DataFrame, name: str, path: str, buckets: int, key: str = "object_id") -> None:
    """Stores the queue as table ``name`` with its files under ``path``. Of rows with one id the first stays; NULL counts as ''.

    ``buckets`` should be the session's shuffle partitions or more: with fewer, Spark
    may prefer to deal both sides anew."""
    rows = _first_of_each(queue.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(""))), key)
    # each task holds whole buckets, so a bucket is one sorted file
    dealt = rows.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def unseen_items(spark: SparkSession, name: str, new_items: DataFrame, key: str = "object_id") -> DataFrame:
    """The new items that the kept queue lacks, one an id, in the columns of the queue."""
    kept = spark.table(name)
    keyed = new_items.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(""))).select(*kept.columns)
    return _first_of_each(keyed, key).join(kept.select(key), key, "left_anti").select(*kept.columns)


def merge_into_kept(spark: SparkSession, name: str, new_items: DataFrame, key: str = "object_id") -> DataFrame:
    """The kept queue with its positions as they are, then the unseen items in their order."""
    kept = spark.table(name)
    last = kept.agg(F.coalesce(F.max("queue_pos"), F.lit(-1))).first()[0]
    fresh = with_positions(unseen_items(spark, name, new_items, key), [F.col("queue_pos")], "__pos", start=int(last) + 1)
    return kept.unionByName(fresh.withColumn("queue_pos", F.col("__pos")).drop("__pos"))


def append_to_kept(spark: SparkSession, name: str, new_items: DataFrame, key: str = "object_id", buckets: int | None = None) -> None:
    """Writes the unseen items to the end of the kept queue, into its buckets."""
    kept = spark.table(name)
    buckets = buckets or kept_buckets(spark, name)
    last = kept.agg(F.coalesce(F.max("queue_pos"), F.lit(-1))).first()[0]
    fresh = with_positions(unseen_items(spark, name, new_items, key), [F.col("queue_pos")], "__pos", start=int(last) + 1)
    rows = fresh.withColumn("queue_pos", F.col("__pos")).select(*kept.columns).repartition(buckets, key)
    rows.write.mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def kept_buckets(spark: SparkSession, name: str) -> int:
    """The number of buckets in the table's description."""
    about = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    return int(about["data_type"])
