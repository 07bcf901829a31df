"""Connected components of a large graph by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, low): the least of u and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge; the label is the least node of its component.

    ``edges`` has longs ``u`` and ``v``; loops and repeats are allowed, an empty
    table gives no rows. Large-star and small-star steps alternate: each node's
    neighbours are linked to the least of them, which keeps components and halves
    depths, until nothing changes. Each round is written to the shared checkpoint
    folder, so a lost executor costs that round only. Nothing is collected but a
    count and a checksum.
    """
    now = stored(
        edges.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select("v", "v").distinct()
            )
        state = tuple(seen)
        both = now.union(now.select("v", "u").toDF("u", "v"))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u != v").distinct()
        low = _least(large)  # here every v is below its u
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            low.select("u", "low")
        )
        now = stored(small.where("u != v").distinct())
