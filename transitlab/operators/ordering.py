"""Row numbers over a total or a load order without a single-partition window.

The numbered rows are written once to the shared checkpoint folder together with
the partition they were in and their place in it. From then on both are stored
values: neither a lost executor, nor a second evaluation, nor another partition
coalescing can change them. Offsets are sums over one row per partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: ``monotonically_increasing_id`` holds the partition above these bits and the place below.
PLACE_BITS = 33


def number_rows(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``name`` = ``start`` + 0-based place of each row in the order that ``df`` delivers them.

    The write to the checkpoint folder is the only job. The offsets are a window
    over the partitions' counts, broadcast back: as many rows as partitions."""
    stored = cut_lineage(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", PLACE_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        stored.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__before") + place + F.lit(start)).cast("long"))
        .drop("__part", "__at", "__before")
    )


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "pos", start: int = 0) -> DataFrame:
    """Append ``name`` = 0-based (plus ``start``) position of each row in ``order``."""
    return number_rows(df.orderBy(*order), name, start)


def top_k_with_positions(df: DataFrame, order: Sequence[Column], k: int, name: str = "pos", start: int = 0) -> DataFrame:
    """Top-k (TakeOrderedAndProject: each task keeps k rows) plus positions.

    The window runs over the k-row result only, so k is a page or a batch; use
    ``with_positions`` and a filter on the position for a large share of the rows."""
    top = df.orderBy(*order).limit(int(k))
    return top.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))
