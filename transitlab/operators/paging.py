"""Deep paging (O4): any page of a sorted table by a range filter, without sorting or skipping what comes before.

The table is sorted and written once, with each row's place. Its page index holds
the key of each page's first row, so a page is the rows from its first key to the
next page's: a filter that the scan answers from the sorted files' statistics.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import with_positions


def write_pages(df: DataFrame, path: str, key: str, page_size: int = 50) -> None:
    """Sorts by ``key`` (unique and not NULL) and writes rows and page index. ``page_size`` <= 0 means 50."""
    size, base = page_size if page_size and page_size > 0 else 50, path.rstrip("/")
    numbered = with_positions(df.where(F.col(key).isNotNull()), [F.col(key).asc()], "__place")
    numbered.drop("__place").write.mode("overwrite").parquet(f"{base}/rows")
    first = numbered.where(F.col("__place") % size == 0)
    index = first.select((F.col("__place") / size + 1).cast("long").alias("page"), F.col(key).alias("first"))
    index.write.mode("overwrite").parquet(f"{base}/index")


def read_pages(spark: SparkSession, path: str, key: str, pages: Sequence[int]) -> DataFrame:
    """The rows of the pages (1-based, clamped at 1) with their ``page``; a page beyond the last has none.

    Two keys a page come to the driver; each page is then one range of keys."""
    base = path.rstrip("/")
    wanted = sorted({max(int(p), 1) for p in pages})
    rows, index = spark.read.parquet(f"{base}/rows"), spark.read.parquet(f"{base}/index")
    ends = index.where(F.col("page").isin(sorted({*wanted, *[p + 1 for p in wanted]}))).collect()
    first = {r["page"]: r["first"] for r in ends}
    found = None
    for page in wanted:
        if page in first:
            inside = F.col(key) >= F.lit(first[page])
            if page + 1 in first:
                inside = inside & (F.col(key) < F.lit(first[page + 1]))
            own = rows.where(inside).withColumn("page", F.lit(page).cast("long"))
            found = own if found is None else found.unionByName(own)
    if found is None:
        found = rows.where(F.lit(False)).withColumn("page", F.lit(0).cast("long"))
    return found.orderBy("page", key)
