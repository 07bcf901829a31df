"""Counts that a write gathers on its way (S8, K2, K6): no second pass over the rows.

``observe`` adds its aggregates to the plan that writes, so rows, NULLs and
non-finite values of every column are known when the write ends. Only these
numbers, two for each column, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reports import FILE_ROWS, META_SCHEMA, ROWS_CODEC, TEXT_CODEC, report_rows, run_timestamp

COUNTS = "column string, rows long, nulls long, non_finite long"


def non_finite(c: Column, dtype: T.DataType) -> Column:
    """1 for NaN and infinities, 0 for everything else."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce((F.isnan(c) | (F.abs(c) == F.lit(float("inf")))).cast("long"), F.lit(0))
    return F.lit(0).cast("long")


def observed(df: DataFrame, name: str = "report") -> tuple[DataFrame, Observation]:
    """The same rows, and what an action over them will have counted."""
    seen, aggregates = Observation(name), [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        aggregates += [
            F.count_if(c.isNull()).alias(f"nulls_{i}"),
            F.coalesce(F.sum(non_finite(c, field.dataType)), F.lit(0)).alias(f"non_finite_{i}"),
        ]
    return df.observe(seen, *aggregates), seen


def counts_frame(spark: SparkSession, columns: list[str], seen: Observation) -> DataFrame:
    """(column, rows, nulls, non_finite) after the action; waits for it to end."""
    got = seen.get
    rows = [(c, got["rows"], got[f"nulls_{i}"], got[f"non_finite_{i}"]) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, COUNTS)


def write_counted(results: DataFrame, out_dir: str, run_ts: str | None = None, form: str = "json") -> tuple[str, DataFrame]:
    """K1/K2 in one form, with its counts: (run timestamp, counts by column).

    Rows are counted as they come, before non-finite values become NULL (X8), so
    ``non_finite`` says how many values the report lost. The metadata row of the
    run is written from the same counts."""
    ts, base, spark = run_ts or run_timestamp(), out_dir.rstrip("/"), results.sparkSession
    rows, seen = observed(results)
    writer = report_rows(rows).write.mode("append").option("compression", TEXT_CODEC).option("maxRecordsPerFile", FILE_ROWS)
    path = f"{base}/{form}/run_ts={ts}"
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif form == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.option("compression", ROWS_CODEC).parquet(path)
    counts = counts_frame(spark, results.columns, seen)
    meta = [(ts, seen.get["rows"], {"form": form})]
    spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/meta")
    return ts, counts
