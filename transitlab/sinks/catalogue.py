"""The report catalogue (S9, F8, J6): which forms of which runs there are, with rows and bytes of each file.

Files come from a listing whose contents are never read, rows from one scan of a
form that reads no column but the file's own metadata. Forms are paired by the
run's timestamp with a full outer join, so a run that has one form alone still has
a row. Names are those of run folders (``run_ts=<ts>``) or of flat report files
(``report_<ts>.csv``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists
from .reports import REPORT_NAME, REPORT_SCHEMA, _reader, run_timestamps

FILES = "run_ts string, form string, file string, bytes long, modified timestamp, rows long"


def run_of(path: Column) -> Column:
    """The run's timestamp in a path: the folder ``run_ts=<ts>``, else the file name ``report_<ts>.<form>``; NULL if neither."""
    folder, name = F.regexp_extract(path, r"/run_ts=([^/]+)/", 1), F.regexp_extract(path, REPORT_NAME + "[^/]*$", 1)
    return F.when(folder != "", folder).when(name != "", name)


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, modified) of all data files below a folder; hidden files and markers are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def report_files(spark: SparkSession, out_dir: str, form: str) -> DataFrame:
    """A row for each file of a form ('csv', 'json', 'rows'): its run, bytes, time and number of rows.

    A file without rows has 0. A form that was never written gives no rows, and so
    do files that belong to no run."""
    base = f"{out_dir.rstrip('/')}/{form}"
    if not path_exists(spark, base):
        return spark.createDataFrame([], FILES)
    scan = _reader(spark, form, REPORT_SCHEMA).option("recursiveFileLookup", True).load(base)
    rows = scan.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    files = listed_files(spark, base).withColumns({"run_ts": run_of(F.col("file")), "form": F.lit(form)})
    return (
        files.where("run_ts is not null")
        .join(rows, "file", "left")
        .select("run_ts", "form", "file", "bytes", "modified", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    )


def runs_of(files: DataFrame) -> DataFrame:
    """(run_ts, files, rows, bytes, newest file) of the files of one form."""
    return files.groupBy("run_ts").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.max("modified").alias("modified"),
    )


def catalogue(spark: SparkSession, out_dir: str, forms: Sequence[str] = ("csv", "json")) -> DataFrame:
    """A row for each run: files, rows and bytes of both forms (NULL where a form is missing) and ``state``.

    ``state`` is 'paired' when both forms have the same number of rows, 'differs'
    when they don't, else '<form> only'. Newest run first (O5)."""
    left, right = forms
    sides = []
    for form in forms:
        # a run without rows may have no file, but it has a folder
        folders = spark.createDataFrame([(ts,) for ts in run_timestamps(spark, out_dir, form)], "run_ts string")
        own = folders.join(runs_of(report_files(spark, out_dir, form)), "run_ts", "full")
        own = own.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "rows", "bytes")})
        sides.append(own.select("run_ts", *[F.col(c).alias(f"{form}_{c}") for c in own.columns if c != "run_ts"]))
    a, b = F.col(f"{left}_rows"), F.col(f"{right}_rows")
    state = (
        F.when(b.isNull(), F.lit(f"{left} only")).when(a.isNull(), F.lit(f"{right} only")).when(a == b, F.lit("paired"))
    ).otherwise(F.lit("differs"))
    return sides[0].join(sides[1], "run_ts", "full").withColumn("state", state).orderBy(F.desc("run_ts"))
