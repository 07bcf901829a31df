"""Report sinks and the run catalogue.

A processing run is evaluated once, into Parquet under ``rows/run_ts=<ts>``; the
CSV (K1) and JSON (K2) forms and the metadata row are made from that. "Latest" is
the greatest folder name in a listing, and only that folder is read, so no pointer
files are kept (K3). Paths can be any Hadoop URI.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import strip
from ..operators.browse import newest_first, page
from ..operators.schema import preferred_order
from ..sources.readers import child_names, path_exists

# Preferred column order of the written report.
REPORT_ORDER = (
    "object_id",
    "koi_disposition",
    "category",
    "disposition_compare",
    "is_disposition_match",
    "color_hint",
    "score",
    "flags",
    "koi_period",
    "koi_prad",
    "koi_teq",
    "koi_insol",
)
TS_FORMAT = "yyyyMMdd_HHmmss"

#: Kept forms are compressed; a text file, which one task reads, holds at most that many rows.
ROWS_CODEC, TEXT_CODEC, FILE_ROWS = "zstd", "gzip", 500_000
REPORT_NAME = r"report_(\d{8}_\d{6})\."


def run_timestamp(now: dt.datetime | None = None) -> str:
    """``%Y%m%d_%H%M%S``."""
    return (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")


def sanitize_value(c: Column, dtype: T.DataType) -> Column:
    """NaN and +-inf -> NULL, also inside arrays, maps and structs."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: sanitize_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _k, v: sanitize_value(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(
            c.isNotNull(),
            F.struct(*[sanitize_value(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]),
        )
    return c


def sanitize(df: DataFrame) -> DataFrame:
    """X8 over every column of a DataFrame."""
    return df.select(*[sanitize_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def report_rows(results: DataFrame) -> DataFrame:
    """K1/K2 row shape: flags as text (P13), preferred order (P8), clean numbers."""
    df = results
    if "flags" in df.columns and df.schema["flags"].dataType.simpleString().startswith("array"):
        df = df.withColumn("flags", F.concat_ws(";", F.col("flags")))
    elif "flags" in df.columns:
        df = df.withColumn("flags", F.coalesce(F.col("flags").cast("string"), F.lit("")))
    return sanitize(preferred_order(df, REPORT_ORDER))


#: How each text form is written: CSV with a header and white space as it is, JSON with its NULLs.
TEXT_FORMS = {
    "csv": {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False},
    "json": {"ignoreNullFields": False},
}


def write_text(rows: DataFrame, form: str, path: str, mode: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """A text form of report rows, compressed, in files of bounded size; ``level`` is one of Hadoop's for zlib."""
    options = TEXT_FORMS[form] | {"compression": TEXT_CODEC, "zlib.compress.level": level, "maxRecordsPerFile": FILE_ROWS}
    rows.write.mode(mode).options(**options).format(form).save(path)


def write_report(
    results: DataFrame,
    out_dir: str,
    run_ts: str | None = None,
    formats: Sequence[str] = ("csv", "json"),
    extras: Mapping[str, str] | None = None,
) -> str:
    """K1+K2: one run under ``<out_dir>/<fmt>/run_ts=<ts>``; returns the timestamp.

    The results are evaluated once, into ``<out_dir>/rows``; text forms are written
    from there, per partition, and ``<out_dir>/meta`` gets a row (run_ts, row_count,
    extras) whose count comes from the Parquet footers. JSON keeps NULL fields
    (``ignoreNullFields=false``) so every row has every column; CSV has a header.
    All forms are compressed, text in files of at most ``FILE_ROWS`` rows."""
    ts, base = run_ts or run_timestamp(), out_dir.rstrip("/")
    spark = results.sparkSession
    stored = f"{base}/rows/run_ts={ts}"
    report_rows(results).write.mode("append").option("compression", ROWS_CODEC).parquet(stored)
    rows = spark.read.parquet(stored)
    for fmt in formats:
        path = f"{base}/{fmt}/run_ts={ts}"
        if fmt in TEXT_FORMS:
            write_text(rows, fmt, path, "append")
        elif fmt != "rows":
            rows.write.mode("append").format(fmt).save(path)
    meta = [(ts, rows.count(), dict(extras or {}))]
    spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/meta")
    return ts


META_SCHEMA = "run_ts string, row_count long, extras map<string,string>"


def read_meta(spark: SparkSession, out_dir: str) -> DataFrame:
    """K2: (run_ts, row_count, extras) of the runs written so far."""
    return spark.read.schema(META_SCHEMA).json(f"{out_dir.rstrip('/')}/meta")


REPORT_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.StringType()),
        T.StructField("koi_disposition", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("disposition_compare", T.StringType()),
        T.StructField("is_disposition_match", T.BooleanType()),
        T.StructField("color_hint", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("flags", T.StringType()),
        T.StructField("koi_period", T.DoubleType()),
        T.StructField("koi_prad", T.DoubleType()),
        T.StructField("koi_teq", T.DoubleType()),
        T.StructField("koi_insol", T.DoubleType()),
    ]
)


def _reader(spark: SparkSession, fmt: str, schema: T.StructType):
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("emptyValue", "").option("escape", '"').format("csv")
    return reader.format("parquet" if fmt == "rows" else fmt)


def _flags_text(df: DataFrame) -> DataFrame:
    return df.withColumn("flags", F.coalesce(F.col("flags"), F.lit(""))) if "flags" in df.columns else df


def read_runs(spark: SparkSession, out_dir: str, fmt: str = "json", schema: T.StructType | None = None) -> DataFrame:
    """All runs with their ``run_ts`` partition column (declared schema,
    so no inference pass; D15: an empty CSV flags cell reads back as '').

    CSV has one spelling for NULL and '' (as in the reference's CSV reports),
    so other empty text cells, e.g. a blank disposition, read back as NULL;
    JSON keeps the difference."""
    full = T.StructType((schema or REPORT_SCHEMA).fields + [T.StructField("run_ts", T.StringType())])
    return _flags_text(_reader(spark, fmt, full).load(f"{out_dir.rstrip('/')}/{fmt}"))


def run_timestamps(spark: SparkSession, out_dir: str, fmt: str = "json") -> list[str]:
    """The runs of a report folder, oldest first, from the names of its folders alone."""
    names = child_names(spark, f"{out_dir.rstrip('/')}/{fmt}")
    return [name.partition("=")[2] for name in names if name.startswith("run_ts=")]


def read_latest(spark: SparkSession, out_dir: str, fmt: str = "json") -> DataFrame:
    """Rows of the newest run; the folders of older runs aren't even listed."""
    runs = run_timestamps(spark, out_dir, fmt)
    if not runs:
        raise FileNotFoundError(f"no {fmt} run under {out_dir}")
    base = f"{out_dir.rstrip('/')}/{fmt}"
    full = T.StructType(REPORT_SCHEMA.fields + [T.StructField("run_ts", T.StringType())])
    return _flags_text(_reader(spark, fmt, full).option("basePath", base).load(f"{base}/run_ts={runs[-1]}"))


def read_report_json_document(
    spark: SparkSession, path: str, row_schema: T.StructType | None = None, limit: int | None = None
) -> DataFrame:
    """Report documents, either ``{"rows": [...], "timestamp": ...}`` or a bare list of rows, read by many tasks.

    ``limit`` is the caller's number of rows."""
    from ..sources.report_documents import read_report_documents

    out = read_report_documents(spark, path, row_schema or REPORT_SCHEMA)
    return out.limit(limit) if limit else out


def read_report(spark: SparkSession, json_path: str, csv_path: str, limit: int | None = None) -> DataFrame:
    """The JSON document if it exists, else the CSV form of the report."""
    if path_exists(spark, json_path):
        return read_report_json_document(spark, json_path, limit=limit).drop("run_ts")
    out = _flags_text(_reader(spark, "csv", REPORT_SCHEMA).load(csv_path))
    return out.limit(limit) if limit else out


def list_files(spark: SparkSession, folder: str, glob: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of files, newest first, ties by path; content never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(folder).select("path", "length", "modificationTime")
    return newest_first(files, "modificationTime", limit, tie="path")


def pair_reports(listing: DataFrame) -> DataFrame:
    """Report files grouped by timestamp; CSV and JSON paths side by side."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    ts = F.regexp_extract(name, REPORT_NAME, 1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    files = listing.select(F.col("path"), ts.alias("ts"), ext.alias("ext")).where(F.col("ts") != "")
    return files.groupBy("ts").agg(
        F.max(F.when(F.col("ext") == "csv", F.col("path"))).alias("csv_path"),
        F.max(F.when(F.col("ext") == "json", F.col("path"))).alias("json_path"),
    )


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Iterable[str] | None = None, codec: str | None = None
) -> None:
    """K4/K5/K7: generic save; ``codec`` is the format's own if none is given."""
    w = df.write.mode(mode).format(fmt)
    if codec:
        w = w.option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def manifest_frame(spark: SparkSession, manifest: dict) -> DataFrame:
    """K6: the ten-field manifest as a one-row DataFrame."""
    fields = [
        ("feature_version", T.StringType()),
        ("source_file", T.StringType()),
        ("engine_loaded", T.StringType()),
        ("rows_loaded", T.LongType()),
        ("features_file", T.StringType()),
        ("feature_specs", T.StringType()),
        ("schema_map", T.StringType()),
        ("albedo", T.DoubleType()),
        ("timestamp", T.StringType()),
        ("feature_names", T.ArrayType(T.StringType())),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return spark.createDataFrame([tuple(manifest.get(n) for n, _ in fields)], schema)


def write_manifest(spark: SparkSession, manifest: dict, manifests_dir: str) -> None:
    """K6: append the manifest row to the manifests table (JSON)."""
    manifest_frame(spark, manifest).write.mode("append").json(manifests_dir)


def latest_manifest(spark: SparkSession, manifests_dir: str) -> DataFrame:
    """The newest manifest row (top-1 by timestamp)."""
    return spark.read.json(manifests_dir).orderBy(F.col("timestamp").desc()).limit(1)


def read_features(
    spark: SparkSession, manifests_dir: str, object_id: str | None = None, page_no: int = 1, page_size: int = 50
) -> DataFrame:
    """A page of the features that the newest manifest names, by id, optionally of one object."""
    rows = spark.read.parquet(latest_manifest(spark, manifests_dir).first()["features_file"])
    if object_id is not None:
        rows = rows.where(F.col("object_id").cast("string") == F.lit(object_id))
    order = ["object_id"] if "object_id" in rows.columns else rows.columns
    return page(rows, page_no, page_size, order)
