"""Candidate-table readers.

CSV is read with every column as text (no ``inferSchema`` pass over the
data); known numeric inputs are typed later with ``try_cast`` after the null
tokens are removed, so one bad cell never turns a column into strings or
fails the job. Paths may be any Hadoop URI (local, HDFS, object stores).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import null_tokens_to_null

# Delimiter candidates of the vote and allowed upload suffixes.
DELIMITERS = (",", "\t", ";", "|")
ALLOWED_EXTENSIONS = ("csv", "parquet")


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def delimiter_by_suffix(path: str) -> str:
    return "\t" if suffix_of(path) == "tsv" else ","


QUOTED_CELL = r'"[^"]*"'


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Vote over ``, \\t ; |`` on all lines, counted outside quotes.

    A candidate that occurs the same non-zero number of times on every line wins
    (most occurrences first); else the highest mean count; else the suffix
    default. One narrow scan with partial aggregates."""
    bare = spark.read.text(path).select(F.regexp_replace("value", QUOTED_CELL, "").alias("value"))
    aggs = []
    for i, d in enumerate(DELIMITERS):
        n = F.length(F.col("value")) - F.length(F.replace(F.col("value"), F.lit(d), F.lit("")))
        aggs += [F.min(n).alias(f"mn{i}"), F.max(n).alias(f"mx{i}"), F.avg(n).alias(f"av{i}")]
    row = bare.where(F.length(F.trim(F.col("value"))) > 0).agg(*aggs).first()
    if row is None or row["mn0"] is None:
        return delimiter_by_suffix(path)
    consistent = [(row[f"mn{i}"], -i, d) for i, d in enumerate(DELIMITERS) if row[f"mn{i}"] == row[f"mx{i}"] and row[f"mn{i}"] > 0]
    if consistent:
        return max(consistent)[2]
    best = max(((row[f"av{i}"] or 0.0), -i, d) for i, d in enumerate(DELIMITERS))
    return best[2] if best[0] > 0 else delimiter_by_suffix(path)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, or ISO-8859-1 if the bytes of some line aren't valid UTF-8."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def csv_options(sep: str, encoding: str = "UTF-8", multi_line: bool = False) -> dict[str, object]:
    """The CSV dialect of batch and stream: a quote inside a quoted cell is doubled.

    ``multi_line`` allows line breaks in quoted cells; such files can't be split."""
    return {
        "header": True, "sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "inferSchema": False,
        "mode": "PERMISSIVE", "multiLine": multi_line,
    }


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str = "UTF-8",
    null_tokens: bool = True,
    sniff: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV, all columns as strings, null tokens -> NULL; ``encoding='auto'`` looks for invalid UTF-8."""
    delim = sep or (detect_delimiter(spark, path) if sniff else delimiter_by_suffix(path))
    charset = detect_encoding(spark, path) if encoding == "auto" else encoding
    df = spark.read.options(**csv_options(delim, charset, multi_line)).csv(path)
    if null_tokens:
        df = df.select(*[null_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


TEXT_FORMATS = ("csv", "tsv", "txt", "")
FORMATS = ("parquet", "json", "orc")


def load(spark: SparkSession, path: str, fmt: str | None = None, limit: int | None = None, **csv_opts) -> DataFrame:
    """Load by explicit format or suffix; an unknown suffix is tried as CSV, an unknown format is an error.

    ``limit`` caps rows for quick runs and stays distributed."""
    if fmt and fmt.lower() not in TEXT_FORMATS + FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; one of {', '.join(f for f in TEXT_FORMATS + FORMATS if f)}")
    kind = (fmt or suffix_of(path)).lower()
    df = spark.read.format(kind).load(path) if kind in FORMATS else read_csv(spark, path, **csv_opts)
    return df.limit(int(limit)) if limit else df


@dataclass(frozen=True)
class ScanMeta:
    rows: int
    cols: int
    format: str
    delimiter: str | None
    koi_disposition_present: bool
    columns: tuple[str, ...]


def scan_meta(df: DataFrame, path: str, delimiter: str | None = None) -> ScanMeta:
    """Rows (one count job), columns (schema), format, delimiter, disposition flag.

    ``cols`` counts the loaded columns only (not an added disposition)."""
    kind = suffix_of(path)
    fmt = "parquet" if kind == "parquet" else "csv" if kind in ("csv", "tsv", "txt") else "unknown"
    return ScanMeta(
        rows=df.count(),
        cols=len(df.columns),
        format=fmt,
        delimiter=delimiter if fmt == "csv" else None,
        koi_disposition_present="koi_disposition" in df.columns,
        columns=tuple(df.columns),
    )


def preview_columns(spark: SparkSession, path: str) -> dict:
    """Column names without reading data; Parquet row count from footers."""
    kind = suffix_of(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
        return {"columns": df.columns, "rows": df.count(), "format": "parquet", "path": path}
    df = spark.read.options(**csv_options(delimiter_by_suffix(path))).csv(path)
    return {"columns": df.columns, "rows": None, "format": "csv", "path": path}


def upload_index(spark: SparkSession, index_path: str) -> DataFrame:
    """``{file_id: path}`` JSON map -> (file_id, path), newest id first."""
    text = spark.read.text(index_path, wholetext=True)
    entries = text.select(F.explode(F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))).alias("file_id", "path"))
    return entries.orderBy(F.col("file_id").desc())


def resolve_upload(index: DataFrame, file_id: str) -> DataFrame:
    """The path registered for a file id (index lookup, first match)."""
    return index.where(F.col("file_id") == F.lit(file_id)).limit(1)


def locate_upload(spark: SparkSession, index_path: str, ref: str, upload_dir: str) -> str:
    """The file that ``ref`` means: the path of that id in the index, the path itself, or a file of that name
    (with or without one of the allowed extensions) in the upload folder; the first of these that exists. Where none
    does, the path in the index is returned as it stands, and reading it says what is wrong."""
    candidates, hit = [], None
    if path_exists(spark, index_path):
        hit = resolve_upload(upload_index(spark, index_path), ref).first()
        candidates += [hit["path"]] if hit else []
    name = f"{upload_dir.rstrip('/')}/{ref.rsplit('/', 1)[-1]}"
    candidates += [ref, name, *[f"{name}.{ext}" for ext in ALLOWED_EXTENSIONS]]
    for candidate in candidates:
        if path_exists(spark, candidate):
            return candidate
    if hit:
        return hit["path"]
    raise FileNotFoundError(ref)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its own file system; any other trouble with it is raised."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder (none if it doesn't exist), from the file system's listing; no file is opened."""
    if not path_exists(spark, folder):
        return []
    location = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(x.getPath().getName() for x in location.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(location))


def allowed_file(path_col, allowed: Sequence[str] = ALLOWED_EXTENSIONS):
    """Extension allow-list as a predicate over a path column."""
    ext = F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]+)$", 1))
    return ext.isin(*allowed)


def safe_filename(name_col):
    """Keep ``-_.() A-Za-z0-9`` (fixed value), replace the rest with '_', strip ``._ ``."""
    cleaned = F.regexp_replace(name_col, r"[^-_.() A-Za-z0-9]", "_")
    return F.regexp_replace(cleaned, r"^[._ ]+|[._ ]+$", "")
