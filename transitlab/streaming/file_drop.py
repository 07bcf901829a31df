"""Files dropped into a folder are processed exactly once each.

Structured Streaming file source with a declared schema (all text, as the
batch CSV reader) -> the same normalise / enrich / classify expressions ->
a Parquet (or any file) sink. All stages are row-local and stateless, so the
stream keeps no state beyond the file log; the checkpoint in the shared
folder makes a restarted query skip files it already committed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import NUMERIC_INPUTS, OBJECT_ID_FALLBACKS, Thresholds
from ..functions.numeric import null_tokens_to_null
from ..operators.classify import classify
from ..operators.enrich import enrich
from ..operators.schema import normalize_columns, resolve_mapping
from ..sources.readers import csv_options


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _parsed_later(columns: Sequence[str]) -> set[str]:
    """The columns that ``enrich`` parses as numbers, whose null tokens it knows; none if ids are made of all cells."""
    mapping = resolve_mapping(columns)
    names = {m.mapped_to for m in mapping if m.status in ("ok", "alias")} | set(columns)
    if names.isdisjoint({"object_id", *OBJECT_ID_FALLBACKS}):
        return set()
    return {m.detected for m in mapping if m.status in ("ok", "alias") and m.mapped_to in NUMERIC_INPUTS}


def classified_stream(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    sep: str = ",",
    albedo: float = 0.3,
    thresholds: Thresholds | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Streaming DataFrame of classified rows for CSV files landing in ``folder``."""
    reader = spark.readStream.schema(text_schema(columns)).options(**csv_options(sep))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.csv(folder)
    typed = _parsed_later(raw.columns)
    raw = raw.select(*[F.col(f"`{c}`") if c in typed else null_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    # Hash ids: a streaming plan cannot run the two-pass ordinal id job.
    normalized, _ = normalize_columns(raw, synthetic_ids="hash")
    return classify(enrich(normalized, albedo=albedo), thresholds)


def run_available_now(stream: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process everything available now, then stop; re-running skips old files."""
    q = (
        stream.writeStream.format(fmt)
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q
