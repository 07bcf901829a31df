"""Rule classification of an enriched candidate table.

Row-local: the result is a projection of the input, so the plan is
scan -> project with no exchange, and the row count is preserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.numeric import as_double
from ..functions.rules import STAGE_COLUMNS, RuleInputs, compare_columns, condition_columns, result_columns

ECHO_COLUMNS = ("object_id", "koi_period", "koi_prad", "koi_teq", "koi_insol")
RESULT_COLUMNS = (
    "koi_disposition",
    "category",
    "score",
    "flags",
    "disposition_compare",
    "is_disposition_match",
    "color_hint",
)


def rule_inputs(df: DataFrame) -> RuleInputs:
    types = {f.name: f.dataType for f in df.schema.fields}

    def num(name: str):
        return as_double(F.col(name), types[name]) if name in types else F.lit(None).cast("double")

    disp = F.col("koi_disposition").cast("string") if "koi_disposition" in types else F.lit(None).cast("string")
    return RuleInputs(
        period=num("koi_period"),
        prad=num("koi_prad"),
        teq=num("koi_teq"),
        insol=num("koi_insol"),
        depth=num("transit_depth"),
        ratio=num("duration_ratio"),
        disposition=disp,
    )


def with_classification(df: DataFrame, thresholds: Thresholds | None = None, flags_as_array: bool = False) -> DataFrame:
    """Append category, score, flags and the comparison columns to every row.

    Two stacked projections: named predicate columns, then the CASE
    expressions over them, so each predicate is evaluated once per row."""
    th = thresholds or Thresholds()
    if "object_id" not in df.columns:
        df = df.withColumn(
            "object_id", F.format_string("OBJ-%016x", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        )
    if "koi_disposition" not in df.columns:
        df = df.withColumn("koi_disposition", F.lit(None).cast("string"))
    staged = df.withColumns(condition_columns(rule_inputs(df), th))
    res = result_columns()
    flags = res["flags"] if flags_as_array else res["flags_text"]
    out = staged.withColumns({"category": res["category"], "score": res["score"], "flags": flags})
    out = out.withColumns(compare_columns(F.col("koi_disposition"), F.col("category")))
    return out.drop(*STAGE_COLUMNS)


def classify(df: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Echo columns that exist, then the seven result columns (fixed order)."""
    out = with_classification(df, thresholds)
    keep = [c for c in ECHO_COLUMNS if c in df.columns or c == "object_id"]
    return out.select(*keep, *RESULT_COLUMNS)
