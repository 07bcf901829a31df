"""Result browsing: filters, lookup, paging, listings and display (F3-F5,
O4-O6, P10, P14, C17).

All filters are plain predicates, so they reach the Parquet scan as pushed
filters (``object_id = x`` is pruned by row-group min/max statistics).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import display_number, fixed_text


def search_id_regex(df: DataFrame, query: str | None) -> DataFrame:
    """case-insensitive regex match on object_id (the reference's default)."""
    if not query:
        return df
    return df.where(F.col("object_id").cast("string").rlike("(?i)" + query))


def search_id_literal(df: DataFrame, query: str | None) -> DataFrame:
    """case-insensitive substring match (what the docstring promised)."""
    if not query:
        return df
    return df.where(F.lower(F.col("object_id").cast("string")).contains(query.lower()))


def filter_category(df: DataFrame, category: str | None) -> DataFrame:
    """exact category match; ignored when the column is absent."""
    if not category or "category" not in df.columns:
        return df
    return df.where(F.col("category").cast("string") == F.lit(category))


def lookup_object(df: DataFrame, object_id: str | Column, columns: Sequence[str] | None = None) -> DataFrame:
    """The first row whose object_id equals the string, optional projection."""
    key = object_id if isinstance(object_id, Column) else F.lit(str(object_id))
    hit = df.where(F.col("object_id").cast("string") == key)
    cols = [c for c in (columns or []) if c in df.columns]
    if cols:
        hit = hit.select(*cols)
    return hit.orderBy(*[F.col(f"`{c}`") for c in hit.columns]).limit(1)


def page(df: DataFrame, page_no: int, page_size: int, order: Sequence[Column | str]) -> DataFrame:
    """1-based page clamped at 1; size <= 0 means 50. Sort + offset + limit."""
    size = page_size if page_size and page_size > 0 else 50
    start = max(int(page_no) - 1, 0) * size
    return df.orderBy(*order).offset(start).limit(size)


def page_after(
    df: DataFrame, key: str, last: tuple | None, page_size: int = 50, unique_id: str = "object_id"
) -> DataFrame:
    """O4 keyset paging for deep pages: the rows after ``last`` = (key, unique id) of the page before.

    Order is key ascending with NULL keys first, then the unique id, so rows that
    share a key, or have none, are served once each."""
    size = page_size if page_size and page_size > 0 else 50
    k, i = F.col(key), F.col(unique_id)
    rows = df
    if last is not None:
        value, ident = last
        if value is None:
            rows = df.where(k.isNotNull() | (i > F.lit(ident)))
        else:
            rows = df.where((k > F.lit(value)) | ((k == F.lit(value)) & (i > F.lit(ident))))
    return rows.orderBy(k.asc_nulls_first(), i.asc()).limit(size)


def total_rows(df: DataFrame) -> int:
    """A1: row count (answered from Parquet footers when nothing is filtered)."""
    return df.count()


def newest_first(df: DataFrame, key: str, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Descending listing, ties by ``tie`` ascending, optional limit (a top-k)."""
    out = df.orderBy(F.col(key).desc(), *([F.col(tie).asc()] if tie else []))
    return out.limit(limit) if limit else out


def ui_order(df: DataFrame, n: int = 25) -> DataFrame:
    """Object id ascending, first ``n`` rows."""
    return df.orderBy(F.col("object_id").asc()).limit(n)


def display_rows(df: DataFrame) -> DataFrame:
    """The table the results page shows."""
    flags = F.col("flags").cast("string")
    flags_txt = F.when(F.coalesce(flags, F.lit("")) == "", F.lit("—")).otherwise(F.regexp_replace(flags, ";", "; "))
    score = F.col("score").cast("double")
    return df.select(
        F.coalesce(F.col("object_id"), F.lit("—")).alias("object_id"),
        F.coalesce(F.col("koi_disposition"), F.lit("")).alias("koi_disposition"),
        F.coalesce(F.col("category"), F.lit("")).alias("category"),
        F.when(score.isNull(), F.lit("—")).otherwise(fixed_text(score, 2)).alias("score"),
        flags_txt.alias("flags"),
        *[display_number(F.col(c).cast("double")).alias(c) for c in ("koi_period", "koi_prad", "koi_teq", "koi_insol")],
    )
