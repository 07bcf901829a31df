"""Labelling queue: score, rank, merge and apply (F1, F2, F6, F7, J1, J2, J4,
J5, O1-O3, U1-U3, W2, W3, X12-X14, A8, A10).

The queue is a table with explicit ordering columns instead of an ordered
JSON list, so every step is a DataFrame operation:

* ranking is a top-k (``TakeOrderedAndProject``: each task keeps k rows);
* merge is ``unionByName`` + the least of one long per key (hash aggregation,
  which collapses a hot key on the map side) + one sort of the rows kept;
* apply is an append to the label log and a ``left_anti`` view, so there is
  no read-modify-write of the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LabelingConfig
from ..functions.numeric import strip
from ..functions.rules import disposition_category
from ..functions.sampling import hash_bucket
from .ordering import top_k_with_positions, with_positions

#: Set in the rank of a new item, so that it comes after every existing one.
NEW_ITEM = 1 << 62

QUEUE_COLUMNS = ("object_id", "suggested_label", "score_model", "score_labeling", "flags")


def split_flags(c: Column) -> Column:
    """F6/X3: ';'-joined flags -> array without blank tokens (NULL -> [])."""
    parts = F.split(F.coalesce(strip(c.cast("string")), F.lit("")), ";")
    return F.array_remove(parts, "")


def _flags_array(df: DataFrame) -> Column:
    if "flags" not in df.columns:
        return F.array().cast("array<string>")
    dtype = df.schema["flags"].dataType.simpleString()
    if dtype.startswith("array"):
        return F.coalesce(F.col("flags").cast("array<string>"), F.array().cast("array<string>"))
    return split_flags(F.col("flags"))


def category_weight(cat: Column, cfg: LabelingConfig) -> Column:
    """Weight of the trimmed category, 0.0 when not listed."""
    if not cfg.category_weights:
        return F.lit(0.0)
    m = F.create_map(*[x for k, v in cfg.category_weights for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, strip(cat)), F.lit(0.0))


def interesting_count(flags: Column, cfg: LabelingConfig) -> Column:
    """Flags found in the interesting list (duplicates count)."""
    if not cfg.interesting_flags:
        return F.lit(0)
    allowed = F.array(*[F.lit(f) for f in cfg.interesting_flags])
    return F.size(F.filter(flags, lambda f: F.array_contains(allowed, f)))


def _score_model(df: DataFrame) -> Column:
    if "score" not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))


def uncertainty_boost(df: DataFrame, cfg: LabelingConfig) -> Column:
    """clamp(uncertainty, 0, 1) * factor; else (1 - 2|0.5 - score|) * factor.

    A NULL/NaN uncertainty falls back to the score formula (D8)."""
    if not cfg.uncertainty_enabled:
        return F.lit(0.0)
    factor = F.lit(float(cfg.uncertainty_factor))
    from_score = (F.lit(1.0) - F.abs(F.lit(0.5) - _score_model(df)) * F.lit(2.0)) * factor
    if "uncertainty" not in df.columns:
        return from_score
    u = F.col("uncertainty").try_cast("double")
    u = F.when(~F.isnan(u), u)
    return F.when(u.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)) * factor).otherwise(from_score)


def labeling_score(df: DataFrame, cfg: LabelingConfig) -> Column:
    """Category weight + flag weight * interesting flags + boost."""
    cat = F.coalesce(F.col("category").cast("string"), F.lit("")) if "category" in df.columns else F.lit("")
    flags = _flags_array(df)
    return (
        category_weight(cat, cfg)
        + interesting_count(flags, cfg).cast("double") * F.lit(float(cfg.flag_weight))
        + uncertainty_boost(df, cfg)
    )


def exclude_rows(df: DataFrame, cfg: LabelingConfig) -> DataFrame:
    """drop excluded categories and dispositions (null-safe).

    F2 compares the lower-cased raw disposition with the list, as shipped
    (D11); ``normalize_dispositions`` compares the normalised category."""
    out = df
    if cfg.exclude_labels and "category" in df.columns:
        cat = F.coalesce(F.col("category").cast("string"), F.lit(""))
        out = out.where(~cat.isin(*cfg.exclude_labels))
    if cfg.exclude_dispositions:
        raw = F.col("koi_disposition").cast("string") if "koi_disposition" in df.columns else F.lit(None).cast("string")
        if cfg.normalize_dispositions:
            key = F.coalesce(disposition_category(raw), F.lit(""))
        else:
            key = F.lower(F.coalesce(raw, F.lit("")))
        out = out.where(~key.isin(*cfg.exclude_dispositions))
    return out


def queue_items(df: DataFrame, cfg: LabelingConfig) -> DataFrame:
    """One queue item per kept row, plus the ranking key columns."""
    kept = exclude_rows(df, cfg)
    cat = F.coalesce(F.col("category").cast("string"), F.lit("")) if "category" in df.columns else F.lit("")
    label = F.when(cat == "", F.lit("candidate")).otherwise(cat)
    oid = F.col("object_id").cast("string") if "object_id" in df.columns else F.lit(None).cast("string")
    synthetic = F.format_string("OBJ-%016x", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    items = kept.select(
        F.when(F.coalesce(oid, F.lit("")) == "", synthetic).otherwise(oid).alias("object_id"),
        label.alias("suggested_label"),
        _score_model(df).alias("score_model"),
        labeling_score(df, cfg).alias("score_labeling"),
        _flags_array(df).alias("flags"),
    )
    n = len(cfg.priority)
    if n:
        pr = F.array_position(F.array(*[F.lit(p) for p in cfg.priority]), F.col("suggested_label"))
        priority_idx = F.when(pr > 0, pr - 1).otherwise(F.lit(n)).cast("int")
    else:
        priority_idx = F.lit(0)
    return items.withColumn("priority_idx", priority_idx)


def ranking_order(cfg: LabelingConfig) -> list[Column]:
    """O1 as a total order: priority index, strategy key, then object_id.

    The random strategy orders by a hash of the id and the seed, so a shuffle is
    the same on every run and partitioning."""
    if cfg.strategy == "random":
        key = hash_bucket(F.col("object_id"), cfg.seed).asc()
    elif cfg.strategy in ("uncertainty", "low_confidence"):
        key = F.abs(F.lit(0.5) - F.col("score_model")).asc()
    else:
        key = F.col("score_labeling").desc()
    return [F.col("priority_idx").asc(), key, F.col("object_id").asc(), F.col("score_model").asc()]


def build_queue(df: DataFrame, cfg: LabelingConfig | None = None, limit: int | None = None) -> DataFrame:
    """Ranked queue with ``queue_pos``.

    ``limit``: None -> batch size; 0 or negative -> no limit (D14). A limited
    queue is a top-k; an unlimited one is a full range-partitioned sort with
    positions from partition offsets."""
    cfg = cfg or LabelingConfig.load()
    k = cfg.batch_size if limit is None else int(limit)
    items = queue_items(df, cfg)
    order = ranking_order(cfg)
    if k and k > 0:
        out = top_k_with_positions(items, order, k, name="queue_pos")
    else:
        out = with_positions(items, order, name="queue_pos")
    return out.select(*QUEUE_COLUMNS, "queue_pos")


def merge_queues(existing: DataFrame, new_items: DataFrame, dedup_on: str = "object_id") -> DataFrame:
    """Keep existing order, append unseen new items in their order.

    Dedup keeps, per key, the item with the smallest (source, position), packed
    into one long: its minimum is a hash aggregate that Spark combines before the
    shuffle, so a key holding a third of the rows stays one small buffer. The rows
    with that minimum are joined back and sorted once. Both queues need a distinct
    ``queue_pos``; without one, number them first (``build_queue``)."""
    cols = [c for c in existing.columns if c != "queue_pos"]
    both = existing.select(*cols, F.col("queue_pos").cast("long").alias("__rank")).unionByName(
        new_items.select(*cols, F.col("queue_pos").cast("long").bitwiseOR(F.lit(NEW_ITEM)).alias("__rank"))
    )
    keyed = both.withColumn("__key", F.coalesce(F.col(dedup_on).cast("string"), F.lit("")))
    first = keyed.groupBy("__key").agg(F.min("__rank").alias("__rank"))
    kept = keyed.join(first, ["__key", "__rank"]).drop("__key")
    return with_positions(kept, [F.col("__rank")], name="queue_pos").drop("__rank")


def enqueue(queue: DataFrame, items: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Append items that carry an object_id, after the current tail.

    New positions continue from ``max(queue_pos) + 1`` (a single scalar read on
    the driver); the items keep their own ``queue_pos`` order if they carry
    one, else ``order`` (default object_id)."""
    valid = items.where(F.col("object_id").isNotNull())
    start = queue.agg(F.coalesce(F.max("queue_pos") + 1, F.lit(0))).first()[0]
    cols = [c for c in queue.columns if c != "queue_pos"]
    fill = {c: F.lit(None).cast(queue.schema[c].dataType) for c in cols if c not in valid.columns}
    valid = valid.withColumns(fill) if fill else valid
    if "queue_pos" in valid.columns:
        order = [F.col("queue_pos").asc(), F.col("object_id").asc()]
    positioned = with_positions(valid.select(*cols, *(["queue_pos"] if "queue_pos" in valid.columns else [])),
                                order or [F.col("object_id").asc()], name="__qp", start=int(start))
    appended = positioned.select(*[F.col(c) for c in cols], F.col("__qp").alias("queue_pos"))
    return queue.unionByName(appended)


def apply_labels(queue: DataFrame, label_log: DataFrame) -> DataFrame:
    """The queue without objects that have a label.

    The label ids are deduplicated first (partial aggregation), so a hot id
    cannot skew the anti join; AQE picks broadcast when the log is small."""
    labelled = label_log.where(F.col("object_id").isNotNull()).select("object_id").distinct()
    return queue.join(labelled, "object_id", "left_anti")


LABEL_EVENT = "object_id string, label string, notes string, labeled_at timestamp, seq long"


def label_events(rows: DataFrame, seq_col: str | None = None, after: int = -1) -> DataFrame:
    """Label events (object_id, label, notes, labeled_at, seq) from any rows.

    ``seq`` is the caller's column, or it counts up from ``after`` + 1, where
    ``after`` is the greatest number in the log so far: in the order of the label
    time, then of all other columns, so a later append always has greater numbers."""
    present = {f.name: f.dataType for f in rows.schema.fields}

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)

    events = rows.where(F.col("object_id").isNotNull() & F.col("label").isNotNull()).select(
        column("object_id", "string"), column("label", "string"), column("notes", "string"),
        column("labeled_at", "timestamp"), *([F.col(seq_col).cast("long").alias("seq")] if seq_col else []),
    )
    if seq_col:
        return events
    order = [F.col(c).asc_nulls_first() for c in ("labeled_at", "object_id", "label", "notes")]
    return with_positions(events, order, name="seq", start=after + 1)
