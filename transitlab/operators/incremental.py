"""Incremental feature fit (E9, A2-A6): each run leaves a mergeable summary, and the fit reads summaries alone.

A run's summary is a table under ``<store>/<kind>/run=<id>``, written over if the
run is summarised again:

* ``values``: how often each value of each numeric feature occurs (NULLs too). Such
  counts add up, and the exact median follows from their running sums. Their size
  is that of the features' distinct values, which for measured quantities may come
  near the number of rows; ``exact=False`` keeps a quantile sketch instead.
* ``sketches``: a KLL sketch of each feature's values (only with ``exact=False``).
* ``moments``: rows, NULLs, finite values, their mean and sum of squared differences.
* ``categories``: how often each category occurs.

Means and squared differences of runs are put together by the rule for two samples,
and filling NULLs afterwards is one more sample of equal values, so standardising
needs no second pass over the data.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FeatureSpec
from ..functions.numeric import as_double
from ..session import cut_lineage
from ..sources.readers import path_exists
from .features import UNK, FeatureModel, _is_finite_col, numeric_features


def _categories(spec: FeatureSpec) -> list[dict]:
    return [
        {"name": c["name"], "encoding": (c.get("encoding") or "onehot").lower(), "impute": (c.get("impute") or "most_frequent").lower()}
        for c in spec.categorical
        if c.get("name")
    ]


def _typed(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The numeric features as doubles and the categories as text; those that the table lacks are NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in numeric_features(spec):
        known = as_double(F.col(f["name"]), types[f["name"]]) if f["name"] in types else F.lit(None).cast("double")
        columns.append(known.alias(f["name"]))
    for c in _categories(spec):
        columns.append((F.col(c["name"]).cast("string") if c["name"] in types else F.lit(None).cast("string")).alias(c["name"]))
    return df.select(*columns)


def _long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, value): a row for each feature of each row."""
    return df.unpivot([], [F.col(f"`{n}`") for n in names], "feature", "value")


def summarise(df: DataFrame, store: str, run: str, spec: FeatureSpec | None = None, exact: bool = True) -> None:
    """Writes the summary of one run's rows; a summary of that name is overwritten."""
    spec, base = spec or FeatureSpec.load(), store.rstrip("/")
    narrow = _typed(df, spec)
    numeric = [f["name"] for f in numeric_features(spec)]
    cats = [c["name"] for c in _categories(spec)]
    if cats:
        counted = _long(narrow, cats).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{base}/categories/run={run}")
    if not numeric:
        return
    if exact:
        path = f"{base}/values/run={run}"
        _long(narrow, numeric).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        rows = df.sparkSession.read.parquet(path)
    else:
        rows = _long(narrow, numeric).withColumn("n", F.lit(1))
        sketch = F.kll_sketch_agg_double("value").alias("sketch")
        rows.groupBy("feature").agg(sketch).write.mode("overwrite").parquet(f"{base}/sketches/run={run}")
    _moments(rows).write.mode("overwrite").parquet(f"{base}/moments/run={run}")


def _moments(rows: DataFrame) -> DataFrame:
    """(feature, rows, nulls, n, mean, m2) of counted values: n, mean and m2 are those of the finite ones."""
    finite = _is_finite_col(F.col("value"))
    # differences are taken from a value near the mean, so that squares don't swamp them
    centre = rows.where(finite).groupBy("feature").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("centre"))
    d = F.when(finite, F.col("value") - F.col("centre"))
    n = F.sum(F.when(finite, F.col("n")).otherwise(0))
    sums = rows.join(F.broadcast(centre), "feature", "left").groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        n.alias("n"),
        F.first("centre").alias("centre"),
        F.sum(d * F.col("n")).alias("d1"),
        F.sum(d * d * F.col("n")).alias("d2"),
    )
    return sums.select(
        "feature", "rows", "nulls", "n",
        (F.col("centre") + F.col("d1") / F.col("n")).alias("mean"),
        (F.col("d2") - F.col("d1") * F.col("d1") / F.col("n")).alias("m2"),
    )


def _read(spark: SparkSession, store: str, kind: str, runs: Sequence[str] | None) -> DataFrame | None:
    """The summaries of one kind; ``run`` is a partition, so runs that aren't asked for aren't read."""
    path = f"{store.rstrip('/')}/{kind}"
    if not path_exists(spark, path):
        return None
    rows = spark.read.option("basePath", path).parquet(path).withColumn("run", F.col("run").cast("string"))
    return rows.where(F.col("run").isin(*runs)) if runs is not None else rows


def merged_moments(moments: DataFrame) -> dict[str, dict]:
    """The moments of all runs together, by feature: one row each comes to the driver."""
    total = moments.groupBy("feature").agg((F.sum(F.col("mean") * F.col("n")) / F.sum(F.when(F.col("n") > 0, F.col("n")))).alias("all"))
    apart = F.col("mean") - F.col("all")
    merged = moments.join(total, "feature").groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n"), F.first("all").alias("mean"),
        F.sum(F.when(F.col("n") > 0, F.col("m2") + F.col("n") * apart * apart)).alias("m2"),
    )
    return {r["feature"]: r.asDict() for r in merged.collect()}


def counted_medians(values: DataFrame) -> dict[str, float | None]:
    """A2: the exact median of each feature from counted values (feature, value, n), NULLs left out.

    Values are sorted by range over all tasks and stored; each task's running sums
    start at the sum of the tasks before it, from a table with one row a task and
    feature. Two values a feature come to the driver."""
    sums = values.where("value is not null").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    stored = cut_lineage(
        sums.repartitionByRange("feature", "value")
        .sortWithinPartitions("feature", "value")
        .withColumn("part", F.spark_partition_id())
    )
    per_part = stored.groupBy("part", "feature").agg(F.sum("n").alias("own"))
    whole = Window.partitionBy("feature")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.withColumns(
        {"start": F.coalesce(F.sum("own").over(earlier), F.lit(0)), "total": F.sum("own").over(whole)}
    ).drop("own")
    running = Window.partitionBy("part", "feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored.withColumn("upto", F.sum("n").over(running)).join(starts, ["part", "feature"])
    last = F.col("start") + F.col("upto")

    def holds(rank: Column) -> Column:
        return (last - F.col("n") <= rank) & (rank < last)

    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = placed.groupBy("feature").agg(
        F.max(F.when(holds(low), F.col("value"))).alias("low"), F.max(F.when(holds(high), F.col("value"))).alias("high")
    )
    return {r["feature"]: r["low"] if r["low"] == r["high"] else (r["low"] + r["high"]) / 2.0 for r in middle.collect()}


def sketched_medians(sketches: DataFrame) -> dict[str, float | None]:
    """A2 by sketches: a value whose rank is near the middle (KLL, about 1.65 % of the rows for the default size)."""
    merged = sketches.groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    found = merged.select("feature", F.kll_sketch_get_n_double("sketch").alias("n"), "sketch").where("n > 0")
    rows = found.select("feature", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median")).collect()
    return {r["feature"]: r["median"] for r in rows}


def _fill(f: dict, moments: dict | None, medians: dict) -> float | None:
    finite = lambda x: x if x is not None and math.isfinite(x) else 0.0
    if f["impute"] in ("zero", "constant"):
        return 0.0
    if f["impute"] == "mean":  # infinite values make the mean infinite, and the fill 0
        whole = moments and moments["rows"] - moments["nulls"] == moments["n"]
        return finite(moments["mean"] if whole else None)
    return finite(medians.get(f["name"])) if f["impute"] == "median" else medians.get(f["name"])


def fit_from_summaries(
    spark: SparkSession, store: str, spec: FeatureSpec | None = None, runs: Sequence[str] | None = None, id_col: str | None = "object_id"
) -> FeatureModel:
    """E1-E8 over all summarised runs (or those named): the model that ``fit`` learns from all their rows.

    Only summaries are read. Without any, every fill is 0 or UNK and no category is known."""
    spec = spec or FeatureSpec.load()
    values, sketches = _read(spark, store, "values", runs), _read(spark, store, "sketches", runs)
    medians = counted_medians(values) if values is not None else sketched_medians(sketches) if sketches is not None else {}
    rows = _read(spark, store, "moments", runs)
    moments = merged_moments(rows) if rows is not None else {}
    model = FeatureModel(spec=spec, id_col=id_col)
    for f in numeric_features(spec):
        own = moments.get(f["name"])
        f["fill"] = _fill(f, own, medians)
        if f["transform"] == "standardize":
            f["mean"], f["sd"] = _filled_moments(own, f["fill"])
        model.numeric.append(f)
    counts = _read(spark, store, "categories", runs)
    for c in _categories(spec):
        own = counts.where(F.col("feature") == c["name"]) if counts is not None else None
        sums = own.where("value is not null").groupBy("value").agg(F.sum("n").alias("n")) if own is not None else None
        top = sums.orderBy(F.desc("n"), "value").first() if sums is not None and c["impute"] == "most_frequent" else None
        c["fill"] = top["value"] if top else UNK
        if c["encoding"] == "onehot":  # a column for each value: the list is part of the schema
            known = {r["value"] for r in sums.select("value").collect()} if sums is not None else set()
            nulls = own is not None and not own.where("value is null").isEmpty()
            c["values"] = sorted(known | ({c["fill"]} if nulls else set()))
        model.categorical.append(c)
    return model


def _filled_moments(own: dict | None, fill: float | None) -> tuple[float, float]:
    """Mean and sample deviation after NULLs are filled: the finite values and one more sample, of equal values."""
    n, mean, m2 = (own["n"], own["mean"] or 0.0, own["m2"] or 0.0) if own else (0, 0.0, 0.0)
    filled = own["nulls"] if own and fill is not None and math.isfinite(fill) else 0
    total = n + filled
    if not total:
        return float("nan"), 1.0
    whole = (n * mean + filled * (fill or 0.0)) / total
    m2 += n * (mean - whole) ** 2 + filled * ((fill or 0.0) - whole) ** 2
    sd = math.sqrt(m2 / (total - 1)) if total > 1 else 0.0
    return whole, sd if sd and math.isfinite(sd) else 1.0
