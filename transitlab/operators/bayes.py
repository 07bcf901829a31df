"""Gaussian naive Bayes from grouped moments (G9): a baseline without iteration.

One aggregation over the training rows gives the number, means and variances of
each class; the model is a row a class. A prediction is one projection: the class
with the greatest log-probability of the features that are present.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share of the greatest variance of all features that is added to each variance.
SMOOTHING = 1e-9
#: Classes that a model may have: each is part of the expression that predicts.
MOST_CLASSES = 200


@dataclass
class GaussianModel:
    """Prior, means and variances by class; a feature that no row of a class has is None there."""

    features: tuple[str, ...]
    classes: dict[str, dict]
    rows: int

    def log_probability(self, name: str) -> Column:
        """log of prior times densities, up to what all classes share; absent and non-finite features are left out."""
        own = self.classes[name]
        total = F.lit(math.log(own["n"] / self.rows))
        for f in self.features:
            mean, variance = own[f]
            if mean is None:
                continue
            x = F.col(f).cast("double")
            d = x - F.lit(mean)
            term = F.lit(-0.5) * (F.lit(math.log(2.0 * math.pi * variance)) + d * d / F.lit(variance))
            present = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
            total = total + F.when(present, term).otherwise(0.0)
        return total

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; equal probabilities go to the class that sorts last. No classes: NULL."""
        if not self.classes:
            return df.withColumn("prediction", F.lit(None).cast("string"))
        scored = [F.struct(self.log_probability(c).alias("p"), F.lit(c).alias("c")) for c in sorted(self.classes)]
        best = F.array_max(F.array(*scored))
        return df.withColumn("prediction", best["c"])


def _pooled(found: list, f: str) -> float | None:
    """The variance of a feature over all classes, from the moments of each; None if no row has it."""
    own = [(r[f"n_{f}"], r[f"mean_{f}"], r[f"var_{f}"]) for r in found if r[f"n_{f}"]]
    if not own:
        return None
    n = sum(k for k, _, _ in own)
    mean = sum(k * m for k, m, _ in own) / n
    return sum(k * (v + (m - mean) ** 2) for k, m, v in own) / n


def fit_gaussian(df: DataFrame, features: Sequence[str], label_col: str = "label") -> GaussianModel:
    """Learns from the rows that have a label: a hash aggregation with one row a class.

    Means and variances are those of the finite values that a class has. Each variance
    is raised by ``SMOOTHING`` of the greatest variance of any feature over all rows."""
    clean = [
        F.when(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f)) != F.lit(float("inf"))), F.col(f).cast("double")).alias(f)
        for f in features
    ]
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), *clean)
    moments = [a for f in features for a in (F.avg(f).alias(f"mean_{f}"), F.var_pop(f).alias(f"var_{f}"), F.count(f).alias(f"n_{f}"))]
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *moments).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes in {label_col!r}")
    extra = SMOOTHING * max([v for f in features if (v := _pooled(found, f))] or [1.0])
    classes = {
        r["label"]: {"n": r["n"]} | {f: (r[f"mean_{f}"], None if r[f"var_{f}"] is None else r[f"var_{f}"] + extra) for f in features}
        for r in found
    }
    return GaussianModel(tuple(features), classes, sum(c["n"] for c in classes.values()))
