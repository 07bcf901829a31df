"""Distributed column statistics for the feature fit.

Spark's exact ``median`` keeps a value->count map of the whole column in one
final task, which does not survive a 100 TB column. ``exact_medians`` instead
narrows the rank window with pivots:

1. one aggregate: non-null count and pivots around the target rank, for every
   column at once: from a KLL sketch of the whole column at first, from
   ``percentile_approx`` inside a bracket, where few values are left;
2. one aggregate: for each pivot, how many values lie below / at it;
3. either a pivot is the value at the target rank, or the bracket between two
   pivots holds it; repeat inside the bracket. The sketch is exact once the
   bracket holds fewer values than its accuracy, so the search ends with a pivot
   at the rank; a bracket that doesn't halve is asked again with a finer sketch.

Every pass is a scan with map-side partial aggregation; the driver only sees
pivots and counts. The result is exact (pandas ``median``: mean of the two
middle values), at any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import with_positions

INF = float("inf")

#: The least and the greatest size that Spark gives a KLL sketch.
KLL_SIZES = (8, 65535)


@dataclass
class _Target:
    col: str
    rank: int  # 0-based rank inside the open bracket (lo, hi)
    lo: float = -INF
    hi: float = INF
    size: int = 0  # number of values strictly inside the bracket
    value: float | None = None


def _inside(c: Column, lo: float, hi: float) -> Column:
    cond = c.isNotNull()
    if lo != -INF:
        cond = cond & (c > F.lit(lo))
    if hi != INF:
        cond = cond & (c < F.lit(hi))
    return cond


def exact_quantile_values(
    df: DataFrame,
    targets: Sequence[tuple[str, int]],
    sizes: dict[str, int] | None = None,
    accuracy: int = 10000,
    first_pivots: dict[str, list[float]] | None = None,
) -> dict[tuple[str, int], float]:
    """Exact value at 0-based rank r of each (column, r); NaN-free double columns.

    ``sizes`` (non-null count per column) saves the counting pass;
    ``first_pivots`` (pivots per column over the whole column) saves the
    first percentile pass."""
    todo = [_Target(c, r) for c, r in targets]
    if not todo:
        return {}
    # Initial bracket is the whole non-null column.
    if sizes is None:
        cols = sorted({c for c, _ in targets})
        row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
        sizes = {c: int(row[c]) for c in cols}
    for t in todo:
        t.size = int(sizes[t.col])

    first = first_pivots
    while open_ := [t for t in todo if t.value is None and t.size > 0]:
        # Pass 1: pivots inside each bracket around the target rank.
        if first is not None:
            pivots = [sorted(set(first.get(t.col) or [])) for t in open_]
            first = None
        else:
            aggs = []
            for i, t in enumerate(open_):
                q = (t.rank + 0.5) / t.size
                inside = F.when(_inside(F.col(t.col), t.lo, t.hi), F.col(t.col))
                aggs.append(F.percentile_approx(inside, _probs_around(q, accuracy), accuracy).alias(f"p{i}"))
            prow = df.agg(*aggs).first()
            pivots = [sorted(set(prow[f"p{i}"] or [])) for i in range(len(open_))]
        # Pass 2: exact counts below / at each pivot, inside each bracket.
        caggs = []
        for i, t in enumerate(open_):
            c = F.col(t.col)
            ins = _inside(c, t.lo, t.hi)
            for j, p in enumerate(pivots[i]):
                caggs.append(F.count(F.when(ins & (c < F.lit(p)), 1)).alias(f"lt{i}_{j}"))
                caggs.append(F.count(F.when(ins & (c <= F.lit(p)), 1)).alias(f"le{i}_{j}"))
        crow = df.agg(*caggs).first() if caggs else None
        stuck = False
        for i, t in enumerate(open_):
            new_lo, new_hi, below = t.lo, t.hi, 0
            hi_lt = t.size
            for j, p in enumerate(pivots[i]):
                lt, le = int(crow[f"lt{i}_{j}"]), int(crow[f"le{i}_{j}"])
                if lt <= t.rank < le:
                    t.value = float(p)
                    break
                if le <= t.rank:
                    new_lo, below = float(p), le
                elif lt > t.rank and float(p) < new_hi:
                    new_hi, hi_lt = float(p), lt
            if t.value is None:
                stuck |= 2 * (hi_lt - below) > t.size
                t.lo, t.hi = new_lo, new_hi
                t.rank -= below
                t.size = hi_lt - below
        if stuck:
            accuracy *= 4
    return {(t.col, r): t.value for t, (_, r) in zip(todo, targets)}


def _probs_around(q: float, accuracy: int) -> list[float]:
    spread = 4.0 / accuracy
    return sorted({min(max(q + d * spread, 0.0), 1.0) for d in (-2, -1, 0, 1, 2)})


def exact_medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10000, **kw) -> dict[str, float | None]:
    """A2: exact median per column (NULLs ignored); None for an all-NULL column.

    The first pass returns both the counts and pivots around the middle (the
    two middle ranks sit within 1/n of 0.5, far inside the pivot spread). Its
    sketch takes every value, in about a third of the time of ``percentile_approx``;
    its error decides how many passes follow, never the result."""
    if not cols:
        return {}
    probs = F.array(*map(F.lit, _probs_around(0.5, accuracy)))
    k = F.lit(min(max(accuracy, KLL_SIZES[0]), KLL_SIZES[1]))
    sketched = df.agg(
        *[F.count(F.col(c)).alias(c) for c in cols],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"__s_{i}") for i, c in enumerate(cols)],
    )
    sketches = [F.col(f"__s_{i}") for i in range(len(cols))]
    counts = sketched.select(
        *[F.col(f"`{c}`") for c in cols],
        *[F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, probs)).alias(f"__p_{i}") for i, s in enumerate(sketches)],
    ).first()
    first = {c: list(counts[f"__p_{i}"] or []) for i, c in enumerate(cols)}
    targets: list[tuple[str, int]] = []
    for c in cols:
        n = int(counts[c])
        if n:
            targets += [(c, (n - 1) // 2), (c, n // 2)]
    vals = exact_quantile_values(df, sorted(set(targets)), sizes={c: int(counts[c]) for c in cols},
                                 accuracy=accuracy, first_pivots=first, **kw)
    out: dict[str, float | None] = {}
    for c in cols:
        n = int(counts[c])
        if not n:
            out[c] = None
            continue
        a, b = vals[(c, (n - 1) // 2)], vals[(c, n // 2)]
        out[c] = a if a == b else (a + b) / 2.0
    return out


def approx_medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10000) -> dict[str, float | None]:
    """D12 option: one pass of ``percentile_approx`` (bounded sketch per task)."""
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(F.col(c), 0.5, accuracy).alias(c) for c in cols]).first()
    return {c: (None if row[c] is None else float(row[c])) for c in cols}


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """A5: most frequent non-null value, smallest on ties.

    ``groupBy(value).count()`` combines on the map side; only the winning
    row per column reaches the driver (a top-1)."""
    out: dict[str, str | None] = {}
    for c in cols:
        row = (
            df.where(F.col(c).isNotNull())
            .groupBy(F.col(c).cast("string").alias("v"))
            .count()
            .orderBy(F.col("count").desc(), F.col("v").asc())
            .limit(1)
            .first()
        )
        out[c] = None if row is None else row["v"]
    return out


def distinct_values(df: DataFrame, col: Column | str) -> DataFrame:
    """(v) the sorted distinct non-null values, as a table of any size."""
    c = F.col(col) if isinstance(col, str) else col
    return df.where(c.isNotNull()).select(c.cast("string").alias("v")).distinct().orderBy("v")


def category_vocabulary(df: DataFrame, col: str) -> DataFrame:
    """(v, index): each distinct non-null value with its place in sorted order, at any cardinality."""
    return with_positions(distinct_values(df, col), [F.col("v")], name="index")
