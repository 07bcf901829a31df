"""Metric enrichment (M1-M9): one narrow projection, no shuffle.

Known numeric inputs are typed to NaN-free doubles (D17), the three derivable
columns are filled only where missing and in dependency order (the derived
semi-major axis feeds Teq, insolation and the expected duration), then depth,
expected duration, ratio and soft flags are appended.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_ALBEDO, NUMERIC_INPUTS
from ..functions import metrics as M
from ..functions.numeric import as_double


DERIVED = ("koi_sma", "koi_teq", "koi_insol", "transit_depth", "expected_duration_hours", "duration_ratio", "soft_flags")


def typed_inputs(df: DataFrame) -> dict[str, Column]:
    """Double Column per known numeric input (typed NULL when absent)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {
        c: (as_double(F.col(c), types[c]) if c in types else F.lit(None).cast("double"))
        for c in NUMERIC_INPUTS
    }


def enrich(
    df: DataFrame,
    albedo: float = DEFAULT_ALBEDO,
    auto_derive: bool = True,
    rsun_in_au: float | None = None,
    outputs: Sequence[str] | None = None,
) -> DataFrame:
    """M7: the input with typed inputs, filled sma/teq/insol and derived columns.

    ``outputs`` names the columns the caller will read: only these leave, and only
    the formulas (and input columns) they need are built. None means all.

    Three stacked projections, each referring to the previous one by column
    name: (1) typed inputs and the filled semi-major axis, (2) everything that
    depends on it, (3) the duration ratio. Catalyst only collapses a project
    into its consumer when that does not repeat a non-trivial expression, so
    ``a`` and the expected duration are evaluated once per row, and the
    generated code stays small."""
    M.albedo_factor(albedo)  # validate the parameter (D5) even without derivation
    x = typed_inputs(df)
    typed = {c: x[c] for c in NUMERIC_INPUTS if c in df.columns}
    # From here on the inputs are doubles: they are referred to by name, never parsed a second time.
    x = {c: F.col(c) if c in typed else x[c] for c in NUMERIC_INPUTS}
    a = x["koi_sma"]
    if auto_derive:
        a = F.coalesce(a, M.semi_major_axis(x["koi_period"], x["koi_smass"]))
    stage1 = df.withColumns(typed).withColumns({f"__{c}": x[c] for c in NUMERIC_INPUTS}).withColumn("koi_sma", a)

    c = {n: F.col(f"__{n}") for n in NUMERIC_INPUTS}
    a_col = F.col("koi_sma")
    teq, insol = c["koi_teq"], c["koi_insol"]
    if auto_derive:
        teq = F.coalesce(teq, M.equilibrium_temp(c["koi_steff"], c["koi_srad"], a_col, albedo, rsun_in_au))
        insol = F.coalesce(insol, M.insolation(c["koi_steff"], c["koi_srad"], a_col))
    stage2 = stage1.withColumns(
        {
            "koi_teq": teq,
            "koi_insol": insol,
            "transit_depth": M.transit_depth(c["koi_prad"], c["koi_srad"]),
            "expected_duration_hours": M.expected_duration_hours(
                c["koi_period"], c["koi_srad"], a_col, c["koi_impact"], rsun_in_au
            ),
            "soft_flags": M.soft_flags(c["koi_prad"], c["koi_srad"], c["koi_period"], c["koi_steff"]),
        }
    )
    stage3 = stage2.withColumn(
        "duration_ratio", M.duration_ratio(F.col("__koi_duration"), F.col("expected_duration_hours"))
    )
    # Optimizer fence: the derived metrics leave through a one-element
    # ``inline`` Generate. A later filter on a classifier output is pushed down
    # only to here and refers to these columns as attributes; without it,
    # Catalyst pastes the whole formula tree into every pushed predicate and
    # the generated filter method outgrows the JVM's 64 KB limit.
    ordered = list(df.columns) + [n for n in DERIVED if n not in df.columns]
    if outputs is not None:
        ordered = [n for n in ordered if n in set(outputs)]
    passthrough = [n for n in ordered if n not in DERIVED]
    derived = [n for n in DERIVED if n in ordered]
    if not derived:
        return stage3.select(*[F.col(f"`{n}`") for n in ordered])
    fenced = stage3.select(*[F.col(f"`{n}`") for n in passthrough], F.inline(F.array(F.struct(*derived))))
    return fenced.select(*[F.col(f"`{n}`") for n in ordered])
