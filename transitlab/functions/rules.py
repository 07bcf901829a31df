"""The rule classifier (C0-C17) as Column expressions.

The reference walks each row through an ordered list of early returns. Here
the same decision is a closed form over a few boolean columns:

  gate (no prad, period, teq, insol)  -> no_result 0.0 [FLAG_NO_FEATURES]
  disposition CONFIRMED               -> confirmed_planet 0.95 []
  disposition FALSE POSITIVE          -> likely_false_positive 0.9 []
  any strong anomaly                  -> anomalous_signal min(0.6+0.1h, 0.9)
  radius class (rocky/super/hot jup.) -> that class, max(habitable score, class score)
  habitable (teq or insol band)       -> habitable_zone_candidate 0.55 / 0.7
  otherwise                           -> candidate 0.5

Everything is a CASE over literals, so Catalyst folds the thresholds; the
classifier is two stacked projections (named predicates, then the CASEs) with
no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COLD_DEEP_DEPTH, Thresholds
from .numeric import strip

# Category names, flag names and scores of the rule classifier.
NO_RESULT = "no_result"
CONFIRMED = "confirmed_planet"
FALSE_POSITIVE = "likely_false_positive"
ANOMALOUS = "anomalous_signal"
HABITABLE = "habitable_zone_candidate"
ROCKY = "rocky_candidate"
SUPER_EARTH = "super_earth_or_mini_neptune"
HOT_JUPITER = "hot_jupiter_candidate"
CANDIDATE = "candidate"
CATEGORIES = (NO_RESULT, CONFIRMED, FALSE_POSITIVE, ANOMALOUS, HABITABLE, ROCKY, SUPER_EARTH, HOT_JUPITER, CANDIDATE)

FLAG_NO_FEATURES = "FLAG_NO_FEATURES"
FLAG_RADIUS_TOO_LARGE = "FLAG_RADIUS_TOO_LARGE"
FLAG_ANOMALOUS_DEPTH = "FLAG_ANOMALOUS_DEPTH"
FLAG_DURATION_TOO_SHORT = "FLAG_DURATION_TOO_SHORT"
FLAG_DURATION_TOO_LONG = "FLAG_DURATION_TOO_LONG"
FLAG_COLD_DEEP_TRANSIT = "FLAG_COLD_DEEP_TRANSIT"
FLAG_MISSING_PRAD = "FLAG_MISSING_PRAD"
FLAG_MISSING_PERIOD = "FLAG_MISSING_PERIOD"
FLAG_MISSING_TEQ = "FLAG_MISSING_TEQ"

SCORE_CONFIRMED = 0.95
SCORE_FALSE_POSITIVE = 0.9
SCORE_HABITABLE = 0.55
SCORE_HABITABLE_BOTH = 0.7
SCORE_ROCKY = 0.6
SCORE_SUPER_EARTH = 0.55
SCORE_HOT_JUPITER = 0.65
SCORE_CANDIDATE = 0.5


@dataclass(frozen=True)
class RuleInputs:
    """NaN-free double columns the rules read, plus the raw disposition."""

    period: Column
    prad: Column
    teq: Column
    insol: Column
    depth: Column
    ratio: Column
    disposition: Column


def disposition_key(raw: Column) -> Column:
    """The disposition in upper case without white space around it; NULL stays NULL."""
    return F.upper(strip(raw))


def anomaly_conditions(x: RuleInputs, th: Thresholds) -> dict[str, Column]:
    """C3-C6 as null-safe booleans (a NULL input never fires a flag)."""
    return {
        FLAG_RADIUS_TOO_LARGE: F.coalesce(x.prad > th.max_radius, F.lit(False)),
        FLAG_ANOMALOUS_DEPTH: F.coalesce(x.depth > th.max_depth, F.lit(False)),
        FLAG_DURATION_TOO_SHORT: F.coalesce(x.ratio < th.duration_ratio_low, F.lit(False)),
        FLAG_DURATION_TOO_LONG: F.coalesce(x.ratio > th.duration_ratio_high, F.lit(False)),
        FLAG_COLD_DEEP_TRANSIT: F.coalesce((x.teq < th.teq_low) & (x.depth > COLD_DEEP_DEPTH), F.lit(False)),
    }


def strong_hits(cond: dict[str, Column]) -> Column:
    """Number of strong anomaly flags (radius, depth, cold-deep)."""
    return (
        cond[FLAG_RADIUS_TOO_LARGE].cast("int")
        + cond[FLAG_ANOMALOUS_DEPTH].cast("int")
        + cond[FLAG_COLD_DEEP_TRANSIT].cast("int")
    )


def disposition_category(raw: Column) -> Column:
    """CONFIRMED / CANDIDATE / FALSE POSITIVE -> category name, else NULL."""
    d = disposition_key(raw)
    return (
        F.when(d == "CONFIRMED", F.lit(CONFIRMED))
        .when(d == "CANDIDATE", F.lit(CANDIDATE))
        .when(d == "FALSE POSITIVE", F.lit(FALSE_POSITIVE))
    )


def compare_columns(raw_disposition: Column, category: Column) -> dict[str, Column]:
    """Missing / match / mismatch with the boolean and the colour."""
    missing = raw_disposition.isNull() | (strip(raw_disposition) == "")
    match = F.coalesce(disposition_category(raw_disposition) == category, F.lit(False))
    return {
        "disposition_compare": F.when(missing, "missing").when(match, "match").otherwise("mismatch"),
        "is_disposition_match": F.when(missing, F.lit(None).cast("boolean")).otherwise(match),
        "color_hint": F.when(missing, "green").when(match, "black").otherwise("red"),
    }


def _norm_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"\s+", "_")


def color_hint_fallback(color_hint: Column, raw_disposition: Column, category: Column) -> Column:
    """C17: keep a valid colour; else compare normalised disposition and category."""
    c = F.lower(color_hint)
    disp = F.coalesce(_norm_label(raw_disposition), F.lit(""))
    cat = F.coalesce(_norm_label(category), F.lit(""))
    derived = F.when(disp == "", "green").when(disp == cat, "black").otherwise("red")
    return F.when(c.isin("green", "black", "red"), c).otherwise(derived)


# Names of the helper columns of the staged classifier.
STAGE_COLUMNS = ("__gate", "__conf", "__fp", "__f_rad", "__f_depth", "__f_short", "__f_long", "__f_cold",
                 "__hab_t", "__hab_i", "__rocky", "__super", "__hot", "__miss_prad", "__miss_period", "__miss_teq")


def condition_columns(x: RuleInputs, th: Thresholds) -> dict[str, Column]:
    """Stage 1 of the classifier: every predicate as a named boolean column."""
    cond = anomaly_conditions(x, th)
    disp = disposition_key(x.disposition)
    rocky = F.coalesce(x.prad < th.rocky_max, F.lit(False))
    hot = F.coalesce(x.period <= th.hot_jupiter_period_max, F.lit(False)) | F.coalesce(
        x.teq >= th.hot_min_teq, F.lit(False)
    )
    return {
        "__gate": x.prad.isNull() & x.period.isNull() & x.teq.isNull() & x.insol.isNull(),
        "__conf": F.coalesce(disp == "CONFIRMED", F.lit(False)),
        "__fp": F.coalesce(disp == "FALSE POSITIVE", F.lit(False)),
        "__f_rad": cond[FLAG_RADIUS_TOO_LARGE],
        "__f_depth": cond[FLAG_ANOMALOUS_DEPTH],
        "__f_short": cond[FLAG_DURATION_TOO_SHORT],
        "__f_long": cond[FLAG_DURATION_TOO_LONG],
        "__f_cold": cond[FLAG_COLD_DEEP_TRANSIT],
        "__hab_t": F.coalesce(x.teq.between(th.habitable_teq_min, th.habitable_teq_max), F.lit(False)),
        "__hab_i": F.coalesce(x.insol.between(th.habitable_insol_min, th.habitable_insol_max), F.lit(False)),
        "__rocky": rocky,
        "__super": F.coalesce((x.prad >= th.rocky_max) & (x.prad < th.super_earth_max), F.lit(False)),
        "__hot": F.coalesce((x.prad >= th.super_earth_max) & (x.prad >= th.hot_jupiter_min), F.lit(False)) & ~rocky & hot,
        "__miss_prad": x.prad.isNull(),
        "__miss_period": x.period.isNull(),
        "__miss_teq": x.teq.isNull(),
    }


def result_columns() -> dict[str, Column]:
    """Stage 2 of the classifier: category, score, flags from the stage-1 columns."""
    b = {n: F.col(n) for n in STAGE_COLUMNS}
    hits = b["__f_rad"].cast("int") + b["__f_depth"].cast("int") + b["__f_cold"].cast("int")
    habitable = b["__hab_t"] | b["__hab_i"]
    s_hab = F.when(b["__hab_t"] & b["__hab_i"], SCORE_HABITABLE_BOTH).when(habitable, SCORE_HABITABLE).otherwise(0.0)
    category = (
        F.when(b["__gate"], F.lit(NO_RESULT))
        .when(b["__conf"], F.lit(CONFIRMED))
        .when(b["__fp"], F.lit(FALSE_POSITIVE))
        .when(hits >= 1, F.lit(ANOMALOUS))
        .when(b["__rocky"], F.lit(ROCKY))
        .when(b["__super"], F.lit(SUPER_EARTH))
        .when(b["__hot"], F.lit(HOT_JUPITER))
        .when(habitable, F.lit(HABITABLE))
        .otherwise(F.lit(CANDIDATE))
    )
    score = (
        F.when(b["__gate"], F.lit(0.0))
        .when(b["__conf"], F.lit(SCORE_CONFIRMED))
        .when(b["__fp"], F.lit(SCORE_FALSE_POSITIVE))
        .when(hits >= 3, F.lit(0.9))
        .when(hits == 2, F.lit(0.8))
        .when(hits == 1, F.lit(0.7))
        .when(b["__rocky"], F.greatest(s_hab, F.lit(SCORE_ROCKY)))
        .when(b["__super"], F.greatest(s_hab, F.lit(SCORE_SUPER_EARTH)))
        .when(b["__hot"], F.greatest(s_hab, F.lit(SCORE_HOT_JUPITER)))
        .when(habitable, s_hab)
        .otherwise(F.lit(SCORE_CANDIDATE))
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    names = [
        ("__f_rad", FLAG_RADIUS_TOO_LARGE), ("__f_depth", FLAG_ANOMALOUS_DEPTH),
        ("__f_short", FLAG_DURATION_TOO_SHORT), ("__f_long", FLAG_DURATION_TOO_LONG),
        ("__f_cold", FLAG_COLD_DEEP_TRANSIT), ("__miss_prad", FLAG_MISSING_PRAD),
        ("__miss_period", FLAG_MISSING_PERIOD), ("__miss_teq", FLAG_MISSING_TEQ),
    ]
    parts = [F.when(b[c], F.lit(n)) for c, n in names]
    flags_text = (
        F.when(b["__gate"], F.lit(FLAG_NO_FEATURES))
        .when(b["__conf"] | b["__fp"], F.lit(""))
        .otherwise(F.concat_ws(";", *parts))
    )
    no_nulls = F.array(F.lit(None).cast("string"))
    flags = (
        F.when(b["__gate"], F.array(F.lit(FLAG_NO_FEATURES)))
        .when(b["__conf"] | b["__fp"], F.array().cast("array<string>"))
        .otherwise(F.array_except(F.array(*parts), no_nulls))
    )
    return {"category": category, "score": score, "flags": flags, "flags_text": flags_text}
