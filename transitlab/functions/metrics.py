"""Orbital and stellar metric formulas (M1-M8) as Column expressions.

Each function takes NaN-free double Columns and returns a double Column that
is NULL exactly where the reference returns None. They are pure expressions,
so a chain of them stays inside one whole-stage-codegen projection. Arithmetic
follows the reference's operation order so results agree bit for bit where
only + - * / sqrt are involved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, DEFAULT_IMPACT, R_EARTH_PER_R_SUN, T_SUN_K


def _pos(c: Column) -> Column:
    # NULL > 0 is NULL, which a CASE condition treats as false.
    return c > 0


def albedo_factor(albedo: float) -> float:
    """(1 - A)^0.25 folded on the driver."""
    a = float(albedo)
    if not 0.0 <= a <= 1.0:
        raise ValueError(f"albedo must lie in [0, 1], got {albedo!r}")
    return (1.0 - a) ** 0.25


def semi_major_axis(period_days: Column, m_star: Column) -> Column:
    """M1: a = ((P/365.25)^2 * M)^(1/3); NULL unless P > 0 and M > 0."""
    p_year = period_days / F.lit(DAYS_PER_YEAR)
    return F.when(_pos(period_days) & _pos(m_star), F.pow(p_year * p_year * m_star, F.lit(1.0 / 3.0)))


def equilibrium_temp(t_star: Column, r_star: Column, a_au: Column, albedo: float, rsun_in_au: float | None = None) -> Column:
    """M2: T * sqrt(Rs / (2a)) * (1-A)^0.25; NULL unless T known, Rs > 0, a > 0.

    The reference divides Solar radii by AU without conversion (D6); pass
    ``rsun_in_au`` to convert Rs to AU first."""
    rs = r_star if rsun_in_au is None else r_star * F.lit(float(rsun_in_au))
    value = t_star * F.sqrt(rs / (F.lit(2.0) * a_au)) * F.lit(albedo_factor(albedo))
    return F.when(t_star.isNotNull() & _pos(r_star) & _pos(a_au), value)


def insolation(t_star: Column, r_star: Column, a_au: Column) -> Column:
    """M3: Rs^2 * (T/5772)^4 / a^2 with products instead of pow; same guards as M2."""
    ratio = t_star / F.lit(T_SUN_K)
    r2 = ratio * ratio
    value = (r_star * r_star) * (r2 * r2) / (a_au * a_au)
    return F.when(t_star.isNotNull() & _pos(r_star) & _pos(a_au), value)


def transit_depth(prad: Column, r_star: Column) -> Column:
    """M4: (Rp / (109 Rs))^2; NULL unless both > 0."""
    ratio = prad / (r_star * F.lit(R_EARTH_PER_R_SUN))
    return F.when(_pos(prad) & _pos(r_star), ratio * ratio)


def expected_duration_hours(period_days: Column, r_star: Column, a_au: Column, impact: Column, rsun_in_au: float | None = None) -> Column:
    """M5: 24 * (P/pi) * sqrt(max(0, 1-b^2)) * (Rs/a); b defaults to 0.5."""
    b = F.coalesce(impact, F.lit(DEFAULT_IMPACT))
    rs = r_star if rsun_in_au is None else r_star * F.lit(float(rsun_in_au))
    days = (period_days / F.lit(math.pi)) * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - b * b)) * (rs / a_au)
    return F.when(_pos(period_days) & _pos(r_star) & _pos(a_au), days * F.lit(24.0))


def duration_ratio(observed_hours: Column, expected_hours: Column) -> Column:
    """M6: observed / expected; NULL unless observed is known and expected > 0."""
    return F.when(observed_hours.isNotNull() & _pos(expected_hours), observed_hours / expected_hours)


# Soft flag names, in emission order.
SOFT_FLAGS = (
    "SOFT_NEGATIVE_RADIUS",
    "SOFT_NEGATIVE_STELLAR_RADIUS",
    "SOFT_NEGATIVE_PERIOD",
    "SOFT_STELLAR_TEFF_OUT_OF_RANGE",
)


def soft_flags_parts(prad: Column, r_star: Column, period_days: Column, t_star: Column) -> list[Column]:
    """M8: one nullable string per soft flag, in emission order."""
    return [
        F.when(prad <= 0, F.lit(SOFT_FLAGS[0])),
        F.when(r_star <= 0, F.lit(SOFT_FLAGS[1])),
        F.when(period_days <= 0, F.lit(SOFT_FLAGS[2])),
        F.when((t_star < 2000) | (t_star > 10000), F.lit(SOFT_FLAGS[3])),
    ]


def soft_flags(prad: Column, r_star: Column, period_days: Column, t_star: Column) -> Column:
    """M8 as text: ``concat_ws`` skips NULL parts, so no array or lambda is needed."""
    return F.concat_ws(";", *soft_flags_parts(prad, r_star, period_days, t_star))
