"""Reusable encoders: one-hots, grids, alignment, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import _col, flag

INFINITY = float("inf")


def one_hot(value, levels, prefix: str, rename=None) -> list[Column]:
    rename = rename or {}
    return [flag(_col(value) == level).alias(f"{prefix}{rename.get(level, level)}") for level in levels]


def member(value, levels) -> Column:
    return flag(_col(value).isin(levels))


def snap(value, lo: float, hi: float, bins: int = fv.POSITION_BINS) -> Column:
    """Nearest point of a fixed grid, halves to even; NULL stays NULL."""
    width = (hi - lo) / bins
    return F.bround((_col(value) - lo) / width) * width + lo


def log1p_nonneg(value) -> Column:
    return F.log1p(F.when(_col(value) < 0, 0.0).otherwise(_col(value)))


def share_lost(position, length: int = fv.MATURE_LENGTH) -> Column:
    """Part of the molecule after ``position``; NULL for an unknown position."""
    pos = _col(position)
    kept = F.when(pos < 0, 0.0).when(pos > length, float(length)).otherwise(pos) / length
    return 1.0 - kept


def is_transition(ref, alt) -> Column:
    pair = F.concat(_col(ref), _col(alt))
    return flag(pair.isin("AA", "AG", "GA", "GG", "CC", "CT", "TC", "TT"))


def is_transversion(ref, alt) -> Column:
    pair = F.concat(_col(ref), _col(alt))
    return flag(pair.isin("AC", "AT", "GC", "GT", "CA", "CG", "TA", "TG"))


def finite_or_null(df: DataFrame, columns=None) -> DataFrame:
    """NaN and infinities become NULL in the given double columns."""
    chosen = columns or [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(F.abs(F.col(c)) < INFINITY, F.col(c)) for c in chosen})


def align(df: DataFrame, columns: list[str], keep=(), fill: float | None = None) -> DataFrame:
    """Exactly ``columns`` in that order; absent ones become ``fill`` (0.0 or NULL)."""
    have = {c.lower() for c in df.columns}
    blank = F.lit(fill).cast("double")
    return df.select(*keep, *[F.col(c) if c.lower() in have else blank.alias(c) for c in columns])


def risk_band(p) -> Column:
    out = F.when(_col(p).isNull(), None)
    for lo, hi, name in fv.RISK_BANDS:
        out = out.when((_col(p) >= lo) & (_col(p) < hi), name)
    return out.otherwise(fv.RISK_BANDS[-1][2])


def call_at(p, threshold) -> Column:
    return _col(p) >= threshold


def threshold_value(thresholds: dict[str, float], rule: str) -> float:
    if rule not in thresholds:
        raise ValueError(f"unknown threshold {rule!r}; available: {sorted(thresholds)}")
    return float(thresholds[rule])
