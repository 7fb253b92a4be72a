"""Probability and weight expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the semi-synthetic design.
CLIP_LOW, CLIP_HIGH = 0.001, 0.999
LOGIT_SHIFT, LOGIT_SCALE = -8.5, 2.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clipped(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; null stays null (``greatest`` alone would drop it)."""
    value = _col(c)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def shifted_probability(p: str | Column, shift: float = LOGIT_SHIFT, scale: float = LOGIT_SCALE) -> Column:
    """``expit(shift + scale * logit(p))`` with p clipped away from 0 and 1."""
    q = clipped(p, CLIP_LOW, CLIP_HIGH)
    return 1.0 / (1.0 + F.exp(-(F.lit(shift) + F.lit(scale) * F.log(q / (1.0 - q)))))


def trait_distorted(w: str | Column, trait_pm1: str | Column, cut: float = 0.75) -> Column:
    """Shrink the weight by ``cut`` for rows whose -1/+1 trait is -1."""
    return _col(w) * (1.0 - F.lit(cut) * (1.0 - _col(trait_pm1)) / 2.0)


def is_infinite(w: str | Column) -> Column:
    return F.abs(_col(w)) == F.lit(float("inf"))


def usable_weight(w: str | Column) -> Column:
    """The weight itself, or 0 where it is null, NaN, infinite or negative."""
    value = _col(w)
    bad = value.isNull() | F.isnan(value) | is_infinite(value) | (value < 0)
    return F.when(bad, 0.0).otherwise(value)
