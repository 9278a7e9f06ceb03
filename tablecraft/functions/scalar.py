"""Null-safe scalar helpers used by the learned transforms and scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROB_EPS = 1e-15


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Two- or one-sided bound; null stays null.

    ``least``/``greatest`` skip nulls, so the null guard is explicit.
    """
    c = col_(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def log1p_pos(c: Column | str) -> Column:
    """log1p(max(x, 0)); null stays null."""
    c = col_(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))


def to_numeric(c: Column | str) -> Column:
    """Parse to double, failures to null."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def prob_clip(c: Column | str, eps: float = PROB_EPS) -> Column:
    return clip(c, eps, 1.0 - eps)


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum of an array column."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
