"""Arithmetic that stays defined under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(numerator: Column, denominator: Column, guard: float = 1e-6) -> Column:
    """a / (b + guard), null where b is zero or missing."""
    b = denominator.cast("double")
    return F.try_divide(numerator.cast("double"), F.when(b != 0, b) + F.lit(guard))


def pair_corr(x: Column, y: Column, x_full: bool = False, y_full: bool = False) -> Column:
    """Pearson correlation over rows where both are present; null without variance.

    A column known to have no gaps needs no test for them; deviations of the other one
    are then the same expression in many pairs, and Spark computes them once.
    """
    x_both = x if y_full else F.when(y.isNotNull(), x)
    y_both = y if x_full else F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x_both) * F.stddev_samp(y_both))
