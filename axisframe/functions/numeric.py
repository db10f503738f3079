"""Number semantics of labelled arrays as Column expressions.

Cells follow IEEE 754: division by zero gives an infinity or NaN, comparisons
with NaN are false, and NaN is the only missing value. Spark's own operators
raise, return NULL or order NaN as the largest, so raw ``/``, ``ln``, ``min``
and ``max`` are used nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN = float("nan")
INF = float("inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_at(x: Column) -> Column:
    return F.isnan(x.cast("double"))


def ieee_div(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when((y != 0) | F.isnan(y), F.try_divide(x, y)).otherwise(by_zero)


def ieee_log(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), x).when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def ieee_sqrt(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x) | (x >= 0), F.sqrt(x)).otherwise(F.lit(NAN))


def larger(x: Column, y: Column) -> Column:
    """x if x > y, else y; so NaN on either side gives y."""
    return F.when(~nan_at(x) & ~nan_at(y) & (x > y), x).otherwise(y)


def smaller(x: Column, y: Column) -> Column:
    return F.when(~nan_at(x) & ~nan_at(y) & (x < y), x).otherwise(y)


def sign(x: Column) -> Column:
    return F.when(nan_at(x), F.lit(0)).when(x > 0, F.lit(1)).when(x < 0, F.lit(-1)).otherwise(F.lit(0))


def clip(x: Column, lo: float, hi: float) -> Column:
    lo, hi = min(lo, hi), max(lo, hi)
    return F.when(nan_at(x), x).when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def whole(x: Column, f) -> Column:
    """``f`` (floor, ceil) kept in the type of x; NaN and infinities stay."""
    big = F.abs(x) >= F.lit(9.0e15)
    return F.when(nan_at(x) | big, x).otherwise(f(x).cast("double"))


def first_min(x: Column, at: Column) -> Column:
    """Least cell by ``<`` from the first one on: NaN only if the first is."""
    return F.when(F.isnan(F.min_by(x.cast("double"), at)), F.lit(NAN)).otherwise(F.min(F.when(~nan_at(x), x)))


def first_max(x: Column, at: Column) -> Column:
    return F.when(F.isnan(F.min_by(x.cast("double"), at)), F.lit(NAN)).otherwise(F.max(F.when(~nan_at(x), x)))


def kept(x: Column) -> Column:
    """x, or NULL where it is NaN, for aggregates that skip NULL."""
    return F.when(~nan_at(x), x)


def or_nan(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(NAN))
