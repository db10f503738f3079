"""Reductions of one dimension or of all cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric
from ..functions.numeric import NAN
from .base import ArrayError, L, P, V



def _v() -> Column:
    return F.col(V)


def _quantile(q: float) -> Callable[[Column, Column], Column]:
    q = min(1.0, max(0.0, q))
    return lambda v, p: F.when(F.count(F.when(numeric.nan_at(v), 1)) > 0, F.lit(NAN)).otherwise(numeric.or_nan(F.percentile(v.cast("double"), F.lit(q))))


def _arg(best: Callable[[Column], Column], key: Callable[[Column], Column], take: Callable[[Column], Column]) -> Callable:
    """The first place of an extremum; a NaN in the first cell sticks."""

    def f(v: Column, p: Column, out: Column) -> Column:
        found = F.min(F.when(~numeric.nan_at(v), F.struct(key(v).alias("k"), p.alias("p"), out.alias("o"))))
        lead = F.min(F.struct(p.alias("p"), v.cast("double").alias("v"), out.alias("o")))
        return F.when(F.isnan(lead["v"]), lead["o"]).otherwise(found["o"])

    return f


_ARG_MIN = _arg(F.min, lambda v: v, None)
_ARG_MAX = _arg(F.min, lambda v: -v, None)

#: name -> aggregate of (value, position); position orders cells of a group.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda v, p: F.coalesce(F.sum(v), F.lit(0)),
    "mean": lambda v, p: numeric.or_nan(F.avg(v)),
    "min": lambda v, p: F.coalesce(numeric.first_min(v, p), F.lit(0)),
    "max": lambda v, p: F.coalesce(numeric.first_max(v, p), F.lit(0)),
    "var": lambda v, p: numeric.or_nan(F.var_pop(v)),
    "std": lambda v, p: numeric.or_nan(F.stddev_pop(v)),
    "median": _quantile(0.5),
    "count": lambda v, p: F.count(numeric.kept(v)),
    "count_na": lambda v, p: F.count(F.when(numeric.nan_at(v), 1)),
    "sum_skipna": lambda v, p: F.coalesce(F.sum(numeric.kept(v)), F.lit(0)),
    "mean_skipna": lambda v, p: numeric.or_nan(F.avg(numeric.kept(v))),
    "min_skipna": lambda v, p: F.coalesce(F.min(numeric.kept(v)), F.lit(0)),
    "max_skipna": lambda v, p: F.coalesce(F.max(numeric.kept(v)), F.lit(0)),
    "arg_min": lambda v, p: _ARG_MIN(v, p, p.cast("double")),
    "arg_max": lambda v, p: _ARG_MAX(v, p, p.cast("double")),
}


class Reduce:
    def reduce(self, dim: str, how: str | Callable[[Column, Column], Column]):
        """One dimension goes; labels of the others stay. Partial aggregates
        are combined before the shuffle wherever the function allows."""
        self.need(dim)
        f = AGGREGATES[how] if isinstance(how, str) else how
        keys = [c for c in self.keys([dim]) if not c.startswith("T_")]
        out = self.df.groupBy(*keys).agg(f(_v(), F.col(P(dim))).alias(V)) if keys else self.df.agg(f(_v(), F.col(P(dim))).alias(V))
        return self._new(out, same_axes=True, dims=[d for d in self.dims if d != dim], texts=(), coord_attrs={})

    def total(self, how: str | Callable[[Column, Column], Column]) -> DataFrame:
        """All cells as one row with ``v``. Positions in C order decide where
        the order matters."""
        f = AGGREGATES[how] if isinstance(how, str) else how
        order = F.struct(*[P(d) for d in self.dims]) if self.dims else F.lit(0)
        return self.df.agg(f(_v(), order).alias(V))

    def value(self, how: str | Callable[[Column, Column], Column]):
        return self.total(how).first()[0]

    def quantile(self, q: float, dim: str | None = None, skipna: bool = False):
        """Exact, with linear interpolation; NaN if a cell is NaN, unless
        ``skipna``. q is clamped to [0, 1]."""
        f = _quantile(q)
        g = (lambda v, p: numeric.or_nan(F.percentile(numeric.kept(v).cast("double"), F.lit(min(1.0, max(0.0, q)))))) if skipna else f
        return self.reduce(dim, g) if dim else self.value(g)

    def approx_quantile(self, q: float, dim: str, accuracy: int = 10_000):
        """Bounded memory at any size; an extension."""
        return self.reduce(dim, lambda v, p: F.percentile_approx(numeric.kept(v), F.lit(q), F.lit(accuracy)))

    def idx_min(self, dim: str):
        """The label of the first smallest cell."""
        self.need_label(dim)
        return self.reduce(dim, lambda v, p: _ARG_MIN(v, p, F.col(L(dim))))

    def idx_max(self, dim: str):
        self.need_label(dim)
        return self.reduce(dim, lambda v, p: _ARG_MAX(v, p, F.col(L(dim))))


def _install(name: str) -> None:
    def method(self, dim: str | None = None):
        return self.reduce(dim, name) if dim else self.value(name)

    method.__name__ = name
    method.__doc__ = f"``{name}`` along ``dim``, or of all cells as a number."
    setattr(Reduce, name, method)


for _name in AGGREGATES:
    if not _name.startswith("arg_"):
        _install(_name)
Reduce.arg_min = lambda self, dim: self.reduce(dim, "arg_min")
Reduce.arg_max = lambda self, dim: self.reduce(dim, "arg_max")


def need_all(arrays: Iterable, dim: str) -> None:
    if not any(dim in a.dims for a in arrays):
        raise ArrayError(f"no variable has dimension {dim!r}")
