"""Grouping along a dimension: by label, width, edges, blocks and calendar."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from ..functions import calendar
from .base import ArrayError, L, P, V, number, small
from .reduce import AGGREGATES


class Grouped:
    """Cells with a bucket label. Aggregates make the grouped dimension the
    first, labelled by bucket in rising order; buckets without cells are not
    there. Any aggregate of :mod:`axisframe.operators.reduce` serves."""

    def __init__(self, array, dim: str, bucket: Column, keep: Column | None = None):
        self.array, self.dim, self.bucket, self.keep = array, dim, bucket, keep

    def _cells(self):
        cells = self.array.df if self.keep is None else self.array.df.filter(self.keep)
        return cells.withColumn("_bucket", self.bucket)

    def _buckets(self):
        """Distinct bucket labels, from the axis alone."""
        axis = self.array.axis(self.dim)
        return (axis if self.keep is None else axis.filter(self.keep)).select(self.bucket.alias("_bucket")).distinct()

    def labels(self) -> list:
        return sorted(r[0] for r in self._buckets().collect())  # a row per group

    def n_groups(self) -> int:
        return self._buckets().count()

    def agg(self, how: str | Callable[[Column, Column], Column]):
        a, d = self.array, self.dim
        f = AGGREGATES[how] if isinstance(how, str) else how
        keys = [c for c in a.keys([d]) if not c.startswith("T_")]
        out = self._cells().groupBy("_bucket", *keys).agg(f(F.col(V), F.col(P(d))).alias(V))
        axis = number(self._buckets().withColumnRenamed("_bucket", "_b"), [F.col("_b")], P(d))
        out = out.join(small(axis), F.col("_bucket").eqNullSafe(F.col("_b"))).withColumn(L(d), F.col("_bucket"))
        dims = [d, *[x for x in a.dims if x != d]]
        return a._new(out, dims=dims, sizes=a._sizes | {d: None}, labelled=a.labelled | {d}, texts=(), attrs={}, coord_attrs={})

    def sum(self):
        return self.agg("sum")

    def mean(self):
        return self.agg("mean")

    def min(self):
        return self.agg("min")

    def max(self):
        return self.agg("max")


class Group:
    def group_by(self, dim: str) -> Grouped:
        """Equal labels form a group (NaN labels form one)."""
        self.need_label(dim)
        return Grouped(self, dim, F.col(L(dim)))

    def resample(self, dim: str, width: float) -> Grouped:
        """Buckets of equal width from the least label on."""
        self.need_label(dim)
        if width <= 0:
            raise ArrayError("the width must be positive")
        least = self.df.agg(F.min(L(dim))).first()[0]
        start = F.lit(least)
        return Grouped(self, dim, start + F.floor((F.col(L(dim)) - start) / F.lit(float(width))) * F.lit(width))

    def coarsen(self, dim: str, factor: int) -> Grouped:
        """Blocks of ``factor`` positions; a rest at the end is left out. The
        label is the block's first label, or its number without labels."""
        n = self.size(dim)
        if factor < 1 or factor > n:
            raise ArrayError(f"factor {factor} does not fit {n} positions")
        block = F.floor(F.col(P(dim)) / factor).cast("long")
        keep = F.col(P(dim)) < n // factor * factor
        if dim not in self.labelled:
            return Grouped(self, dim, block.cast("double"), keep)
        firsts = self.axis(dim).filter(F.col(P(dim)) % factor == 0).select(F.col(P(dim)).alias("_p"), F.col(L(dim)).alias("_first"))
        joined = self.df.join(small(firsts), F.col(P(dim)) - F.col(P(dim)) % factor == F.col("_p"))
        return _Blocks(self, joined, dim, block, keep)

    def group_by_bins(self, dim: str, edges: Sequence[float]) -> Grouped:
        """Buckets [e0, e1), ..., the last one closed; labels outside are left
        out; the bucket's label is its left edge."""
        self.need_label(dim)
        if len(edges) < 2:
            raise ArrayError("two edges at least")
        x, bucket = F.col(L(dim)), F.lit(None).cast("double")
        for k in reversed(range(len(edges) - 1)):
            inside = (x >= edges[k]) & ((x <= edges[k + 1]) if k == len(edges) - 2 else (x < edges[k + 1])) & ~F.isnan(x.cast("double"))
            bucket = F.when(inside, F.lit(float(edges[k]))).otherwise(bucket)
        return Grouped(self, dim, bucket, bucket.isNotNull())

    def resample_calendar(self, dim: str, period: str) -> Grouped:
        """Labels are epoch seconds; buckets begin with hour, day, month or year."""
        self.need_label(dim)
        return Grouped(self, dim, calendar.period_start(F.col(L(dim)), period))

    def group_by_time(self, dim: str, component: str) -> Grouped:
        """Climatology: equal calendar components of epoch seconds."""
        self.need_label(dim)
        return Grouped(self, dim, calendar.component(F.col(L(dim)), component))


class _Blocks(Grouped):
    """Coarsened blocks keep their order by position, whatever their labels."""

    def __init__(self, array, cells, dim: str, block: Column, keep: Column):
        super().__init__(array, dim, block, keep)
        self.cells = cells

    def labels(self) -> list:
        rows = self.cells.filter(self.keep).select(self.bucket.alias("b"), "_first").distinct().orderBy("b").collect()
        return [r[1] for r in rows]

    def agg(self, how):
        a, d = self.array, self.dim
        f = AGGREGATES[how] if isinstance(how, str) else how
        keys = [c for c in a.keys([d]) if not c.startswith("T_")]
        grouped = self.cells.filter(self.keep).groupBy(self.bucket.alias("_bucket"), F.col("_first"), *keys).agg(f(F.col(V), F.col(P(d))).alias(V))
        out = grouped.withColumn(P(d), F.col("_bucket")).withColumn(L(d), F.col("_first"))
        return a._new(out, dims=[d, *[x for x in a.dims if x != d]], sizes=a._sizes | {d: None}, labelled=a.labelled | {d}, texts=(), attrs={}, coord_attrs={})
