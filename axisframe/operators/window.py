"""Windows, scans and gaps along a dimension.

Each runs in blocks of positions. A scan first aggregates every block, sums
(or multiplies, or looks for the last valid cell) over the blocks before, and
then scans inside the blocks; a trailing window sees copies of the few cells
before its block. So a long one-dimensional array is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric
from ..functions.numeric import NAN
from .base import ArrayError, L, P, V

ROLLING = {
    "mean": lambda v, w, p: F.avg(v).over(w),
    "sum": lambda v, w, p: F.sum(v).over(w),
    "min": lambda v, w, p: F.when(F.isnan(F.first(v).over(w)), F.lit(NAN)).otherwise(F.min(numeric.kept(v)).over(w)),
    "max": lambda v, w, p: F.when(F.isnan(F.first(v).over(w)), F.lit(NAN)).otherwise(F.max(numeric.kept(v)).over(w)),
}


class Rolling:
    def __init__(self, array, dim: str, width: int):
        array.need(dim)
        if width < 1:
            raise ArrayError("a window has one position at least")
        self.array, self.dim, self.width = array, dim, width

    def agg(self, how: str):
        """Over the ``width`` positions up to each; NaN where there are fewer."""
        a, d, n = self.array, self.dim, self.width
        cells = _haloed(a, d, n - 1).withColumn(V, F.col(V).cast("double"))
        w = Window.partitionBy(*a.others(d), "_block").orderBy(P(d)).rowsBetween(-(n - 1), 0)
        out = cells.withColumn("_x", F.when(F.col(P(d)) >= n - 1, ROLLING[how](F.col(V), w, F.col(P(d)))).otherwise(F.lit(NAN)))
        return a._new(out.filter(~F.col("_halo")).withColumn(V, F.coalesce("_x", F.lit(NAN))), same_axes=True, texts=(), attrs={}, coord_attrs={})

    def mean(self):
        return self.agg("mean")

    def sum(self):
        return self.agg("sum")

    def min(self):
        return self.agg("min")

    def max(self):
        return self.agg("max")


def _haloed(a, dim: str, before: int, cells_per_block: int | None = None) -> DataFrame:
    """Cells with ``_block``; the last ``before`` positions of each block also
    stand, marked ``_halo``, at the head of the next."""
    from .base import BLOCK_CELLS

    size = max(cells_per_block or BLOCK_CELLS, before + 1)
    block = F.floor(F.col(P(dim)) / size)
    if not before:
        return a.df.withColumn("_block", block).withColumn("_halo", F.lit(False))
    own, again = F.struct(block.alias("b"), F.lit(False).alias("h")), F.struct((block + 1).alias("b"), F.lit(True).alias("h"))
    at_end = F.col(P(dim)) % size >= size - before
    return a.df.withColumn("_x", F.explode(F.when(at_end, F.array(own, again)).otherwise(F.array(own)))).withColumn("_block", F.col("_x.b")).withColumn("_halo", F.col("_x.h")).drop("_x")


def _carried(a, dim: str, block_value: Column, combine, name: str) -> DataFrame:
    """Cells with ``_block`` and, in ``name``, what ``combine`` makes of the
    values of all blocks before, along each line of the dimension."""
    from .base import BLOCK_CELLS

    cells = a.df.withColumn("_block", F.floor(F.col(P(dim)) / BLOCK_CELLS))
    keys = [*a.others(dim), "_block"]
    blocks = cells.groupBy(*keys).agg(block_value.alias("_bv"))
    w = Window.partitionBy(*a.others(dim)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_k{k}") for k in keys], combine(F.col("_bv"), w).alias(name))
    return cells.join(blocks, [F.col(k) == F.col(f"_k{k}") for k in keys]).drop(*[f"_k{k}" for k in keys])


class Windowed:
    def rolling(self, dim: str, width: int) -> Rolling:
        return Rolling(self, dim, width)

    def cumsum(self, dim: str):
        self.need(dim)
        cells = _carried(self, dim, F.sum(V), lambda b, w: F.sum(b).over(w), "_before")
        w = Window.partitionBy(*self.others(dim), "_block").orderBy(P(dim)).rowsBetween(Window.unboundedPreceding, 0)
        return self._new(cells.withColumn(V, F.coalesce("_before", F.lit(0)) + F.sum(V).over(w)))

    def cumprod(self, dim: str):
        """Running product, multiplied out block by block."""
        cells = _carried(self, dim, F.product(F.col(V).cast("double")), lambda b, w: F.product(b).over(w), "_before")
        w = Window.partitionBy(*self.others(dim), "_block").orderBy(P(dim)).rowsBetween(Window.unboundedPreceding, 0)
        return self._new(cells.withColumn(V, F.coalesce("_before", F.lit(1.0)) * F.product(F.col(V).cast("double")).over(w)), same_axes=True)

    def diff(self, dim: str):
        """Each cell less the one before; labels are those of the later."""
        self.need(dim)
        w = Window.partitionBy(*self.others(dim), "_block").orderBy(P(dim))
        cells = _haloed(self, dim, 1).withColumn("_prev", F.lag(V).over(w)).filter(~F.col("_halo") & (F.col(P(dim)) > 0))
        out = cells.withColumn(V, F.col(V) - F.col("_prev")).withColumn(P(dim), F.col(P(dim)) - 1)
        size = self._sizes[dim]
        return self._new(out, sizes=self._sizes | {dim: None if size is None else max(0, size - 1)}, texts=(), attrs={})

    def _last_valid(self, dim: str, backward: bool, what: Column, name: str, cells: DataFrame | None = None) -> DataFrame:
        """The nearest cell with a value before (or after) each, as ``what``."""
        step = -F.col(P(dim)) if backward else F.col(P(dim))
        cells = (self.df if cells is None else cells).withColumn("_block", self.block_of(dim))
        valid = F.when(~numeric.nan_at(F.col(V)), what)
        keys = [*self.others(dim), "_block"]
        blocks = cells.groupBy(*keys).agg(F.max_by(valid, F.when(valid.isNotNull(), step)).alias("_bv"))
        order = F.col("_block").desc() if backward else F.col("_block").asc()
        lines = Window.partitionBy(*self.others(dim)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.last("_bv", ignorenulls=True).over(lines).alias("_out"))
        w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
        joined = cells.join(blocks, [F.col(k) == F.col(f"_k{k}") for k in keys])
        return joined.withColumn(name, F.coalesce(F.last(valid, ignorenulls=True).over(w), F.col("_out"))).drop(*[f"_k{k}" for k in keys], "_out", "_block")

    def ffill(self, dim: str):
        self.need(dim)
        return self._new(self._last_valid(dim, False, F.col(V), "_x").withColumn(V, F.coalesce("_x", V)))

    def bfill(self, dim: str):
        self.need(dim)
        return self._new(self._last_valid(dim, True, F.col(V), "_x").withColumn(V, F.coalesce("_x", V)))

    def interpolate_na(self, dim: str):
        """Linear between the nearest valid cells, over labels or positions;
        NaN before the first and after the last stay."""
        self.need(dim)
        at = F.col(L(dim)) if dim in self.labelled else F.col(P(dim))
        what = F.struct(at.cast("double").alias("x"), F.col(V).alias("y"))
        both = self._last_valid(dim, True, what, "_b", self._last_valid(dim, False, what, "_f"))
        f, b = F.col("_f"), F.col("_b")
        between = f["y"] + (b["y"] - f["y"]) * numeric.ieee_div(at.cast("double") - f["x"], b["x"] - f["x"])
        fill = F.when(numeric.nan_at(F.col(V)) & f.isNotNull() & b.isNotNull(), between).otherwise(F.col(V))
        return self._new(both.withColumn(V, fill))

    def dropna(self, dim: str):
        """Positions whose slice has a NaN go; the others move together."""
        self.need(dim)
        bad = self.df.filter(numeric.nan_at(F.col(V))).select(F.col(P(dim)).alias("_bad")).distinct()
        kept = self.df.join(bad, F.col(P(dim)) == F.col("_bad"), "left_anti")
        return self._new(kept, sizes=self._sizes | {dim: None})._repacked(dim)

    def fillna(self, value: float):
        return self._new(self.df.withColumn(V, F.when(numeric.nan_at(F.col(V)), F.lit(value)).otherwise(F.col(V))))

    def isnull(self):
        return self._new(self.df.withColumn(V, F.when(numeric.nan_at(F.col(V)), 1.0).otherwise(0.0)))

    def notnull(self):
        return self._new(self.df.withColumn(V, F.when(numeric.nan_at(F.col(V)), 0.0).otherwise(1.0)))
