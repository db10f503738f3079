"""Block-wise arrays: a plan over blocks of the leading dimension.

A :class:`BlockArray` is a DataFrame of cells with a block number, so deferred
operations, partial aggregates by block and their combination are plain Spark
plans. Least and greatest cells propagate NaN here.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..array import ArrayError, LabeledArray
from ..functions import numeric
from ..operators.align import ADD, DIV, MUL, SUB, Op
from ..operators.base import P, V


class BlockSource(Protocol):
    """What a connector offers: metadata and the cells of any array."""

    def open(self, spark: SparkSession) -> LabeledArray: ...


class BlockArray:
    def __init__(self, array: LabeledArray, rows: int):
        if rows < 1:
            raise ArrayError("a block has one row at least")
        if not array.dims:
            raise ArrayError("blocks need a dimension")
        self.array, self.rows = array, rows

    @classmethod
    def from_source(cls, spark: SparkSession, source: BlockSource, rows: int):
        return cls(source.open(spark), rows)

    @property
    def n_blocks(self) -> int:
        return -(-self.array.size(self.array.dims[0]) // self.rows)

    def blocks(self) -> DataFrame:
        return self.array.df.withColumn("block", F.floor(F.col(P(self.array.dims[0])) / self.rows))

    def _new(self, array: LabeledArray):
        return BlockArray(array, self.rows)

    def map(self, f: Callable[[Column], Column]):
        return self._new(self.array.apply(f))

    def add_scalar(self, s: float):
        return self.map(lambda v: v + F.lit(s))

    def mul_scalar(self, s: float):
        return self.map(lambda v: v * F.lit(s))

    def _combine(self, other: BlockArray, op: Op):
        """By position; labels are those of the left side."""
        a, b = self.array, other.array
        if a.shape != b.shape or self.n_blocks != other.n_blocks:
            raise ArrayError("shapes or blocks differ")
        right = b.df.select(*[F.col(P(d)).alias(f"_{P(e)}") for d, e in zip(b.dims, a.dims)], F.col(V).alias("_w"))
        both = a.df.join(right, [F.col(P(d)) == F.col(f"_{P(d)}") for d in a.dims])
        return self._new(a._new(both.withColumn(V, op(F.col(V), F.col("_w")))))

    def __add__(self, other):
        return self._combine(other, ADD)

    def __sub__(self, other):
        return self._combine(other, SUB)

    def __mul__(self, other):
        return self._combine(other, MUL)

    def __truediv__(self, other):
        return self._combine(other, DIV)

    def compute(self) -> LabeledArray:
        """The array itself; Spark runs the blocks in parallel."""
        return self.array

    def _total(self, partial: Column, final: Callable[[Column], Column]) -> float:
        parts = self.blocks().groupBy("block").agg(partial.alias("x"))
        return parts.agg(final(F.col("x"))).first()[0]

    def sum(self) -> float:
        return self._total(F.sum(V), lambda x: F.coalesce(F.sum(x), F.lit(0.0)))

    def mean(self) -> float:
        row = self.array.df.agg(F.sum(V), F.count(V)).first()
        return row[0] / row[1] if row[1] else float("nan")

    def min(self) -> float:
        return self._total(_least(), lambda x: F.coalesce(_nan_first(F.min(x), x), F.lit(float("inf"))))

    def max(self) -> float:
        return self._total(F.max(V), lambda x: F.coalesce(F.max(x), F.lit(float("-inf"))))

    def _axis(self, dim: str, f: Callable[[Column, Column], Column]) -> LabeledArray:
        return self.array.reduce(dim, f)

    def sum_axis(self, dim: str):
        return self._axis(dim, lambda v, p: F.sum(v))

    def mean_axis(self, dim: str):
        return self._axis(dim, lambda v, p: F.avg(v))

    def min_axis(self, dim: str):
        return self._axis(dim, lambda v, p: _nan_first(F.min(v), v))

    def max_axis(self, dim: str):
        return self._axis(dim, lambda v, p: F.max(v))


def _nan_first(least: Column, v: Column) -> Column:
    return F.when(F.count(F.when(numeric.nan_at(v), 1)) > 0, F.lit(float("nan"))).otherwise(least)


def _least() -> Column:
    return _nan_first(F.min(V), F.col(V))
