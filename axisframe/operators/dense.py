"""Dense arrays with numbered axes, and linear algebra on them.

The cells are those of a :class:`~axisframe.LabeledArray` whose dimensions
are named by number. Shapes are matched from the right and size 1 stretches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numeric
from .align import ADD, DIV, MUL, SUB, Op
from .base import ArrayError, P, V


class DenseArray:
    def __init__(self, df: DataFrame, shape: Sequence[int]):
        self.shape = tuple(shape)
        self.df = df.select(*[P(str(i)) for i in range(len(self.shape))], V)

    @classmethod
    def from_flat(cls, spark: SparkSession, shape: Sequence[int], data: Sequence[float]):
        from ..array import LabeledArray

        return cls(LabeledArray.from_flat(spark, [str(i) for i in range(len(shape))], shape, data).df, shape)

    @classmethod
    def zeros(cls, spark: SparkSession, *shape: int):
        steps = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
        cells = spark.range(math.prod(shape))
        return cls(cells.select(*[(F.floor(F.col("id") / s) % n).cast("long").alias(P(str(i))) for i, (s, n) in enumerate(zip(steps, shape))], F.lit(0.0).alias(V)), shape)

    @classmethod
    def arange(cls, spark: SparkSession, n: int):
        return cls(spark.range(n).select(F.col("id").alias(P("0")), F.col("id").cast("double").alias(V)), (n,))

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def like(self):
        return DenseArray.zeros(self.df.sparkSession, *self.shape)

    def flat(self) -> list[float]:
        return [r[0] for r in self.df.orderBy(*[P(str(i)) for i in range(self.ndim)]).select(V).collect()]

    def at(self, *index: int) -> float:
        if len(index) != self.ndim or any(not 0 <= i < n for i, n in zip(index, self.shape)):
            raise ArrayError(f"index {index} is outside of {self.shape}")
        return self.df.filter(" and ".join(f"`{P(str(k))}` = {i}" for k, i in enumerate(index)) or "true").first()[V]

    def combine(self, other: DenseArray, op: Op) -> DenseArray:
        n = max(self.ndim, other.ndim)
        a, b = [(1,) * (n - x.ndim) + x.shape for x in (self, other)]
        if any(x != y and 1 not in (x, y) for x, y in zip(a, b)):
            raise ArrayError(f"shapes {self.shape} and {other.shape} do not fit")
        shift = lambda x: n - x.ndim
        left = self.df.select(*[F.col(P(str(i))).alias(f"a{i + shift(self)}") for i in range(self.ndim)], F.col(V).alias("_x"))
        right = other.df.select(*[F.col(P(str(i))).alias(f"b{i + shift(other)}") for i in range(other.ndim)], F.col(V).alias("_y"))
        on = [F.col(f"a{i}") == F.col(f"b{i}") for i in range(n) if a[i] == b[i] and i >= shift(self) and i >= shift(other)]
        both = left.join(right, on) if on else left.crossJoin(right)

        def place(i: int):
            if i >= shift(self) and (a[i] > 1 or i < shift(other) or b[i] == 1):
                return F.col(f"a{i}")
            return F.col(f"b{i}")

        return DenseArray(both.select(*[place(i).alias(P(str(i))) for i in range(n)], op(F.col("_x"), F.col("_y")).alias(V)), [max(x, y) for x, y in zip(a, b)])

    def __add__(self, other):
        return self.combine(other, ADD)

    def __sub__(self, other):
        return self.combine(other, SUB)

    def __mul__(self, other):
        return self.combine(other, MUL)

    def __truediv__(self, other):
        return self.combine(other, DIV)

    def add_scalar(self, s: float):
        return DenseArray(self.df.withColumn(V, F.col(V) + F.lit(float(s))), self.shape)

    def mul_scalar(self, s: float):
        return DenseArray(self.df.withColumn(V, F.col(V) * F.lit(float(s))), self.shape)

    def sum(self) -> float:
        return self.df.agg(F.coalesce(F.sum(V), F.lit(0.0))).first()[0]

    def mean(self) -> float:
        return self.df.agg(F.coalesce(F.avg(V), F.lit(0.0))).first()[0]

    def _axis(self, axis: int, f) -> DenseArray:
        if not 0 <= axis < self.ndim:
            raise ArrayError(f"no axis {axis} in {self.shape}")
        keep = [i for i in range(self.ndim) if i != axis]
        out = self.df.groupBy(*[P(str(i)) for i in keep]).agg(f(F.col(V)).alias(V))
        return DenseArray(out.select(*[F.col(P(str(i))).alias(P(str(k))) for k, i in enumerate(keep)], V), [self.shape[i] for i in keep])

    def sum_axis(self, axis: int):
        return self._axis(axis, F.sum)

    def mean_axis(self, axis: int):
        return self._axis(axis, F.avg)

    def transpose(self):
        if self.ndim != 2:
            raise ArrayError("a transpose needs two axes")
        return DenseArray(self.df.select(F.col(P("1")).alias(P("0")), F.col(P("0")).alias(P("1")), V), self.shape[::-1])


def matmul(a: DenseArray, b: DenseArray) -> DenseArray:
    """Product of two matrices; factors of 0 on the left add nothing, so
    nothing of 0 times NaN or an infinity."""
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[0]:
        raise ArrayError(f"shapes {a.shape} and {b.shape} do not fit")
    left = a.df.filter((F.col(V) != 0) | F.isnan(V)).select(F.col(P("0")).alias("i"), F.col(P("1")).alias("k"), F.col(V).alias("x"))
    right = b.df.select(F.col(P("0")).alias("k"), F.col(P("1")).alias("j"), F.col(V).alias("y"))
    found = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    full = DenseArray.zeros(a.df.sparkSession, a.shape[0], b.shape[1]).df
    out = full.join(found, (F.col(P("0")) == F.col("i")) & (F.col(P("1")) == F.col("j")), "left")
    return DenseArray(out.withColumn(V, F.coalesce("s", V)), (a.shape[0], b.shape[1]))


def matvec(a: DenseArray, v: DenseArray) -> DenseArray:
    if a.ndim != 2 or v.ndim != 1 or a.shape[1] != v.shape[0]:
        raise ArrayError(f"shapes {a.shape} and {v.shape} do not fit")
    right = v.df.select(F.col(P("0")).alias("k"), F.col(V).alias("y"))
    out = a.df.join(right, F.col(P("1")) == F.col("k")).groupBy(P("0")).agg(F.sum(F.col(V) * F.col("y")).alias(V))
    return DenseArray(out, (a.shape[0],))


def standardize(x: DenseArray) -> tuple[DenseArray, DenseArray, DenseArray]:
    """Column z-scores with population deviation (1 where it is 0), with the
    means and deviations used."""
    if x.ndim != 2:
        raise ArrayError("columns need two axes")
    deviation = F.stddev_pop(V)
    by_column = x.df.groupBy(P("1")).agg(F.avg(V).alias("_m"), F.when(deviation == 0, 1.0).otherwise(deviation).alias("_s"))
    joined = x.df.join(by_column.withColumnRenamed(P("1"), "_c"), F.col(P("1")) == F.col("_c"))
    out = DenseArray(joined.withColumn(V, numeric.ieee_div(F.col(V) - F.col("_m"), F.col("_s"))), x.shape)
    column = lambda c: DenseArray(by_column.select(F.col(P("1")).alias(P("0")), F.col(c).alias(V)), (x.shape[1],))
    return out, column("_m"), column("_s")


class LinearRegression:
    """Batch gradient descent from zero weights over a fixed number of epochs.

    The gradient is linear in the sums of products of features and target, so
    the rows are read once for those sums and the epochs run on them."""

    def __init__(self, rate: float = 0.01, epochs: int = 1000):
        self.rate, self.epochs = rate, epochs
        self.weights: list[float] | None = None
        self.bias = 0.0

    def fit(self, x: DenseArray, y: DenseArray) -> LinearRegression:
        import numpy as np

        n, k = x.shape
        if y.shape[0] != n:
            raise ArrayError("features and target differ in rows")
        right = x.df.select(F.col(P("0")).alias("r"), F.col(P("1")).alias("j"), F.col(V).alias("w"))
        squares = x.df.join(right, F.col(P("0")) == F.col("r")).groupBy(P("1"), "j").agg(F.sum(F.col(V) * F.col("w")).alias("s")).collect()  # features squared
        target = y.df.select(F.col(P("0")).alias("r"), F.col(V).alias("w"))
        cross = x.df.join(target, F.col(P("0")) == F.col("r")).groupBy(P("1")).agg(F.sum(F.col(V) * F.col("w")).alias("s"), F.sum(V).alias("t")).collect()
        total = y.df.agg(F.sum(V)).first()[0]
        xx, xy, xs = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        for i, j, s in squares:
            xx[i, j] = s
        for i, s, t in cross:
            xy[i], xs[i] = s, t
        w, b = np.zeros(k), 0.0
        for _ in range(self.epochs):
            dw, db = (xx @ w + xs * b - xy) / n, (xs @ w + n * b - total) / n
            w, b = w - self.rate * dw, b - self.rate * db
        self.weights, self.bias = w.tolist(), float(b)
        return self

    def predict(self, x: DenseArray) -> DenseArray:
        if self.weights is None:
            raise ArrayError("fit first")
        if x.shape[1] != len(self.weights):
            raise ArrayError(f"{x.shape[1]} features, fitted on {len(self.weights)}")
        weights = F.array(*[F.lit(w) for w in self.weights])
        out = x.df.groupBy(P("0")).agg((F.sum(F.col(V) * F.get(weights, F.col(P("1")).cast("int"))) + F.lit(self.bias)).alias(V))
        return DenseArray(out, (x.shape[0],))


def mean_squared_error(predicted: DenseArray, y: DenseArray) -> float:
    if predicted.shape != y.shape:
        raise ArrayError("shapes differ")
    d = predicted - y
    return (d * d).mean()
