"""Element-wise functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions import numeric
from .base import V


class Scalar:
    def apply(self, f: Callable[[Column], Column]):
        """Any Column function of the cell; a Python function enters as a
        pandas UDF, batch by batch."""
        return self._new(self.df.withColumn(V, f(F.col(V))), same_axes=True, texts=())

    def apply_python(self, f: Callable[[float], float]):
        """A Python function of one number, run over Arrow batches."""
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return x.map(f)

        return self.apply(lambda v: numeric.or_nan(run(v.cast("double"))))

    def clip(self, low: float, high: float):
        return self.apply(lambda v: numeric.clip(v, low, high))

    def pow(self, exponent: float):
        return self.apply(lambda v: F.pow(v.cast("double"), F.lit(float(exponent))))

    def add_scalar(self, s: float):
        return self.apply(lambda v: v + F.lit(s))

    def mul_scalar(self, s: float):
        return self.apply(lambda v: v * F.lit(s))


#: Names of the functions of one cell.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "sqrt": numeric.ieee_sqrt, "exp": lambda v: F.exp(v.cast("double")), "log": numeric.ieee_log,
    "round": lambda v: F.when(numeric.nan_at(v), v).otherwise(F.round(v)), "floor": lambda v: numeric.whole(v, F.floor), "ceil": lambda v: numeric.whole(v, F.ceil),
    "sign": lambda v: numeric.sign(v).cast("double"), "sin": F.sin, "cos": F.cos, "tanh": F.tanh,
}

for _name, _f in UNARY.items():
    setattr(Scalar, _name, lambda self, f=_f: self.apply(f))
