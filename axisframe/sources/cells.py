"""Between blocks of numbers and rows of cells.

A dense file is described by a :class:`Grid`; its chunks become partitions of a
Python data source, and a chunk's cells are made as Arrow columns, not row by
row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..array import LabeledArray
from ..operators.base import L, P, V


@dataclass
class Grid:
    """Dimensions, sizes, label vectors and attributes of a dense array."""

    dims: list[str]
    shape: list[int]
    coords: dict[str, list[float]] = field(default_factory=dict)
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    coord_attrs: dict[str, dict[str, str]] = field(default_factory=dict)

    def schema(self) -> str:
        return ", ".join([f"`{P(d)}` long" for d in self.dims] + [f"`{L(d)}` double" for d in self.dims if d in self.coords] + [f"{V} double"])

    def batch(self, block: np.ndarray, start: Sequence[int]) -> pa.RecordBatch:
        """The cells of a block whose first cell is at ``start``."""
        at = [i.ravel() + s for i, s in zip(np.indices(block.shape), start)] if block.ndim else []
        columns = [pa.array(a.astype(np.int64)) for a in at]
        for d, a in zip(self.dims, at):
            if d in self.coords:
                columns.append(pa.array(np.asarray(self.coords[d], float)[a]))
        columns.append(pa.array(block.ravel().astype(float)))
        names = [P(d) for d in self.dims] + [L(d) for d in self.dims if d in self.coords] + [V]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def array(self, df: DataFrame) -> LabeledArray:
        return LabeledArray(df, self.dims, dict(zip(self.dims, self.shape)), self.coords, (), self.name, self.attrs, self.coord_attrs)

    def from_values(self, spark: SparkSession, values: np.ndarray) -> LabeledArray:
        """From values on the driver, sent as Arrow."""
        table = pa.Table.from_batches([self.batch(np.asarray(values, float).reshape(self.shape), [0] * len(self.shape))])
        return self.array(spark.createDataFrame(table))


def chunk_starts(shape: Sequence[int], chunks: Sequence[int]) -> Iterator[tuple[int, ...]]:
    for flat in range(math.prod(-(-n // c) for n, c in zip(shape, chunks))):
        out = []
        for n, c in zip(reversed(shape), reversed(chunks)):
            k = -(-n // c)
            out.append(flat % k)
            flat //= k
        yield tuple(reversed(out))


def grid_of(array: LabeledArray) -> Grid:
    coords = {d: [float(x) for x in array.labels(d)] for d in array.dims if d in array.labelled}
    return Grid(list(array.dims), list(array.shape), coords, array.name, dict(array.attrs), dict(array.coord_attrs))


def blocks(array: LabeledArray, chunks: Sequence[int]) -> DataFrame:
    """One row per chunk with cells: its numbers ``c0, c1, ...`` and ``cells``,
    (place in the chunk in C order, value). Cells meet by chunk, so no task
    holds more than the chunks it makes."""
    numbers = [F.floor(F.col(P(d)) / c).cast("int").alias(f"c{i}") for i, (d, c) in enumerate(zip(array.dims, chunks))]
    inner = F.lit(0).cast("long")
    for d, c in zip(array.dims, chunks):
        inner = inner * c + F.col(P(d)) % c
    cell = F.struct(inner.cast("int").alias("i"), F.col(V).cast("double").alias("x"))
    return array.df.groupBy(*numbers).agg(F.collect_list(cell).alias("cells"))


def collected(array: LabeledArray) -> np.ndarray:
    """All values on the driver, for single-file formats."""
    shape = array.shape
    out = np.full(shape, np.nan)
    table = array.df.select(*[P(d) for d in array.dims], F.col(V).cast("double").alias(V)).toArrow()
    if shape:
        out[tuple(table[P(d)].to_numpy() for d in array.dims)] = table[V].to_numpy()
        return out
    return np.asarray(table[V].to_numpy()[0] if table.num_rows else np.nan)
