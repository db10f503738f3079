"""Raw files of little-endian doubles in C order."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..array import ArrayError, LabeledArray
from .cells import Grid


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def write_raw(values, path: str) -> None:
    np.asarray(values, "<f8").tofile(path.removeprefix("file://"))


class RawSource(DataSource):
    """``format("axisframe_raw")`` with ``dims`` and ``shape`` (comma lists)
    and ``rows``, the leading positions of a partition."""

    @classmethod
    def name(cls) -> str:
        return "axisframe_raw"

    def _grid(self) -> Grid:
        return Grid(self.options["dims"].split(","), [int(n) for n in self.options["shape"].split(",")])

    def schema(self) -> str:
        return self._grid().schema()

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options["path"].removeprefix("file://"), self._grid(), int(self.options.get("rows", "0")))


class RawReader(DataSourceReader):
    def __init__(self, path: str, grid: Grid, rows: int):
        self.path, self.grid = path, grid
        self.inner = math.prod(grid.shape[1:])
        self.rows = rows or max(1, (1 << 20) // max(1, self.inner))

    def partitions(self) -> list[InputPartition]:
        n = self.grid.shape[0]
        return [_Range(i, min(n, i + self.rows)) for i in range(0, n, self.rows)]

    def read(self, partition: _Range) -> Iterator:
        n = (partition.stop - partition.start) * self.inner
        block = np.fromfile(self.path, "<f8", n, offset=8 * partition.start * self.inner)
        if len(block) != n:
            raise ArrayError(f"{self.path} is too short")
        shape = [partition.stop - partition.start, *self.grid.shape[1:]]
        yield self.grid.batch(block.reshape(shape), [partition.start] + [0] * (len(shape) - 1))


def read_raw(spark: SparkSession, path: str, dims: list[str], shape: list[int], rows: int = 0, name: str = "") -> LabeledArray:
    local = path.removeprefix("file://")
    if os.path.getsize(local) != 8 * math.prod(shape):
        raise ArrayError(f"{path} does not hold {math.prod(shape)} numbers")
    spark.dataSource.register(RawSource)
    df = spark.read.format("axisframe_raw").options(dims=",".join(dims), shape=",".join(map(str, shape)), rows=str(rows)).load(local)
    return Grid(dims, shape, {}, name).array(df)
