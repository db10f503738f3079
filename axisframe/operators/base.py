"""The relational form of a labelled array.

One row per cell: a position column ``P_<dim>`` for each dimension, a numeric
label column ``L_<dim>`` and a text label column ``T_<dim>`` where the dimension
has them, and the value ``v``. Positions are the key, labels may repeat. Sizes,
dimension order, name and attributes live in the driver's object; operators
only build plans, except where a rule needs a look at the data (a missing
label is an error), which is one small aggregate.
"""

from __future__ import annotations

import copy
import math
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T_

V = "v"
#: Cells per block of scans along a dimension.
BLOCK_CELLS = 100_000
#: Axis rows up to which an axis is broadcast.
BROADCAST_ROWS = 200_000


def P(dim: str) -> str:
    return f"P_{dim}"


def L(dim: str) -> str:
    return f"L_{dim}"


def T(dim: str) -> str:
    return f"T_{dim}"


class ArrayError(ValueError):
    """A request that the array's dimensions, labels or sizes do not allow."""


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode without that
    setting, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="axisframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """Rows numbered from 0 in order, and how many there are. Up to
    ``BROADCAST_ROWS`` rows are sorted and numbered at once; beyond, ranges of
    the order are written, counted and numbered side by side, so that no task
    holds them all."""
    found = df.orderBy(*order).limit(BROADCAST_ROWS + 1).toArrow()
    if found.num_rows <= BROADCAST_ROWS:
        schema = T_.StructType([*df.schema.fields, T_.StructField(name, T_.LongType())])
        return df.sparkSession.createDataFrame(found.append_column(name, pa.array(range(found.num_rows), pa.int64())), schema), found.num_rows
    df = settled(df)
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = before.select(F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_own", own).join(F.broadcast(before), F.col("_part") == F.col("_q")).withColumn(name, (F.col("_base") + F.col("_own") - 1).cast("long")).drop("_part", "_q", "_own", "_base")
    return out, ranged.count()


def number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    return numbered(df, order, name)[0]


class Base:
    """Construction, metadata and materialisation."""

    def __init__(
        self, df: DataFrame, dims: Sequence[str], sizes: dict[str, int | None] | None = None, labelled: Iterable[str] = (),
        texts: Iterable[str] = (), name: str = "", attrs: dict[str, str] | None = None, coord_attrs: dict[str, dict[str, str]] | None = None,
    ):
        if len(set(dims)) != len(dims) or not all(dims):
            raise ArrayError("dimension names must be distinct and not empty")
        self.dims = tuple(dims)
        self._sizes: dict[str, int | None] = {d: (sizes or {}).get(d) for d in self.dims}
        self.labelled = frozenset(labelled) & set(dims)
        self.texts = frozenset(texts) & set(dims)
        self.name, self.attrs, self.coord_attrs = name, dict(attrs or {}), copy.deepcopy(coord_attrs or {})
        self._axes: dict[str, DataFrame] = {}  # known without a look at the cells
        self.df = df.select(*self.columns())

    def columns(self, without: str | None = None) -> list[str]:
        keep = [d for d in self.dims if d != without]
        return [P(d) for d in keep] + [L(d) for d in keep if d in self.labelled] + [T(d) for d in keep if d in self.texts] + [V]

    def keys(self, without: Iterable[str] = ()) -> list[str]:
        """Position and label columns of all other dimensions."""
        keep = [d for d in self.dims if d not in set(without)]
        return [P(d) for d in keep] + [L(d) for d in keep if d in self.labelled] + [T(d) for d in keep if d in self.texts]

    def _new(self, df: DataFrame, same_axes: bool = False, **changes: Any):
        """An array with ``df`` and ``changes``; ``same_axes`` says that the
        dimensions that stay keep positions and labels."""
        own = {"dims": self.dims, "sizes": self._sizes, "labelled": self.labelled, "texts": self.texts, "name": self.name, "attrs": self.attrs, "coord_attrs": self.coord_attrs}
        made = type(self)(df, **(own | changes))
        if same_axes:
            for d in made.dims:
                columns = [P(d)] + [L(d)] * (d in made.labelled) + [T(d)] * (d in made.texts)
                if d in self._axes and set(columns) <= set(self._axes[d].columns):
                    made._axes[d] = self._axes[d].select(*columns)
        return made

    @classmethod
    def from_flat(
        cls, spark: SparkSession, dims: Sequence[str], shape: Sequence[int], data: Sequence, coords: dict[str, Sequence] | None = None,
        name: str = "", texts: dict[str, Sequence[str]] | None = None, attrs: dict[str, str] | None = None, kind: str = "double",
    ):
        """From values in C order, with label vectors by dimension."""
        dims, shape, coords, texts = list(dims), list(shape), coords or {}, texts or {}
        if len(dims) != len(shape):
            raise ArrayError(f"{len(dims)} dimensions but {len(shape)} sizes")
        if any(s < 0 for s in shape):
            raise ArrayError("sizes must not be negative")
        if math.prod(shape) != len(data):
            raise ArrayError(f"{math.prod(shape)} cells but {len(data)} values")
        for d, labels in [*coords.items(), *texts.items()]:
            if d not in dims or len(labels) != shape[dims.index(d)]:
                raise ArrayError(f"labels of {d!r} do not fit")
        number_ = (lambda x: float(x)) if kind in ("double", "float") else int
        steps = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
        rows = []
        for i, x in enumerate(data):
            at = [i // s % n for s, n in zip(steps, shape)]
            rows.append((*at, *[number_(coords[d][at[dims.index(d)]]) for d in dims if d in coords], *[texts[d][at[dims.index(d)]] for d in dims if d in texts], number_(x)))
        schema = ", ".join([f"`{P(d)}` long" for d in dims] + [f"`{L(d)}` {kind}" for d in dims if d in coords] + [f"`{T(d)}` string" for d in dims if d in texts] + [f"{V} {kind}"])
        return cls(spark.createDataFrame(rows, schema), dims, dict(zip(dims, shape)), coords, texts, name, attrs)

    @classmethod
    def from_table(cls, table: DataFrame, dims: Sequence[str], value: Column | str, name: str = "", text_dims: Sequence[str] = ()):
        """From a table with one row per cell: labels of each dimension are the
        distinct values in order, positions their ranks. Absent cells stay
        absent; :meth:`dense` fills them. A null label is one, the first. The
        table is read once: its cells are written, and axes come from those."""
        value = F.col(value) if isinstance(value, str) else value
        out = settled(table.select(*[F.col(d) for d in dims], value.alias(V)))
        sizes, axes = {}, {}
        for d in dims:
            axis, sizes[d] = numbered(out.select(d).distinct(), [F.col(d).asc()], P(d))
            axis = axis.withColumnRenamed(d, "_label")
            axes[d] = axis.select(P(d), F.col("_label").alias(T(d) if d in text_dims else L(d)))
            out = out.join(F.broadcast(axis) if sizes[d] <= BROADCAST_ROWS else axis, F.col(d).eqNullSafe(F.col("_label"))).drop("_label")
            out = out.withColumnRenamed(d, T(d) if d in text_dims else L(d))
        made = cls(out, dims, sizes, [d for d in dims if d not in text_dims], text_dims, name)
        made._axes = axes
        return made

    # -- metadata
    def size(self, dim: str) -> int:
        self.need(dim)
        if self._sizes[dim] is None:
            last = self.df.agg(F.max(P(dim))).first()[0]
            self._sizes[dim] = 0 if last is None else last + 1
        return self._sizes[dim]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.size(d) for d in self.dims)

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def n_cells(self) -> int:
        return math.prod(self.shape)

    def has_dim(self, dim: str) -> bool:
        return dim in self.dims

    def need(self, *dims: str) -> None:
        for d in dims:
            if d not in self.dims:
                raise ArrayError(f"no dimension {d!r} in {self.dims}")

    def need_label(self, dim: str) -> None:
        self.need(dim)
        if dim not in self.labelled:
            raise ArrayError(f"dimension {dim!r} has no labels")

    def renamed(self, name: str):
        return self._new(self.df, name=name)

    def with_attr(self, key: str, value: str):
        return self._new(self.df, attrs=self.attrs | {key: value})

    def with_coord_attr(self, dim: str, key: str, value: str):
        return self._new(self.df, coord_attrs=self.coord_attrs | {dim: self.coord_attrs.get(dim, {}) | {key: value}})

    def with_text_labels(self, dim: str, labels: Sequence[str]):
        self.need(dim)
        if len(labels) != self.size(dim):
            raise ArrayError(f"{len(labels)} labels for {self.size(dim)} positions")
        axis = self.df.sparkSession.createDataFrame(list(enumerate(labels)), f"_p long, `{T(dim)}` string")
        return self._new(self.df.drop(T(dim)).join(small(axis), F.col(P(dim)) == F.col("_p")), texts=self.texts | {dim})

    def axis(self, dim: str) -> DataFrame:
        """Distinct positions of a dimension with their labels."""
        self.need(dim)
        if dim in self._axes:
            return self._axes[dim]
        label = [L(dim)] if dim in self.labelled else []
        text = [T(dim)] if dim in self.texts else []
        return self.df.groupBy(P(dim)).agg(*[F.first(c).alias(c) for c in [*label, *text]] or [F.count(F.lit(1)).alias("_n")]).select(P(dim), *label, *text)

    def labels(self, dim: str) -> list:
        """The label vector; as long as the dimension."""
        self.need_label(dim)
        return [r[1] for r in self.axis(dim).orderBy(P(dim)).select(P(dim), L(dim)).collect()]

    def text_labels(self, dim: str) -> list[str]:
        if dim not in self.texts:
            raise ArrayError(f"dimension {dim!r} has no text labels")
        return [r[1] for r in self.axis(dim).orderBy(P(dim)).select(P(dim), T(dim)).collect()]

    def flat(self) -> list:
        """All values in C order, on the driver; for small arrays."""
        ordered = self.df.orderBy(*[P(d) for d in self.dims]) if self.dims else self.df
        return [r[V] for r in ordered.select(V).collect()]

    def at(self, *index: int):
        if len(index) != len(self.dims) or any(not 0 <= i < self.size(d) for i, d in zip(index, self.dims)):
            raise ArrayError(f"index {index} is outside of {self.shape}")
        row = self.df.filter(" and ".join([f"`{P(d)}` = {i}" for i, d in zip(index, self.dims)] or ["true"])).select(V).first()
        return row[0] if row else float("nan")

    def grid(self) -> DataFrame:
        """Every position of the full array. Each axis is a range, and Spark
        generates their product cell by cell."""
        spark = self.df.sparkSession
        sizes = [self.size(d) for d in self.dims]
        steps = [math.prod(sizes[i + 1 :]) for i in range(len(sizes))]
        flat = spark.range(math.prod(sizes))
        return flat.select(*[(F.floor(F.col("id") / s) % n if n else F.lit(0)).cast("long").alias(P(d)) for d, s, n in zip(self.dims, steps, sizes)])

    def dense(self, fill: float = float("nan")):
        """With all cells present, ``fill`` in those that were absent."""
        full = self.grid()
        for d in self.dims:
            if d in self.labelled | self.texts:
                full = full.join(small(self.axis(d)), P(d))
        cells = self.df.select(*[F.col(P(d)).alias(f"_{P(d)}") for d in self.dims], V)
        on = [F.col(P(d)) == F.col(f"_{P(d)}") for d in self.dims]
        return self._new(full.join(cells, on, "left").withColumn(V, F.coalesce(V, F.lit(fill))))

    def __repr__(self) -> str:
        parts = ", ".join(f"{d}={self._sizes[d] if self._sizes[d] is not None else '?'}" for d in self.dims)
        return f"<LabeledArray {self.name!r} ({parts}) labels: {', '.join(d for d in self.dims if d in self.labelled) or 'none'}>"

    def block_of(self, dim: str, cells: int | None = None) -> Column:
        """Blocks of positions along a dimension, for scans that no single
        task could hold."""
        return F.floor(F.col(P(dim)) / (cells or BLOCK_CELLS))

    def others(self, dim: str) -> list[str]:
        return [P(d) for d in self.dims if d != dim]

    def _over(self, dim: str, *more: str) -> Any:
        return Window.partitionBy(*self.others(dim), *more).orderBy(P(dim))
