"""Cell by cell arithmetic with alignment by label and broadcasting by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric
from .base import ArrayError, L, P, V, number, small

JOINS = ("inner", "outer", "left", "right")
Op = Callable[[Column, Column], Column]

ADD: Op = lambda x, y: x + y
SUB: Op = lambda x, y: x - y
MUL: Op = lambda x, y: x * y
DIV: Op = numeric.ieee_div


def _same_axis(a, b, dim: str) -> bool:
    """Whether two label vectors agree position by position (NaN with none)."""
    if a.df is b.df:
        return True
    if a.size(dim) != b.size(dim):
        return False
    mark = lambda x: x.axis(dim).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(P(dim), F.col(L(dim)).cast("double"))), F.count(F.when(F.isnan(F.col(L(dim)).cast("double")), 1))).first()
    left, right = mark(a), mark(b)
    return tuple(left) == tuple(right) and not left[2]


def _places(a, b, dim: str, join: str) -> DataFrame:
    """``_new, _a, _b, _label``: positions of a joined label list on both
    sides. On the right, and wherever one label must be found, the last of
    equal labels stands for all; NaN is found nowhere."""
    left = a.axis(dim).select(F.col(P(dim)).alias("_a"), F.col(L(dim)).alias("_la"))
    right = b.axis(dim).select(F.col(P(dim)).alias("_b"), F.col(L(dim)).alias("_lb"))
    last = lambda df, p, x: df.filter(~numeric.nan_at(F.col(x))).groupBy(x).agg(F.max(p).alias(p))
    if join == "inner":
        out = left.join(last(right, "_b", "_lb"), F.col("_la") == F.col("_lb")).withColumn("_label", F.col("_la"))
        order = [F.col("_a")]
    elif join == "left":
        out = left.select("_la", F.col("_a").alias("_o")).join(last(left, "_a", "_la").withColumnRenamed("_la", "_l2"), F.col("_la") == F.col("_l2"), "left")
        out = out.join(last(right, "_b", "_lb"), F.col("_la") == F.col("_lb"), "left").withColumn("_label", F.col("_la"))
        order = [F.col("_o")]
    elif join == "right":
        out = right.select("_lb", F.col("_b").alias("_o")).join(last(right, "_b", "_lb").withColumnRenamed("_lb", "_l2"), F.col("_lb") == F.col("_l2"), "left")
        out = out.join(last(left, "_a", "_la"), F.col("_lb") == F.col("_la"), "left").withColumn("_label", F.col("_lb"))
        order = [F.col("_o")]
    else:
        seen = left.select(F.col("_la").alias("_seen")).distinct()
        extra = right.groupBy("_lb").agg(F.min("_b").alias("_o")).join(seen, F.col("_lb") == F.col("_seen"), "left_anti")
        target = left.select(F.col("_la").alias("_label"), F.lit(0).alias("_side"), F.col("_a").alias("_o")).unionByName(extra.select(F.col("_lb").alias("_label"), F.lit(1).alias("_side"), "_o"))
        out = target.join(last(left, "_a", "_la"), F.col("_label") == F.col("_la"), "left").join(last(right, "_b", "_lb"), F.col("_label") == F.col("_lb"), "left")
        order = [F.col("_side"), F.col("_o")]
    return number(out, order, "_new").select("_new", "_a", "_b", "_label")


def _filled(cells: DataFrame, at: str, places: DataFrame, side: str, label: str) -> DataFrame:
    """With rows, null in value, for the joined positions that a side lacks,
    at every combination of its other columns."""
    value = next(c for c in reversed(cells.columns))
    rest = [c for c in cells.columns if c not in (at, value, label)]
    lacking = places.filter(F.col(side).isNull()).select(F.col("_new").alias(at))
    extra = cells.select(*rest).distinct().crossJoin(small(lacking)) if rest else lacking
    extra = extra.withColumns({c: F.lit(None).cast(cells.schema[c].dataType) for c in cells.columns if c not in extra.columns})
    return cells.unionByName(extra)


class Align:
    def combine(self, other, op: Op, join: str = "inner", fill: float | None = None):
        """``op`` on cells at equal labels of the shared dimensions; other
        dimensions are broadcast by name. The result has the left dimensions,
        then those of the right side alone. Unlabelled shared dimensions go by
        position and must have equal sizes."""
        if join not in JOINS:
            raise ArrayError(f"join {join!r} is none of {JOINS}")
        a, b = self, other
        shared = [d for d in a.dims if d in b.dims]
        left, right = a.df, b.df
        sizes = a._sizes | b._sizes
        moved = []
        for d in shared:
            if d in a.labelled and d in b.labelled:
                if _same_axis(a, b, d):
                    sizes[d] = a.size(d)
                    continue
                places = number_checked(_places(a, b, d, join), d)
                sizes[d] = places.count()
                moved.append((d, places))
            elif a.size(d) != b.size(d):
                raise ArrayError(f"{d!r} has {a.size(d)} and {b.size(d)} positions and labels on one side at most")
        name = {c: f"_r{i}" for i, c in enumerate(b.columns())}
        right = right.select(*[F.col(c).alias(name[c]) for c in b.columns()])
        for d, places in moved:
            left = left.join(small(places.filter("_a is not null").select(F.col("_a").alias("_from"), F.col("_new").alias("_to"))), F.col(P(d)) == F.col("_from")).withColumn(P(d), F.col("_to")).drop("_from", "_to")
            right = right.join(small(places.filter("_b is not null").select(F.col("_b").alias("_from"), F.col("_new").alias("_to"))), F.col(name[P(d)]) == F.col("_from")).withColumn(name[P(d)], F.col("_to")).drop("_from", "_to")
        only = [d for d in b.dims if d not in shared]
        on = [F.col(P(d)) == F.col(name[P(d)]) for d in shared]
        if join == "inner" or not moved:
            both = left.join(right, on) if on else left.crossJoin(right)
        else:
            if only or len(shared) != len(a.dims):
                # a side without some dimension: what it lacks along the joined ones is made explicit, then cells meet
                for d, places in moved:
                    left = _filled(left, P(d), places, "_a", L(d))
                    right = _filled(right, name[P(d)], places, "_b", name[L(d)])
                both = left.join(right, on)
            else:
                both = left.join(right, on, "full")
        x, y = F.col(V), F.col(name[V])
        if fill is not None:
            x, y = F.coalesce(x, F.lit(fill)), F.coalesce(y, F.lit(fill))
        columns = [F.coalesce(P(d), name[P(d)]).alias(P(d)) if d in shared else F.col(P(d)) for d in a.dims]
        columns += [F.col(name[P(d)]).alias(P(d)) for d in only]
        for d in a.dims:
            if d in a.labelled and d not in [m[0] for m in moved]:
                columns.append((F.coalesce(L(d), name[L(d)]) if d in shared and d in b.labelled else F.col(L(d))).alias(L(d)))
            elif d in shared and d in b.labelled and d not in a.labelled:
                columns.append(F.col(name[L(d)]).alias(L(d)))
        columns += [F.col(name[L(d)]).alias(L(d)) for d in only if d in b.labelled]
        out = both.select(*columns, op(x, y).alias(V))
        for d, places in moved:
            out = out.join(small(places.select(F.col("_new").alias("_at"), F.col("_label").alias(L(d)))), F.col(P(d)) == F.col("_at")).drop("_at")
        return a._new(out, dims=[*a.dims, *only], sizes=sizes, labelled=a.labelled | b.labelled, texts=(), attrs={}, coord_attrs=b.coord_attrs | a.coord_attrs)

    def __add__(self, other):
        return self._arith(other, ADD)

    def __sub__(self, other):
        return self._arith(other, SUB)

    def __mul__(self, other):
        return self._arith(other, MUL)

    def __truediv__(self, other):
        return self._arith(other, DIV)

    def _arith(self, other, op: Op):
        if isinstance(other, (int, float)):
            return self._new(self.df.withColumn(V, op(F.col(V), F.lit(other))), same_axes=True, texts=())
        return self.combine(other, op)

    def maximum(self, other):
        return self.combine(other, numeric.larger)

    def minimum(self, other):
        return self.combine(other, numeric.smaller)

    def add_join(self, other, join: str, fill: float):
        return self.combine(other, ADD, join, fill)

    def sub_join(self, other, join: str, fill: float):
        return self.combine(other, SUB, join, fill)

    def mul_join(self, other, join: str, fill: float):
        return self.combine(other, MUL, join, fill)

    def div_join(self, other, join: str, fill: float):
        return self.combine(other, DIV, join, fill)

    def dot(self, other, dim: str):
        """Sum of products over the one shared dimension, by position."""
        shared = [d for d in self.dims if d in other.dims]
        if shared != [dim]:
            raise ArrayError(f"{dim!r} must be the one shared dimension, found {shared}")
        if self.size(dim) != other.size(dim):
            raise ArrayError(f"{dim!r} has {self.size(dim)} and {other.size(dim)} positions")
        rest = [d for d in other.dims if d != dim]
        right = other.df.select(*[F.col(c) for c in other.columns(dim) if c != V and not c.startswith("T_")], F.col(P(dim)).alias("_k"), F.col(V).alias("_w"))
        keys = [c for c in self.keys([dim]) if not c.startswith("T_")] + [c for c in other.keys([dim]) if not c.startswith("T_")]
        out = self.df.join(right, F.col(P(dim)) == F.col("_k")).groupBy(*keys).agg(F.sum(F.col(V) * F.col("_w")).alias(V))
        dims = [d for d in self.dims if d != dim] + rest
        return self._new(out, dims=dims, sizes=self._sizes | other._sizes, labelled=(self.labelled | other.labelled) - {dim}, texts=(), attrs={}, coord_attrs={})

    def bilinear(self, x_dim: str, y_dim: str, x: float, y: float):
        """Value at a point between four grid positions; both dimensions go.
        NaN of a corner stays even if its weight is 0."""
        self.need_label(x_dim)
        self.need_label(y_dim)
        weights = []
        for d, at in ((x_dim, x), (y_dim, y)):
            labels = self.labels(d)
            weights.append(self.df.sparkSession.createDataFrame(bracket(labels, at), f"_p{d} long, _w{d} double"))
        out = self.df
        for d, w in zip((x_dim, y_dim), weights):
            out = out.join(F.broadcast(w), F.col(P(d)) == F.col(f"_p{d}"))  # two rows
        product = F.col(V) * F.col(f"_w{x_dim}") * F.col(f"_w{y_dim}")
        keys = [c for c in self.keys([x_dim, y_dim]) if not c.startswith("T_")]
        return self._new(out.groupBy(*keys).agg(F.sum(product).alias(V)), dims=[d for d in self.dims if d not in (x_dim, y_dim)], texts=())


def bracket(labels: list[float], at: float) -> list[tuple[int, float]]:
    """(position, weight) of the two neighbours between which ``at`` lies, on
    a rising or falling axis; the first such interval."""
    for i in range(len(labels) - 1):
        a, b = labels[i], labels[i + 1]
        if min(a, b) <= at <= max(a, b):
            w = 0.0 if a == b else (at - a) / (b - a)
            return [(i, 1 - w), (i + 1, w)]
    raise ArrayError(f"{at} is outside of the axis")


def number_checked(places: DataFrame, dim: str) -> DataFrame:
    if not places.limit(1).count():
        raise ArrayError(f"no common label along {dim!r}")
    return places
