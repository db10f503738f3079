"""Selection by position and by label, masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .base import ArrayError, L, P, T, V, small


class Selection:
    def isel(self, dim: str, index: int):
        """One position; the dimension goes."""
        self.need(dim)
        if not 0 <= index < self.size(dim):
            raise ArrayError(f"position {index} is outside of {dim!r} with {self.size(dim)}")
        return self._new(self.df.filter(F.col(P(dim)) == index), dims=[d for d in self.dims if d != dim])

    def sel(self, dim: str, label: float):
        """The first position with this label; the dimension goes."""
        self.need_label(dim)
        return self._at(dim, F.col(L(dim)) == F.lit(label), label)

    def sel_text(self, dim: str, label: str):
        if dim not in self.texts:
            raise ArrayError(f"dimension {dim!r} has no text labels")
        return self._at(dim, F.col(T(dim)) == label, label)

    def _at(self, dim: str, where: Column, label):
        if isinstance(label, float) and label != label:
            raise ArrayError("NaN is no label to select by")
        found = self.df.filter(where).agg(F.min(P(dim))).first()[0]
        if found is None:
            raise ArrayError(f"no label {label!r} along {dim!r}")
        return self._new(self.df.filter(F.col(P(dim)) == found), dims=[d for d in self.dims if d != dim])

    def _nearest(self, dim: str, label: float) -> int:
        self.need_label(dim)
        near = F.min(F.struct(F.abs(F.col(L(dim)) - F.lit(label)).alias("far"), F.col(P(dim)).alias("p")))
        found = self.df.filter(~F.isnan(F.col(L(dim)).cast("double"))).agg(near.alias("x")).first()["x"]
        if found is None:
            raise ArrayError(f"no labels along {dim!r}")
        return found["p"]

    def sel_nearest(self, dim: str, label: float):
        """The position whose label is nearest, the first of equally near ones."""
        found = self._nearest(dim, label)
        return self._new(self.df.filter(F.col(P(dim)) == found), dims=[d for d in self.dims if d != dim])

    def sel_nearest_keep(self, dim: str, label: float):
        return self.take(dim, [self._nearest(dim, label)])

    def sel_nearest_many(self, dim: str, labels: Sequence[float]):
        return self.take(dim, [self._nearest(dim, x) for x in labels])

    def sel_range(self, dim: str, low: float, high: float):
        """Labels in the closed interval; swapped bounds are put in order."""
        self.need_label(dim)
        low, high = min(low, high), max(low, high)
        cut = self.df.filter(F.col(L(dim)).between(low, high) & ~F.isnan(F.col(L(dim)).cast("double")))
        if not cut.limit(1).count():
            raise ArrayError(f"no labels of {dim!r} in [{low}, {high}]")
        return self._new(cut, sizes=self._sizes | {dim: None})._repacked(dim)

    def sel_many(self, dim: str, labels: Sequence[float]):
        """Exact labels in the order asked for; of equal labels the last."""
        self.need_label(dim)
        return self._many(dim, L(dim), labels)

    def sel_text_many(self, dim: str, labels: Sequence[str]):
        if dim not in self.texts:
            raise ArrayError(f"dimension {dim!r} has no text labels")
        return self._many(dim, T(dim), labels)

    def _many(self, dim: str, label: str, labels: Sequence):
        rows = self.df.filter(F.col(label).isin(list(labels))).groupBy(label).agg(F.max(P(dim)).alias("p")).collect()  # a row per label asked for
        found = {r[label]: r["p"] for r in rows}
        missing = [x for x in labels if x not in found]
        if missing:
            raise ArrayError(f"no label {missing[0]!r} along {dim!r}")
        return self.take(dim, [found[x] for x in labels])

    def take(self, dim: str, positions: Sequence[int]):
        """Positions in the order given, which may repeat."""
        self.need(dim)
        if any(not 0 <= p < self.size(dim) for p in positions):
            raise ArrayError(f"a position is outside of {dim!r} with {self.size(dim)}")
        return self._placed(dim, self.df.sparkSession.createDataFrame(list(enumerate(positions)), "_new long, _old long"), len(positions))

    def _placed(self, dim: str, places: DataFrame, size: int | None):
        """Cells moved from ``_old`` to ``_new`` positions of a dimension."""
        moved = self.df.join(small(places), F.col(P(dim)) == F.col("_old")).withColumn(P(dim), F.col("_new").cast("long"))
        return self._new(moved, sizes=self._sizes | {dim: size})

    def _repacked(self, dim: str):
        """Positions renumbered from 0 in their order, without gaps."""
        from .base import number

        axis = self.df.select(F.col(P(dim)).alias("_old")).distinct()
        return self._placed(dim, number(axis, [F.col("_old")], "_new"), None)

    def where(self, keep: Callable[[Column], Column], other: float = float("nan")):
        """Cells for which ``keep(cell)`` holds; ``other`` elsewhere."""
        return self._new(self.df.withColumn(V, F.when(keep(F.col(V)), F.col(V)).otherwise(F.lit(other))))

    def where_mask(self, mask, other: float = float("nan")):
        """Cells where ``mask`` at the same position is not 0 (NaN keeps)."""
        if mask.dims != self.dims or mask.shape != self.shape:
            raise ArrayError("the mask's dimensions or sizes differ")
        m = mask.df.select(*[F.col(P(d)).alias(f"_{P(d)}") for d in self.dims], F.col(V).alias("_m"))
        both = self.df.join(m, [F.col(P(d)) == F.col(f"_{P(d)}") for d in self.dims], "left")
        return self._new(both.withColumn(V, F.when(F.col("_m") != 0, F.col(V)).otherwise(F.lit(other))))

    def box(self, x: str, y: str, bounds: tuple[float, float, float, float]):
        """(min x, min y, max x, max y) in labels."""
        return self.sel_range(x, bounds[0], bounds[2]).sel_range(y, bounds[1], bounds[3])

    def point(self, x_dim: str, y_dim: str, x: float, y: float) -> float:
        """The cell nearest to a point of a grid of two dimensions."""
        if set(self.dims) != {x_dim, y_dim}:
            raise ArrayError("a point needs exactly these two dimensions")
        return self.sel_nearest(x_dim, x).sel_nearest(y_dim, y).flat()[0]
