"""Dimension order and names, concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from .base import ArrayError, L, P, T, V


class Reshape:
    def transpose(self, *dims: str):
        if sorted(dims) != sorted(self.dims):
            raise ArrayError(f"{dims} is no order of {self.dims}")
        return self._new(self.df, dims=dims, texts=())

    def squeeze(self, dim: str):
        if self.size(dim) != 1:
            raise ArrayError(f"{dim!r} has {self.size(dim)} positions")
        return self._new(self.df, dims=[d for d in self.dims if d != dim], texts=(), attrs={}, coord_attrs={})

    def expand_dims(self, dim: str):
        if dim in self.dims:
            raise ArrayError(f"{dim!r} is there already")
        return self._new(self.df.withColumn(P(dim), F.lit(0).cast("long")), dims=(dim, *self.dims), sizes=self._sizes | {dim: 1}, texts=(), attrs={}, coord_attrs={})

    def rename_dim(self, old: str, new: str):
        self.need(old)
        if new in self.dims and new != old:
            raise ArrayError(f"{new!r} is there already")
        swap = lambda ds: [new if d == old else d for d in ds]
        df = self.df.withColumnsRenamed({P(old): P(new), L(old): L(new), T(old): T(new)})
        return self._new(df, dims=swap(self.dims), sizes={new if d == old else d: s for d, s in self._sizes.items()}, labelled=swap(self.labelled), texts=(), attrs={}, coord_attrs={})


def concat(arrays: Sequence, dim: str):
    """Along a dimension that all have; the other sizes must agree. Labels of
    the dimension are kept if all arrays have them."""
    if not arrays:
        raise ArrayError("nothing to concatenate")
    first = arrays[0]
    first.need(dim)
    for a in arrays[1:]:
        if a.dims != first.dims or any(a.size(d) != first.size(d) for d in first.dims if d != dim):
            raise ArrayError("arrays to concatenate must agree in all but one dimension")
    keep = all(dim in a.labelled for a in arrays)
    others = [d for d in first.dims if d != dim]
    labelled = [d for d in others if d in first.labelled]
    columns = [P(d) for d in first.dims] + ([L(dim)] if keep else []) + [V]
    out, before = None, 0
    for a in arrays:
        part = a.df.select(*columns).withColumn(P(dim), F.col(P(dim)) + F.lit(before))
        out = part if out is None else out.unionByName(part)
        before += a.size(dim)
    for d in labelled:
        from .base import small

        axis = first.axis(d).select(F.col(P(d)).alias("_p"), L(d))
        out = out.join(small(axis), F.col(P(d)) == F.col("_p")).drop("_p")
    return first._new(out, sizes={d: first.size(d) for d in others} | {dim: before}, labelled=[*labelled, *([dim] if keep else [])], texts=(), attrs={}, coord_attrs={})


def stack(arrays: Sequence, dim: str, labels: Sequence[float] | None = None):
    """On a new leading dimension, with labels if given."""
    if not arrays or any(a.dims != arrays[0].dims or a.shape != arrays[0].shape for a in arrays):
        raise ArrayError("arrays to stack must have equal dimensions and sizes")
    if dim in arrays[0].dims or (labels is not None and len(labels) != len(arrays)):
        raise ArrayError("the new dimension or its labels do not fit")
    first, out = arrays[0], None
    for i, a in enumerate(arrays):
        part = a.df.select(*[P(d) for d in a.dims], *[L(d) for d in a.dims if d in first.labelled], V).withColumn(P(dim), F.lit(i).cast("long"))
        part = part.withColumn(L(dim), F.lit(float(labels[i]))) if labels is not None else part
        out = part if out is None else out.unionByName(part)
    labelled = set(first.labelled) | ({dim} if labels is not None else set())
    return first._new(out, dims=(dim, *first.dims), sizes={dim: len(arrays)} | dict(zip(first.dims, first.shape)), labelled=labelled, texts=(), attrs={}, coord_attrs={})
