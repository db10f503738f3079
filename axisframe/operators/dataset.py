"""Datasets: named arrays that share dimensions and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from .align import ADD, DIV, MUL, SUB
from .base import ArrayError


class LabeledDataset:
    """Arrays by name. Sizes and labels of shared dimensions must agree."""

    def __init__(self, arrays: dict, check: bool = True):
        self.arrays = {k: a.renamed(k) for k, a in arrays.items()}
        if check:
            self._check()

    def _check(self) -> None:
        from .align import _same_axis

        first: dict = {}
        for name, a in self.arrays.items():
            for d in a.dims:
                if d not in first:
                    first[d] = a
                    continue
                b = first[d]
                if a.size(d) != b.size(d):
                    raise ArrayError(f"{name}: {d!r} has {a.size(d)} positions, elsewhere {b.size(d)}")
                if d in a.labelled and d in b.labelled and not _same_axis(a, b, d):
                    raise ArrayError(f"{name}: labels of {d!r} differ")
                if d in a.labelled and d not in b.labelled:
                    first[d] = a

    @property
    def names(self) -> list[str]:
        return sorted(self.arrays)

    @property
    def sizes(self) -> dict[str, int]:
        return {d: a.size(d) for a in self.arrays.values() for d in a.dims}

    def __getitem__(self, name: str):
        if name not in self.arrays:
            raise ArrayError(f"no variable {name!r}")
        return self.arrays[name]

    def labels(self, dim: str) -> list:
        for a in self.arrays.values():
            if dim in a.labelled:
                return a.labels(dim)
        raise ArrayError(f"no labels of {dim!r}")

    def with_var(self, name: str, array):
        return LabeledDataset(self.arrays | {name: array})

    def drop_vars(self, *names: str):
        return LabeledDataset({k: a for k, a in self.arrays.items() if k not in names}, check=False)

    def merge(self, other: LabeledDataset):
        """All variables of both; the right one wins where both have a name."""
        return LabeledDataset(self.arrays | other.arrays)

    def _map(self, dim: str | None, f: Callable) -> LabeledDataset:
        """``f`` on the variables that have ``dim``; the others stay."""
        if dim is not None and not any(a.has_dim(dim) for a in self.arrays.values()):
            raise ArrayError(f"no variable has dimension {dim!r}")
        return LabeledDataset({k: f(a) if dim is None or a.has_dim(dim) else a for k, a in self.arrays.items()}, check=False)

    def _converted(self, dim: str, f: Callable) -> LabeledDataset:
        """The same where values take a new type: variables without ``dim`` are
        converted, which leaves their attributes and text labels behind."""
        bare = lambda a: a if a.has_dim(dim) else a._new(a.df, texts=(), attrs={}, coord_attrs={})
        return LabeledDataset({k: bare(a) for k, a in self.arrays.items()}, check=False)._map(dim, f)

    def isel(self, dim: str, index: int):
        return self._map(dim, lambda a: a.isel(dim, index))

    def sel(self, dim: str, label: float):
        return self._map(dim, lambda a: a.sel(dim, label))

    def reduce(self, dim: str, how):
        return self._converted(dim, lambda a: a.reduce(dim, how))

    def cumsum(self, dim: str):
        return self._map(dim, lambda a: a.cumsum(dim))

    def fillna(self, value: float):
        return self._map(None, lambda a: a.fillna(value))

    def add_scalar(self, s: float):
        return self._map(None, lambda a: a.add_scalar(s))

    def mul_scalar(self, s: float):
        return self._map(None, lambda a: a.mul_scalar(s))

    def rolling(self, dim: str, width: int) -> _Each:
        return _Each(self, dim, lambda a: a.rolling(dim, width))

    def group_by(self, dim: str) -> _Each:
        return _Each(self, dim, lambda a: a.group_by(dim))

    def resample(self, dim: str, width: float) -> _Each:
        return _Each(self, dim, lambda a: a.resample(dim, width))

    def coarsen(self, dim: str, factor: int) -> _Each:
        return _Each(self, dim, lambda a: a.coarsen(dim, factor))

    def group_by_bins(self, dim: str, edges: Sequence[float]) -> _Each:
        return _Each(self, dim, lambda a: a.group_by_bins(dim, edges))

    def resample_calendar(self, dim: str, period: str) -> _Each:
        return _Each(self, dim, lambda a: a.resample_calendar(dim, period))

    def group_by_time(self, dim: str, component: str) -> _Each:
        return _Each(self, dim, lambda a: a.group_by_time(dim, component))

    def _with(self, other: LabeledDataset, op) -> LabeledDataset:
        missing = [k for k in self.arrays if k not in other.arrays]
        if missing:
            raise ArrayError(f"the right side has no variable {missing[0]!r}")
        return LabeledDataset({k: a.combine(other[k], op) for k, a in self.arrays.items()}, check=False)

    def __add__(self, other):
        return self._with(other, ADD)

    def __sub__(self, other):
        return self._with(other, SUB)

    def __mul__(self, other):
        return self._with(other, MUL)

    def __truediv__(self, other):
        return self._with(other, DIV)

    def __repr__(self) -> str:
        return "<LabeledDataset " + ", ".join(map(repr, (self.arrays[k] for k in self.names))) + ">"


for _name in ("sum", "mean", "min", "max", "var", "std", "median"):
    setattr(LabeledDataset, _name, lambda self, dim, how=_name: self.reduce(dim, how))


class _Each:
    """The same grouping or window on every variable with the dimension."""

    def __init__(self, dataset: LabeledDataset, dim: str, make: Callable):
        self.dataset, self.dim, self.make = dataset, dim, make

    def n_groups(self) -> int:
        return self.make(next(a for a in self.dataset.arrays.values() if a.has_dim(self.dim))).n_groups()

    def agg(self, how):
        return self.dataset._converted(self.dim, lambda a: self.make(a).agg(how))

    def sum(self):
        return self.agg("sum")

    def mean(self):
        return self.agg("mean")

    def min(self):
        return self.agg("min")

    def max(self):
        return self.agg("max")
