"""NetCDF classic files (CDF-1): writer, and reader with one record dimension.

The header is parsed once on the driver; values are read by a Python data
source, a range of the leading dimension to a partition.
"""

from __future__ import annotations

import math
import shutil
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..array import ArrayError, LabeledArray
from ..operators.dataset import LabeledDataset
from .cells import Grid, collected, grid_of

#: Fixed values of the format: tags of the header lists, and types by number.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CELLS_PER_PARTITION = 1 << 20


@dataclass
class Variable:
    name: str
    dims: list[int]
    attrs: dict[str, str]
    kind: int
    size: int
    begin: int
    record: bool


@dataclass
class Header:
    dims: list[tuple[str, int]]
    attrs: dict[str, str]
    variables: list[Variable]
    records: int

    def shape(self, v: Variable) -> list[int]:
        return [self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in v.dims]

    def record_bytes(self) -> int:
        """Distance of two records. A lone record variable is not padded."""
        own = [v for v in self.variables if v.record]
        if len(own) == 1:
            v = own[0]
            return math.prod(self.shape(v)[1:]) * np.dtype(TYPES[v.kind]).itemsize
        return sum(v.size for v in own)


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        (x,) = struct.unpack_from(">i", self.data, self.at)
        self.at += 4
        return x

    def name(self) -> str:
        n = self.number()
        x = self.data[self.at : self.at + n].decode("utf-8")
        self.at += -(-n // 4) * 4
        return x

    def items(self, tag: int) -> int:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise ArrayError(f"header list {found} where {tag} belongs")
        return n

    def attributes(self) -> dict[str, str]:
        out = {}
        for _ in range(self.items(ATTRIBUTE)):
            key, kind, n = self.name(), self.number(), self.number()
            width = np.dtype(TYPES[kind]).itemsize * n
            raw = self.data[self.at : self.at + width]
            self.at += -(-width // 4) * 4
            out[key] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else " ".join(f"{x:g}" if kind > 4 else str(x) for x in np.frombuffer(raw, TYPES[kind]).tolist())
        return out


def parse_header(data: bytes) -> Header:
    if data[:4] != b"CDF\x01":
        raise ArrayError("not a CDF-1 file")
    b = _Bytes(data)
    b.at = 4
    records = b.number()
    dims = [(b.name(), b.number()) for _ in range(b.items(DIMENSION))]
    attrs, variables = b.attributes(), []
    for _ in range(b.items(VARIABLE)):
        name = b.name()
        ids = [b.number() for _ in range(b.number())]
        own, kind, size, begin = b.attributes(), b.number(), b.number(), b.number()
        variables.append(Variable(name, ids, own, kind, size, begin, bool(ids) and dims[ids[0]][1] == 0))
    return Header(dims, attrs, variables, max(0, records))


def _open(path: str) -> tuple[np.memmap, Header]:
    data = np.memmap(path, np.uint8, "r")
    for size in (1 << 16, 1 << 20, 1 << 24, len(data)):
        try:
            return data, parse_header(bytes(data[:size]))
        except (struct.error, IndexError):
            if size >= len(data):
                raise ArrayError("the header is cut short") from None
    raise ArrayError("no header")


def _rows(data: np.ndarray, h: Header, v: Variable, start: int, stop: int) -> np.ndarray:
    """Positions [start, stop) of the leading dimension (all of a scalar)."""
    shape, kind = h.shape(v), np.dtype(TYPES[v.kind])
    inner = math.prod(shape[1:]) if shape else 1
    if not v.record:
        at = v.begin + start * inner * kind.itemsize
        n = (stop - start) * inner if shape else 1
        return np.frombuffer(data[at : at + n * kind.itemsize].tobytes(), kind).astype(float).reshape([stop - start, *shape[1:]] if shape else [])
    step = h.record_bytes()
    parts = [np.frombuffer(data[v.begin + r * step : v.begin + r * step + inner * kind.itemsize].tobytes(), kind) for r in range(start, stop)]
    return np.concatenate(parts).astype(float).reshape([stop - start, *shape[1:]]) if parts else np.zeros([0, *shape[1:]])


def _grid(data: np.ndarray, h: Header, name: str) -> Grid:
    v = next((v for v in h.variables if v.name == name), None)
    if v is None:
        raise ArrayError(f"no variable {name!r}")
    dims, coords, notes = [h.dims[d][0] for d in v.dims], {}, {}
    for own in h.variables:
        if own.name in dims and [h.dims[d][0] for d in own.dims] == [own.name] and own.name != name:
            coords[own.name] = _rows(data, h, own, 0, h.shape(own)[0]).tolist()
            notes[own.name] = own.attrs
    return Grid(dims, h.shape(v), coords, name, v.attrs, notes)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NetCDFSource(DataSource):
    """``format("axisframe_netcdf").option("variable", name).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "axisframe_netcdf"

    def schema(self) -> str:
        return _grid(*_open(_local(self.options["path"])), self.options["variable"]).schema()

    def reader(self, schema) -> DataSourceReader:
        return NetCDFReader(_local(self.options["path"]), self.options["variable"])


class NetCDFReader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path, self.variable = path, variable

    def partitions(self) -> list[InputPartition]:
        _, h = _open(self.path)
        shape = h.shape(next(v for v in h.variables if v.name == self.variable))
        if not shape:
            return [_Range(0, 1)]
        step = max(1, CELLS_PER_PARTITION // max(1, math.prod(shape[1:])))
        return [_Range(i, min(shape[0], i + step)) for i in range(0, shape[0], step)]

    def read(self, partition: _Range) -> Iterator:
        data, h = _open(self.path)
        v = next(v for v in h.variables if v.name == self.variable)
        block = _rows(data, h, v, partition.start, partition.stop)
        yield _grid(data, h, self.variable).batch(block, [partition.start] + [0] * (block.ndim - 1))


def _local(path: str) -> str:
    return path.removeprefix("file://")


def read_netcdf(spark: SparkSession, path: str) -> LabeledDataset:
    """All variables that are no label vectors of a dimension."""
    spark.dataSource.register(NetCDFSource)
    data, h = _open(_local(path))
    names = [v.name for v in h.variables if not (len(v.dims) == 1 and h.dims[v.dims[0]][0] == v.name) and v.kind != 2]
    out = {}
    for k in names:
        df = spark.read.format("axisframe_netcdf").option("variable", k).load(_local(path))
        out[k] = _grid(data, h, k).array(df)
    return LabeledDataset(out, check=False)


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(attrs: dict[str, str]) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTE, len(attrs))
    for k in sorted(attrs):
        raw = str(attrs[k]).encode()
        out += _name(k) + struct.pack(">ii", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4)
    return out


def to_netcdf(ds: LabeledDataset, kind: str = "double") -> bytes:
    """A CDF-1 file with fixed dimensions; the values pass through the driver,
    as the format is one file."""
    number = {"double": 6, "float": 5, "int": 4, "short": 3, "byte": 1}[kind]
    dims: dict[str, int] = {}
    parts: list[tuple[str, list[str], dict[str, str], np.ndarray]] = []
    for k in ds.names:
        g = grid_of(ds[k])
        dims |= dict(zip(g.dims, g.shape))
        for d, labels in g.coords.items():
            if d not in [p[0] for p in parts]:
                parts.append((d, [d], g.coord_attrs.get(d, {}), np.asarray(labels)))
        parts.append((k, g.dims, g.attrs, collected(ds[k])))
    index = {d: i for i, d in enumerate(dims)}
    head = b"CDF\x01" + struct.pack(">i", 0)
    head += struct.pack(">ii", DIMENSION, len(dims)) if dims else struct.pack(">ii", 0, 0)
    head += b"".join(_name(d) + struct.pack(">i", n) for d, n in dims.items())
    head += _attributes({}) + (struct.pack(">ii", VARIABLE, len(parts)) if parts else struct.pack(">ii", 0, 0))
    bodies = []
    for _, _, _, values in parts:
        raw = np.ascontiguousarray(values).astype(TYPES[number]).tobytes()
        bodies.append(raw + b"\0" * (-len(raw) % 4))
    entries = [_name(k) + struct.pack(f">i{len(ds_)}i", len(ds_), *[index[d] for d in ds_]) + _attributes(attrs) + struct.pack(">i", number) for k, ds_, attrs, _ in parts]
    at = len(head) + sum(len(e) + 8 for e in entries)
    for e, body in zip(entries, bodies):
        head += e + struct.pack(">ii", len(body), at)
        at += len(body)
    return head + b"".join(bodies)


def array_to_netcdf(array: LabeledArray, kind: str = "double") -> bytes:
    return to_netcdf(LabeledDataset({array.name or "data": array}), kind)


#: First bytes of the kinds of files.
MAGIC = {b"CDF\x01": "classic", b"CDF\x02": "64-bit offset", b"CDF\x05": "64-bit data", b"\x89HDF": "netCDF-4"}


def sniff(path: str) -> str:
    with open(_local(path), "rb") as f:
        return MAGIC.get(f.read(4), "unknown")


def find_converter() -> tuple[str, str] | None:
    """A program that rewrites other kinds as classic files, if installed."""
    for tool in ("nccopy", "cdo"):
        if found := shutil.which(tool):
            return tool, found
    return None


def open_netcdf(spark: SparkSession, path: str) -> LabeledDataset:
    """Reads classic files, and others through a converter next to them."""
    kind = sniff(path)
    if kind == "classic":
        return read_netcdf(spark, path)
    if kind == "unknown":
        raise ArrayError(f"{path} is no netCDF file")
    tool = find_converter()
    if tool is None:
        raise ArrayError(f"{kind} files need nccopy or cdo")
    import subprocess

    out = _local(path) + ".classic.nc"
    command = [tool[1], "-k", "classic", _local(path), out] if tool[0] == "nccopy" else [tool[1], "-f", "nc1", "copy", _local(path), out]
    subprocess.run(command, check=True, capture_output=True)
    return read_netcdf(spark, out)
