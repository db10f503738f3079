"""Zarr stores, versions 2 and 3, written and read chunk by chunk.

Readers are Python data sources: chunks are dealt to partitions and decoded
there. Stores are folders that driver and executors share.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..array import ArrayError, LabeledArray
from ..operators.dataset import LabeledDataset
from . import codecs
from .cells import Grid, blocks, chunk_starts, grid_of

#: Data type names of version 3 as numpy has them.
V3_TYPES = {"float64": "f8", "float32": "f4", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8"}
CHUNKS_PER_PARTITION = 16


@dataclass
class Layout:
    """How the chunks of one array lie in its folder."""

    version: int
    shape: list[int]
    chunks: list[int]
    dtype: str
    codec: str
    fill: float
    separator: str
    prefix: str = ""
    dims: list[str] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)

    def key(self, at: tuple[int, ...]) -> str:
        body = self.separator.join(map(str, at)) if at else "0" if self.version == 2 else ""
        return self.prefix + body if self.version == 2 or at else self.prefix.rstrip("/")

    def chunk(self, folder: str, at: tuple[int, ...]) -> np.ndarray:
        """A chunk cut to the array; the fill value where there is no file."""
        path = os.path.join(folder, *self.key(at).split("/"))
        size = [min(c, n - i * c) for c, n, i in zip(self.chunks, self.shape, at)]
        if not os.path.exists(path):
            return np.full(size, self.fill)
        with open(path, "rb") as f:
            raw = codecs.DECODERS[self.codec](f.read())
        found = np.frombuffer(raw, self.dtype).astype(float).reshape(self.chunks)
        return found[tuple(slice(0, s) for s in size)]


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _fill(x) -> float:
    return float("nan") if x in (None, "NaN") else math.inf if x == "Infinity" else -math.inf if x == "-Infinity" else float(x)


def _layout(folder: str) -> Layout:
    v3 = os.path.join(folder, "zarr.json")
    if os.path.exists(v3):
        with open(v3) as f:
            d = json.load(f)
        if d.get("node_type") != "array":
            raise ArrayError(f"{folder} is no array")
        order, codec = "<", "none"
        for c in d["codecs"]:
            if c["name"] == "bytes":
                order = ">" if c.get("configuration", {}).get("endian") == "big" else "<"
            elif c["name"] in ("gzip", "zstd", "blosc"):
                codec = c["name"]
            else:
                raise ArrayError(f"codec {c['name']!r} is not supported")
        if d["data_type"] not in V3_TYPES:
            raise ArrayError(f"data type {d['data_type']!r} is not supported")
        key = d.get("chunk_key_encoding", {"name": "default"})
        default = key["name"] == "default"
        separator = key.get("configuration", {}).get("separator", "/" if default else ".")
        dims = d.get("dimension_names") or [f"dim_{i}" for i in range(len(d["shape"]))]
        return Layout(3, d["shape"], d["chunk_grid"]["configuration"]["chunk_shape"], order + V3_TYPES[d["data_type"]], codec, _fill(d.get("fill_value")), separator, f"c{separator}" if default else "", dims, d.get("attributes", {}))
    with open(os.path.join(folder, ".zarray")) as f:
        d = json.load(f)
    if d.get("filters"):
        raise ArrayError("filters are not supported")
    if d.get("order", "C") != "C":
        raise ArrayError("only C order is supported")
    codec = (d.get("compressor") or {"id": "none"})["id"]
    if codec not in codecs.DECODERS:
        raise ArrayError(f"codec {codec!r} is not supported")
    attrs = {}
    if os.path.exists(os.path.join(folder, ".zattrs")):
        with open(os.path.join(folder, ".zattrs")) as f:
            attrs = json.load(f)
    dims = attrs.pop("_ARRAY_DIMENSIONS", None) or [f"dim_{i}" for i in range(len(d["shape"]))]
    return Layout(2, d["shape"], d["chunks"], d["dtype"].replace("|", "<"), codec, _fill(d.get("fill_value")), d.get("dimension_separator", "."), "", dims, attrs)


def _values(folder: str) -> np.ndarray:
    """A whole small array (label vectors) on the driver."""
    lay = _layout(folder)
    out = np.full(lay.shape, lay.fill)
    for at in chunk_starts(lay.shape, lay.chunks):
        part = lay.chunk(folder, at)
        out[tuple(slice(i * c, i * c + s) for i, c, s in zip(at, lay.chunks, part.shape))] = part
    return out


class _Chunks(InputPartition):
    def __init__(self, chunks: list[tuple[int, ...]]):
        self.chunks = chunks


class ZarrSource(DataSource):
    """``spark.read.format("axisframe_zarr").load(folder)``: the cells of one
    array, with label vectors where its attributes or siblings hold them."""

    @classmethod
    def name(cls) -> str:
        return "axisframe_zarr"

    def schema(self) -> str:
        return _grid(_local(self.options["path"])).schema()

    def reader(self, schema) -> DataSourceReader:
        return ZarrReader(_local(self.options["path"]))


class ZarrReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.layout, self.grid = folder, _layout(folder), _grid(folder)

    def partitions(self) -> list[InputPartition]:
        every = list(chunk_starts(self.layout.shape, self.layout.chunks))
        return [_Chunks(every[i : i + CHUNKS_PER_PARTITION]) for i in range(0, len(every), CHUNKS_PER_PARTITION)]

    def read(self, partition: _Chunks) -> Iterator:
        for at in partition.chunks:
            yield self.grid.batch(self.layout.chunk(self.folder, at), [i * c for i, c in zip(at, self.layout.chunks)])


def _grid(folder: str) -> Grid:
    lay = _layout(folder)
    coords = {k: v for k, v in lay.attrs.get("axisframe_coords", {}).items()}
    for d, n in zip(lay.dims, lay.shape):
        beside = os.path.join(os.path.dirname(folder.rstrip("/")), d)
        if d not in coords and os.path.basename(folder.rstrip("/")) != d and any(os.path.exists(os.path.join(beside, f)) for f in (".zarray", "zarr.json")):
            labels = _values(beside)
            if labels.ndim == 1 and len(labels) == n:
                coords[d] = labels.tolist()
    attrs = {k: str(v) for k, v in lay.attrs.items() if not k.startswith("axisframe_")}
    return Grid(lay.dims, lay.shape, coords, lay.attrs.get("axisframe_name", os.path.basename(folder.rstrip("/"))), attrs)


def read_zarr(spark: SparkSession, folder: str) -> LabeledArray:
    spark.dataSource.register(ZarrSource)
    folder = _local(folder)
    return _grid(folder).array(spark.read.format("axisframe_zarr").load(folder))


def write_zarr(array: LabeledArray, folder: str, chunks: list[int], codec: str = "zlib", version: int = 2, coords_inside: bool = True) -> None:
    """Each chunk is written by the task that gathers it. Absent cells are NaN."""
    folder = _local(folder)
    if len(chunks) != array.ndim or any(c < 1 for c in chunks):
        raise ArrayError(f"chunks {chunks} do not fit {array.shape}")
    g = grid_of(array)
    own = {"axisframe_coords": g.coords, "axisframe_name": g.name} if coords_inside else {}
    _describe(folder, g, chunks, codec, version, own)
    lay = _layout(folder)
    size, order = math.prod(chunks), [f"c{i}" for i in range(array.ndim)]

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for row in batch.itertuples(index=False):
                values = np.full(size, np.nan)
                for cell in row.cells:
                    values[cell["i"]] = cell["x"]
                path = os.path.join(folder, *lay.key(tuple(int(getattr(row, c)) for c in order)).split("/"))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(codecs.encode(values.astype("<f8").tobytes(), codec))
                os.replace(part, path)  # a repeated task writes the same bytes
                done += 1
            yield pd.DataFrame({"n": [done]})

    blocks(array, chunks).mapInPandas(save, "n long").agg(F.sum("n")).collect()


def _describe(folder: str, g: Grid, chunks: list[int], codec: str, version: int, own: dict) -> None:
    os.makedirs(folder, exist_ok=True)
    if version == 2:
        head = {"zarr_format": 2, "shape": g.shape, "chunks": list(chunks), "dtype": "<f8", "compressor": None if codec == "none" else {"id": codec, "level": 5}, "fill_value": "NaN", "order": "C", "filters": None}
        _save(folder, ".zarray", head)
        _save(folder, ".zattrs", {"_ARRAY_DIMENSIONS": g.dims, **g.attrs, **own})
    else:
        if codec == "zlib":
            raise ArrayError("version 3 has no zlib codec")
        pipe = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([] if codec == "none" else [{"name": codec, "configuration": {"level": 5}}])
        _save(folder, "zarr.json", {
            "zarr_format": 3, "node_type": "array", "shape": g.shape, "data_type": "float64", "fill_value": "NaN", "codecs": pipe, "dimension_names": g.dims, "attributes": {**g.attrs, **own},
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        })


def _save(folder: str, name: str, content: dict) -> None:
    with open(os.path.join(folder, name), "w") as f:
        json.dump(content, f)


def write_zarr_dataset(ds: LabeledDataset, folder: str, chunks: dict[str, int] | None = None, codec: str = "zlib", version: int = 2) -> None:
    """A group: an array for each variable and for each label vector, and for
    version 2 the consolidated metadata."""
    folder = _local(folder)
    os.makedirs(folder, exist_ok=True)
    _save(folder, ".zgroup", {"zarr_format": 2}) if version == 2 else _save(folder, "zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {}})
    labels: dict[str, list[float]] = {}
    for k in ds.names:
        a = ds[k]
        write_zarr(a, os.path.join(folder, k), [min((chunks or {}).get(d, a.size(d)) or 1, max(1, a.size(d))) for d in a.dims], codec, version, coords_inside=False)
        labels |= {d: a.labels(d) for d in a.dims if d in a.labelled and d not in labels}
    for d, values in labels.items():
        path = os.path.join(folder, d)
        _describe(path, Grid([d], [len(values)]), [max(1, len(values))], codec, version, {})
        lay = _layout(path)
        chunk = os.path.join(path, *lay.key((0,)).split("/"))
        os.makedirs(os.path.dirname(chunk), exist_ok=True)
        with open(chunk, "wb") as f:
            f.write(codecs.encode(np.asarray(values, "<f8").tobytes(), codec))
    if version == 2:
        found = {".zgroup": {"zarr_format": 2}}
        for k in [*ds.names, *labels]:
            for name in (".zarray", ".zattrs"):
                with open(os.path.join(folder, k, name)) as f:
                    found[f"{k}/{name}"] = json.load(f)
        _save(folder, ".zmetadata", {"zarr_consolidated_format": 1, "metadata": found})


def read_zarr_dataset(spark: SparkSession, folder: str) -> LabeledDataset:
    folder = _local(folder)
    subs = sorted(d for d in os.listdir(folder) if any(os.path.exists(os.path.join(folder, d, f)) for f in (".zarray", "zarr.json")))
    dims = {d for k in subs for d in _layout(os.path.join(folder, k)).dims}
    return LabeledDataset({k: read_zarr(spark, os.path.join(folder, k)) for k in subs if k not in dims})


def write_pyramid(array: LabeledArray, folder: str, y: str, x: str, levels: int, factor: int = 2, codec: str = "zlib") -> None:
    """Level 0 and means over ``factor`` x ``factor`` cells of each level before."""
    folder = _local(folder)
    os.makedirs(folder, exist_ok=True)
    current, found = array, []
    for k in range(levels):
        write_zarr(current, os.path.join(folder, str(k)), [max(1, min(256, n)) for n in current.shape], codec)
        found.append({"path": str(k), "factor": factor**k, "shape": list(current.shape)})
        if k + 1 < levels:
            current = current.coarsen(y, factor).mean().coarsen(x, factor).mean()
    _save(folder, ".zgroup", {"zarr_format": 2})
    _save(folder, ".zattrs", {"multiscales": [{"version": "0.1", "datasets": found}]})


def pyramid_levels(folder: str) -> list[dict]:
    with open(os.path.join(_local(folder), ".zattrs")) as f:
        return json.load(f)["multiscales"][0]["datasets"]


def read_pyramid_level(spark: SparkSession, folder: str, level: int) -> LabeledArray:
    found = pyramid_levels(folder)
    if not 0 <= level < len(found):
        raise ArrayError(f"level {level} of {len(found)}")
    return read_zarr(spark, os.path.join(_local(folder), found[level]["path"]))
