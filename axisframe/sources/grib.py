"""GRIB2 messages on regular latitude-longitude grids, without bitmaps:
simple packing (5.0) and complex packing without and with spatial differences
(5.2, 5.3). Messages are found on the driver or per file in tasks, and
unpacked with numpy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from ..array import ArrayError, LabeledArray
from .cells import Grid


@dataclass
class Message:
    lats: np.ndarray
    lons: np.ndarray
    values: np.ndarray
    discipline: int
    category: int
    number: int

    def array(self, spark: SparkSession, name: str) -> LabeledArray:
        return Grid(["latitude", "longitude"], list(self.values.shape), {"latitude": self.lats.tolist(), "longitude": self.lons.tolist()}, name).from_values(spark, self.values)


def signed(raw: int, bits: int) -> int:
    """Sign and magnitude, as the code tables have it."""
    top = 1 << (bits - 1)
    return -(raw & (top - 1)) if raw & top else raw


def bits(data: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` unsigned numbers of ``width`` bits from bit ``start`` on."""
    if width == 0 or n == 0:
        return np.zeros(n, np.int64)
    first, last = start // 8, -(-(start + n * width) // 8)
    plain = np.unpackbits(np.frombuffer(data[first:last], np.uint8))
    plain = plain[start - first * 8 :][: n * width].reshape(n, width)
    return plain.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def _scaled(section: bytes, packed: np.ndarray) -> np.ndarray:
    (reference,) = struct.unpack_from(">f", section, 11)
    binary, decimal = (signed(x, 16) for x in struct.unpack_from(">HH", section, 15))
    return (reference + packed * 2.0**binary) / 10.0**decimal


def _complex(section: bytes, data: bytes, n: int, differences: bool) -> np.ndarray:
    """Groups: references, widths and lengths, then members; differences of
    first or second order are summed up again."""
    width = section[19]
    (groups,) = struct.unpack_from(">I", section, 31)
    ref_width, bits_width = section[35], section[36]
    (ref_length,), step = struct.unpack_from(">I", section, 37), section[41]
    (last,), bits_length = struct.unpack_from(">I", section, 42), section[46]
    at, first, least, order = 0, [], 0, 0
    if differences:
        order, size = section[47], section[48]
        word = lambda i: signed(int.from_bytes(data[i * size : (i + 1) * size], "big"), 8 * size)
        first, least, at = [word(i) for i in range(order)], word(order), (order + 1) * size
    at *= 8
    fields = []
    for w in (width, bits_width, bits_length):
        fields.append(bits(data, w, groups, at))
        at = -(-(at + w * groups) // 8) * 8
    refs, widths, lengths = fields[0], fields[1] + ref_width, fields[2] * step + ref_length
    lengths[-1] = last
    out = np.repeat(refs, lengths)
    place = 0
    for w, k in zip(widths.tolist(), lengths.tolist()):
        if w:
            out[place : place + k] += bits(data, w, k, at)
            at += w * k
        place += k
    if len(out) != n:
        raise ArrayError(f"{len(out)} values where the grid has {n}")
    if order:
        out[order:] += least
        out[:order] = first
        if order == 1:
            out = np.cumsum(out)
        else:
            steps = out.copy()
            steps[0], steps[1] = first[0], first[1] - first[0]
            steps[1:] = np.cumsum(steps[1:])
            out = np.cumsum(steps)
    return out


def decode(message: bytes) -> Message:
    at, n, grid, packing, product = 16, 0, None, b"", (0, 0)
    while message[at : at + 4] != b"7777":
        length, number = struct.unpack_from(">IB", message, at)
        s = message[at : at + length]
        if number == 3:
            if struct.unpack_from(">H", s, 12)[0] != 0:
                raise ArrayError("only regular latitude-longitude grids are read")
            nx, ny = struct.unpack_from(">II", s, 30)
            lat, lon = (signed(x, 32) / 1e6 for x in struct.unpack_from(">II", s, 46))
            di, dj = (x / 1e6 for x in struct.unpack_from(">II", s, 63))
            scan = s[71]
            grid = (nx, ny, lon + np.arange(nx) * (-di if scan & 128 else di), lat + np.arange(ny) * (dj if scan & 64 else -dj))
        elif number == 4:
            product = (s[9], s[10])
        elif number == 5:
            (n,), packing = struct.unpack_from(">I", s, 5), s
        elif number == 6 and s[5] != 255:
            raise ArrayError("bitmaps are not read")
        elif number == 7:
            body = s[5:]
        at += length
    if grid is None or not packing:
        raise ArrayError("a message without grid or data")
    template = struct.unpack_from(">H", packing, 9)[0]
    if template == 0:
        packed = bits(body, packing[19], n)
    elif template in (2, 3):
        packed = _complex(packing, body, n, template == 3)
    else:
        raise ArrayError(f"packing 5.{template} is not read")
    nx, ny, lons, lats = grid
    return Message(lats, lons, _scaled(packing, packed).reshape(ny, nx), message[6], *product)


def messages(data: bytes) -> Iterator[Message]:
    """All messages of a file; other bytes between them are passed over."""
    at = data.find(b"GRIB")
    while at >= 0:
        if data[at + 7] != 2:
            raise ArrayError("only edition 2 is read")
        (length,) = struct.unpack_from(">Q", data, at + 8)
        yield decode(data[at : at + length])
        at = data.find(b"GRIB", at + length)


def read_grib(spark: SparkSession, path: str) -> list[LabeledArray]:
    """An array for each message of a file."""
    with open(path.removeprefix("file://"), "rb") as f:
        return [m.array(spark, f"var_{m.discipline}_{m.category}_{m.number}") for m in messages(f.read())]


def read_grib_cells(spark: SparkSession, pattern: str):
    """``file, message, latitude, longitude, v`` of many files, a file to a row
    of ``binaryFile`` and unpacked in its task."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for k, m in enumerate(messages(content)):
                    lat, lon = np.meshgrid(m.lats, m.lons, indexing="ij")
                    yield pd.DataFrame({"file": path, "message": k, "latitude": lat.ravel(), "longitude": lon.ravel(), "v": m.values.ravel()})

    found = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return found.mapInPandas(run, "file string, message int, latitude double, longitude double, v double")
