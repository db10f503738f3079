import json
import math
import os
import struct
import zlib

import numpy as np
import pytest

from axisframe import ArrayError, LabeledArray, LabeledDataset
from axisframe.operators import raster
from axisframe.plans.blocks import BlockArray
from axisframe.sources import codecs, grib, netcdf, raw, text, zarr


@pytest.fixture
def grid(spark):
    return LabeledArray.from_flat(spark, ["y", "x"], [3, 4], [float(i) for i in range(12)], {"y": [45, 44, 43], "x": [0, 1, 2, 3]}, "t2m")


def test_json(spark, grid):
    back = text.from_json(spark, text.to_json(grid))
    assert back.flat() == grid.flat() and back.dims == grid.dims and back.labels("y") == [45, 44, 43]
    ds = text.dataset_from_json(spark, text.dataset_to_json(LabeledDataset({"a": grid})))
    assert ds["a"].flat() == grid.flat()
    with pytest.raises(ArrayError):
        text.to_json(LabeledArray.from_flat(spark, ["x"], [1], [float("nan")]))


def test_csv(spark, grid, tmp_path):
    found = text.to_csv(grid)
    assert found.splitlines()[0] == "y,x,t2m"
    back = text.from_csv(spark, found)
    assert back.flat() == grid.flat() and back.labels("y") == [45, 44, 43] and back.name == "t2m"
    with pytest.raises(ArrayError):
        text.from_csv(spark, "x,y,value\n0,0,1\n1,1,2\n")
    with pytest.raises(ArrayError):
        text.from_csv(spark, "x,value\n0,no\n")
    assert text.from_csv(spark, "x,value\n0,1\n0,2\n").flat() == [2]
    text.write_csv(grid, f"{tmp_path}/csv")
    assert sorted(text.read_csv(spark, f"{tmp_path}/csv", ["y", "x"], "t2m").flat()) == sorted(grid.flat())


def test_coverage(grid):
    made = json.loads(text.to_coverage_json(grid, "t2m", "x", "y"))
    assert made["domain"]["domainType"] == "Grid" and made["ranges"]["t2m"]["shape"] == [3, 4]
    one = json.loads(text.to_coverage_json(grid.sel_nearest_keep("x", 1.0).sel_nearest_keep("y", 44.0), "t2m", "x", "y"))
    assert one["domain"]["domainType"] == "PointSeries" and one["ranges"]["t2m"]["values"] == [5]


@pytest.mark.parametrize("version,codec", [(2, "zlib"), (2, "none"), (2, "zstd"), (3, "zstd"), (3, "gzip")])
def test_zarr(spark, grid, tmp_path, version, codec):
    path = f"{tmp_path}/a.zarr"
    zarr.write_zarr(grid, path, [2, 3], codec, version)
    back = zarr.read_zarr(spark, path)
    assert back.flat() == grid.flat() and back.labels("x") == [0, 1, 2, 3] and back.name == "t2m"


@pytest.mark.parametrize("version", [2, 3])
def test_zarr_dataset_and_missing_chunk(spark, grid, tmp_path, version):
    path = f"{tmp_path}/g.zarr"
    ds = LabeledDataset({"t2m": grid, "rain": grid.sum("x")})
    zarr.write_zarr_dataset(ds, path, {"y": 2}, "zlib" if version == 2 else "zstd", version)
    back = zarr.read_zarr_dataset(spark, path)
    assert back.names == ["rain", "t2m"] and back["t2m"].flat() == grid.flat() and back["rain"].labels("y") == [45, 44, 43]
    os.remove(f"{path}/t2m/1.0" if version == 2 else f"{path}/t2m/c/1/0")
    assert sum(map(math.isnan, zarr.read_zarr(spark, f"{path}/t2m").flat())) == 4


def test_pyramid(spark, tmp_path):
    a = LabeledArray.from_flat(spark, ["y", "x"], [8, 8], range(64))
    zarr.write_pyramid(a, f"{tmp_path}/p", "y", "x", 3)
    assert [level["shape"] for level in zarr.pyramid_levels(f"{tmp_path}/p")] == [[8, 8], [4, 4], [2, 2]]
    assert zarr.read_pyramid_level(spark, f"{tmp_path}/p", 1).flat()[0] == 4.5
    with pytest.raises(ArrayError):
        zarr.read_pyramid_level(spark, f"{tmp_path}/p", 3)


def blosc_container(data: bytes, width: int, flags: int, pieces: list[bytes], block: int) -> bytes:
    starts, body, at = [], b"", 16 + 4 * len(pieces)
    for p in pieces:
        starts.append(at + len(body))
        body += struct.pack("<i", len(p)) + p
    head = bytes([2, 1, flags, width]) + struct.pack("<III", len(data), block, at + len(body))
    return head + struct.pack(f"<{len(starts)}I", *starts) + body


def test_codecs():
    import zstandard

    data = np.arange(2000, dtype="<i4").tobytes()
    shuffled = np.frombuffer(data, np.uint8).reshape(-1, 4).T.tobytes()
    piece = zstandard.ZstdCompressor().compress(shuffled)
    assert codecs.blosc(blosc_container(data, 4, 1 | 16 | 4 << 5, [piece], len(data))) == data
    # literals "abcd", then a copy of 8 from 4 back, then a last literal
    lz4 = bytes([0x44]) + b"abcd" + struct.pack("<H", 4) + bytes([0x10]) + b"z"
    assert codecs.lz4_block(lz4, 13) == b"abcdabcdabcdz"
    assert codecs.blosc(blosc_container(b"abcdabcdabcdz", 1, 16 | 1 << 5, [lz4], 13)) == b"abcdabcdabcdz"
    items = np.arange(64, dtype="<u2")
    bits = np.unpackbits(items.view(np.uint8).reshape(64, 2), axis=1, bitorder="little").T
    assert codecs.bit_unshuffle(np.packbits(bits, axis=1, bitorder="little").tobytes(), 2) == items.tobytes()
    with pytest.raises(codecs.CodecError):
        codecs.blosc(blosc_container(data, 4, 16, [b""], len(data)))
    assert codecs.DECODERS["zlib"](zlib.compress(b"x")) == b"x"


def test_netcdf(spark, grid, tmp_path):
    path = f"{tmp_path}/a.nc"
    with open(path, "wb") as f:
        f.write(netcdf.array_to_netcdf(grid.with_attr("units", "K")))
    assert netcdf.sniff(path) == "classic"
    back = netcdf.open_netcdf(spark, path)["t2m"]
    assert back.flat() == grid.flat() and back.labels("y") == [45, 44, 43] and back.attrs["units"] == "K"


def test_netcdf_records(spark, tmp_path):
    """Two record variables, hand-assembled: time and v(time, x)."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 2)
    head += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
    one = name("time") + struct.pack(">iiii", 1, 0, 0, 0) + struct.pack(">ii", 6, 8)
    two = name("v") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, 16)
    begin = len(head) + len(one) + 4 + len(two) + 4
    body = struct.pack(">3d", 100, 1, 2) + struct.pack(">3d", 200, 3, 4)
    with open(f"{tmp_path}/r.nc", "wb") as f:
        f.write(head + one + struct.pack(">i", begin) + two + struct.pack(">i", begin + 8) + body)
    v = netcdf.read_netcdf(spark, f"{tmp_path}/r.nc")["v"]
    assert v.flat() == [1, 2, 3, 4] and v.labels("time") == [100, 200]


def grib_message(template: int = 0, section5: bytes = b"", body: bytes = b"") -> bytes:
    s1 = struct.pack(">IB", 21, 1) + bytes(16)
    s3 = bytearray(struct.pack(">IB", 72, 3) + bytes(67))
    struct.pack_into(">I", s3, 6, 4)
    struct.pack_into(">II", s3, 30, 2, 2)
    struct.pack_into(">II", s3, 46, 45_000_000, (1 << 31) | 1_000_000)
    struct.pack_into(">II", s3, 63, 1_000_000, 2_000_000)
    s4 = struct.pack(">IB", 34, 4) + bytes(29)
    s5 = section5 or struct.pack(">IBIHfHHBB", 21, 5, 4, template, 10.0, 1, 0, 8, 0)
    s6 = struct.pack(">IBB", 6, 6, 255)
    data = body or bytes([0, 5, 10, 15])
    s7 = struct.pack(">IB", 5 + len(data), 7) + data
    rest = s1 + bytes(s3) + s4 + s5 + s6 + s7 + b"7777"
    return b"GRIB" + bytes([0, 0, 0, 2]) + struct.pack(">Q", 16 + len(rest)) + rest


def test_grib(spark, tmp_path):
    with open(f"{tmp_path}/a.grib2", "wb") as f:
        f.write(grib_message() + b"junk" + grib_message())
    found = grib.read_grib(spark, f"{tmp_path}/a.grib2")
    assert len(found) == 2 and found[0].flat() == [10, 20, 30, 40]
    assert found[0].labels("latitude") == [45, 43] and found[0].labels("longitude") == [-1, 0]
    assert grib.read_grib_cells(spark, f"{tmp_path}/a.grib2").count() == 8


def test_grib_complex():
    """One group of width 4 with first-order differences: 10 20 30 40."""
    s5 = bytearray(struct.pack(">IBIHfHHB", 49, 5, 4, 3, 0.0, 0, 0, 8) + bytes(29))
    struct.pack_into(">I", s5, 31, 1)
    s5[35], s5[36] = 4, 0
    struct.pack_into(">IBIB", s5, 37, 4, 1, 4, 0)
    s5[47], s5[48] = 1, 1
    body = bytes([10, 5]) + bytes([0]) + bytes([0x05, 0x55])  # first value, least difference, reference; members 0 5 5 5
    assert grib.decode(grib_message(3, bytes(s5), body)).values.ravel().tolist() == [10, 20, 30, 40]


def test_raw_and_blocks(spark, tmp_path):
    raw.write_raw(range(80), f"{tmp_path}/a.f64")
    a = raw.read_raw(spark, f"{tmp_path}/a.f64", ["t", "x"], [20, 4], rows=5)
    blocks = BlockArray(a, 5)
    assert blocks.n_blocks == 4 and blocks.sum() == 3160 and blocks.map(lambda v: v + 1).compute().flat() == [i + 1.0 for i in range(80)]
    assert (blocks + blocks).mean() == 79 and blocks.min() == 0 and blocks.max() == 79
    assert blocks.sum_axis("t").flat() == [sum(range(i, 80, 4)) for i in range(4)]
    nan = BlockArray(LabeledArray.from_flat(spark, ["x"], [3], [1, float("nan"), 2]), 2)
    assert math.isnan(nan.min()) and math.isnan(nan.max())
    with pytest.raises(ArrayError):
        raw.read_raw(spark, f"{tmp_path}/a.f64", ["t"], [79])


def test_decoding(spark):
    a = LabeledArray.from_flat(spark, ["x"], [3], [10, 20, 999], {"x": [0, 1, 2]}, "t")
    a = a.with_attr("scale_factor", "0.5").with_attr("add_offset", "1").with_attr("_FillValue", "999").with_attr("units", "K")
    out = raster.decode_array(a)
    assert out.flat()[:2] == [6, 11] and math.isnan(out.flat()[2]) and out.attrs == {"units": "K"}
    days = a.with_coord_attr("x", "units", "days since 2000-01-01")
    assert raster.decode_time(LabeledDataset({"t": days}), "x").labels("x") == [946684800 + 86400 * i for i in range(3)]
