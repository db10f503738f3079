"""Rasters: geo-referencing, reprojection, swaths and decoding of attributes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..array import LabeledArray
from ..functions import calendar, geo, numeric
from ..functions.geo import Affine, Geostationary
from .base import ArrayError, L, P, V
from .dataset import LabeledDataset

NAN = float("nan")


@dataclass(frozen=True)
class GeoRef:
    transform: Affine
    crs: str = "EPSG:4326"


def georeference(array: LabeledArray, ref: GeoRef, x: str, y: str) -> LabeledArray:
    """Pixel-centre labels on both axes, and the CRS as an attribute."""
    array.need(x, y)
    t = ref.transform
    if t.b or t.d:
        raise ArrayError("a rotated transform has no axes")
    df = array.df.withColumn(L(x), F.lit(t.a) * (F.col(P(x)) + 0.5) + F.lit(t.c)).withColumn(L(y), F.lit(t.e) * (F.col(P(y)) + 0.5) + F.lit(t.f))
    return array._new(df, labelled=array.labelled | {x, y}, attrs=array.attrs | {"crs": ref.crs})


def geo_ref(ds: LabeledDataset, name: str) -> GeoRef | None:
    """From the attributes of the variable that ``grid_mapping`` names."""
    mapping = ds[name].attrs.get("grid_mapping")
    if not mapping or mapping not in ds.arrays:
        return None
    attrs = ds[mapping].attrs
    text = attrs.get("GeoTransform")
    if not text:
        return None
    crs = attrs.get("epsg_code") or attrs.get("crs") or "EPSG:4326"
    return GeoRef(Affine.parse(text), crs if ":" in crs else f"EPSG:{crs}")


def _pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """The target grid, generated in parallel: ``c``, ``r``."""
    return spark.range(width * height).select((F.col("id") % width).alias("c"), F.floor(F.col("id") / width).alias("r"))


def _keys(t: Column) -> Column:
    """Cubic convolution with a = -1/2."""
    t = F.abs(t)
    near, far = ((t * 1.5 - 2.5) * t) * t + 1, ((t * -0.5 + 2.5) * t - 4) * t + 2
    return F.when(t <= 1, near).when(t < 2, far).otherwise(0.0)


def warp(
    array: LabeledArray, x: str, y: str, source: Affine, to_source: Callable[[Column, Column], tuple[Column, Column]],
    target: Affine, width: int, height: int, method: str = "bilinear",
) -> LabeledArray:
    """Each target pixel centre is led to source pixels and sampled there from
    1, 4 or 16 neighbours: the pixels needed are exploded and joined to the
    source by position. Absent neighbours give NaN."""
    if set(array.dims) != {x, y}:
        raise ArrayError("a warp needs exactly the two raster dimensions")
    grid = _pixels(array.df.sparkSession, width, height)
    wx, wy = target.apply(F.col("c") + 0.5, F.col("r") + 0.5)
    sx, sy = to_source(wx, wy)
    back = source.inverse()
    grid = grid.withColumn("_sx", sx).withColumn("_sy", sy)
    col, row = back.apply(F.col("_sx"), F.col("_sy"))
    grid = grid.withColumn("_col", col).withColumn("_row", row)
    if method == "nearest":
        grid = grid.withColumn("_i", F.floor("_col")).withColumn("_j", F.floor("_row"))
        offsets, weight = [(0, 0)], F.lit(1.0)
    else:
        reach = {"bilinear": (0, 1), "cubic": (-1, 2)}[method]
        grid = grid.withColumn("_i", F.floor(F.col("_col") - 0.5)).withColumn("_j", F.floor(F.col("_row") - 0.5))
        offsets = [(i, j) for j in range(reach[0], reach[1] + 1) for i in range(reach[0], reach[1] + 1)]
        kernel = _keys if method == "cubic" else (lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t)))
        weight = kernel(F.col("_col") - 0.5 - F.col("_p")) * kernel(F.col("_row") - 0.5 - F.col("_q"))
    near = F.array(*[F.struct((F.col("_i") + i).alias("p"), (F.col("_j") + j).alias("q")) for i, j in offsets])
    need = grid.withColumn("_n", F.explode(near)).withColumn("_p", F.col("_n.p")).withColumn("_q", F.col("_n.q"))
    cells = array.df.select(F.col(P(x)).alias("_x"), F.col(P(y)).alias("_y"), F.col(V).cast("double").alias("_v"))
    got = need.join(cells, (F.col("_p") == F.col("_x")) & (F.col("_q") == F.col("_y")), "left")
    value = F.when(F.count("_v") == len(offsets), F.sum(F.col("_v") * weight)).otherwise(F.lit(NAN))
    out = got.groupBy("c", "r").agg(value.alias(V)).select(F.col("r").alias(P(y)), F.col("c").alias(P(x)), V)
    made = LabeledArray(out, [y, x], {y: height, x: width}, (), (), array.name, array.attrs)
    return georeference(made, GeoRef(target), x, y) if not (target.b or target.d) else made


def reproject(array: LabeledArray, x: str, y: str, source: Affine, source_crs: str, target: Affine, target_crs: str, width: int, height: int, method: str = "bilinear") -> LabeledArray:
    out = warp(array, x, y, source, lambda a, b: geo.transform(target_crs, source_crs, a, b), target, width, height, method)
    return out.with_attr("crs", target_crs)


def reproject_from_geostationary(array: LabeledArray, x: str, y: str, source: Affine, view: Geostationary, target: Affine, target_crs: str, width: int, height: int, method: str = "nearest") -> LabeledArray:
    def to_source(a: Column, b: Column) -> tuple[Column, Column]:
        lon, lat = geo.transform(target_crs, "EPSG:4326", a, b)
        sx, sy, _ = view.forward(lon, lat)
        return sx, sy

    return warp(array, x, y, source, to_source, target, width, height, method).with_attr("crs", target_crs)


def bin_swath(points: DataFrame, target: Affine, width: int, height: int, lon: str = "lon", lat: str = "lat", value: str = "value") -> DataFrame:
    """``row, col, n, mean`` of the points in each cell that has any; partial
    sums are combined before the shuffle."""
    back = target.inverse()
    col, row = back.apply(F.col(lon), F.col(lat))
    placed = points.select(F.floor(row).alias("row"), F.floor(col).alias("col"), F.col(value).cast("double").alias("x"))
    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width) & ~F.isnan("x")
    return placed.filter(inside).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def swath_array(points: DataFrame, target: Affine, width: int, height: int, name: str, y: str = "latitude", x: str = "longitude") -> LabeledArray:
    """The means on the whole grid, NaN where no point fell."""
    found = bin_swath(points, target, width, height)
    full = _pixels(points.sparkSession, width, height).join(found, (F.col("c") == F.col("col")) & (F.col("r") == F.col("row")), "left")
    cells = full.select(F.col("r").alias(P(y)), F.col("c").alias(P(x)), numeric.or_nan(F.col("mean")).alias(V))
    return georeference(LabeledArray(cells, [y, x], {y: height, x: width}, (), (), name), GeoRef(target), x, y)


def nearest_swath(points: DataFrame, target: Affine, width: int, height: int, radius: int, lon: str = "lon", lat: str = "lat", value: str = "value") -> DataFrame:
    """``row, col, value`` of the point nearest to each cell's centre among the
    points at most ``radius`` cells away; of equally near ones the first by place."""
    back = target.inverse()
    col, row = back.apply(F.col(lon), F.col(lat))
    placed = points.select(col.alias("_c"), row.alias("_r"), F.col(value).cast("double").alias("x")).filter(~F.isnan("x"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)])
    cells = placed.withColumn("_o", F.explode(around)).withColumn("row", F.floor("_r") + F.col("_o.j")).withColumn("col", F.floor("_c") + F.col("_o.i"))
    cells = cells.filter((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))
    far = F.pow(F.col("col") + 0.5 - F.col("_c"), 2) + F.pow(F.col("row") + 0.5 - F.col("_r"), 2)
    return cells.groupBy("row", "col").agg(F.min(F.struct(far.alias("far"), "_r", "_c", "x")).alias("m")).select("row", "col", F.col("m.x").alias("value"))


# -- decoding by attributes


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def decode_array(array: LabeledArray) -> LabeledArray:
    """raw * scale_factor + add_offset, the fill value as NaN; the attributes
    used are taken away, those that are no numbers are ignored."""
    attrs = dict(array.attrs)
    scale, offset = _number(attrs.get("scale_factor")), _number(attrs.get("add_offset"))
    fill, missing = _number(attrs.get("_FillValue")), _number(attrs.get("missing_value"))
    gone = fill if fill is not None else missing
    v = F.col(V).cast("double")
    out = v * F.lit(1.0 if scale is None else scale) + F.lit(0.0 if offset is None else offset)
    if gone is not None:
        out = F.when(v == F.lit(gone), F.lit(NAN)).otherwise(out)
    for key, x in (("scale_factor", scale), ("add_offset", offset), ("_FillValue", fill), ("missing_value", missing)):
        if x is not None:
            attrs.pop(key)
    return array._new(array.df.withColumn(V, out), attrs=attrs)


def decode(ds: LabeledDataset) -> LabeledDataset:
    return LabeledDataset({k: decode_array(a) for k, a in ds.arrays.items()}, check=False)


def decode_time(ds: LabeledDataset, dim: str) -> LabeledDataset:
    """Labels of ``dim`` in ``<unit> since <date>`` as epoch seconds."""
    units = next((a.coord_attrs[dim]["units"] for a in ds.arrays.values() if "units" in a.coord_attrs.get(dim, {})), None)
    if units is None:
        raise ArrayError(f"{dim!r} has no units")

    def one(a: LabeledArray) -> LabeledArray:
        if dim not in a.labelled:
            return a
        attrs = a.coord_attrs | {dim: {k: x for k, x in a.coord_attrs.get(dim, {}).items() if k != "units"}}
        return a._new(a.df.withColumn(L(dim), calendar.decode_labels(F.col(L(dim)), units)), coord_attrs=attrs)

    return LabeledDataset({k: one(a) for k, a in ds.arrays.items()}, check=False)
