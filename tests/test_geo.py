import math

import pytest
from pyspark.sql import functions as F

from axisframe import ArrayError, LabeledArray, LabeledDataset
from axisframe.functions import geo
from axisframe.functions.geo import Affine
from axisframe.operators import raster


def test_affine():
    t = Affine(10, 0, 100, 0, -10, 200)
    assert t.apply(1, 2) == (110, 180)
    assert t.inverse().apply(110, 180) == (1, 2)
    assert Affine.from_gdal(t.gdal()) == t and Affine.parse("100 10 0 200 0 -10") == t
    with pytest.raises(ArrayError):
        Affine(1, 1, 0, 1, 1, 0).inverse()


@pytest.mark.parametrize(
    "crs,lon,lat,x,y",
    [
        ("EPSG:3857", 2.3522, 48.8566, 261845.706, 6250564.350),
        ("EPSG:32631", 3.0, 0.0, 500000.0, 0.0),
        ("EPSG:32631", 2.3522, 48.8566, 452483.1, 5411717.2),
        ("EPSG:2154", 3.0, 46.5, 700000.0, 6600000.0),
        ("EPSG:2154", 2.3522, 48.8566, 652469.0, 6862035.3),
    ],
)
def test_known_points(spark, crs, lon, lat, x, y):
    got = geo.transform("EPSG:4326", crs, lon, lat)
    assert got == pytest.approx((x, y), abs=1.0)
    assert geo.transform(crs, "EPSG:4326", *got) == pytest.approx((lon, lat), abs=1e-8)
    row = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    cx, cy = geo.transform("EPSG:4326", crs, F.col("lon"), F.col("lat"))
    there = row.select(cx.alias("x"), cy.alias("y"))
    assert tuple(there.first()) == pytest.approx(got, abs=1e-6)
    bx, by = geo.transform(crs, "EPSG:4326", F.col("x"), F.col("y"))
    assert tuple(there.select(bx.alias("lon"), by.alias("lat")).first()) == pytest.approx((lon, lat), abs=1e-8)


def test_unknown_crs():
    with pytest.raises(ArrayError):
        geo.projection("EPSG:1234")
    assert geo.crs_name("urn:ogc:def:crs:EPSG::4326") == "4326"


def test_geostationary():
    view = geo.Geostationary()
    assert view.forward(0.0, 0.0) == pytest.approx((0, 0, True))
    x, y, seen = view.forward(10.0, 45.0)
    assert seen and view.inverse(x, y) == pytest.approx((10, 45, True), abs=1e-9)
    assert not view.forward(120.0, 0.0)[2] and not view.inverse(9e6, 0.0)[2]
    assert math.isnan(view.forward(120.0, 0.0)[0])


def test_georeference_and_box(spark):
    a = LabeledArray.from_flat(spark, ["y", "x"], [2, 3], range(6))
    g = raster.georeference(a, raster.GeoRef(Affine(1, 0, 10, 0, -1, 50)), "x", "y")
    assert g.labels("x") == [10.5, 11.5, 12.5] and g.labels("y") == [49.5, 48.5] and g.attrs["crs"] == "EPSG:4326"
    assert g.box("x", "y", (11, 48, 13, 49)).flat() == [4, 5]
    assert g.point("x", "y", 12.4, 49.4) == 2
    mapping = LabeledArray.from_flat(spark, [], [], [0.0]).with_attr("GeoTransform", "10 1 0 50 0 -1").with_attr("epsg_code", "32631")
    ref = raster.geo_ref(LabeledDataset({"v": a.with_attr("grid_mapping", "m"), "m": mapping}), "v")
    assert ref.crs == "EPSG:32631" and ref.transform.a == 1


@pytest.mark.parametrize("method,lost", [("nearest", 0), ("bilinear", 0), ("cubic", 20)])
def test_identity_warp(spark, method, lost):
    a = LabeledArray.from_flat(spark, ["y", "x"], [6, 6], [float(i * i) for i in range(36)])
    t = Affine(1, 0, 0, 0, -1, 6)
    out = raster.reproject(a, "x", "y", t, "EPSG:4326", t, "EPSG:4326", 6, 6, method)
    nan = [v for v in out.flat() if math.isnan(v)]
    assert all(math.isnan(g) or g == pytest.approx(e) for g, e in zip(out.flat(), a.flat()))
    assert len(nan) >= lost and len(nan) < 36


def test_swath(spark):
    points = spark.createDataFrame([(0.2, 9.5, 10.0), (0.8, 9.6, 20.0), (1.2, 9.5, 30.0), (5.0, 5.0, 40.0)], "lon double, lat double, value double")
    t = Affine(1, 0, 0, 0, -1, 10)
    found = {(r["row"], r["col"]): (r["n"], r["mean"]) for r in raster.bin_swath(points, t, 3, 2).collect()}
    assert found == {(0, 0): (2, 15.0), (0, 1): (1, 30.0)}
    grid = raster.swath_array(points, t, 3, 2, "s").flat()
    assert grid[:2] == [15, 30] and all(map(math.isnan, grid[2:]))
    near = {(r["row"], r["col"]): r["value"] for r in raster.nearest_swath(points, t, 3, 2, 1).collect()}
    assert near[(0, 2)] == 30 and near[(0, 0)] == 10
