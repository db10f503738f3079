import datetime as dt
import math

import pytest

from axisframe import ArrayError, LabeledArray, LabeledDataset, concat, stack
from axisframe.functions import calendar
from axisframe.operators import dense

NAN = float("nan")


@pytest.fixture
def A(spark):
    return lambda dims, shape, data, **more: LabeledArray.from_flat(spark, dims, shape, list(data), **more)


def same(got, expected):
    got, expected = list(got), list(expected)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert (math.isnan(g) and math.isnan(e)) or g == pytest.approx(e, rel=1e-9), (got, expected)


def epochs(*days):
    return [calendar.to_epoch(dt.datetime.fromisoformat(d)) for d in days]


@pytest.fixture
def weather(A):
    return A(["time", "place"], [2, 3], range(1, 7), coords={"time": [2020, 2021], "place": [10, 20, 30]})


def test_construction_is_checked(A):
    for dims, shape, data in ((["x"], [2], [1]), (["x", "x"], [1, 1], [1]), (["x"], [-1], []), (["x", "y"], [1], [1])):
        with pytest.raises(ArrayError):
            A(dims, shape, data)
    with pytest.raises(ArrayError):
        A(["x"], [2], [1, 2], coords={"y": [1, 2]})


def test_selection(weather):
    same(weather.sel("time", 2021.0).flat(), [4, 5, 6])
    same(weather.isel("place", 1).flat(), [2, 5])
    same(weather.sel_nearest("place", 19.0).flat(), [2, 5])
    same(weather.sel_range("place", 25.0, 15.0).flat(), [2, 5])
    same(weather.sel_many("place", [30.0, 10.0]).flat(), [3, 1, 6, 4])
    same(weather.sel_nearest_many("place", [29.0, 11.0]).flat(), [3, 1, 6, 4])
    assert weather.at(1, 2) == 6
    for bad in (lambda: weather.sel("time", 1.0), lambda: weather.isel("time", 2), lambda: weather.sel_range("place", 1.0, 2.0), lambda: weather.sel("nowhere", 1.0)):
        with pytest.raises(ArrayError):
            bad()


def test_text_labels(A):
    a = A(["station", "hour"], [3, 2], range(1, 7), texts={"station": ["Paris", "Lyon", "Nice"]})
    same(a.sel_text("station", "Lyon").flat(), [3, 4])
    same(a.sel_text_many("station", ["Nice", "Paris"]).flat(), [5, 6, 1, 2])


def test_binary_and_joins(A):
    a = A(["x", "y"], [2, 3], range(6), coords={"x": [0, 1], "y": [10, 20, 30]})
    b = A(["x", "y"], [2, 3], range(6, 12), coords={"x": [0, 1], "y": [10, 20, 30]})
    same((a + b).flat(), [6, 8, 10, 12, 14, 16])
    same((A(["x"], [3], [1, 2, 3]) + A(["y"], [2], [10, 20])).flat(), [11, 21, 12, 22, 13, 23])
    left, right = A(["x"], [3], [10, 20, 30], coords={"x": [0, 1, 2]}), A(["x"], [3], [1, 2, 3], coords={"x": [1, 2, 3]})
    same((left + right).flat(), [21, 32])
    same(left.add_join(right, "outer", 0.0).flat(), [10, 21, 32, 3])
    same(left.add_join(right, "left", 0.0).flat(), [10, 21, 32])
    same(left.add_join(right, "right", 0.0).flat(), [21, 32, 3])
    two = A(["x", "k"], [3, 2], [10, 11, 20, 21, 30, 31], coords={"x": [0, 1, 2]})
    same(two.add_join(right, "outer", 0.0).flat(), [10, 11, 21, 22, 32, 33, 3, 3])
    with pytest.raises(ArrayError):
        left + A(["x"], [3], [1, 2, 3], coords={"x": [7, 8, 9]})
    same((A(["x"], [3], [1, 0, -1]) / A(["x"], [3], [0, 0, 0])).isnull().flat(), [0, 1, 0])
    assert (A(["x"], [2], [1, -1]) / A(["x"], [2], [0, 0])).flat() == [math.inf, -math.inf]
    same(A(["x"], [2], [NAN, 1]).maximum(A(["x"], [2], [2, NAN])).flat(), [2, NAN])


def test_dot_and_bilinear(A):
    same(A(["x", "k"], [2, 3], range(1, 7)).dot(A(["k", "y"], [3, 2], range(7, 13)), "k").flat(), [58, 64, 139, 154])
    same(A(["k"], [3], [1, 2, 3]).dot(A(["k"], [3], [4, 5, 6]), "k").flat(), [32])
    grid = A(["lat", "lon"], [2, 2], [0, 10, 20, 30], coords={"lat": [1, 0], "lon": [0, 1]})
    same(grid.bilinear("lon", "lat", 0.5, 0.5).flat(), [15])
    with pytest.raises(ArrayError):
        grid.bilinear("lon", "lat", 5, 0.5)


def test_reductions(A):
    same(A(["a", "b", "c"], [2, 2, 2], range(8)).sum("b").flat(), [2, 4, 10, 12])
    v = A(["x"], [4], [2, 4, 4, 6])
    same([v.var(), v.std(), v.median(), v.mean()], [2, math.sqrt(2), 4, 4])
    same([A(["x"], [5], range(5)).quantile(0.25), A(["x"], [4], range(4)).quantile(0.5)], [1, 1.5])
    a = A(["x", "y"], [2, 3], [3, 1, 2, 5, 9, 4], coords={"y": [10, 20, 30]})
    same(a.arg_min("y").flat(), [1, 2])
    same(a.arg_max("y").flat(), [0, 1])
    same(a.idx_min("y").flat(), [20, 30])
    with_nan = A(["x"], [5], [1, NAN, 3, NAN, 5])
    same([with_nan.sum_skipna(), with_nan.mean_skipna(), with_nan.min_skipna(), with_nan.max_skipna(), with_nan.count(), with_nan.count_na()], [9, 3, 1, 5, 3, 2])
    same([with_nan.sum(), with_nan.min(), A(["x"], [2], [NAN, 1]).min()], [NAN, 1, NAN])
    empty = A(["x"], [0], [])
    same([empty.sum(), empty.mean(), A(["x"], [1], [NAN]).sum_skipna(), A(["x"], [1], [NAN]).max_skipna()], [0, NAN, 0, 0])


def test_groups(A):
    same(A(["t"], [5], [10, 20, 30, 40, 50], coords={"t": [1, 1, 2, 2, 2]}).group_by("t").sum().flat(), [30, 120])
    same(A(["t", "x"], [3, 2], range(1, 7), coords={"t": [0, 0, 1]}).group_by("t").sum().flat(), [4, 6, 5, 6])
    six = A(["t"], [6], [10, 20, 30, 40, 50, 60], coords={"t": range(6)})
    same(six.resample("t", 2.0).mean().flat(), [15, 35, 55])
    same(six.resample("t", 2.0).mean().labels("t"), [0, 2, 4])
    same(six.coarsen("t", 4).sum().flat(), [100])
    same(A(["x"], [7], range(1, 8)).coarsen("x", 2).sum().flat(), [3, 7, 11])
    same(A(["x"], [4], [1, 2, 3, 4], coords={"x": [-5, 5, 15, 100]}).group_by_bins("x", [0, 10, 20]).sum().flat(), [2, 3])
    month = A(["t"], [4], [1, 2, 3, 4], coords={"t": epochs("2020-01-15", "2020-02-10", "2020-02-20", "2021-01-05")}).resample_calendar("t", "month").sum()
    same(month.flat(), [1, 5, 4])
    same(month.labels("t"), epochs("2020-01-01", "2020-02-01", "2021-01-01"))
    season = A(["t"], [5], [2, 4, 10, 20, 30], coords={"t": epochs("2020-01-15", "2020-12-20", "2020-04-10", "2020-07-05", "2020-10-01")})
    same(season.group_by_time("t", "season").mean().flat(), [3, 10, 20, 30])
    for bad in (lambda: six.resample("t", 0), lambda: six.coarsen("t", 7), lambda: six.group_by_bins("t", [1])):
        with pytest.raises(ArrayError):
            bad()


@pytest.mark.parametrize("block", [2, 3, 100_000])
def test_windows_in_blocks(A, monkeypatch, block):
    from axisframe.operators import base

    monkeypatch.setattr(base, "BLOCK_CELLS", block)
    same(A(["x"], [5], range(1, 6)).rolling("x", 3).mean().flat(), [NAN, NAN, 2, 3, 4])
    q = A(["x"], [4], [5, 1, 9, 3])
    same(q.rolling("x", 2).sum().flat(), [NAN, 6, 10, 12])
    same(q.rolling("x", 2).min().flat(), [NAN, 1, 1, 3])
    same(A(["x"], [4], range(1, 5)).cumsum("x").flat(), [1, 3, 6, 10])
    same(A(["x"], [5], [1, -2, 3, 0, 4]).cumprod("x").flat(), [1, -2, -6, 0, 0])
    d = A(["x"], [4], [1, 3, 6, 10], coords={"x": range(4)}).diff("x")
    same(d.flat() + d.labels("x"), [2, 3, 4, 1, 2, 3])
    gaps = A(["x"], [6], [NAN, 1, NAN, NAN, 4, NAN])
    same(gaps.ffill("x").flat(), [NAN, 1, 1, 1, 4, 4])
    same(gaps.bfill("x").flat(), [1, 1, 4, 4, 4, NAN])
    same(A(["x"], [5], [NAN, 2, NAN, 6, NAN]).interpolate_na("x").flat(), [NAN, 2, 4, 6, NAN])
    same(A(["x"], [3], [0, NAN, 8], coords={"x": [0, 1, 4]}).interpolate_na("x").flat(), [0, 2, 8])
    n = A(["x"], [5], [1, NAN, 3, NAN, 5], coords={"x": range(5)})
    same(n.dropna("x").flat() + n.dropna("x").labels("x"), [1, 3, 5, 0, 2, 4])
    same(n.fillna(0.0).flat(), [1, 0, 3, 0, 5])


def test_reshape(A):
    same(concat([A(["r", "c"], [2, 2], [1, 2, 3, 4]), A(["r", "c"], [2, 1], [9, 8])], "c").flat(), [1, 2, 9, 3, 4, 8])
    same(stack([A(["x"], [2], [1, 2]), A(["x"], [2], [3, 4])], "e", [10.0, 20.0]).flat(), [1, 2, 3, 4])
    a = A(["x", "y"], [2, 3], range(6))
    same(a.transpose("y", "x").flat(), [0, 3, 1, 4, 2, 5])
    assert a.expand_dims("z").squeeze("z").dims == ("x", "y")
    assert a.rename_dim("x", "w").dims == ("w", "y")


def test_scalar_functions(A):
    x = A(["x"], [5], [-2.5, 0, 2.5, NAN, 9])
    same(x.sign().flat(), [-1, 0, 1, 0, 1])
    same(x.round().flat(), [-3, 0, 3, NAN, 9])
    same(x.floor().flat(), [-3, 0, 2, NAN, 9])
    same(x.clip(5.0, 0.0).flat(), [0, 0, 2.5, NAN, 5])
    assert A(["x"], [2], [0, -1]).log().flat()[0] == -math.inf
    same(x.apply_python(lambda v: v * 2).flat(), [-5, 0, 5, NAN, 18])


def test_dataset(A):
    ds = LabeledDataset({"t": A(["x", "y"], [2, 3], range(6), coords={"x": [0, 1]}), "p": A(["x"], [2], [100, 200], coords={"x": [0, 1]})})
    same(ds.mean("y")["t"].flat() + ds.mean("y")["p"].flat() + (ds + ds)["p"].flat(), [1, 4, 100, 200, 200, 400])
    same(ds.group_by("x").sum()["p"].flat(), [100, 200])
    assert ds.names == ["p", "t"] and ds.drop_vars("p", "none").names == ["t"]
    with pytest.raises(ArrayError):
        LabeledDataset({"a": A(["x"], [2], [1, 2]), "b": A(["x"], [3], [1, 2, 3])})


def test_dense_and_models(spark):
    N = lambda s, d: dense.DenseArray.from_flat(spark, s, list(d))
    out, mean, deviation = dense.standardize(N([2, 2], [1, 10, 3, 30]))
    same(out.flat() + mean.flat() + deviation.flat(), [-1, -1, 1, 1, 2, 20, 1, 10])
    same(dense.matmul(N([2, 3], range(1, 7)), N([3, 2], range(7, 13))).flat(), [58, 64, 139, 154])
    same(dense.matvec(N([2, 2], [1, 2, 3, 4]), N([2], [5, 6])).flat(), [17, 39])
    same((N([2, 1], [1, 2]) + N([3], [10, 20, 30])).flat(), [11, 21, 31, 12, 22, 32])
    same(dense.matmul(N([1, 2], [0, 1]), N([2, 1], [NAN, 5])).flat(), [5])
    model = dense.LinearRegression(0.1, 500).fit(N([4, 1], [0, 1, 2, 3]), N([4], [1, 3, 5, 7]))
    assert model.weights[0] == pytest.approx(2, abs=1e-3) and model.bias == pytest.approx(1, abs=1e-2)
    assert dense.mean_squared_error(model.predict(N([2, 1], [0, 1])), N([2], [1, 3])) < 1e-3
    with pytest.raises(ArrayError):
        dense.LinearRegression().predict(N([1, 1], [1]))


def test_one_position(A):
    """A dimension of one position is one in every family, after narrowing too."""
    a = A(["x", "y"], [3, 2], range(6), coords={"x": [1, 2, 3], "y": [5, 6]}, attrs={"u": "K"})
    one = a.sel_range("x", 2, 2)
    assert one.shape == (1, 2) and one.size("x") == 1 and one.n_cells == 2
    same(one.isel("x", 0).flat(), [2, 3])
    same(one.squeeze("x").flat(), [2, 3])
    assert a.coarsen("x", 3).mean().squeeze("x").dims == ("y",)
    same(one.sum("x").flat(), [2, 3])
    same((one + one).flat(), [4, 6])
    same(one.rolling("x", 1).mean().flat(), [2, 3])
    assert one.expand_dims("z").shape == (1, 1, 2) and concat([one, one], "x").shape == (2, 2) and stack([one, one], "k").shape == (2, 1, 2)
    assert a._new(a.df.filter("false"), sizes={}).shape == (0, 0)


def test_null_labels(spark):
    """A null label is a position like others, the first; no cell is lost."""
    from axisframe import LabeledArray

    table = spark.createDataFrame([(None, "a", 5.0), (1.0, "a", 7.0), (None, None, 2.0)], "x double, t string, v double")
    a = LabeledArray.from_table(table, ["x", "t"], "v", text_dims=["t"])
    assert a.shape == (2, 2) and a.df.count() == 3 and a.value("sum") == 14.0
    assert a.text_labels("t") == [None, "a"] and a.labels("x") == [None, 1.0]


def test_running_product_is_real(A):
    a = A(["x"], [4], [2.0, float("inf"), 0.0, 3.0])
    same(a.cumprod("x").flat(), [2.0, float("inf"), NAN, NAN])
    same(A(["x"], [4], [-0.5, 3.0, 1 / 3, NAN]).cumprod("x").flat(), [-0.5, -1.5, -0.5, NAN])


@pytest.mark.parametrize(
    "name, make, attrs, coord, texts",
    [
        ("take", lambda a: a.take("x", [1, 0]), 1, 1, 1), ("isel", lambda a: a.isel("y", 0), 1, 1, 1), ("where", lambda a: a.where(lambda v: v > 1), 1, 1, 1),
        ("ffill", lambda a: a.ffill("x"), 1, 1, 1), ("cumsum", lambda a: a.cumsum("x"), 1, 1, 1), ("cumprod", lambda a: a.cumprod("x"), 1, 1, 1), ("name", lambda a: a.renamed("n"), 1, 1, 1),
        ("sqrt", lambda a: a.sqrt(), 1, 1, 0), ("scalar", lambda a: a + 1.0, 1, 1, 0), ("transpose", lambda a: a.transpose("y", "x"), 1, 1, 0),
        ("binary", lambda a: a + a, 0, 1, 0), ("diff", lambda a: a.diff("x"), 0, 1, 0), ("reduce", lambda a: a.sum("y"), 1, 0, 0),
        ("group", lambda a: a.group_by("x").sum(), 0, 0, 0), ("coarsen", lambda a: a.coarsen("x", 2).mean(), 0, 0, 0), ("rolling", lambda a: a.rolling("x", 2).mean(), 0, 0, 0),
        ("concat", lambda a: concat([a, a], "x"), 0, 0, 0), ("stack", lambda a: stack([a, a], "k"), 0, 0, 0), ("squeeze", lambda a: a.take("y", [0]).squeeze("y"), 0, 0, 0),
        ("expand", lambda a: a.expand_dims("k"), 0, 0, 0), ("rename", lambda a: a.rename_dim("y", "z"), 0, 0, 0), ("dot", lambda a: a.dot(a.rename_dim("x", "w"), "y"), 0, 0, 0),
        ("untouched", lambda a: LabeledDataset({"a": a, "b": a.isel("y", 0)}, check=False).sum("y")["b"], 0, 0, 0),
    ],
)
def test_what_metadata_survives(A, name, make, attrs, coord, texts):
    a = A(["x", "y"], [2, 2], [1, 2, 3, 4], coords={"x": [1, 2]}, texts={"x": ["p", "q"]}).with_attr("units", "K").with_coord_attr("x", "units", "m")
    out = make(a)
    assert (out.attrs == {"units": "K"}, out.coord_attrs == {"x": {"units": "m"}}, bool(out.texts)) == (bool(attrs), bool(coord), bool(texts)), name
