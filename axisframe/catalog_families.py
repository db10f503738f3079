"""Queries for whole families of operators, with their SQL twins: datasets,
skip-NaN and global reductions, block plans, sources, rasters and dense arrays.

They register themselves beside those of :mod:`axisframe.catalog`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .array import LabeledArray
from .catalog import _DAILY, _QUANTITY, _FEATURES, _PLACES, _cells, _daily, _day, _exact, _features, _places, _quantity, _SHIPPED, _shipped, _t, query
from .functions import geo
from .functions.geo import Affine
from .operators import dense, raster
from .operators.base import L, P, V, shared_folder
from .operators.dataset import LabeledDataset
from .operators.reshape import concat, stack
from .plans.blocks import BlockArray
from .sources import netcdf, raw, text, zarr

# -- arrays


def _grid(spark: SparkSession, sf: str) -> LabeledArray:
    """Extended price by quantity and line number, every cell present."""
    rows = _t(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").cast("double").alias("line")).agg(_exact("l_extendedprice").alias("x"))
    return LabeledArray.from_table(rows, ["line", "q"], "x", "price").dense(0.0)


_RAW_GRID = "(select cast(l_quantity as double) q, cast(l_linenumber as double) line, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) x from lineitem group by 1, 2)"
_GRID = f"(select a.line, b.q, coalesce(g.x, 0.0) x, a.i, b.j from (select line, row_number() over (order by line) - 1 i from (select distinct line from {_RAW_GRID})) a cross join (select q, row_number() over (order by q) - 1 j from (select distinct q from {_RAW_GRID})) b left join {_RAW_GRID} g on g.line = a.line and g.q = b.q)"


def _gappy(spark, sf) -> LabeledArray:
    """Quantities, NaN where they are small."""
    return _quantity(spark, sf).where(lambda v: v > 150)


_GAPPY = f"(select supp, flag, case when x > 150 then x end x from {_QUANTITY})"


def _pair(spark, sf) -> LabeledDataset:
    """Quantity and price by supplier and return flag number, and an array without suppliers."""
    flag = F.expr("cast(ascii(l_returnflag) as double)")
    rows = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("double").alias("supp"), flag.alias("flag")).agg(F.struct(_exact("l_quantity").alias("q"), _exact("l_extendedprice").alias("p")).alias("x"))
    both = LabeledArray.from_table(rows, ["supp", "flag"], "x")
    part = lambda c: both._new(both.df.withColumn(V, F.col(f"{V}.{c}")), same_axes=True)
    return LabeledDataset({"quantity": part("q"), "price": part("p")}, check=False)


_PAIR = "(select cast(l_suppkey as double) supp, cast(ascii(l_returnflag) as double) flag, cast(sum(cast(l_quantity as decimal(18,2))) as double) q, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) p from lineitem group by 1, 2)"


def _by_day(spark, sf) -> LabeledDataset:
    """Order totals and their number by day."""
    rows = _t(spark, sf, "orders").groupBy(_day("o_orderdate").alias("day")).agg(F.struct(_exact("o_totalprice").alias("t"), F.count(F.lit(1)).cast("double").alias("n")).alias("x"))
    both = LabeledArray.from_table(rows, ["day"], "x")
    part = lambda c: both._new(both.df.withColumn(V, F.col(f"{V}.{c}")), same_axes=True)
    return LabeledDataset({"total": part("t"), "number": part("n")}, check=False)


_BY_DAY = "(select date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 86400.0::double as day, cast(sum(cast(o_totalprice as decimal(18,2))) as double) t, cast(count(*) as double) n from orders group by 1)"


def _vars(ds: LabeledDataset, digits: int = 4) -> DataFrame:
    """All variables of a dataset below one another."""
    out = None
    for name in ds.names:
        part = _cells(ds[name], digits).withColumn("var", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _register(name: str, sql: str | None, run) -> None:
    run.__name__ = name
    query(sql)(run)


# -- reductions


_SKIP = {
    "sum_skipna": "coalesce(sum(x), 0)", "mean_skipna": "avg(x)", "min_skipna": "coalesce(min(x), 0)", "max_skipna": "coalesce(max(x), 0)",
    "count": "count(x)", "count_na": "count(*) - count(x)",
}
_ALL = {"sum": "sum(x)", "mean": "avg(x)", "min": "min(x)", "max": "max(x)", "var": "var_pop(x)", "std": "stddev_pop(x)", "median": "median(x)"}

for _how, _q in _SKIP.items():
    _register(f"gaps_{_how}", f"select flag, round(cast({_q} as double), 4) x from {_GAPPY} group by 1", lambda spark, sf, how=_how: _cells(getattr(_gappy(spark, sf), how)("supp"), 4).fillna(float("nan")))


def _totals(a: LabeledArray, names) -> DataFrame:
    out = None
    for name in names:
        part = a.total(name).select(F.lit(name).alias("what"), F.round(F.col(V).cast("double"), 3).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


_register("total_of_all_cells", " union all ".join(f"select '{h}' what, round({q}, 3) x from {_QUANTITY}" for h, q in _ALL.items()), lambda spark, sf: _totals(_quantity(spark, sf), _ALL))
_register("total_without_gaps", " union all ".join(f"select '{h}' what, round(cast({q} as double), 3) x from {_GAPPY}" for h, q in _SKIP.items()), lambda spark, sf: _totals(_gappy(spark, sf), _SKIP))


@query(f"select 0.9::double q, round(quantile_cont(x, 0.9), 4) x from {_QUANTITY}")
def total_quantile(spark, sf):
    return spark.createDataFrame([(0.9, _quantity(spark, sf).quantile(0.9))], "q double, x double").select("q", F.round("x", 4).alias("x"))


@query(f"select flag, cast(p as double) x from (select *, row_number() over (partition by flag order by x desc, supp) r from (select *, dense_rank() over (order by supp) - 1 p from {_QUANTITY})) where r = 1")
def arg_max(spark, sf):
    return _cells(_quantity(spark, sf).arg_max("supp"))


# -- datasets


for _how, _q in _ALL.items():
    _sql = " union all ".join(f"select '{v}' var, flag, round({_q.replace('x', c)}, 3) x from {_PAIR} group by 2" for v, c in (("quantity", "q"), ("price", "p")))
    _sql = _sql.replace("maq(", "max(").replace("map(", "max(")
    _register(f"dataset_{_how}", _sql, lambda spark, sf, how=_how: _vars(getattr(_pair(spark, sf), how)("supp"), 3))

_OPS = {"add": ("{c} + ({c} * 2 + 1)", lambda a, b: a + b), "sub": ("{c} - ({c} * 2 + 1)", lambda a, b: a - b), "mul": ("{c} * ({c} * 2 + 1)", lambda a, b: a * b), "div": ("{c} / ({c} * 2 + 1)", lambda a, b: a / b)}
for _how, (_q, _f) in _OPS.items():
    _sql = " union all ".join(f"select '{v}' var, supp, flag, round({_q.format(c=c)}, 3) x from {_PAIR}" for v, c in (("quantity", "q"), ("price", "p")))

    def _run(spark, sf, f=_f):
        ds = _pair(spark, sf)
        return _vars(f(ds, ds.mul_scalar(2.0).add_scalar(1.0)), 3)

    _register(f"dataset_{_how}", _sql, _run)


@query(" union all ".join(f"select '{v}' var, flag, round({c}, 3) x from {_PAIR} where supp = (select min(supp) from {_PAIR})" for v, c in (("quantity", "q"), ("price", "p"))))
def dataset_isel(spark, sf):
    return _vars(_pair(spark, sf).isel("supp", 0), 3)


@query(" union all ".join(f"select '{v}' var, supp, round({c}, 3) x from {_PAIR} where flag = 82" for v, c in (("quantity", "q"), ("price", "p"))))
def dataset_sel(spark, sf):
    return _vars(_pair(spark, sf).sel("flag", 82.0), 3)


@query(f"select 'number' var, day, round(n, 3) x from {_BY_DAY} union all select 'mean' var, day, round(t / n, 3) x from {_BY_DAY}")
def dataset_merge(spark, sf):
    """Variables are added, merged and left out."""
    ds = _by_day(spark, sf)
    return _vars(ds.merge(LabeledDataset({"mean": ds["total"] / ds["number"]})).with_var("again", ds["number"]).drop_vars("total", "again"), 3)


_DS = (("total", "t"), ("number", "n"))


def _both(sql: str) -> str:
    return " union all ".join(f"select '{v}' var, {sql.format(c=c)}" for v, c in _DS)


@query(_both("day, round(sum({c}) over (order by day), 2) x from " + _BY_DAY))
def dataset_cumsum(spark, sf):
    return _vars(_by_day(spark, sf).cumsum("day"), 2)


@query(_both("day, case when {c} > 5 then round({c}, 2) else -1.0 end x from " + _BY_DAY))
def dataset_fillna(spark, sf):
    ds = _by_day(spark, sf)
    return _vars(LabeledDataset({k: ds[k].where(lambda v: v > 5) for k in ds.names}, check=False).fillna(-1.0), 2)


_AGG = {"sum": "sum({c})", "mean": "avg({c})", "min": "min({c})", "max": "max({c})"}
_MONTH = f"(select cast(epoch(date_trunc('month', to_timestamp(day) at time zone 'UTC')) as double) as day, t, n from {_BY_DAY})"
_GROUPS = {
    "calendar": (lambda ds: ds.resample_calendar("day", "month"), _MONTH),
    "climate": (lambda ds: ds.group_by_time("day", "month"), f"(select cast(month(to_timestamp(day) at time zone 'UTC') as double) as day, t, n from {_BY_DAY})"),
    "width": (lambda ds: ds.resample("day", 864000.0), f"(select m + floor((day - m) / 864000) * 864000 as day, t, n from {_BY_DAY}, (select min(day) m from {_BY_DAY}))"),
    "bins": (lambda ds: ds.group_by_bins("day", [0.0, 7e8, 8e8, 1e10]), f"(select case when day < 7e8 then 0.0::double when day < 8e8 then 7e8::double else 8e8::double end as day, t, n from {_BY_DAY})"),
    "label": (lambda ds: LabeledDataset({k: ds[k]._new(ds[k].df.withColumn(L("day"), F.floor(F.col(L("day")) / 604800).cast("double"))) for k in ds.names}, check=False).group_by("day"), f"(select cast(floor(day / 604800) as double) as day, t, n from {_BY_DAY})"),
    "coarsen": (lambda ds: ds.coarsen("day", 7), f"(select min(day) over (partition by p // 7) as day, t, n from (select *, row_number() over (order by day) - 1 p, count(*) over () c from {_BY_DAY}) where p < c // 7 * 7)"),
}
_SOME = {"calendar": ("sum", "mean", "min", "max"), "label": ("sum", "mean", "min", "max"), "width": ("mean", "min"), "bins": ("mean",), "climate": ("mean",), "coarsen": ("mean", "max")}
for _kind, (_make, _from) in _GROUPS.items():
    for _how in _SOME[_kind]:
        _register(
            f"dataset_{_kind}_{_how}", _both("day, round(" + _AGG[_how] + ", 5) x from " + _from + " group by day"),
            lambda spark, sf, make=_make, how=_how: _vars(getattr(make(_by_day(spark, sf)), how)(), 5),
        )
for _how, _q in _AGG.items():
    _register(
        f"group_{_how}", f"select floor(day / 604800) as week, round({_q.format(c='x')}, 5) x from {_DAILY} group by 1",
        lambda spark, sf, how=_how: _cells(getattr(_weeks(spark, sf), how)(), 5, day="week"),
    )
    _register(
        f"resample_{_how}", f"select m + floor((day - m) / 1728000) * 1728000 as day, round({_q.format(c='x')}, 5) x from {_DAILY}, (select min(day) m from {_DAILY}) group by 1",
        lambda spark, sf, how=_how: _cells(getattr(_daily(spark, sf).resample("day", 1728000.0), how)(), 5),
    )
    _register(
        f"dataset_rolling_{_how}",
        _both("day, round(y, 5) x from (select day, " + _q + " over (order by day rows between 4 preceding and current row) y, row_number() over (order by day) r from " + _BY_DAY + ") where r >= 5"),
        lambda spark, sf, how=_how: _vars(getattr(_by_day(spark, sf).rolling("day", 5), how)(), 5).filter(~F.isnan("x")),
    )


def _weeks(spark, sf):
    a = _daily(spark, sf)
    return a._new(a.df.withColumn(L("day"), F.floor(F.col(L("day")) / 604800).cast("double"))).group_by("day")


@query(f"select 'groups' what, cast(count(distinct floor(day / 604800)) as double) x from {_DAILY} union all select 'first', min(floor(day / 604800)) from {_DAILY} union all select 'last', max(floor(day / 604800)) from {_DAILY}")
def group_labels(spark, sf):
    weeks = _weeks(spark, sf)
    labels = weeks.labels()
    return spark.createDataFrame([("groups", float(weeks.n_groups())), ("first", labels[0]), ("last", labels[-1])], "what string, x double")


# -- selection, shape, arithmetic


@query(f"select line, q, round(x, 2) x from {_GRID} where line = 3")
def squeeze_one(spark, sf):
    """A dimension of one position is there, goes, and comes back."""
    a = _grid(spark, sf).sel_range("line", 3.0, 3.0)
    return _cells(a.squeeze("line").expand_dims("line"), 2).withColumn("line", F.col("line") + 3.0)


@query(f"select q, round(x, 2) x from {_GRID} where line = 5")
def isel_after_range(spark, sf):
    return _cells(_grid(spark, sf).sel_range("line", 5.0, 5.0).isel("line", 0), 2)


@query(f"select cast(0 as bigint) as one, q, line, round(x, 2) x from {_GRID}")
def expand_dims(spark, sf):
    return _cells(_grid(spark, sf).expand_dims("one"), 2)


@query(f"select line, q, round(x, 2) x from {_GRID} where line between 2 and 4 and q between 10 and 20")
def box_of_labels(spark, sf):
    return _cells(_grid(spark, sf).box("q", "line", (10.0, 2.0, 20.0, 4.0)), 2)


@query(f"select 'point' what, round(x, 2) x from {_GRID} where line = 4 and q = 13 union all select 'at', round(x, 2) from {_GRID} where i = 2 and j = 3")
def single_cells(spark, sf):
    a = _grid(spark, sf)
    return spark.createDataFrame([("point", float(a.point("q", "line", 13.2, 3.9))), ("at", float(a.at(2, 3)))], "what string, x double").withColumn("x", F.round("x", 2))


@query(f"select line, q, round(x, 2) x from {_GRID} where line in (2, 6)")
def sel_nearest_many(spark, sf):
    return _cells(_grid(spark, sf).sel_nearest_many("line", [1.8, 6.3]), 2)


@query(f"select line, q, round(x, 2) x from {_GRID} where line = 2")
def sel_nearest_keep(spark, sf):
    return _cells(_grid(spark, sf).sel_nearest_keep("line", 1.8), 2)


@query(f"select size, brand, round(x, 4) x from (select cast(p_size as double) size, p_brand brand, max(p_retailprice) x from part group by 1, 2) where brand in (select brand from (select distinct p_brand brand from part) order by brand limit 2)")
def sel_text_many(spark, sf):
    from .catalog import _part_grid

    a = _part_grid(spark, sf)
    return _cells(a.sel_text_many("brand", sorted(a.text_labels("brand"))[:2]))


@query(f"select k, line, q, round(x * k, 2) x from {_GRID}, (select unnest([1.0, 2.0, 3.0])::double k)")
def stack_copies(spark, sf):
    a = _grid(spark, sf)
    return _cells(stack([a, a.mul_scalar(2.0), a.mul_scalar(3.0)], "k", [1.0, 2.0, 3.0]), 2)


@query(f"select cast(i + 7 * k as bigint) place, q, round(x + k, 2) x from {_GRID}, (select unnest([0, 1]) k)")
def concat_copies(spark, sf):
    a = _grid(spark, sf)
    out = concat([a, a.add_scalar(1.0)], "line")
    return out.df.select(F.col(P("line")).alias("place"), F.col(L("q")).alias("q"), F.round(V, 2).alias("x"))


@query(f"select day, round(least(a.x, b.x), 2) x from {_DAILY} a join {_SHIPPED} b using (day)")
def minimum_inner(spark, sf):
    return _cells(_daily(spark, sf).minimum(_shipped(spark, sf)), 2)


@query(f"select day, round(coalesce(a.x, 0) + coalesce(b.x, 0), 2) x from {_DAILY} a full join {_SHIPPED} b using (day)")
def add_outer(spark, sf):
    return _cells(_daily(spark, sf).add_join(_shipped(spark, sf), "outer", 0.0), 2)


@query(f"select day, round(pow(x / 1e6, 1.5), 6) x from {_DAILY}")
def scalar_pow(spark, sf):
    return _cells(_daily(spark, sf).mul_scalar(1e-6).pow(1.5), 6)


@query(f"select supp, flag, case when x is null then 0.0 else 1.0 end::double x from {_GAPPY}")
def value_mask(spark, sf):
    return _cells(_gappy(spark, sf).notnull(), None)


@query(f"select 10.25::double q, 3.5::double line, round(sum(x * (1 - abs(q - 10.25)) * (1 - abs(line - 3.5))), 2) x from {_GRID} where q in (10, 11) and line in (3, 4)")
def bilinear_point(spark, sf):
    out = _grid(spark, sf).bilinear("q", "line", 10.25, 3.5)
    return out.df.select(F.lit(10.25).alias("q"), F.lit(3.5).alias("line"), F.round(V, 2).alias("x"))


@query(f"select day, round(x, 9) x from (with recursive d as (select day, 1 + x / 1e9 f, row_number() over (order by day) r from {_DAILY}), p as (select day, f x, r from d where r = 1 union all select d.day, p.x * d.f, d.r from p join d on d.r = p.r + 1) select day, x from p)")
def running_product(spark, sf):
    return _cells(_daily(spark, sf).mul_scalar(1e-9).add_scalar(1.0).cumprod("day"), 9)


# -- block plans


@query(" union all ".join(f"select '{h}' what, round({q}, 2) x from {_GRID}" for h, q in (("sum", "sum(x + 1)"), ("mean", "avg(x + 1)"), ("min", "min(x + 1)"), ("max", "max(x + 1)"), ("mean of products", "avg((x + 1) * x / 1e6)"), ("blocks", "ceil(count(distinct i) / 2)"))))
def blocks_totals(spark, sf):
    a = _grid(spark, sf)
    b = BlockArray(a, 2)
    c = b.add_scalar(1.0)
    rows = [("sum", c.sum()), ("mean", c.mean()), ("min", c.min()), ("max", c.max()), ("mean of products", (c * b.mul_scalar(1e-6)).mean()), ("blocks", float(b.n_blocks))]
    return spark.createDataFrame([(k, float(x)) for k, x in rows], "what string, x double").withColumn("x", F.round("x", 2))


for _how, _q in {"sum": "sum", "mean": "avg", "min": "min", "max": "max"}.items():
    _register(f"blocks_{_how}_axis", f"select q, round({_q}(x), 2) x from {_GRID} group by 1", lambda spark, sf, how=_how: _cells(getattr(BlockArray(_grid(spark, sf), 3), f"{how}_axis")("line"), 2))
for _how, (_q, _f) in _OPS.items():

    def _run(spark, sf, f=_f):
        b = BlockArray(_grid(spark, sf), 3)
        return _cells(f(b, b.map(lambda v: v * 2 + 1)).compute(), 3)

    _register(f"blocks_{_how}", f"select line, q, round({_q.format(c='x')}, 3) x from {_GRID}", _run)


# -- sources: what is written is read back


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark).removeprefix('file://')}/source-{uuid.uuid4().hex}"


_CELLS = f"select line, q, round(x, 2) x from {_GRID}"


def _by_zarr(version: int, codec: str):
    def run(spark, sf):
        path = _place(spark)
        zarr.write_zarr(_grid(spark, sf), path, [3, 16], codec, version)
        return _cells(zarr.read_zarr(spark, path), 2)

    return run


for _version, _codec in ((2, "zlib"), (2, "zstd"), (3, "zstd"), (3, "gzip")):
    _register(f"zarr{_version}_{_codec}", _CELLS, _by_zarr(_version, _codec))


def _by_zarr_dataset(version: int):
    def run(spark, sf):
        path, a = _place(spark), _grid(spark, sf)
        zarr.write_zarr_dataset(LabeledDataset({"price": a, "double": a.mul_scalar(2.0)}), path, {"q": 10, "line": 4}, "zlib" if version == 2 else "zstd", version)
        return _vars(zarr.read_zarr_dataset(spark, path), 2)

    return run


_TWO = f"select 'price' var, line, q, round(x, 2) x from {_GRID} union all select 'double' var, line, q, round(2 * x, 2) x from {_GRID}"
for _version in (2, 3):
    _register(f"zarr{_version}_dataset", _TWO, _by_zarr_dataset(_version))


@query(f"select cast(i // 2 as bigint) line, cast(j // 2 as bigint) q, round(avg(x), 5) x from {_GRID} where i < 6 group by 1, 2")
def zarr_pyramid(spark, sf):
    path = _place(spark)
    zarr.write_pyramid(_grid(spark, sf), path, "line", "q", 2)
    out = zarr.read_pyramid_level(spark, path, 1)
    return out.df.select(F.col(P("line")).alias("line"), F.col(P("q")).alias("q"), F.round(V, 5).alias("x"))


@query(_CELLS)
def netcdf_array(spark, sf):
    path = _place(spark)
    with open(path, "wb") as f:
        f.write(netcdf.array_to_netcdf(_grid(spark, sf)))
    return _cells(netcdf.open_netcdf(spark, path)["price"], 2)


@query(_TWO)
def netcdf_dataset(spark, sf):
    path, a = _place(spark), _grid(spark, sf)
    with open(path, "wb") as f:
        f.write(netcdf.to_netcdf(LabeledDataset({"price": a, "double": a.mul_scalar(2.0)})))
    return _vars(netcdf.read_netcdf(spark, path), 2)


@query(_CELLS)
def json_array(spark, sf):
    return _cells(text.from_json(spark, text.to_json(_grid(spark, sf))), 2)


@query(_TWO)
def json_dataset(spark, sf):
    a = _grid(spark, sf)
    return _vars(text.dataset_from_json(spark, text.dataset_to_json(LabeledDataset({"price": a, "double": a.mul_scalar(2.0)}))), 2)


@query(_CELLS)
def csv_text(spark, sf):
    return _cells(text.from_csv(spark, text.to_csv(_grid(spark, sf))), 2)


@query(_CELLS)
def csv_files(spark, sf):
    path = _place(spark)
    text.write_csv(_grid(spark, sf), f"file://{path}")
    return _cells(text.read_csv(spark, f"file://{path}", ["line", "q"], "price"), 2)


@query(f"select i as line, j as q, round(x, 2) x from {_GRID}")
def raw_cells(spark, sf):
    path, a = _place(spark), _grid(spark, sf)
    raw.write_raw(a.flat(), path)
    return _cells(raw.read_raw(spark, path, ["line", "q"], list(a.shape), 2), 2)


# -- rasters: positions of the grid as pixels of one degree


_SOURCE = Affine(1, 0, 0, 0, -1, 7)
_KERNEL = {"bilinear": (0, 1, "greatest(0.0, 1 - abs({t}))"), "cubic": (-1, 2, "case when abs({t}) <= 1 then ((abs({t}) * 1.5 - 2.5) * abs({t})) * abs({t}) + 1 when abs({t}) < 2 then ((abs({t}) * -0.5 + 2.5) * abs({t}) - 4) * abs({t}) + 2 else 0.0 end")}
_FINE = "(select c, r, (c + 0.5) * 0.5 u, (r + 0.5) * 0.5 w from (select unnest(range(100)) c), (select unnest(range(14)) r))"


def _pixels(a: LabeledArray, digits: int = 2) -> DataFrame:
    return a.df.select(F.col(P("line")).alias("r"), F.col(P("q")).alias("c"), F.round(V, digits).alias("x")).filter(~F.isnan("x"))


def _warped(method: str):
    def run(spark, sf):
        fine = Affine(0.5, 0, 0, 0, -0.5, 7)
        return _pixels(raster.warp(_grid(spark, sf), "q", "line", _SOURCE, lambda x, y: (x, y), fine, 100, 14, method), 6 if method == "bilinear" else 2)

    return run


_register("warp_nearest", f"select r, c, round(x, 2) x from {_FINE} join {_GRID} on i = floor(w) and j = floor(u)", _warped("nearest"))
for _method, (_low, _high, _k) in _KERNEL.items():
    _n = (_high - _low + 1) ** 2
    _weight = f"({_k.format(t='(u - 0.5 - j)')}) * ({_k.format(t='(w - 0.5 - i)')})"
    _register(
        f"warp_{_method}",
        f"select r, c, round(sum(x * {_weight}), {6 if _method == 'bilinear' else 2}) x from {_FINE} join {_GRID} on i between floor(w - 0.5) + {_low} and floor(w - 0.5) + {_high} and j between floor(u - 0.5) + {_low} and floor(u - 0.5) + {_high} group by 1, 2 having count(*) = {_n}",
        _warped(_method),
    )


@query(
    f"select r, c, round(x, 2) x from (select c, r, (c + 0.5) * 100000.0 / 6378137.0 * 180 / pi() lon, (2 * atan(exp((700000.0 - (r + 0.5) * 100000.0) / 6378137.0)) - pi() / 2) * 180 / pi() lat"
    f" from (select unnest(range(55)) c), (select unnest(range(7)) r)) join {_GRID} on i = floor(7 - lat) and j = floor(lon)"
)
def reproject_nearest(spark, sf):
    target = Affine(100000, 0, 0, 0, -100000, 700000)
    return _pixels(raster.reproject(_grid(spark, sf), "q", "line", _SOURCE, "EPSG:4326", target, "EPSG:3857", 55, 7, "nearest"))


@query(f"select 6.5 - i as line, j + 0.5 as q, round(x, 2) x from {_GRID}")
def georeferenced(spark, sf):
    return _cells(raster.georeference(_grid(spark, sf), raster.GeoRef(_SOURCE), "q", "line"), 2)


@query(f"select floor((90 - lat) / 10) * -10 + 85 as latitude, floor((lon + 180) / 10) * 10 - 175 as longitude, round(avg(x), 6) x from {_PLACES} group by 1, 2")
def swath_grid(spark, sf):
    out = raster.swath_array(_places(spark, sf), Affine(10, 0, -180, 0, -10, 90), 36, 18, "mean")
    return _cells(out, 6).filter(~F.isnan("x"))


@query(f"select event_id, round(lon, 6) lon, round(lat, 6) lat from {_PLACES}")
def web_mercator_and_back(spark, sf):
    x, y = geo.transform("EPSG:4326", "EPSG:3857", F.col("lon"), F.col("lat"))
    there = _places(spark, sf).select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.transform("EPSG:3857", "EPSG:4326", F.col("x"), F.col("y"))
    return there.select("event_id", (F.round(lon, 6) + 0.0).alias("lon"), (F.round(lat, 6) + 0.0).alias("lat"))


@query(f"select event_id, round(lon / 60 + 3, 6) lon, round(lat, 6) lat from {_PLACES}")
def utm_and_back(spark, sf):
    x, y = geo.transform("EPSG:4326", "EPSG:32631", F.col("lon") / 60 + 3, F.col("lat"))
    there = _places(spark, sf).select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.transform("EPSG:32631", "EPSG:4326", F.col("x"), F.col("y"))
    return there.select("event_id", (F.round(lon, 6) + 0.0).alias("lon"), (F.round(lat, 6) + 0.0).alias("lat"))


@query(f"select event_id, round(lon / 36 + 3, 6) lon, round(46.5 + lat / 40, 6) lat from {_PLACES}")
def lambert_and_back(spark, sf):
    x, y = geo.transform("EPSG:4326", "EPSG:2154", F.col("lon") / 36 + 3, 46.5 + F.col("lat") / 40)
    there = _places(spark, sf).select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.transform("EPSG:2154", "EPSG:4326", F.col("x"), F.col("y"))
    return there.select("event_id", (F.round(lon, 6) + 0.0).alias("lon"), (F.round(lat, 6) + 0.0).alias("lat"))


# -- decoding of datasets and time


@query(_both("day, case when {c} = 7 then -1.0 else round({c} * 0.5 + 3, 4) end x from " + _BY_DAY))
def dataset_decode(spark, sf):
    ds = _by_day(spark, sf)
    coded = {k: ds[k].with_attr("scale_factor", "0.5").with_attr("add_offset", "3").with_attr("_FillValue", "7") for k in ds.names}
    return _vars(raster.decode(LabeledDataset(coded, check=False)).fillna(-1.0), 4)


@query(_both("day, round({c}, 2) x from " + _BY_DAY))
def dataset_decode_time(spark, sf):
    ds = _by_day(spark, sf)
    hours = {k: ds[k]._new(ds[k].df.withColumn(L("day"), (F.col(L("day")) - 86400.0 * 10957) / 3600)).with_coord_attr("day", "units", "hours since 2000-01-01") for k in ds.names}
    return _vars(raster.decode_time(LabeledDataset(hours, check=False), "day"), 2)


# -- dense arrays


_TABLE = f"(select r, 0::bigint c, s x from {_FEATURES} union all select r, 1::bigint c, p x from {_FEATURES})"


def _numbers(a: dense.DenseArray, digits: int = 4) -> DataFrame:
    return a.df.select(*[F.col(P(str(i))).alias("rc"[i]) for i in range(a.ndim)], F.round(V, digits).alias("x"))


for _how, (_q, _f) in _OPS.items():

    def _run(spark, sf, f=_f):
        a = _features(spark, sf)
        return _numbers(f(a, a.mul_scalar(2.0).add_scalar(1.0)))

    _register(f"dense_{_how}", f"select r, c, round({_q.format(c='x')}, 4) x from {_TABLE}", _run)
_register("dense_sum_axis", f"select c as r, round(sum(x), 2) x from {_TABLE} group by 1", lambda spark, sf: _numbers(_features(spark, sf).sum_axis(0), 2))
_register("dense_mean_axis", f"select r, round(avg(x), 4) x from {_TABLE} group by 1", lambda spark, sf: _numbers(_features(spark, sf).mean_axis(1)))


@query(f"select 'sum' what, round(sum(x), 2) x from {_TABLE} union all select 'mean', round(avg(x), 2) from {_TABLE} union all select 'size', cast(count(*) as double) from {_TABLE} union all select 'at', round(x, 2) from {_TABLE} where r = 3 and c = 1 union all select 'error', round(avg((2 * s + 0.5 * p + 1 - p) * (2 * s + 0.5 * p + 1 - p)), 2) from {_FEATURES}")
def dense_numbers(spark, sf):
    """Totals, a cell, and the error of a linear model's predictions."""
    a = _features(spark, sf)
    model = dense.LinearRegression()
    model.weights, model.bias = [2.0, 0.5], 1.0
    target = dense.DenseArray(a.df.filter(F.col(P("1")) == 1).select(P("0"), V), (a.shape[0],))
    rows = [("sum", a.sum()), ("mean", a.mean()), ("size", float(a.size)), ("at", a.at(3, 1)), ("error", dense.mean_squared_error(model.predict(a), target))]
    return spark.createDataFrame(rows, "what string, x double").withColumn("x", F.round("x", 2))


@query("select r, round(r * 2.0 + 1, 2) x from (select unnest(range(1000)) r)")
def dense_made(spark, sf):
    a = dense.DenseArray.arange(spark, 1000)
    return _numbers(a + a + dense.DenseArray.zeros(spark, 1000).add_scalar(1.0), 2)
