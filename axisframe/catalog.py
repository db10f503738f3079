"""The queries over the driver's tables and their SQL twins.

Each takes (spark, sf_dir), builds labelled arrays from the tables, applies an
operator and returns its cells with plain column names; the SQL beside it says
the same in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .array import LabeledArray
from .functions import calendar, geo, numeric
from .functions.geo import Affine
from .operators import dense, raster
from .operators.base import L, P, T, V, small
from .operators.reshape import concat, stack

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- arrays from the tables


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day(c: str):
    """Epoch seconds of the day of a TIMESTAMP_NTZ column."""
    return (F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) * 86400.0).cast("double")


def _exact(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _prices(spark, sf) -> LabeledArray:
    """Extended price by ship day and return flag."""
    rows = _t(spark, sf, "lineitem").groupBy(_day("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag")).agg(_exact("l_extendedprice").alias("x"))
    return LabeledArray.from_table(rows, ["day", "flag"], "x", "price", ["flag"])


def _quantity(spark, sf) -> LabeledArray:
    """Quantity by supplier and return flag number."""
    flag = F.expr("cast(ascii(l_returnflag) as double)")
    rows = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("double").alias("supp"), flag.alias("flag")).agg(_exact("l_quantity").alias("x"))
    return LabeledArray.from_table(rows, ["supp", "flag"], "x", "quantity")


_QUANTITY = "(select cast(l_suppkey as double) supp, cast(ascii(l_returnflag) as double) flag, cast(sum(cast(l_quantity as decimal(18,2))) as double) x from lineitem group by 1, 2)"


def _part_grid(spark, sf) -> LabeledArray:
    """Largest retail price by size and brand."""
    rows = _t(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand")).agg(F.max("p_retailprice").alias("x"))
    return LabeledArray.from_table(rows, ["size", "brand"], "x", "price", ["brand"])


_PART = "(select cast(p_size as double) size, p_brand brand, max(p_retailprice) x from part group by 1, 2)"


def _daily(spark, sf) -> LabeledArray:
    """Order totals by day: one dimension."""
    rows = _t(spark, sf, "orders").groupBy(_day("o_orderdate").alias("day")).agg(_exact("o_totalprice").alias("x"))
    return LabeledArray.from_table(rows, ["day"], "x", "total")


_DAILY = "(select date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 86400.0::double as day, cast(sum(cast(o_totalprice as decimal(18,2))) as double) x from orders group by 1)"


def _events(spark, sf) -> LabeledArray:
    """Event values along the event number, with every seventh missing."""
    rows = _t(spark, sf, "events").select(F.col("event_id").cast("double").alias("event"), F.when(F.col("event_id") % 7 == 0, F.lit(numeric.NAN)).otherwise(F.col("value")).alias("x"))
    return LabeledArray.from_table(rows, ["event"], "x", "value")


_EVENTS = "(select cast(event_id as double) event, case when event_id % 7 = 0 then null else value end x from events)"


def _shipped(spark, sf) -> LabeledArray:
    """Quantity by ship day; days are others than those of orders."""
    rows = _t(spark, sf, "lineitem").groupBy(_day("l_shipdate").alias("day")).agg(_exact("l_quantity").alias("x"))
    return LabeledArray.from_table(rows, ["day"], "x", "shipped")


_SHIPPED = "(select date_diff('day', date '1970-01-01', cast(l_shipdate as date)) * 86400.0::double as day, cast(sum(cast(l_quantity as decimal(18,2))) as double) x from lineitem group by 1)"


def _cells(a: LabeledArray, digits: int | None = 4, value: str = "x", **names: str) -> DataFrame:
    """Labels (or positions) by dimension and the rounded value."""
    label = lambda d: F.col(T(d) if d in a.texts and d not in a.labelled else L(d) if d in a.labelled else P(d))
    v = F.col(V).cast("double")
    return a.df.select(*[label(d).alias(names.get(d, d)) for d in a.dims], (F.round(v, digits) if digits is not None else v).alias(value))


# -- selection


@query(f"select brand, round(x, 4) x from {_PART} where size = 10")
def sel_label(spark, sf):
    return _cells(_part_grid(spark, sf).sel("size", 10.0))


@query(f"select size, round(x, 4) x from {_PART} where brand = (select min(brand) from {_PART})")
def sel_text(spark, sf):
    a = _part_grid(spark, sf)
    first = a.df.agg(F.min(T("brand"))).first()[0]
    return _cells(a.sel_text("brand", first))


@query(f"select brand, round(x, 4) x from {_PART} where size = (select size from (select distinct size from {_PART}) order by size limit 1 offset 4)")
def isel_position(spark, sf):
    return _cells(_part_grid(spark, sf).isel("size", 4))


@query(f"select size, brand, round(x, 4) x from {_PART} where size between 10 and 20")
def sel_range(spark, sf):
    return _cells(_part_grid(spark, sf).sel_range("size", 20.0, 10.0))


@query(f"select size, brand, round(x, 4) x from {_PART} where size in (30, 5, 17)")
def sel_many(spark, sf):
    return _cells(_part_grid(spark, sf).sel_many("size", [30.0, 5.0, 17.0]))


@query(f"select brand, round(x, 4) x from {_PART} where size = (select size from (select distinct size from {_PART}) order by abs(size - 12.4), size limit 1)")
def sel_nearest(spark, sf):
    return _cells(_part_grid(spark, sf).sel_nearest("size", 12.4))


@query(f"select size, brand, case when x > 1500 then round(x, 4) else -1.0 end x from {_PART}")
def where_predicate(spark, sf):
    return _cells(_part_grid(spark, sf).where(lambda v: v > 1500, -1.0))


@query(f"select a.supp, a.flag, case when b.x > 50 then round(a.x, 4) else 0.0 end x from {_QUANTITY} a join {_QUANTITY} b using (supp, flag)")
def where_mask(spark, sf):
    a = _quantity(spark, sf)
    return _cells(a.where_mask(a.where(lambda v: v > 50, 0.0), 0.0))


# -- reshape and set operations


@query(f"select size, brand, round(x, 4) x from (select * from {_PART} where size between 1 and 10 union all select * from {_PART} where size between 11 and 30)")
def concat_ranges(spark, sf):
    a = _part_grid(spark, sf)
    brands = a._new(a.df.drop(T("brand")), texts=())
    low, high = brands.sel_range("size", 1.0, 10.0), brands.sel_range("size", 11.0, 30.0)
    out = concat([low, high], "size")
    names = a.axis("brand").select(F.col(P("brand")).alias("_p"), F.col(T("brand")).alias("brand"))
    return out.df.join(small(names), F.col(P("brand")) == F.col("_p")).select(F.col(L("size")).alias("size"), "brand", F.round(V, 4).alias("x"))


@query(f"select k, day, round(x, 2) x from (select 1.0::double k, day, coalesce(a.x, 0) x from {_DAILY} a full join {_SHIPPED} b using (day) union all select 2.0::double k, day, coalesce(b.x, 0) x from {_DAILY} a full join {_SHIPPED} b using (day))")
def stack_aligned(spark, sf):
    """Both sides are brought to all labels of either, then stacked."""
    a, b = _both(spark, sf)
    left, right = a.combine(b, lambda x, y: x, "outer", 0.0), a.combine(b, lambda x, y: y, "outer", 0.0)
    return _cells(stack([left, right], "k", [1.0, 2.0]), 2)


@query(f"select flag, supp, round(x, 4) x from {_QUANTITY}")
def transpose_dims(spark, sf):
    return _cells(_quantity(spark, sf).transpose("flag", "supp"))


# -- alignment


def _both(spark, sf):
    return _daily(spark, sf), _shipped(spark, sf)


@query(f"select day, round(a.x + b.x, 2) x from {_DAILY} a join {_SHIPPED} b using (day)")
def add_inner(spark, sf):
    a, b = _both(spark, sf)
    return _cells(a + b, 2)


@query(f"select day, round(coalesce(a.x, 0) - coalesce(b.x, 0), 2) x from {_DAILY} a full join {_SHIPPED} b using (day)")
def sub_outer(spark, sf):
    a, b = _both(spark, sf)
    return _cells(a.sub_join(b, "outer", 0.0), 2)


@query(f"select day, round(a.x * coalesce(b.x, 1) / 1e6, 2) x from {_DAILY} a left join {_SHIPPED} b using (day)")
def mul_left(spark, sf):
    a, b = _both(spark, sf)
    return _cells(a.mul_join(b, "left", 1.0).mul_scalar(1 / 1e6), 2)


@query(f"select day, round(coalesce(a.x, 1) / b.x, 6) x from {_DAILY} a right join {_SHIPPED} b using (day)")
def div_right(spark, sf):
    a, b = _both(spark, sf)
    return _cells(a.div_join(b, "right", 1.0), 6)


@query(f"select day, round(greatest(a.x, b.x), 2) x from {_DAILY} a join {_SHIPPED} b using (day)")
def maximum_inner(spark, sf):
    a, b = _both(spark, sf)
    return _cells(a.maximum(b), 2)


@query("select cast(r_regionkey as double) region, priority, round(r_regionkey + x, 2) x from region, (select o_orderpriority priority, cast(sum(cast(o_totalprice as decimal(18,2))) as double) x from orders group by 1)")
def broadcast_by_name(spark, sf):
    regions = _t(spark, sf, "region").select(F.col("r_regionkey").cast("double").alias("region"), F.col("r_regionkey").cast("double").alias("x"))
    totals = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(_exact("o_totalprice").alias("x"))
    a, b = LabeledArray.from_table(regions, ["region"], "x"), LabeledArray.from_table(totals, ["priority"], "x", "", ["priority"])
    names = b.axis("priority").select(F.col(P("priority")).alias("_p"), F.col(T("priority")).alias("priority"))
    out = (a + b).df.join(small(names), F.col(P("priority")) == F.col("_p"))
    return out.select(F.col(L("region")).alias("region"), "priority", F.round(V, 2).alias("x"))


@query(
    "with e as (select label, k, sum(v) v from (select label, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 k from embeddings) group by 1, 2)"
    " select cast(a.label as double) a, cast(b.label as double) b, round(sum(a.v * b.v), 3) x from e a join e b using (k) group by 1, 2"
)
def dot_gram(spark, sf):
    long = _t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.sum(F.col("v").cast("double")).alias("x"))
    a = LabeledArray.from_table(long.select(F.col("label").cast("double").alias("a"), F.col("k").cast("double").alias("k"), "x"), ["a", "k"], "x")
    return _cells(a.dot(a.rename_dim("a", "b").transpose("k", "b"), "k"), 3)


# -- reductions


_REDUCTIONS = {
    "sum": "sum(x)", "mean": "avg(x)", "min": "min(x)", "max": "max(x)", "var": "var_pop(x)", "std": "stddev_pop(x)", "median": "median(x)", "count": "count(x)",
}


def _reduction(how: str, sql: str) -> None:
    digits = 4 if how in ("var",) else 6

    def run(spark, sf):
        return _cells(_quantity(spark, sf).reduce("supp", how), digits)

    run.__name__ = f"reduce_{how}"
    query(f"select flag, round(cast({sql} as double), {digits}) x from {_QUANTITY} group by 1")(run)


for _how, _q in _REDUCTIONS.items():
    _reduction(_how, _q)


@query(f"select flag, round(quantile_cont(x, 0.9), 6) x from {_QUANTITY} group by 1")
def reduce_quantile(spark, sf):
    return _cells(_quantity(spark, sf).quantile(0.9, "supp"), 6)


@query(f"select flag, supp x from (select *, row_number() over (partition by flag order by x, supp) r from {_QUANTITY}) where r = 1")
def idx_min(spark, sf):
    return _cells(_quantity(spark, sf).idx_min("supp"))


@query(f"select flag, supp x from (select *, row_number() over (partition by flag order by x desc, supp) r from {_QUANTITY}) where r = 1")
def idx_max(spark, sf):
    return _cells(_quantity(spark, sf).idx_max("supp"))


@query(f"select flag, cast(p as double) x from (select *, row_number() over (partition by flag order by x, supp) r from (select *, dense_rank() over (order by supp) - 1 p from {_QUANTITY})) where r = 1")
def arg_min(spark, sf):
    return _cells(_quantity(spark, sf).arg_min("supp"))


@query(f"select cast(count(x) as bigint) n, cast(count(*) - count(x) as bigint) n_na, round(sum(x), 2) total, round(avg(x), 6) mean, min(x) least, max(x) most from {_EVENTS}")
def skipna_totals(spark, sf):
    a = _events(spark, sf)
    found = {n: a.value(how) for n, how in (("n", "count"), ("n_na", "count_na"), ("total", "sum_skipna"), ("mean", "mean_skipna"), ("least", "min_skipna"), ("most", "max_skipna"))}
    rows = spark.createDataFrame([tuple(found.values())], "n long, n_na long, total double, mean double, least double, most double")
    return rows.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 6))


# -- groups


_PRICES = "(select date_diff('day', date '1970-01-01', cast(l_shipdate as date)) * 86400.0::double as day, l_returnflag flag, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) x from lineitem group by 1, 2)"


def _flagged(a: LabeledArray, out: LabeledArray, digits: int = 2) -> DataFrame:
    names = a.axis("flag").select(F.col(P("flag")).alias("_p"), F.col(T("flag")).alias("flag"))
    return out.df.join(small(names), F.col(P("flag")) == F.col("_p")).select(F.col(L("day")).alias("day"), "flag", F.round(F.col(V).cast("double"), digits).alias("x"))


@query(f"select cast(epoch(date_trunc('month', to_timestamp(day) at time zone 'UTC')) as double) as day, flag, round(sum(x), 2) x from {_PRICES} group by 1, 2")
def resample_calendar_month(spark, sf):
    a = _prices(spark, sf)
    return _flagged(a, a.resample_calendar("day", "month").sum())


@query(f"select cast(epoch(date_trunc('year', to_timestamp(day) at time zone 'UTC')) as double) as day, flag, round(max(x), 2) x from {_PRICES} group by 1, 2")
def resample_calendar_year(spark, sf):
    a = _prices(spark, sf)
    return _flagged(a, a.resample_calendar("day", "year").max())


def _climate(component: str, sql: str) -> None:
    def run(spark, sf):
        a = _prices(spark, sf)
        return _flagged(a, a.group_by_time("day", component).mean(), 5)

    run.__name__ = f"climatology_{component}"
    query(f"select cast({sql} as double) as day, flag, round(avg(x), 5) x from (select to_timestamp(day) at time zone 'UTC' t, flag, x from {_PRICES}) group by 1, 2")(run)


for _c, _q in {"month": "month(t)", "weekday": "dayofweek(t)", "dayofyear": "dayofyear(t)", "season": "(month(t) % 12) // 3"}.items():
    _climate(_c, _q)


@query("select l_quantity as quantity, round(sum(x), 2) x from (select l_quantity, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) x from lineitem group by 1, l_linenumber) group by 1")
def group_by_label(spark, sf):
    rows = _t(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("quantity"), F.col("l_linenumber").cast("double").alias("line")).agg(_exact("l_extendedprice").alias("x"))
    rows = rows.select((F.col("quantity") * 10 + F.col("line")).alias("cell"), "quantity", "x")
    a = LabeledArray.from_table(rows, ["cell"], "x")
    same = a._new(a.df.withColumn(L("cell"), F.floor(F.col(L("cell")) / 10).cast("double")))  # labels now repeat
    return _cells(same.group_by("cell").sum(), 2, cell="quantity")


@query("select bin, round(avg(x), 4) x from (select case when q < 10 then 0.0::double when q < 25 then 10.0::double when q <= 50 then 25.0::double end bin, x from (select l_quantity q, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) x from lineitem group by 1)) where bin is not null group by 1")
def group_by_bins(spark, sf):
    rows = _t(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(_exact("l_extendedprice").alias("x"))
    return _cells(LabeledArray.from_table(rows, ["q"], "x").group_by_bins("q", [0.0, 10.0, 25.0, 50.0]).mean(), 4, q="bin")


@query(f"select m + floor((day - m) / 864000) * 864000 as day, round(sum(x), 2) x from {_DAILY}, (select min(day) m from {_DAILY}) group by 1")
def resample_width(spark, sf):
    return _cells(_daily(spark, sf).resample("day", 864000.0).sum(), 2)


@query(f"with d as (select *, row_number() over (order by day) - 1 p, count(*) over () n from {_DAILY}) select min(day) as day, round(avg(x), 4) x from d where p < n // 7 * 7 group by p // 7")
def coarsen_weeks(spark, sf):
    return _cells(_daily(spark, sf).coarsen("day", 7).mean(), 4)


# -- windows


def _rolling(how: str, sql: str) -> None:
    def run(spark, sf):
        out = _daily(spark, sf).rolling("day", 7).agg(how)
        return _cells(out, 2).filter(~F.isnan("x"))

    run.__name__ = f"rolling_{how}"
    query(f"select day, round(y, 2) x from (select day, {sql} over w y, row_number() over (order by day) r from {_DAILY} window w as (order by day rows between 6 preceding and current row)) where r >= 7")(run)


for _how, _q in {"sum": "sum(x)", "mean": "avg(x)", "min": "min(x)", "max": "max(x)"}.items():
    _rolling(_how, _q)


@query(f"select day, round(sum(x) over (order by day), 2) x from {_DAILY}")
def cumulative_sum(spark, sf):
    return _cells(_daily(spark, sf).cumsum("day"), 2)


@query(f"select day, round(exp(sum(ln(1 + x / 1e9)) over (order by day)), 6) x from {_DAILY}")
def cumulative_product(spark, sf):
    return _cells(_daily(spark, sf).mul_scalar(1e-9).add_scalar(1.0).cumprod("day"), 6)


@query(f"select day, round(x - p, 2) x from (select day, x, lag(x) over (order by day) p from {_DAILY}) where p is not null")
def difference(spark, sf):
    return _cells(_daily(spark, sf).diff("day"), 2)


@query(f"select event, coalesce(x, last_value(x ignore nulls) over (order by event rows between unbounded preceding and current row), -1) x from {_EVENTS}")
def forward_fill(spark, sf):
    return _cells(_events(spark, sf).ffill("event").fillna(-1.0), None)


@query(f"select event, coalesce(x, first_value(x ignore nulls) over (order by event rows between current row and unbounded following), -1) x from {_EVENTS}")
def backward_fill(spark, sf):
    return _cells(_events(spark, sf).bfill("event").fillna(-1.0), None)


@query(f"""with e as (select event, x,
 last_value(case when x is not null then event end ignore nulls) over b ea, last_value(x ignore nulls) over b xa,
 first_value(case when x is not null then event end ignore nulls) over f eb, first_value(x ignore nulls) over f xb from {_EVENTS}
 window b as (order by event rows between unbounded preceding and current row), f as (order by event rows between current row and unbounded following))
 select event, round(coalesce(x, case when ea is not null and eb is not null then xa + (xb - xa) * (event - ea) / (eb - ea) else -1 end), 6) x from e""")
def interpolate_missing(spark, sf):
    return _cells(_events(spark, sf).interpolate_na("event").fillna(-1.0), 6)


@query(f"select event, coalesce(x, 0.0) x from {_EVENTS}")
def fill_missing(spark, sf):
    return _cells(_events(spark, sf).fillna(0.0), None)


@query(f"select event, x from {_EVENTS} where x is not null")
def drop_missing(spark, sf):
    return _cells(_events(spark, sf).dropna("event"), None)


@query(f"select event, case when x is null then 1.0 else 0.0 end::double x from {_EVENTS}")
def null_mask(spark, sf):
    return _cells(_events(spark, sf).isnull(), None)


# -- scalar functions


_UNARY = {
    "abs": ("abs(x)", 4), "sqrt": ("sqrt(abs(x))", 6), "log": ("ln(abs(x) + 1)", 6), "exp": ("exp(-abs(x) / 1e4)", 8), "round": ("round(x)", 4),
    "floor": ("floor(x)", 4), "ceil": ("ceil(x)", 4), "sign": ("cast(sign(x) as double)", 4), "sin": ("sin(x / 1e4)", 8), "cos": ("cos(x / 1e4)", 8), "tanh": ("tanh(x / 1e4)", 8),
}
_ACCOUNTS = "(select cast(c_custkey as double) customer, c_acctbal x from customer)"


def _unary(name: str, sql: str, digits: int) -> None:
    def run(spark, sf):
        rows = _t(spark, sf, "customer").select(F.col("c_custkey").cast("double").alias("customer"), F.col("c_acctbal").alias("x"))
        a = LabeledArray.from_table(rows, ["customer"], "x")
        before = {"sqrt": lambda v: F.abs(v), "log": lambda v: F.abs(v) + 1, "exp": lambda v: -F.abs(v) / 1e4, "sin": lambda v: v / 1e4, "cos": lambda v: v / 1e4, "tanh": lambda v: v / 1e4}
        a = a.apply(before[name]) if name in before else a
        return _cells(getattr(a, name)(), digits)

    run.__name__ = f"scalar_{name}"
    query(f"select customer, round({sql}, {digits}) x from {_ACCOUNTS}")(run)


for _name, (_q, _d) in _UNARY.items():
    _unary(_name, _q, _d)


@query(f"select customer, least(greatest(x, 0), 5000)::double x from {_ACCOUNTS}")
def scalar_clip(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").cast("double").alias("customer"), F.col("c_acctbal").alias("x"))
    return _cells(LabeledArray.from_table(rows, ["customer"], "x").clip(5000.0, 0.0), None)


@query("select cast(o_orderkey as double) k, case when o_orderkey % 11 = 0 then -1.0 else round(o_totalprice * 0.01 + 5.0, 6) end x from orders")
def decode_attributes(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("k"), F.when(F.col("o_orderkey") % 11 == 0, F.lit(-999.0)).otherwise(F.col("o_totalprice")).alias("x"))
    a = LabeledArray.from_table(rows, ["k"], "x").with_attr("scale_factor", "0.01").with_attr("add_offset", "5.0").with_attr("_FillValue", "-999")
    return _cells(raster.decode_array(a).fillna(-1.0), 6)


# -- dense arrays and models


_FEATURES = "(select cast(row_number() over (order by p_partkey) - 1 as bigint) r, cast(p_size as double) s, p_retailprice p from part)"


def _features(spark, sf) -> dense.DenseArray:
    rows = _t(spark, sf, "part").select(F.col("p_partkey").cast("double").alias("part"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("f"))
    a = LabeledArray.from_table(rows, ["part"], "f")
    cells = a.df.select(F.col(P("part")).alias(P("0")), F.posexplode(V).alias(P("1"), "x")).select(P("0"), F.col(P("1")).cast("long").alias(P("1")), F.col("x").alias(V))
    return dense.DenseArray(cells, (a.size("part"), 2))


@query(f"with f as (select r, 0::bigint c, s x from {_FEATURES} union all select r, 1::bigint c, p x from {_FEATURES}), m as (select c, avg(x) m, stddev_pop(x) s from f group by 1) select r, c, round((x - m) / s, 6) x from f join m using (c)")
def standardize_columns(spark, sf):
    out, _, _ = dense.standardize(_features(spark, sf))
    return out.df.select(F.col(P("0")).alias("r"), F.col(P("1")).alias("c"), F.round(V, 6).alias("x"))


@query(f"select r, round(2 * s + 0.5 * p, 4) x from {_FEATURES}")
def matrix_vector(spark, sf):
    out = dense.matvec(_features(spark, sf), dense.DenseArray.from_flat(spark, [2], [2.0, 0.5]))
    return out.df.select(F.col(P("0")).alias("r"), F.round(V, 4).alias("x"))


@query(f"with f as (select r, 0::bigint c, s x from {_FEATURES} union all select r, 1::bigint c, p x from {_FEATURES}) select a.c i, b.c j, round(sum(a.x * b.x), 1) x from f a join f b using (r) group by 1, 2")
def matrix_product(spark, sf):
    f = _features(spark, sf)
    out = dense.matmul(f.transpose(), f)
    return out.df.select(F.col(P("0")).alias("i"), F.col(P("1")).alias("j"), F.round(V, 1).alias("x"))


_STANDARD = f"(select r, (s - avg(s) over ()) / stddev_pop(s) over () a, (p - avg(p) over ()) / stddev_pop(p) over () b from {_FEATURES})"


@query(
    f"with recursive m as materialized (select count(*) n, sum(a * a) aa, sum(a * b) ab, sum(b * b) bb, sum(a) a, sum(b) b, sum(a * (3 * b + 1)) ay, sum(b * (3 * b + 1)) hy, sum(3 * b + 1) y from {_STANDARD}),"
    " g as (select 0 e, 0.0::double u, 0.0::double v, 0.0::double w union all select e + 1, u - 0.1 * (u * aa + v * ab + w * m.a - ay) / n, v - 0.1 * (u * ab + v * bb + w * m.b - hy) / n, w - 0.1 * (u * m.a + v * m.b + w * n - y) / n from g, m where e < 200)"
    " select unnest([0, 1, 2])::int i, round(unnest([u, v, w]), 6) + 0.0 w from g where e = 200"
)
def linear_regression(spark, sf):
    x, _, _ = dense.standardize(_features(spark, sf))
    y = dense.DenseArray(x.df.filter(F.col(P("1")) == 1).select(P("0"), (F.col(V) * 3 + 1).alias(V)), (x.shape[0],))
    model = dense.LinearRegression(0.1, 200).fit(x, y)
    return spark.createDataFrame([(i, round(float(w), 6) + 0.0) for i, w in enumerate([*model.weights, model.bias])], "i int, w double")


# -- geography


_PLACES = "(select event_id, (event_id * 37 % 3600) / 10.0 - 180 lon, (event_id * 17 % 1600) / 10.0 - 80 lat, value x from events)"


def _places(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return _t(spark, sf, "events").select("event_id", ((e * 37 % 3600) / 10.0 - 180).alias("lon"), ((e * 17 % 1600) / 10.0 - 80).alias("lat"), F.col("value").alias("value"))


@query(f"select cast(floor((90 - lat) / 10) as bigint) as row, cast(floor((lon + 180) / 10) as bigint) as col, count(*) n, round(avg(x), 6) mean from {_PLACES} group by 1, 2")
def swath_bins(spark, sf):
    return raster.bin_swath(_places(spark, sf), Affine(10, 0, -180, 0, -10, 90), 36, 18).withColumn("mean", F.round("mean", 6))


@query(f"select event_id, round(lon * 6378137.0 * pi() / 180, 3) x, round(ln(tan(lat * pi() / 360 + pi() / 4)) * 6378137.0, 3) + 0.0 y from {_PLACES}")
def web_mercator(spark, sf):
    x, y = geo.transform("EPSG:4326", "EPSG:3857", F.col("lon"), F.col("lat"))
    return _places(spark, sf).select("event_id", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query(f"select event_id, round((lon + 180) / 0.5, 6) col, round((90 - lat) / 0.5, 6) as row from {_PLACES}")
def affine_pixels(spark, sf):
    col, row = Affine(0.5, 0, -180, 0, -0.5, 90).inverse().apply(F.col("lon"), F.col("lat"))
    return _places(spark, sf).select("event_id", F.round(col, 6).alias("col"), F.round(row, 6).alias("row"))


@query(
    "with k as (select f / (2 - f) n, sqrt(f * (2 - f)) e from (select 1 / 298.257223563::double f)),"
    f" t as (select event_id, n, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) t, lam from (select event_id, lat * pi() / 180 phi, lon / 60 * pi() / 180 lam from {_PLACES}), k),"
    " z as (select event_id, n, atan2(t, cos(lam)) xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) eta from t),"
    " c as (select *, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 a2, 61 * n ** 3 / 240 a3, 0.9996 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) r from z)"
    " select event_id, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 2) + 0.0 x,"
    " round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 2) + 0.0 y from c"
)
def utm_coordinates(spark, sf):
    x, y = geo.transform("EPSG:4326", "EPSG:32631", F.col("lon") / 60 + 3, F.col("lat"))
    return _places(spark, sf).select("event_id", (F.round(x, 2) + 0.0).alias("x"), (F.round(y, 2) + 0.0).alias("y"))


@query(
    "with s as (select 6378137.0::double a, 6356752.31414::double b, 35785831.0::double h),"
    f" g as (select event_id, a, b, h, atan((b / a) ** 2 * tan(lat * pi() / 180)) c, lon * pi() / 180 lam from {_PLACES}, s),"
    " v as (select *, b / sqrt(1 - (1 - (b / a) ** 2) * cos(c) ** 2) r from g),"
    " p as (select *, a + h - r * cos(c) * cos(lam) r1, -r * cos(c) * sin(lam) r2, r * sin(c) r3 from v),"
    " w as (select *, r1 * (a + h - r1) - r2 * r2 - r3 * r3 * (a / b) ** 2 >= 0 seen from p)"
    " select event_id, case when seen then round(atan(-r2 / r1) * h, 1) + 0.0 else -1.0 end x, case when seen then round(asin(r3 / sqrt(r1 * r1 + r2 * r2 + r3 * r3)) * h, 1) + 0.0 else -1.0 end y, seen from w"
)
def geostationary_view(spark, sf):
    x, y, seen = geo.Geostationary().forward(F.col("lon"), F.col("lat"))
    shown = lambda c: F.when(seen, F.round(c, 1) + 0.0).otherwise(-1.0)
    return _places(spark, sf).select("event_id", shown(x).alias("x"), shown(y).alias("y"), seen.alias("seen"))


# -- calendar components of timestamps


@query("select event_id, cast(hour(ts) as double) as hour, cast(dayofweek(ts) as double) as weekday, cast((month(ts) % 12) // 3 as double) as season from events")
def time_components(spark, sf):
    epoch = (F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60).cast("double")
    return _t(spark, sf, "events").select("event_id", *[calendar.component(epoch, c).alias(c) for c in ("hour", "weekday", "season")])
