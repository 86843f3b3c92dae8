"""Registered queries of the panel operators, each with the same in DuckDB SQL."""

from __future__ import annotations

import asyncio
import itertools
import tempfile
from collections.abc import Callable
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.calendars import AllDays, Calendar, DayList, Weekdays
from panelwright.panel import Panel
from panelwright.plans.batches import batch
from panelwright.plans.held import HELD
from panelwright.plans.keys import DATE, ID
from panelwright.plans.settings import configure, reset_settings
from panelwright.sources.store import PanelStore

USER_RANGE = (date(2024, 1, 1), date(2024, 1, 31))
LONG_RANGE = (date(1995, 1, 1), date(2001, 12, 31))
MONEY = "decimal(18,4)"

#: Panels by letter, in SQL: daily sums for users (u), the same with gaps in the values (g),
#: orders of customers (c), shipments of suppliers (s).
PANELS = {
    "u": "select cast(ts as date) as as_of_date, user_id as id, cast(sum(cast(value as decimal(18,4))) as double) as value, cast(count(*) as double) as n from events group by 1, 2",
    "c": "select cast(o_orderdate as date) as as_of_date, o_custkey as id, cast(sum(cast(o_totalprice as decimal(18,4))) as double) as spent, cast(count(*) as double) as orders from orders group by 1, 2",
    "s": "select cast(l_shipdate as date) as as_of_date, l_suppkey as id, cast(sum(cast(l_quantity as decimal(18,4))) as double) as quantity, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as price from lineitem group by 1, 2",
}
PANELS["g"] = f"select as_of_date, id, case when (id + day(as_of_date)) % 5 = 0 then null else value end as value, case when (id + day(as_of_date)) % 7 < 2 then null else n end as n from ({PANELS['u']})"


def _daily(spark: SparkSession, sf_dir: str, table: str, time: str, key: str, **sums: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    totals = [F.sum(F.col(c).cast(MONEY)).cast("double").alias(n) if c != "*" else F.count("*").cast("double").alias(n) for n, c in sums.items()]
    return df.groupBy(F.col(time).cast("date").alias(DATE), F.col(key).alias(ID)).agg(*totals)


def users(spark: SparkSession, sf_dir: str, calendar=None) -> Panel:
    return Panel.from_table(_daily(spark, sf_dir, "events", "ts", "user_id", value="value", n="*"), calendar or AllDays(), name="users")


def gappy(spark: SparkSession, sf_dir: str, calendar=None) -> Panel:
    mix = lambda k: (F.col(ID) + F.day(DATE)) % k
    return users(spark, sf_dir, calendar).transform(lambda df: df.withColumns({"value": F.when(mix(5) != 0, F.col("value")), "n": F.when(mix(7) >= 2, F.col("n"))}))


def customers(spark: SparkSession, sf_dir: str) -> Panel:
    return Panel.from_table(_daily(spark, sf_dir, "orders", "o_orderdate", "o_custkey", spent="o_totalprice", orders="*"), AllDays(), name="customers")


def suppliers(spark: SparkSession, sf_dir: str) -> Panel:
    return Panel.from_table(_daily(spark, sf_dir, "lineitem", "l_shipdate", "l_suppkey", quantity="l_quantity", price="l_extendedprice"), AllDays(), name="suppliers")


class Fridays(Calendar):
    """A calendar of its own: one day a week."""

    def contains(self, d: date) -> bool:
        return d.weekday() == 4

    def offset(self, d: date, n: int) -> date:
        if n == 0:
            return d
        last = d - timedelta((d.weekday() - 4) % 7)
        return last + timedelta(7 * n + (7 if n < 0 and last != d else 0))


SOURCES = {"u": (users, USER_RANGE), "g": (gappy, USER_RANGE), "c": (customers, LONG_RANGE), "s": (suppliers, LONG_RANGE)}
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Six decimals, for two engines that add in different orders; the offset moves values
    that are exactly between two sixth decimals off the edge."""
    return df.select(*[(F.round(F.col(f.name) + F.lit(1e-8), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def _panel(name: str, letter: str, op: Callable[..., Panel], sql: str, second: str = "", calendar=None) -> None:
    """Register ``op(panel)`` or ``op(panel, second panel)`` over the panel's whole range."""
    source, span = SOURCES[letter]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = source(spark, sf_dir, calendar) if calendar else source(spark, sf_dir)
        other = [SOURCES[second][0](spark, sf_dir)] if second else []
        return rounded(op(own, *other).df(*span))

    both = f"with p as ({PANELS[letter]})" + (f", q as ({PANELS[second]})" if second else "")
    _FOUND[name] = (run, f"{both} {sql}")


def r(x: str, name: str) -> str:
    return f"round({x} + 1e-8, 6) + 0.0 as {name}"


def _rows(value: str, letter: str = "g") -> str:
    """SQL that maps ``value`` (with @ for the column) over both value columns."""
    names = {"u": ("value", "n"), "g": ("value", "n"), "c": ("spent", "orders"), "s": ("quantity", "price")}[letter]
    return f"select as_of_date, id, {', '.join(r(value.replace('@', c), c) for c in names)} from p"


W = "over (partition by id order by as_of_date rows between 4 preceding and current row)"
U = "over (partition by id order by as_of_date rows between unbounded preceding and current row)"
O = "over (partition by id order by as_of_date)"  # noqa: E741
X = "over (partition by as_of_date)"
RATIO = "case when {b} <> 0 then {a} / {b} when {b} = 0 and {a} > 0 then 'inf'::double when {b} = 0 and {a} < 0 then '-inf'::double end"


def _register_rows() -> None:
    _panel("s2_range_scan", "u", lambda p: Panel(lambda s, e: p.df(date(2024, 1, 8), date(2024, 1, 12), ["value"], [("n", ">", 1.0)])), f"select as_of_date, id, {r('value', 'value')} from p where as_of_date between '2024-01-08' and '2024-01-12' and n > 1")
    _panel("s3_point_scan", "u", lambda p: Panel(lambda s, e: p.get(date(2024, 1, 9))), f"select id, {r('value', 'value')}, {r('n', 'n')} from p where as_of_date = '2024-01-09'")
    _panel("p1_select", "u", lambda p: p.select(["value"]), f"select as_of_date, id, {r('value', 'value')} from p")
    _panel("p2_filter", "g", lambda p: p.filter([("value", ">=", 20.0), ("id", "<", 100)]), _rows("@") + " where value >= 20 and id < 100")
    _panel("p3_not_equal", "g", lambda p: p.filter([("n", "!=", 2.0)]), _rows("@") + " where n is distinct from 2")
    _panel("p3_not_in", "g", lambda p: p.filter([("n", "not in", [1.0, 2.0])]), _rows("@") + " where n is null or n not in (1, 2)")
    _panel("p3_in", "g", lambda p: p.filter([("n", "in", [2.0, 3.0])]), _rows("@") + " where n in (2, 3)")
    _panel("p5_rename", "u", lambda p: p.rename({"value": "amount", "nothing": "x"}), f"select as_of_date, id, {r('value', 'amount')}, {r('n', 'n')} from p")
    _panel("p6_dropna_any", "g", lambda p: p.dropna(), _rows("@") + " where value is not null and n is not null")
    _panel("p6_dropna_all", "g", lambda p: p.dropna("all"), _rows("@") + " where value is not null or n is not null")
    _panel("p7_fillna_value", "g", lambda p: p.fillna(-1.5), _rows("coalesce(@, -1.5)"))
    _panel("p7_fillna_ffill", "g", lambda p: p.fillna(method="ffill"), _rows(f"last_value(@ ignore nulls) {U}"))
    _panel("p7_fillna_bfill", "g", lambda p: p.fillna(method="bfill"), _rows("first_value(@ ignore nulls) over (partition by id order by as_of_date rows between current row and unbounded following)"))
    _panel("p8_clip", "g", lambda p: p.clip(2.0, 80.0), _rows("case when @ is not null then least(greatest(@, 2), 80) end"))
    cond = lambda p: p.transform(lambda df: df.select(F.date_add(DATE, 1).alias(DATE), ID, (F.col("value") > 50).alias("value")))
    joined = "from p left join (select as_of_date + 1 as as_of_date, id, value > 50 as c from p) k using (as_of_date, id)"
    _panel("p9_where", "g", lambda p: p.where(cond(p), -1.0), f"select as_of_date, id, {r('case when coalesce(c, false) then value else -1 end', 'value')}, {r('-1.0::double', 'n')} {joined}")
    _panel("p10_mask", "g", lambda p: p.mask(cond(p)), f"select as_of_date, id, {r('case when coalesce(c, true) then null else value end', 'value')}, null::double as n {joined}")
    _panel("p4_output_filter", "g", lambda p: Panel(lambda s, e: p.rolling(3, "sum").df(s, e, ["value"], [("n", ">", 3.0)])), f"select as_of_date, id, {r('value', 'value')} from (select as_of_date, id, {', '.join(f'case when count({c}) over w >= 3 then sum({c}) over w end as {c}' for c in ('value', 'n'))} from p window w as (partition by id order by as_of_date rows between 2 preceding and current row)) where n > 3")


def _register_arithmetic() -> None:
    # the supplier and customer panels overlap in part: an outer union of keys and columns
    for name, op, sql in (("a1_add", lambda a, b: a + b, "{a} + {b}"), ("a2_sub", lambda a, b: a - b, "{a} - {b}"), ("a3_mul", lambda a, b: a * b, "{a} * {b}"), ("a4_div", lambda a, b: a / b, RATIO), ("a5_pow", lambda a, b: a.clip(0.5, 3).pow(b.clip(0, 2)), "power({a}, {b})")):
        bounded = lambda x, low, high: f"case when {x} is not null then least(greatest({x}, {low}), {high}) end"
        a, b = (bounded("p.@", 0.5, 3), bounded("z.@", 0, 2)) if name == "a5_pow" else ("p.@", "z.@")
        lagged = "select as_of_date + 1 as as_of_date, id, value, value * 0 as n from p"
        _panel(f"{name}_panel", "g", lambda p, op=op: op(p, p.transform(lambda df: df.select(F.date_add(DATE, 1).alias(DATE), ID, "value", (F.col("value") * 0).alias("n")))), f", z as ({lagged}) select coalesce(p.as_of_date, z.as_of_date) as as_of_date, coalesce(p.id, z.id) as id, {', '.join(r(sql.format(a=a, b=b).replace('@', c), c) for c in ('value', 'n'))} from p full join z on p.as_of_date = z.as_of_date and p.id = z.id")
    _panel("a1_add_scalar", "g", lambda p: 2 + p, _rows("@ + 2"))
    _panel("a2_rsub_scalar", "g", lambda p: 10 - p, _rows("10 - @"))
    _panel("a3_neg", "g", lambda p: -p, _rows("-@"))
    _panel("a4_div_zero", "g", lambda p: (p - 1) / 0, _rows("case when @ - 1 > 0 then 'inf'::double when @ - 1 < 0 then '-inf'::double end"))
    _panel("a5_pow_scalar", "g", lambda p: p.clip(0, 20) ** 0.5, _rows("sqrt(case when @ is not null then least(greatest(@, 0), 20) end)"))
    _panel("a6_abs", "g", lambda p: (p - 40).abs(), _rows("abs(@ - 40)"))
    _panel("a1_add_other_columns", "c", lambda c, s: c + s, f"select coalesce(p.as_of_date, q.as_of_date) as as_of_date, coalesce(p.id, q.id) as id, {', '.join(f'null::double as {c}' for c in ('spent', 'orders', 'quantity', 'price'))} from p full join q on p.as_of_date = q.as_of_date and p.id = q.id", second="s")


def _register_windows() -> None:
    agg = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "var": "var_samp", "min": "min", "max": "max", "median": "median"}
    for f, sql in agg.items():
        _panel(f"w1_rolling_{f}", "g", lambda p, f=f: p.rolling(5, f, 2), _rows(f"case when count(@) {W} >= 2 then {sql}(@) {W} end"))
        _panel(f"t2_expanding_{f}", "g", lambda p, f=f: p.expanding(f, 2), _rows(f"case when count(@) {U} >= 2 then {sql}(@) {U} end"))
    _panel("w1_rolling_mean_full", "s", lambda p: p.rolling(20), _rows(f"case when count(@) {W} >= 20 then avg(@) {W} end".replace("4 preceding", "19 preceding"), "s"))
    _panel("w1_rolling_count", "g", lambda p: p.rolling(5, "count"), _rows(f"case when count(*) {W} >= 5 then count(@) {W}::double end"))
    _panel("w1_rolling_sem", "g", lambda p: p.rolling(5, "sem", 3), _rows(f"case when count(@) {W} >= 3 then stddev_samp(@) {W} / sqrt(count(@) {W} - 1) end"))
    big = "over (partition by id order by as_of_date rows between 9 preceding and current row)"
    _panel("w1_rolling_skew", "s", lambda p: p.rolling(10, "skew"), _rows(f"case when count(@) {big} >= 10 then skewness(@) {big} end", "s"))
    _panel("w1_rolling_kurt", "s", lambda p: p.rolling(10, "kurt"), _rows(f"case when count(@) {big} >= 10 then kurtosis(@) {big} end", "s"))
    _panel("w2_zscore", "g", lambda p: p.zscore(5, 3), _rows(f"case when count(@) {W} >= 3 then (@ - avg(@) {W}) / nullif(stddev_samp(@) {W}, 0) end"))
    _panel("w3_shift", "g", lambda p: p.shift(2), _rows(f"lag(@, 2) {O}"))
    _panel("w3_lead", "g", lambda p: p.shift(-1), _rows(f"lead(@, 1) {O}"))
    _panel("w4_diff", "c", lambda p: p.diff(), _rows(f"@ - lag(@, 1) {O}", "c"))
    filled = f", f as (select as_of_date, id, last_value(value ignore nulls) {U} as value, last_value(n ignore nulls) {U} as n from p)"
    ratio = "case when lag(@, 1) over w <> 0 then @ / lag(@, 1) over w - 1 when lag(@, 1) over w = 0 and @ > 0 then 'inf'::double when lag(@, 1) over w = 0 and @ < 0 then '-inf'::double end"
    window = " window w as (partition by id order by as_of_date)"
    _panel("w5_pct_change", "g", lambda p: p.pct_change(), f"{filled} {_rows(ratio).replace('from p', 'from f')}{window}")
    _panel("w5_pct_change_unfilled", "g", lambda p: p.pct_change(fill=False), _rows(ratio) + window)
    clip = "case when @ is not null then least(greatest(@, quantile_cont(@, {lo}) {x}), quantile_cont(@, {hi}) {x}) end"
    _panel("w6_winsorize", "g", lambda p: p.winsorize(0.1, 0.9), _rows(clip.format(lo=0.1, hi=0.9, x="over (partition by id)")))
    for f in ("sum", "max", "min"):
        _panel(f"t{3 if f == 'sum' else 5 if f == 'max' else 6}_cum{f}", "g", lambda p, f=f: getattr(p, f"cum{f}")(), _rows(f"case when @ is not null then {f}(@) {U} end"))
    _panel("t4_cumprod", "g", lambda p: (p / 50).clip(0.5, 1.5).cumprod(), _rows(f"case when @ is not null then product(case when @ is not null then least(greatest(@ / 50, 0.5), 1.5) end) {U} end"))
    for f in ("mean", "var", "std"):
        q, sums = 1 - 2 / (5 + 1), {}
        for c in ("value", "n"):
            w = f"case when b.{c} is not null then power({q!r}, a.k - b.k) else 0 end"
            sums[c] = f"sum({w}) as w_{c}, sum({w} * coalesce(b.{c}, 0)) as x_{c}, sum(power({w}, 2)) as v_{c}, count(b.{c}) as c_{c}"
        spread = ", ".join(f"sum(case when b.{c} is not null then power({q!r}, m.k - b.k) * power(b.{c} - m.x_{c} / m.w_{c}, 2) end) as y_{c}" for c in ("value", "n"))
        var = "case when m.c_@ > 1 then (y_@ / m.w_@) * m.w_@ * m.w_@ / (m.w_@ * m.w_@ - m.v_@) end"
        out = {"mean": "case when m.c_@ > 0 then m.x_@ / m.w_@ end", "var": var, "std": f"sqrt({var})"}[f]
        cols = ", ".join(r(out.replace("@", c), c) for c in ("value", "n"))
        _panel(f"t1_ewm_{f}", "g", lambda p, f=f: p.ewm(5, f), f", k as (select *, row_number() over (partition by id order by as_of_date) as k from p), m as (select a.as_of_date, a.id, a.k, {', '.join(sums.values())} from k a join k b on a.id = b.id and b.k <= a.k group by all), y as (select m.as_of_date, m.id, {spread} from m join k b on m.id = b.id and b.k <= m.k group by all) select m.as_of_date, m.id, {cols} from m join y on m.as_of_date = y.as_of_date and m.id = y.id")
    rank = "case when @ is not null then (rank() over (partition by as_of_date order by @ nulls last) + (count(@) over (partition by as_of_date, @) - 1) / 2.0) / count(@) over (partition by as_of_date) end"
    _panel("c1_cs_rank", "g", lambda p: p.cs_rank(), _rows(rank))
    _panel("c2_cs_zscore", "s", lambda p: p.cs_zscore(), _rows(f"(@ - avg(@) {X}) / nullif(stddev_samp(@) {X}, 0)", "s"))
    _panel("c3_cs_demean", "g", lambda p: p.cs_demean(), _rows(f"@ - avg(@) {X}"))
    _panel("c4_cs_winsorize", "s", lambda p: p.cs_winsorize(0.05, 0.95), _rows(clip.format(lo=0.05, hi=0.95, x=X), "s"))


def _register_resample() -> None:
    units = {"W": ("week", "7 days", "g + 6"), "M": ("month", "1 month", "last_day(g)"), "Q": ("quarter", "3 months", "last_day((g + interval 2 months)::date)"), "Y": ("year", "1 year", "last_day((g + interval 11 months)::date)")}
    funcs = {"last": "max_by(@, as_of_date) filter (where @ is not null)", "first": "min_by(@, as_of_date) filter (where @ is not null)", "mean": "avg(@)", "sum": "sum(@)", "min": "min(@)", "max": "max(@)"}
    for letter, freqs in (("g", ("W",)), ("c", ("M", "Q", "Y"))):
        names = ("value", "n") if letter == "g" else ("spent", "orders")
        for freq in freqs:
            unit, step, label = units[freq]
            for f, sql in funcs.items():
                aggs = ", ".join(f"{sql.replace('@', c)} as {c}" for c in names)
                cols = ", ".join(r(f"coalesce({c}, 0)" if f == "sum" else c, c) for c in names)
                _panel(f"g1_resample_{freq}_{f}", letter, lambda p, a=freq, b=f: p.resample(a, b), f", b as (select id, date_trunc('{unit}', as_of_date)::date as g, {aggs} from p group by 1, 2), grid as (select id, unnest(generate_series(min(g)::timestamp, max(g)::timestamp, interval {step}))::date as g from b group by id) select ({label})::date as as_of_date, id, {cols} from grid left join b using (id, g)")


def _register_joins() -> None:
    # the right side is a day late, so either side has keys that the other lacks
    left, right = "select as_of_date, id, value, n from p", "select as_of_date + 1 as as_of_date, id, value, n * 2 as m from p"
    lp = lambda p: p
    rp = lambda p: p.transform(lambda df: df.select(F.date_add(DATE, 1).alias(DATE), ID, "value", (F.col("n") * 2).alias("m")))
    cols = f"{r('a.value', 'value_left')}, {r('a.n', 'n')}, {r('b.value', 'value_right')}, {r('b.m', 'm')}"
    ab = f", a as ({left}), b as ({right})"
    for how, word in (("inner", "inner"), ("left", "left"), ("right", "right"), ("outer", "full")):
        _panel(f"j1_join_{how}", "g", lambda p, how=how: lp(p).join(rp(p), how=how), f"{ab} select coalesce(a.as_of_date, b.as_of_date) as as_of_date, coalesce(a.id, b.id) as id, {cols} from a {word} join b on a.as_of_date = b.as_of_date and a.id = b.id")
    one = lambda p: p.transform(lambda df: df.where(F.col(DATE) == "2024-01-05"))
    _panel("j1_join_on_id", "g", lambda p: lp(p).join(one(rp(p)), on="id", how="inner"), f"{ab} select a.id, a.as_of_date as as_of_date_left, b.as_of_date as as_of_date_right, {cols} from a join b on a.id = b.id where b.as_of_date = '2024-01-05'")
    # orders are facts for shipments of the supplier with the customer's number
    for name, tol, test in (("j2_asof_join", None, ""), ("j2_asof_tolerance", "30d", "and p.as_of_date - q.as_of_date <= 30")):
        kept = "case when q.as_of_date is not null " + test + " then {} end"
        _panel(name, "s", lambda s, c, tol=tol: s.asof_join(c, tolerance=tol), f"select p.as_of_date, p.id, {r('quantity', 'quantity')}, {r('price', 'price')}, {r(kept.format('spent'), 'spent')}, {r(kept.format('orders'), 'orders')} from p asof left join q on p.id = q.id and p.as_of_date >= q.as_of_date", second="c")
    _panel("j2_asof_without_by", "s", lambda s, c: s.asof_join(c, by=None), f", f as (select as_of_date, max(id) as id, max_by(spent, id) as spent, max_by(orders, id) as orders from q group by 1) select p.as_of_date, p.id as id_left, {r('quantity', 'quantity')}, {r('price', 'price')}, f.id as id_right, {r('spent', 'spent')}, {r('orders', 'orders')} from p asof left join f on p.as_of_date >= f.as_of_date", second="c")
    _panel("j3_concat", "g", lambda p: Panel.concat([lp(p), rp(p)]), f"{ab} select as_of_date, id, {r('value', 'value')}, {r('n', 'n')}, null::double as m from a union all select as_of_date, id, {r('value', 'value')}, null, {r('m', 'm')} from b")


def _register_calendars() -> None:
    grid = ", grid as (select as_of_date, id from (select unnest(generate_series(min(as_of_date)::timestamp, max(as_of_date)::timestamp, interval 1 day))::date as as_of_date from p), (select distinct id from p) where isodow(as_of_date) < 6), j as (select as_of_date, id, value, n from grid left join p using (as_of_date, id))"
    fills = {"ffill": f"last_value(@ ignore nulls) {U}", "bfill": "first_value(@ ignore nulls) over (partition by id order by as_of_date rows between current row and unbounded following)", "none": "@", "scalar": "coalesce(@, 0)"}
    for name, sql in fills.items():
        method = {"none": None, "scalar": 0}.get(name, name)
        _panel(f"l1_align_calendar_{name}", "g", lambda p, m=method: p.align_to_calendar(Weekdays(), m), f"{grid} {_rows(sql).replace('from p', 'from j')}")
        target = lambda p: p.transform(lambda df: df.select(F.date_add(DATE, 2).alias(DATE), ID))
        _panel(f"l2_align_to_{name}", "g", lambda p, m=method, t=target: p.align_to(t(p), m), f", j as (select t.as_of_date, t.id, p.value, p.n from (select as_of_date + 2 as as_of_date, id from p) t left join p on p.as_of_date = t.as_of_date and p.id = t.id) {_rows(sql).replace('from p', 'from j')}")
    fridays = grid.replace("isodow(as_of_date) < 6", "isodow(as_of_date) = 5")
    _panel("l1_align_custom", "g", lambda p: p.align_to_calendar(Fridays(), "ffill"), f"{fridays} {_rows(fills['ffill']).replace('from p', 'from j')}")
    _panel("l3_dt_shift_custom", "u", lambda p: p.dt_shift(1), f", m as (select as_of_date + 7 as as_of_date, id, value, n from p where isodow(as_of_date) = 5 and as_of_date between '2023-12-29' and '2024-01-26') {_rows('@', 'u').replace('from p', 'from m')}", calendar=Fridays())
    late = lambda df: df.withColumn(DATE, F.col(DATE).cast("timestamp") + F.expr("interval '15:30' hour to minute"))
    text = lambda df: df.withColumn(DATE, F.date_format(DATE, "yyyy-MM-dd HH:mm"))
    _panel("l3_dt_shift_timestamps", "u", lambda p: p.transform(late).dt_shift(2).transform(text), f"select strftime(as_of_date + interval 2 days, '%Y-%m-%d 15:30') as as_of_date, id, {r('value', 'value')}, {r('n', 'n')} from p where as_of_date between '2023-12-30' and '2024-01-29'")
    some = DayList([d for d in AllDays().days(*USER_RANGE) if d.day % 3])
    for name, calendar in (("all_days", AllDays()), ("weekdays", Weekdays()), ("weekdays_ahead", Weekdays()), ("listed_days", some)):
        n = -2 if name == "weekdays_ahead" else 2
        low, high = (calendar.offset(d, -n) for d in USER_RANGE)
        moved = {d: calendar.offset(d, n) for d in AllDays().days(min(low, USER_RANGE[0]), max(high, USER_RANGE[1]))}
        if isinstance(calendar, DayList):
            at = {d: i for i, d in enumerate(calendar.listed)}
            moved = {d: m for d, m in moved.items() if d in at and at[d] + n < len(at)}
        values = ", ".join(f"(date '{d}', date '{m}')" for d, m in moved.items())
        _panel(f"l3_dt_shift_{name}", "u", lambda p, n=n: p.dt_shift(n), f", moved(d, m) as (values {values}) select m as as_of_date, id, {r('value', 'value')}, {r('n', 'n')} from p join moved on d = as_of_date where as_of_date between '{low}' and '{high}'", calendar=calendar)
    _panel("l3_dt_shift_then_rolling", "u", lambda p: p.dt_shift(1).rolling(2, "sum"), f", m as (select as_of_date + 1 as as_of_date, id, value, n from p where as_of_date between '2023-12-31' and '2024-01-30') " + _rows("case when count(@) over w >= 2 then sum(@) over w end").replace("from p", "from m") + " window w as (partition by id order by as_of_date rows between 1 preceding and current row)", calendar=AllDays())
    _panel("lookback_rolling", "u", lambda p: Panel(lambda s, e: p.rolling(3, "sum").lookback(10).df(date(2024, 1, 15), date(2024, 1, 20))), "select * from (select as_of_date, id, " + ", ".join(r(f"case when count({c}) over w >= 3 then sum({c}) over w end", c) for c in ("value", "n")) + " from p where as_of_date >= '2024-01-05' window w as (partition by id order by as_of_date rows between 2 preceding and current row)) where as_of_date between '2024-01-15' and '2024-01-20'")


def _stored(spark: SparkSession, chunk_by: str = "month") -> PanelStore:
    """A new store in the folder that the session shares; a temporary one where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="panelwright-")
    return PanelStore(spark, f"{base.rstrip('/')}/panel-store-{spark.sparkContext.applicationId}-{next(_COUNT)}", chunk_by)


_COUNT = itertools.count()


def _register_store() -> None:
    def append(p: Panel) -> Panel:
        def build(s, e):
            store = _stored(p.df(s, s).sparkSession, "week")
            kept = p.cached(store)
            kept.df(date(2024, 1, 3), date(2024, 1, 9)).count()
            kept.df(date(2024, 1, 6), date(2024, 1, 20)).count()
            return kept.df(date(2024, 1, 1), date(2024, 1, 20))

        return Panel(build)

    def levels(p: Panel) -> Panel:
        def build(s, e):
            spark = p.df(s, s).sparkSession
            parent, store = _stored(spark), _stored(spark, "day")
            days = p.calendar.days(date(2024, 1, 10), date(2024, 1, 12))
            parent.of(p).write((p * 2).df(days[0], days[-1]), days)
            return p.cached(store, "a", (parent,)).df(date(2024, 1, 8), date(2024, 1, 15))

        return Panel(build)

    def append_rolling(p: Panel) -> Panel:
        def build(s, e):
            kept = p.rolling(3, "sum").cached(_stored(p.df(s, s).sparkSession))
            kept.df(date(2024, 1, 1), date(2024, 1, 10)).count()
            return kept.df(date(2024, 1, 1), date(2024, 1, 20))

        return Panel(build)

    def apart(p: Panel) -> Panel:
        def build(s, e):
            store = _stored(p.df(s, s).sparkSession)
            p.rolling(3, "sum").cached(store).df(date(2024, 1, 1), date(2024, 1, 5)).count()
            return (p * 100).cached(store).df(date(2024, 1, 1), date(2024, 1, 5))

        return Panel(build)

    summed = ", ".join(f"case when count({c}) over w >= 3 then sum({c}) over w end as {c}" for c in ("value", "n"))
    rolled = f"with p as (select as_of_date, id, {summed} from ({PANELS['u']}) where as_of_date between '2024-01-01' and '2024-01-20' window w as (partition by id order by as_of_date rows between 2 preceding and current row)) "
    _panel("s8_store_append_rolling", "u", append_rolling, "")
    _FOUND["s8_store_append_rolling"] = (_FOUND["s8_store_append_rolling"][0], rolled + _rows("@", "u"))
    _panel("s8_stores_apart", "u", apart, _rows("@ * 100", "u") + " where as_of_date between '2024-01-01' and '2024-01-05'")
    _panel("s8_store_append", "u", append, _rows("@", "u") + " where as_of_date between '2024-01-01' and '2024-01-20'")
    _panel("s9_store_levels", "u", levels, _rows("@ * case when as_of_date between '2024-01-10' and '2024-01-12' then 2 else 1 end", "u") + " where as_of_date between '2024-01-08' and '2024-01-15'")
    _panel("s13_materialize", "u", lambda p: Panel(lambda s, e: p.rolling(3, "sum", 1).cached(_stored(p.df(s, s).sparkSession), "w").df(s, e)), _rows("sum(@) over (partition by id order by as_of_date rows between 2 preceding and current row)", "u"))
    _panel("u1_apply", "u", lambda p: p.apply(lambda df: df.withColumn("value", F.col("value") + F.col("n"))), f"select as_of_date, id, {r('value + n', 'value')}, {r('n', 'n')} from p")

    def centred(rows):
        return rows.assign(value=rows["value"] - rows["value"].mean())

    _panel("u1_apply_pandas", "u", lambda p: p.select(["value"]).apply_pandas(centred, "as_of_date date, id long, value double"), f"select as_of_date, id, {r('value - avg(value) over (partition by id)', 'value')} from p")
    score = "(x - avg(x) over (partition by as_of_date)) / nullif(stddev_samp(x) over (partition by as_of_date), 0)"
    parts = ", ".join(f"case when count({c}) {W} >= 5 then avg({c}) {W} end as {c}" for c in ("value", "n"))
    _panel("flagship", "u", lambda p: p.rolling(5).cs_zscore(), f", m as (select as_of_date, id, {parts} from p) select as_of_date, id, {r(score.replace('(x', '(value'), 'value')}, {r(score.replace('(x', '(n'), 'n')} from m")


def _back(p: Panel, rows) -> DataFrame:
    """Rows that were on the driver, as a table again; there they are the result asked for."""
    spark = p.df(*(USER_RANGE[0],) * 2).sparkSession
    return spark.createDataFrame(rows, "as_of_date date, id long, value double, n double") if isinstance(rows, pd.DataFrame) else spark.createDataFrame(rows)


def _register_reading() -> None:
    whole = _rows("@", "u")
    span = USER_RANGE

    def scaled(start, end, panel, scale):
        return panel.df(start, end).withColumn("value", F.col("value") * scale)

    def parquet(p: Panel) -> Panel:
        def build(s, e):
            store = _stored(p.df(s, s).sparkSession)
            p.df(s, e).withColumnsRenamed({DATE: "day", ID: "who"}).write.parquet(store.path)
            return Panel.from_parquet(store.spark, store.path, AllDays(), "day", "who").df(s, e)

        return Panel(build)

    def empty_dates(p: Panel) -> Panel:
        def build(s, e):
            store, first = _stored(p.df(s, s).sparkSession, "year"), date(2023, 12, 20)
            p.cached(store).df(first, date(2024, 1, 10)).count()
            return p.cached(store, "r").df(first, date(2024, 1, 10))

        return Panel(build)

    def in_memory(p: Panel) -> Panel:
        def build(s, e):
            kept, was = p.cached(_stored(p.df(s, s).sparkSession)), HELD.enabled
            HELD.configure(enabled=True, max_bytes=1 << 28)
            try:
                kept.df(s, e).count()
                return kept.df(s, e)
            finally:
                HELD.configure(enabled=was, max_bytes=0)

        return Panel(build)

    def defaults(p: Panel) -> Panel:
        def build(s, e):
            spark = p.df(s, s).sparkSession
            own, parent = _stored(spark), _stored(spark)
            configure(store_dir=own.path, parent_dirs=[parent.path])
            try:
                parent.of(p).write((p * 3).df(s, s), [s])
                return p.cached().df(s, e)
            finally:
                reset_settings()

        return Panel(build)

    def batched(p: Panel) -> Panel:
        def build(s, e):
            middle = date(2024, 1, 15)
            with batch():
                one, two = p.get_range(s, middle), p.get_range(middle + timedelta(1), e)
            return one.table().unionByName(two.table())

        return Panel(build)

    def handled(p: Panel) -> Panel:
        def build(s, e):
            with batch():
                found = p.get_range(s, e)
            rows = found.assign(value=(found["value"] + 1) * 2, n=-found["n"])
            return _back(p, rows[found["value"] >= 20])

        return Panel(build)

    def ordered(p: Panel) -> Panel:
        return Panel(lambda s, e: _back(p, (rows := p.to_pandas(s, e)).assign(n=np.arange(len(rows), dtype=float))))

    _panel("s1_function_source", "u", lambda p: Panel.from_function(scaled, {"panel": p, "scale": 2.0}, AllDays()), f"select as_of_date, id, {r('value * 2', 'value')}, {r('n', 'n')} from p")
    _panel("s4_async_scan", "u", lambda p: Panel(lambda s, e: _back(p, asyncio.run(p.aget_range(s, e)))), whole)
    _panel("s5_from_parquet", "u", parquet, whole)
    _panel("s10_known_empty_dates", "u", empty_dates, f"{whole} where as_of_date <= '2024-01-10'")
    _panel("s12_memory_cache", "u", in_memory, whole)
    _panel("s14_defaults", "u", defaults, _rows(f"@ * case when as_of_date = '{span[0]}' then 3 else 1 end", "u"))
    _panel("u2_nested_panels", "u", lambda p: Panel.from_function(lambda s, e: p.rolling(2, "sum", 1).df(s, e), None, AllDays()), _rows("sum(@) over (partition by id order by as_of_date rows between 1 preceding and current row)", "u"))
    _panel("u3_own_operator", "u", lambda p: p.transform(lambda df, k: df.withColumn("n", F.col("value") - k), 3.0), f"select as_of_date, id, {r('value', 'value')}, {r('value - 3', 'n')} from p")
    _panel("u4_to_pandas", "u", lambda p: Panel(lambda s, e: _back(p, p.to_pandas(s, e))), whole)
    _panel("u5_to_arrow", "u", lambda p: Panel(lambda s, e: _back(p, p.to_arrow(s, e))), whole)
    _panel("e1_batch", "u", batched, whole)
    _panel("e3_handles", "u", handled, f"select as_of_date, id, {r('(value + 1) * 2', 'value')}, {r('-n', 'n')} from p where value >= 20")
    _panel("e4_ordered_sink", "u", ordered, f"select as_of_date, id, {r('value', 'value')}, {r('(row_number() over (order by as_of_date, id) - 1)::double', 'n')} from p")
    _panel("g1_resample_D_sum", "u", lambda p: p.resample("D", "sum"), f", b as (select id, min(as_of_date)::timestamp as lo, max(as_of_date)::timestamp as hi from p group by id), grid as (select id, unnest(generate_series(lo, hi, interval 1 day))::date as as_of_date from b) select grid.as_of_date, grid.id, {r('coalesce(value, 0)', 'value')}, {r('coalesce(n, 0)', 'n')} from grid left join p using (as_of_date, id)")
    place = "(select count(*) from p q where q.id = p.id and q.as_of_date between p.as_of_date - 10000 and p.as_of_date"
    _panel("t2_expanding_rank", "u", lambda p: p.select(["value"]).expanding("rank"), f"select as_of_date, id, {r(f'{place} and q.value < p.value) + ({place} and q.value = p.value) + 1) / 2.0', 'value')} from p")


for _register in (_register_rows, _register_arithmetic, _register_windows, _register_resample, _register_joins, _register_calendars, _register_store, _register_reading):
    _register()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}
