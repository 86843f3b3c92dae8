"""Operators against pandas on a seeded panel with gaps, missing values and ties."""

from __future__ import annotations

import asyncio
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright import HELD, AllDays, CacheMissError, Calendar, DayList, Panel, PanelStore, ValidationError, Weekdays, batch, configure, reset_settings, validate
from panelwright.operators import timejoin
from panelwright.plans.batches import Handle
from panelwright.plans.held import Held

START, END = date(2024, 1, 1), date(2024, 3, 15)


@pytest.fixture(scope="module")
def raw() -> pd.DataFrame:
    rng = np.random.default_rng(7)
    rows = []
    for i in range(4):
        for k in range(75):
            if rng.random() < 0.8:
                value = None if rng.random() < 0.12 else round(float(rng.normal(10, 4)), 1)
                rows.append((START + timedelta(k), i, value, float(rng.integers(0, 5))))
    return pd.DataFrame(rows, columns=["as_of_date", "id", "value", "size"])


@pytest.fixture(scope="module")
def panel(spark, raw) -> Panel:
    rows = [(d, i, None if v != v or v is None else v, s) for d, i, v, s in raw.itertuples(index=False)]
    return Panel.from_table(spark.createDataFrame(rows, "as_of_date date, id long, value double, size double"), AllDays())


def got(p: Panel, columns=("value", "size")) -> pd.DataFrame:
    out = p.df(START, END).toPandas().sort_values(["id", "as_of_date"]).set_index(["id", "as_of_date"])
    return out[list(columns)].astype(float)


def wanted(raw: pd.DataFrame, f) -> pd.DataFrame:
    by = raw.sort_values(["id", "as_of_date"]).set_index(["id", "as_of_date"])[["value", "size"]].astype(float)
    parts = {i: f(g.droplevel(0)) for i, g in by.groupby(level=0)}
    return pd.concat(parts, names=["id"])


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert list(a.index) == list(b.index)
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-8, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("func", ["mean", "sum", "std", "var", "min", "max", "median", "count", "skew", "kurt", "sem"])
def test_rolling(panel, raw, func):
    same(got(panel.rolling(6, func, 4)), wanted(raw, lambda g: getattr(g.rolling(6, min_periods=4), func)()))


@pytest.mark.parametrize("func", ["mean", "sum", "std", "max", "median", "count"])
def test_expanding(panel, raw, func):
    same(got(panel.expanding(func, 3)), wanted(raw, lambda g: getattr(g.expanding(3), func)()))


@pytest.mark.parametrize("func", ["mean", "var", "std"])
@pytest.mark.parametrize("span", [2, 5, 30])
def test_ewm(panel, raw, func, span):
    same(got(panel.ewm(span, func)), wanted(raw, lambda g: getattr(g.ewm(span=span), func)()))


def test_ewm_long_series(spark):
    """Many blocks, large mean, small spread."""
    n = 900
    x = 1e6 + np.sin(np.arange(n))
    rows = [(START + timedelta(i), 1, float(v)) for i, v in enumerate(x)]
    p = Panel.from_table(spark.createDataFrame(rows, "as_of_date date, id long, value double"), AllDays())
    out = p.ewm(3, "std").df(START, START + timedelta(n)).orderBy("as_of_date").toPandas()["value"].to_numpy(float)
    np.testing.assert_allclose(out, pd.Series(x).ewm(span=3).std().to_numpy(), rtol=1e-6, equal_nan=True)


@pytest.mark.parametrize(("name", "op", "f"), [
    ("shift", lambda p: p.shift(2), lambda g: g.shift(2)),
    ("lead", lambda p: p.shift(-1), lambda g: g.shift(-1)),
    ("diff", lambda p: p.diff(), lambda g: g.diff()),
    ("pct", lambda p: p.pct_change(), lambda g: g.ffill() / g.ffill().shift() - 1),
    ("cumsum", lambda p: p.cumsum(), lambda g: g.cumsum()),
    ("cumprod", lambda p: (p / 10).cumprod(), lambda g: (g / 10).cumprod()),
    ("cummax", lambda p: p.cummax(), lambda g: g.cummax()),
    ("cummin", lambda p: p.cummin(), lambda g: g.cummin()),
    ("ffill", lambda p: p.fillna(method="ffill"), lambda g: g.ffill()),
    ("bfill", lambda p: p.fillna(method="bfill"), lambda g: g.bfill()),
    ("winsorize", lambda p: p.winsorize(0.1, 0.9), lambda g: g.clip(g.quantile(0.1), g.quantile(0.9), axis=1)),
    ("zscore", lambda p: p.zscore(8, 4), lambda g: (g - g.rolling(8, min_periods=4).mean()) / g.rolling(8, min_periods=4).std().replace(0, np.nan)),
])
def test_along_ids(panel, raw, name, op, f):
    same(got(op(panel)), wanted(raw, f))


def test_across_dates(panel, raw):
    by = raw.sort_values(["id", "as_of_date"]).set_index(["id", "as_of_date"])[["value", "size"]].astype(float)
    day = by.groupby(level=1)
    same(got(panel.cs_rank()), day.rank(pct=True))
    same(got(panel.cs_demean()), by - day.transform("mean"))
    same(got(panel.cs_zscore()), (by - day.transform("mean")) / day.transform("std").replace(0, np.nan))
    low, high = (day.transform(lambda s, q=q: s.quantile(q)) for q in (0.2, 0.8))
    same(got(panel.cs_winsorize(0.2, 0.8)), by.clip(low, high))


@pytest.mark.parametrize("freq", ["W", "M"])
@pytest.mark.parametrize("func", ["last", "first", "mean", "sum", "min", "max"])
def test_resample(panel, raw, freq, func):
    def f(g):
        out = getattr(g.set_axis(pd.DatetimeIndex(g.index)).resample({"M": "ME"}.get(freq, freq)), func)()
        return out.set_axis([d.date() for d in out.index])

    same(got(panel.resample(freq, func)), wanted(raw, f).rename_axis(["id", "as_of_date"]))


def test_resample_fills_gaps(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1, 2.0), (date(2024, 1, 25), 1, 3.0)], "as_of_date date, id long, value double")
    out = Panel.from_table(df, AllDays()).resample("W", "sum").df(START, END).orderBy("as_of_date").collect()
    assert [(r["as_of_date"].day, r["value"]) for r in out] == [(7, 2.0), (14, 0.0), (21, 0.0), (28, 3.0)]


def test_arithmetic(panel, raw):
    by = wanted(raw, lambda g: g)
    same(got(3 - panel * 2), 3 - by * 2)
    out = got(panel / 0)
    assert np.isinf(out["value"].dropna()).all()
    assert out["size"][by["size"] == 0].isna().all()
    assert np.isinf(out["size"][by["size"] > 0]).all()
    same(got((panel - 10).abs().clip(1, 3)), (by - 10).abs().clip(1, 3))
    both = got(panel + panel.filter([("id", "<", 2)]))
    same(both, by + by[by.index.get_level_values(0) < 2])
    with pytest.raises(NotImplementedError):
        2**panel


def test_rules_for_missing(panel, raw):
    by = wanted(raw, lambda g: g)
    assert panel.filter([("value", "!=", 10.0)]).df(START, END).count() == (by["value"] != 10.0).sum()
    assert panel.filter([("value", "not in", [10.0])]).df(START, END).count() == (~by["value"].isin([10.0])).sum()
    assert panel.dropna().df(START, END).count() == len(by.dropna())
    with pytest.raises(KeyError):
        panel.filter([("nothing", "=", 1)]).df(START, END)
    with pytest.raises(ValueError):
        panel.filter([("value", "~", 1)]).df(START, END)
    for bad in ({}, {"value": 1, "method": "ffill"}):
        with pytest.raises(ValueError):
            panel.fillna(**bad)


def test_where_and_mask(spark):
    d = date(2024, 1, 2)
    p = Panel.from_table(spark.createDataFrame([(d, 0, 10.0), (d, 1, 20.0), (d, 2, 30.0)], "as_of_date date, id long, value double"), AllDays())
    cond = Panel.from_table(spark.createDataFrame([(d, 0, True), (d, 1, False)], "as_of_date date, id long, value boolean"), AllDays())
    values = lambda q: [r["value"] for r in q.df(d, d).orderBy("id").collect()]
    assert values(p.where(cond, -1)) == [10.0, -1.0, -1.0]
    assert values(p.mask(cond, -1)) == [-1.0, 20.0, -1.0]
    assert values(p.where(cond)) == [10.0, None, None]


def test_joins(spark):
    d, schema = date(2024, 1, 2), "as_of_date date, id long, {} double"
    a = Panel.from_table(spark.createDataFrame([(d, 1, 1.0), (d, 2, 2.0), (d, None, 9.0)], schema.format("x")), AllDays())
    b = Panel.from_table(spark.createDataFrame([(d, 2, 5.0), (d, 3, 6.0), (d, None, 7.0)], schema.format("x")), AllDays())
    ids = lambda how: sorted((str(r["id"]), r["x_left"], r["x_right"]) for r in a.join(b, how=how).df(d, d).collect())
    assert ids("inner") == [("2", 2.0, 5.0), ("None", 9.0, 7.0)]
    assert ids("outer") == [("1", 1.0, None), ("2", 2.0, 5.0), ("3", None, 6.0), ("None", 9.0, 7.0)]
    with pytest.raises(ValueError):
        a.join(b, how="cross")
    assert set(a.join(b, on="id").df(d, d).columns) == {"id", "as_of_date_left", "as_of_date_right", "x_left", "x_right"}


def test_asof_join(spark):
    days = [date(2024, 1, k) for k in (1, 5, 9, 20)]
    left = Panel.from_table(spark.createDataFrame([(d, i, 1.0) for d in days for i in (1, 2)], "as_of_date date, id long, px double"), AllDays())
    right = Panel.from_table(spark.createDataFrame([(date(2024, 1, 5), 1, 10.0), (date(2024, 1, 8), 1, None), (date(2024, 1, 3), 2, 7.0)], "as_of_date date, id long, eps double"), AllDays())
    rows = lambda p: [(r["id"], r["as_of_date"].day, r["eps"]) for r in p.df(START, END).orderBy("id", "as_of_date").collect()]
    assert rows(left.asof_join(right)) == [(1, 1, None), (1, 5, 10.0), (1, 9, None), (1, 20, None), (2, 1, None), (2, 5, 7.0), (2, 9, 7.0), (2, 20, 7.0)]
    assert rows(left.asof_join(right, tolerance="6d"))[-2:] == [(2, 9, 7.0), (2, 20, None)]
    assert [r["eps"] for r in left.asof_join(right, by=None).df(START, END).orderBy("as_of_date", "id_left").collect()] == [None, None, 10.0, 10.0, None, None, None, None]
    early = left.asof_join(right, lookback=10)
    assert [r["eps"] for r in early.df(date(2024, 1, 9), date(2024, 1, 9)).orderBy("id").collect()] == [None, 7.0]


def test_concat_and_errors(panel):
    twice = Panel.concat([panel, panel.select(["value"])])
    assert twice.df(START, END).count() == 2 * panel.df(START, END).count()
    with pytest.raises(ValueError):
        Panel.concat([])
    with pytest.raises(ValueError):
        panel.rolling(3, "mode").df(START, END)
    with pytest.raises(ValueError):
        panel.winsorize(0.9, 0.1)
    with pytest.raises(ValueError):
        panel.align_to_calendar(fill_method="linear")


@pytest.mark.parametrize("n", range(-12, 13))
def test_weekday_offsets(spark, n):
    def step(d, k):
        while k:
            d += timedelta(1 if k > 0 else -1)
            k -= (1 if k > 0 else -1) * (d.weekday() < 5)
        return d

    days = [date(2024, 1, 1) + timedelta(i) for i in range(14)]
    assert [Weekdays().offset(d, n) for d in days] == [step(d, n) for d in days]
    if n % 4 == 0:
        df = spark.createDataFrame([(d,) for d in days], "as_of_date date")
        moved = [r[0] for r in df.select("as_of_date", Weekdays().offset_expression(F.col("as_of_date"), n).alias("m")).orderBy("as_of_date").select("m").collect()]
        assert moved == [step(d, n) for d in days]


def test_calendars(spark):
    assert Weekdays().days(date(2024, 1, 5), date(2024, 1, 9)) == [date(2024, 1, k) for k in (5, 8, 9)]
    listed = DayList([date(2024, 1, k) for k in (2, 4, 8)])
    assert listed.offset(date(2024, 1, 2), 2) == date(2024, 1, 8)
    df = spark.createDataFrame([(date(2024, 1, k), 0, float(k)) for k in (4, 5, 8, 9)], "as_of_date date, id long, value double")
    p = Panel.from_table(df, Weekdays())
    assert p.dt_shift(1).get(date(2024, 1, 8)).collect()[0]["value"] == 5.0  # Monday has Friday's
    spread = p.align_to_calendar(AllDays()).df(START, END).orderBy("as_of_date").collect()
    assert [r["value"] for r in spread] == [4.0, 5.0, 5.0, 5.0, 8.0, 9.0]


def test_plans_use_one_shuffle_for_chains(panel, spark):
    plan = panel.rolling(5).shift(1).zscore(10).df(START, END)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = panel.cs_zscore().df(START, END)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_validation(spark):
    d = date(2024, 1, 1)
    ok = spark.createDataFrame([(d, 1, 1.0)], "as_of_date date, id long, value double")
    assert validate(ok) is ok
    with pytest.raises(ValidationError):
        validate(ok.union(ok))
    with pytest.raises(ValidationError):
        validate(ok.drop("id"))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1, float("nan"))], "as_of_date date, id long, value double")
    assert Panel.from_table(df, AllDays()).df(START, END).collect()[0]["value"] is None


def test_store_modes(spark, tmp_path):
    calls = []

    def source(start, end, scale=1.0):
        calls.append((start, end))
        days = [start + timedelta(i) for i in range((end - start).days + 1)]
        rows = [(d, i, scale * d.day) for d in days if d.weekday() == 0 for i in (1, 2)]
        return spark.createDataFrame(rows, "as_of_date date, id long, value double")

    p = Panel.from_function(source, {"scale": 2.0}, AllDays())
    store = PanelStore(spark, str(tmp_path / "s"), "week")
    jan = lambda k: date(2024, 1, k)
    assert p.cached(store).df(jan(1), jan(10)).count() == 4
    assert p.cached(store).df(jan(1), jan(10)).count() == 4
    assert len(calls) == 1  # days without rows are known to be empty
    assert p.cached(store).df(jan(5), jan(20)).count() == 4
    assert calls[-1] == (jan(11), jan(20))
    assert p.cached(store, "r").df(jan(1), jan(20)).count() == 6
    with pytest.raises(CacheMissError):
        p.cached(store, "r").df(jan(1), jan(25))
    q = Panel.from_function(source, {"scale": 3.0}, AllDays())
    q.cached(store, "w").df(jan(8), jan(8)).count()  # another panel's rows: kept apart
    assert {r["as_of_date"].day: r["value"] for r in p.cached(store, "r").df(jan(1), jan(20)).collect()} == {1: 2.0, 8: 16.0, 15: 30.0}
    store.of(p).write(q.df(jan(8), jan(8)), [jan(8)])
    values = {r["as_of_date"].day: r["value"] for r in p.cached(store, "r").df(jan(1), jan(20)).collect()}
    assert values == {1: 2.0, 8: 24.0, 15: 30.0}
    n = len(calls)
    assert p.cached(store, "l").df(jan(1), jan(10)).count() == 4 and len(calls) == n + 1
    parent = PanelStore(spark, str(tmp_path / "parent"), "day")
    parent.of(p).write((q * 10).df(jan(1), jan(2)), [jan(1), jan(2)])
    levels = p.cached(store, "a", (parent,)).df(jan(1), jan(9)).collect()
    assert {r["as_of_date"].day: r["value"] for r in levels} == {1: 30.0, 8: 24.0}
    with pytest.raises(ValueError):
        p.cached(store, "x").df(jan(1), jan(2))


def test_batch_and_async(panel):
    with batch() as b:
        one = panel.get_range(START, END)
        two = panel.rolling(3).get(date(2024, 1, 9))
    assert len(b.handles) == 2
    assert len(one.pandas()) > 200 and "as_of_date" not in two.pandas().columns
    assert len(asyncio.run(panel.aget_range(START, END))) == len(one.pandas())


def test_held_plans(panel):
    held = Held(limit=1)
    a = held.get(("p", 1), lambda: panel.df(START, END))
    assert held.get(("p", 1), lambda: None) is a
    held.get(("q", 1), lambda: panel.df(START, START))
    assert (held.stats.hits, held.stats.misses, held.stats.evictions, len(held)) == (1, 2, 1, 1)
    assert held.invalidate("q") == 1 and held.clear() == 0


def test_own_functions(panel, raw):
    out = panel.apply(lambda df: df.withColumn("value", F.col("value") * 2)).df(START, END)
    assert out.columns == panel.df(START, END).columns
    ids = panel.select(["size"]).apply_pandas(lambda g: g.assign(size=g["size"].sum()), "as_of_date date, id long, size double")
    assert ids.df(START, END).select("id", "size").distinct().count() == 4
    assert panel.rolling(3).key != panel.rolling(4).key


def test_streaming_into_store(spark, tmp_path):
    from panelwright.streaming.ingest import daily, into_store

    source, store = str(tmp_path / "in"), PanelStore(spark, str(tmp_path / "out"), "month")
    rows = [(datetime(2024, 1, k, 12), i, 1.5 * k) for k in (1, 2, 3) for i in (1, 2)]
    spark.createDataFrame(rows, "ts timestamp, user long, value double").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, user long, value double").parquet(source)
    query = into_store(daily(stream, "ts", "user", "value"), store, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    found = store.read(date(2024, 1, 1), date(2024, 1, 31))
    assert found.count() == 6 and found.agg(F.sum("value")).first()[0] == 18.0


def test_ewm_carries_its_last_result_through_long_gaps(spark):
    """Gaps over two blocks, which are 99 rows at a span of 5."""
    n = 700
    days = pd.date_range("2020-01-01", periods=n)
    value = np.where((np.arange(n) > 20) & (np.arange(n) < 330) | (np.arange(n) > 333), np.nan, np.arange(n) % 17 * 1.5)
    df = pd.DataFrame({"as_of_date": days, "id": 1, "value": value})
    rows = [(d.date(), 1, None if np.isnan(v) else float(v)) for d, v in zip(days, value, strict=True)]
    table = spark.createDataFrame(rows, "as_of_date date, id long, value double")
    for func in ("mean", "var"):
        got = Panel.from_table(table, AllDays()).ewm(5, func).to_pandas(days[0].date(), days[-1].date())["value"].to_numpy(float)
        want = getattr(df["value"].ewm(span=5), func)().to_numpy()
        assert np.allclose(got, want, equal_nan=True)


class Fridays(Calendar):
    def contains(self, d):
        return d.weekday() == 4

    def offset(self, d, n):
        last = d - timedelta((d.weekday() - 4) % 7)
        return d if n == 0 else last + timedelta(7 * n + (7 if n < 0 and last != d else 0))


def test_own_calendar(spark):
    days = [date(2024, 1, 1) + timedelta(i) for i in range(40)]
    p = Panel.from_table(spark.createDataFrame([(d, 1, float(i)) for i, d in enumerate(days)], "as_of_date date, id long, value double"), Fridays())
    moved = p.dt_shift(1).to_pandas(date(2024, 1, 12), date(2024, 1, 26))
    assert [(r.as_of_date, r.value) for r in moved.itertuples()] == [(date(2024, 1, 12), 4.0), (date(2024, 1, 19), 11.0), (date(2024, 1, 26), 18.0)]
    onto = p.align_to_calendar().to_pandas(date(2024, 1, 1), date(2024, 1, 31))
    assert list(onto["as_of_date"]) == [date(2024, 1, d) for d in (5, 12, 19, 26)]


def test_shift_keeps_the_time_of_day(spark):
    at = datetime(2024, 1, 5, 15, 30)
    for calendar, to in ((Weekdays(), datetime(2024, 1, 8, 15, 30)), (AllDays(), datetime(2024, 1, 6, 15, 30)), (DayList([date(2024, 1, 5), date(2024, 1, 11)]), datetime(2024, 1, 11, 15, 30))):
        p = Panel.from_table(spark.createDataFrame([(at, 1, 2.0)], "as_of_date timestamp, id long, value double"), calendar)
        rows = p.dt_shift(1).df(to.date(), to.date()).collect()
        assert [(r["as_of_date"], r["value"]) for r in rows] == [(to, 2.0)]


def test_keys_tell_panels_apart(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1, 2.0)], "as_of_date date, id long, value double")
    p = Panel.from_table(df)
    made = [p, p * 2, p * 3, p.rolling(2), p.rolling(3), Panel.from_table(df.where("id > 0")), Panel.from_table(df, DayList([date(2024, 1, 1)])), Panel.from_table(df, DayList([date(2024, 1, 2)]))]
    made += [p.transform(lambda d, k=k: d.where(F.col("id") > k)) for k in (1, 2)] + [Panel.from_function(lambda s, e, k: df, {"k": k}) for k in (1, 2)]
    assert len({m.key for m in made}) == len(made)
    assert Panel.from_table(df).rolling(2).key == p.rolling(2).key


def test_store_keeps_panels_apart_and_windows_whole(spark, tmp_path):
    days = [date(2024, 1, 1) + timedelta(i) for i in range(20)]
    p = Panel.from_table(spark.createDataFrame([(d, 1, float(i)) for i, d in enumerate(days)], "as_of_date date, id long, value double"), AllDays())
    store = PanelStore(spark, str(tmp_path))
    rolled = p.rolling(3, "sum")
    rolled.cached(store).df(days[0], days[9]).count()
    assert rolled.cached(store).to_pandas(days[0], days[19]).equals(rolled.to_pandas(days[0], days[19]))
    assert list((p * 100).cached(store).to_pandas(days[0], days[4])["value"]) == [0, 100, 200, 300, 400]


def test_store_computes_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.createDataFrame([(date(2024, 1, 1), i, 2.0) for i in range(10)], "as_of_date date, id long, value double")
    p = Panel.from_table(df, AllDays()).transform(lambda d: d.mapInPandas(seen, d.schema))
    p.cached(PanelStore(spark, str(tmp_path))).df(date(2024, 1, 1), date(2024, 1, 1)).count()
    assert calls.value == 10


def test_defaults_and_memory(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, d), 1, float(d)) for d in (1, 2, 3)], "as_of_date date, id long, value double")
    p, a, b = Panel.from_table(df, AllDays()), date(2024, 1, 1), date(2024, 1, 3)
    configure(store_dir=str(tmp_path / "own"), parent_dirs=[str(tmp_path / "parent")])
    HELD.reset()
    HELD.configure(enabled=True)
    try:
        PanelStore(spark, str(tmp_path / "parent")).of(p).write((p * 10).df(a, a), [a])
        assert list(p.cached().to_pandas(a, b)["value"]) == [10, 2, 3]
        before = HELD.stats.hits
        assert list(p.cached().to_pandas(a, b)["value"]) == [10, 2, 3]
        assert HELD.stats.hits > before
        HELD.configure(max_bytes=1)
        assert len(HELD) == 0
    finally:
        HELD.configure(enabled=False, max_bytes=0)
        reset_settings()


@pytest.mark.parametrize(("text", "micros"), [("7d", 7 * 86400 * 10**6), ("1D2h", 26 * 3600 * 10**6), ("1.5h", 5400 * 10**6), ("500ms", 500_000), ("d", 86400 * 10**6), (timedelta(milliseconds=1500), 1_500_000), (None, None)])
def test_tolerances(text, micros):
    assert timejoin.microseconds(text) == micros


def test_tolerance_below_a_second(spark):
    t = datetime(2024, 1, 1, 12, 0, 0, 600_000)
    left = spark.createDataFrame([(t, 1, 1.0)], "as_of_date timestamp, id long, a double")
    right = spark.createDataFrame([(t - timedelta(milliseconds=700), 1, 5.0)], "as_of_date timestamp, id long, b double")
    assert timejoin.asof_join(left, right, tolerance="700ms").first()["b"] == 5.0
    assert timejoin.asof_join(left, right, tolerance="699ms").first()["b"] is None


def test_handles_act_like_their_rows(spark):
    df = spark.createDataFrame([(date(2024, 1, d), 1, float(d)) for d in (3, 1, 2)], "as_of_date date, id long, value double")
    p = Panel.from_table(df, AllDays()).select(["value"])
    with batch():
        one, two = p.get_range(date(2024, 1, 1), date(2024, 1, 3)), p.get_range(date(2024, 1, 1), date(2024, 1, 3))
    assert list(one["value"]) == [1, 2, 3] and len(one) == 3 and one.shape == (3, 3)
    assert list((one[["value"]] + 1)["value"]) == [2, 3, 4]
    assert (one == two).all().all() and hash(one) != hash(two)
    waiting = Handle(p.df(date(2024, 1, 1), date(2024, 1, 3)))
    assert list(-waiting["value"]) == [-1, -2, -3] and "value" in waiting


def test_batch_keeps_rows_beside_the_data(spark, panel, tmp_path, monkeypatch):
    monkeypatch.setattr("panelwright.plans.batches._place", lambda spark: str(tmp_path / "kept"))
    calls = spark.sparkContext.accumulator(0)

    def seen(parts):
        for rows in parts:
            calls.add(len(rows))
            yield rows

    df = spark.createDataFrame([(date(2024, 1, d), 1, float(d)) for d in (3, 1, 2)], "as_of_date date, id long, value double")
    odd = Panel.from_table(df.mapInPandas(seen, df.schema), AllDays()).transform(lambda d: d.select("*", F.lit(None).alias("none"), F.lit("x").alias("Value"), F.lit("a b").alias("twice"), F.lit(2).alias("twice")))
    with monkeypatch.context() as m:
        for name in ("toPandas", "collect", "toArrow"):
            m.setattr(type(df), name, lambda self: pytest.fail("rows went to the driver"))
        with batch():
            found = odd.get_range(date(2024, 1, 1), date(2024, 1, 3))
        table = found.table()
        assert calls.value == 3 and list((tmp_path / "kept").glob("*.parquet"))
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in found.plan.schema]
    want = [(date(2024, 1, d), 1, float(d), None, "x", "a b", 2) for d in (1, 2, 3)]
    assert sorted(map(tuple, table.collect())) == want == list(found.pandas().itertuples(index=False, name=None))
    assert calls.value == 3 and table.count() == 3  # computed once; a table given out stays
    with batch():
        rows = panel.get_range(START, END)
    assert list((tmp_path / "kept").glob("*.parquet")) and len(rows) > 200
    assert not (tmp_path / "kept").exists()  # once the driver has the rows they are dropped


def test_batch_raises_when_it_ends(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1)], "as_of_date date, id long").withColumn("value", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"), batch():
        Panel.from_table(df, AllDays()).get_range(START, END)


def test_rolling_rank(panel, raw):
    want = raw.set_index(["as_of_date", "id"]).sort_index()[["value"]].groupby(level="id", group_keys=False).rolling(5, min_periods=2).rank()
    rows = panel.select(["value"]).rolling(5, "rank", 2).to_pandas(START, END)
    have = rows.set_index(["id", "as_of_date"])["value"].sort_index().to_numpy(float)
    assert np.allclose(have, want.droplevel(0)["value"].reorder_levels(["id", "as_of_date"]).sort_index().to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("freq", ["W-WED", "W-SUN", "MS", "QS", "D", "YE"])
@pytest.mark.parametrize("func", ["sum", "size", "nunique", "prod", "last"])
def test_more_buckets(panel, raw, freq, func):
    rows = panel.select(["size"]).resample(freq, func).to_pandas(START, END)
    for i, g in raw.groupby("id"):
        want = getattr(g.assign(as_of_date=pd.to_datetime(g["as_of_date"])).set_index("as_of_date")["size"].resample(freq), func)()
        have = rows[rows["id"] == i]
        assert [str(d) for d in have["as_of_date"]] == [str(d.date()) for d in want.index]
        assert np.allclose(have["size"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_asof_without_by_over_hours(spark):
    """Times within hours, on their borders, and hours without facts, against pandas."""
    rng = np.random.default_rng(5)
    at = lambda n: sorted({datetime(2024, 1, 1) + timedelta(minutes=int(m) * 15) for m in rng.integers(0, 24 * 4 * 6, n)})
    left, right = pd.DataFrame({"as_of_date": at(150)}), pd.DataFrame({"as_of_date": [*at(25), datetime(2024, 1, 9)]})
    left["id"], left["a"], right["id"], right["b"] = 1, 1.0, 2, np.arange(len(right)) * 1.0
    got = timejoin.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), by=None).orderBy("as_of_date").toPandas()
    want = pd.merge_asof(left, right.drop(columns="id"), on="as_of_date")
    assert np.allclose(got["b"].to_numpy(float), want["b"].to_numpy(float), equal_nan=True)
