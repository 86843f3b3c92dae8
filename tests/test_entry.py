"""Registered queries: names match their SQL, and results match DuckDB's."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from panelwright.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def _rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(str([str(x).removesuffix(" 00:00:00") if "as_of_date" in c else None if x != x or x is None else x for c, x in zip(df.columns, row, strict=True)]) for row in df.values.tolist())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p3_not_in", "p9_where", "a4_div_panel", "w1_rolling_median", "w5_pct_change", "t1_ewm_var", "c1_cs_rank", "g1_resample_W_sum", "j1_join_outer", "j2_asof_tolerance", "l1_align_calendar_ffill", "l3_dt_shift_weekdays", "s8_store_append", "s8_store_append_rolling", "s8_stores_apart", "s12_memory_cache", "s14_defaults", "l1_align_custom", "l3_dt_shift_timestamps", "e1_batch", "e3_handles", "u5_to_arrow"])
def test_equal_to_sql(spark, db, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), db.sql(catalog.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)


def test_batch_query_leaves_rows_beside_the_data(spark, db, monkeypatch):
    with monkeypatch.context() as m:
        for name in ("toPandas", "collect", "toArrow"):
            m.setattr(type(spark.range(0)), name, lambda self: pytest.fail("rows went to the driver"))
        found = catalog.queries()["e1_batch"](spark, str(DATA))
    assert _rows(found.toPandas()) == _rows(db.sql(catalog.oracle_sql()["e1_batch"]).df())
