"""Reindexing a panel to a calendar or to another panel's keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.calendars import Calendar
from panelwright.operators.rows import fill_missing
from panelwright.plans.keys import DATE, ID, KEYS


def check_fill(method) -> None:
    if not (method in ("ffill", "bfill", None) or (isinstance(method, int | float) and not isinstance(method, bool))):
        raise ValueError(f"fill_method must be 'ffill', 'bfill', None or a number, not {method!r}")


def _fill(df: DataFrame, method) -> DataFrame:
    if method is None:
        return df
    return fill_missing(df, method=method) if isinstance(method, str) else fill_missing(df, value=method)


def _onto(keys: DataFrame, df: DataFrame) -> DataFrame:
    """The rows of ``df`` at ``keys``; keys that it lacks have missing values."""
    own = df.select(*[F.col(k).alias(f"__k_{k}") for k in KEYS], *[c for c in df.columns if c not in KEYS])
    joined = keys.join(own, (F.col(DATE) == F.col(f"__k_{DATE}")) & (F.col(ID) == F.col(f"__k_{ID}")), "left")
    return joined.select(*df.columns)


def align_to_calendar(df: DataFrame, start: date, end: date, calendar: Calendar, method="ffill") -> DataFrame:
    """Every id on every calendar day between the panel's first and last date; rows on
    other days go before filling, and gaps that were there are filled too."""
    check_fill(method)
    low, high = (df.agg(f(F.col(DATE).cast("date"))).scalar() for f in (F.min, F.max))
    ids = df.select(ID).distinct().withColumns({"__low": low, "__high": high})
    days = calendar.sequence(F.col("__low"), F.col("__high"), start, end)
    keys = ids.select(F.explode(days).alias("__d"), ID).select(F.col("__d").cast(df.schema[DATE].dataType).alias(DATE), ID)
    return _fill(_onto(keys, df), method)


def align_to(df: DataFrame, target: DataFrame, method="ffill") -> DataFrame:
    """The panel at the target's keys; rows elsewhere go before filling."""
    check_fill(method)
    return _fill(_onto(target.select(*KEYS), df), method)
