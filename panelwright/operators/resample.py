"""Resampling each id to weeks, months, quarters or years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.plans.keys import DATE, ID, numeric_columns, value_columns

#: Unit, step, and the label of a bucket from its first day.
_RULES = {
    "D": ("day", "interval 1 day", lambda b: b),
    "W": ("week", "interval 7 days", lambda b: F.date_add(b, 6)),
    "M": ("month", "interval 1 month", lambda b: F.last_day(b)),
    "Q": ("quarter", "interval 3 months", lambda b: F.last_day(F.add_months(b, 2))),
    "Y": ("year", "interval 1 year", lambda b: F.last_day(F.add_months(b, 11))),
    "MS": ("month", "interval 1 month", lambda b: b),
    "QS": ("quarter", "interval 3 months", lambda b: b),
    "YS": ("year", "interval 1 year", lambda b: b),
}
_SAME = {"ME": "M", "QE": "Q", "YE": "Y", "A": "Y", "AS": "YS"}
_DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
FUNCTIONS = ("last", "first", "mean", "sum", "min", "max", "std", "var", "sem", "median", "count", "size", "nunique", "prod")
#: What a bucket without rows has, where that is not missing.
_EMPTY = {"sum": 0.0, "prod": 1.0, "count": 0, "size": 0, "nunique": 0}


def _aggregate(c: str, func: str) -> Column:
    seen = F.when(F.col(c).isNotNull(), F.col(DATE))
    x = F.col(c)
    return {
        "last": lambda: F.max_by(x, seen), "first": lambda: F.min_by(x, seen), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "mean": lambda: F.avg(x.cast("double")), "sum": lambda: F.coalesce(F.sum(x.cast("double")), F.lit(0.0)), "count": lambda: F.count(x),
        "std": lambda: F.stddev_samp(x.cast("double")), "var": lambda: F.var_samp(x.cast("double")), "median": lambda: F.median(x.cast("double")),
        "sem": lambda: F.stddev_samp(x.cast("double")) / F.sqrt(F.count(x)), "size": lambda: F.count(F.lit(1)), "nunique": lambda: F.count_distinct(x),
        "prod": lambda: F.coalesce(F.product(x.cast("double")), F.lit(1.0)),
    }[func]()


def resample(df: DataFrame, freq: str, func: str = "last") -> DataFrame:
    """One row for each id and bucket from its first to its last, labelled by the bucket's
    last day. Buckets without rows are missing, or 0 for sum and count.

    The gaps come from each id's own span, so the grid grows with ids and their spans.
    """
    freq, back = _SAME.get(freq, freq), 0
    if freq.startswith("W-") and freq[2:] in _DAYS:
        # weeks that end on another day are weeks of days moved to end on Sunday
        freq, back = "W", 6 - _DAYS.index(freq[2:])
    if freq not in _RULES:
        raise ValueError(f"unknown frequency: {freq!r}")
    if func not in FUNCTIONS:
        raise ValueError(f"unknown resampling function: {func!r}")
    unit, step, label = _RULES[freq]
    names = numeric_columns(df) if func in ("mean", "sum", "std", "var", "sem", "median", "prod") else value_columns(df)
    day = F.date_add(F.col(DATE).cast("date"), back)
    start = F.date_sub(F.trunc(day, unit), back) if unit != "day" else day
    found = df.groupBy(ID, start.alias("__b")).agg(*[_aggregate(c, func).alias(c) for c in names])
    spans = found.groupBy(F.col(ID).alias("__id")).agg(F.min("__b").alias("lo"), F.max("__b").alias("hi"))
    grid = spans.select("__id", F.explode(F.sequence("lo", "hi", F.expr(step))).alias("__g"))
    joined = grid.join(found, (F.col("__id") == F.col(ID)) & (F.col("__g") == F.col("__b")), "left")
    empty = _EMPTY.get(func)
    value = lambda c: F.coalesce(F.col(c), F.lit(empty)) if empty is not None else F.col(c)
    return joined.select(label(F.col("__g")).alias(DATE), F.col("__id").alias(ID), *[value(c).alias(c) for c in names])
