"""Column expressions with a panel's rules for missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def known(x: Column) -> Column:
    """NULL for NaN."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """True division in double: x/0 is signed infinity, 0/0 is missing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when((b == 0) & (a > 0), F.lit(INFINITY)).when((b == 0) & (a < 0), F.lit(-INFINITY))


def power(a: Column, b: Column) -> Column:
    return known(F.pow(a.cast("double"), b.cast("double")))


def clip(x: Column, low: Column | None, high: Column | None) -> Column:
    """Bounded ``x``; missing stays missing, a missing bound does not bound."""
    out = x if low is None else F.greatest(x, low)
    out = out if high is None else F.least(out, high)
    return F.when(x.isNotNull(), out)


def _compare(c: Column, op: str, value) -> Column:
    if op in ("=", "=="):
        return c == F.lit(value)
    if op == "!=":
        return ~c.eqNullSafe(F.lit(value))
    if op == "in":
        return c.isin(list(value))
    if op == "not in":
        return c.isNull() | ~c.isin(list(value))
    orders = {"<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}
    if op not in orders:
        raise ValueError(f"unknown operator: {op!r}")
    return orders[op](F.lit(value))


def predicate(filters: list[tuple], columns: list[str]) -> Column:
    """All (column, operator, value) triples hold. Rows with a missing value pass ``!=`` and
    ``not in``, and no other test."""
    for column, _, _ in filters:
        if column not in columns:
            raise KeyError(column)
    tests = [_compare(F.col(c), op, value) for c, op, value in filters]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
