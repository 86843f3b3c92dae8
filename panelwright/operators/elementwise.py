"""Arithmetic of panels with scalars and with each other, and per-row conditionals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import expressions as x
from panelwright.plans.keys import DATE, ID, KEYS, each, numeric_columns, value_columns

OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a.cast("double") + b.cast("double"),
    "sub": lambda a, b: a.cast("double") - b.cast("double"),
    "mul": lambda a, b: a.cast("double") * b.cast("double"),
    "div": x.divide,
    "pow": x.power,
}


def with_scalar(df: DataFrame, op: str, scalar: float) -> DataFrame:
    return each(df, numeric_columns(df), lambda c: OPERATIONS[op](F.col(c), F.lit(float(scalar))))


def aligned(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Outer union of keys and columns; a key or column of one side only is missing.
    Columns that are not numeric on the left pass through from there."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, (F.col(f"a.{DATE}") == F.col(f"b.{DATE}")) & (F.col(f"a.{ID}") == F.col(f"b.{ID}")), "full")
    keys = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in KEYS]
    ours, theirs = set(numeric_columns(left)), set(numeric_columns(right))
    out = []
    for c in [*value_columns(left), *[c for c in value_columns(right) if c not in left.columns]]:
        if c in ours and c in theirs:
            out.append(OPERATIONS[op](F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
        elif c in ours or c in theirs:
            out.append(F.lit(None).cast("double").alias(c))
        else:
            out.append(F.col(f"a.{c}" if c in left.columns else f"b.{c}").alias(c))
    return joined.select(*keys, *out)


def absolute(df: DataFrame) -> DataFrame:
    return each(df, numeric_columns(df), lambda c: F.abs(c))


def clip(df: DataFrame, lower: float | None, upper: float | None) -> DataFrame:
    bound = lambda v: None if v is None else F.lit(float(v))
    return each(df, numeric_columns(df), lambda c: x.clip(F.col(c).cast("double"), bound(lower), bound(upper)))


def choose(df: DataFrame, condition: DataFrame, other, keep_where: bool) -> DataFrame:
    """Values where the condition is ``keep_where``, else ``other``. A key or column that
    the condition lacks counts against keeping, whichever way round."""
    named = {c: f"__c_{c}" for c in value_columns(condition)}
    cond = condition.select(*[F.col(k).alias(f"__k_{k}") for k in KEYS], *[F.col(c).alias(n) for c, n in named.items()])
    joined = df.join(cond, (F.col(DATE) == F.col(f"__k_{DATE}")) & (F.col(ID) == F.col(f"__k_{ID}")), "left")

    def pick(c: str) -> Column:
        value = F.lit(other).cast(df.schema[c].dataType)
        if c not in named:
            return value
        test = F.coalesce(F.col(named[c]), F.lit(not keep_where))
        return F.when(test == F.lit(keep_where), F.col(c)).otherwise(value)

    return joined.select(*[F.col(c) if c in KEYS else pick(c).alias(c) for c in df.columns])
