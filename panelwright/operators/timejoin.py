"""As-of joins: the latest row of another panel at or before each row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.plans.keys import DATE, ID

def microseconds(tolerance) -> int | None:
    """Microseconds in a tolerance: None, a timedelta, or text as pandas reads it, like '7d',
    '1D2h', '1.5h' or '500ms'; a unit alone is one of it."""
    if tolerance is None:
        return None
    text = tolerance.strip() if isinstance(tolerance, str) else tolerance
    try:
        return pd.Timedelta(f"1{text}" if isinstance(text, str) and text.isalpha() else text) // pd.Timedelta(1, "us")
    except (ValueError, TypeError) as error:
        raise ValueError(f"cannot read tolerance {tolerance!r}") from error


def asof_join(left: DataFrame, right: DataFrame, on: str = DATE, by: str | list[str] | None = ID, tolerance=None, suffix: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Left rows with the right row of the greatest ``on`` not after theirs.

    Both sides become one stream of each ``by``, right rows first at equal times, and the
    last right row seen is carried along: one shuffle, linear work. Without ``by`` only
    distinct times are matched - the last right row of a time, by id, stands for it - and
    the rows then join on the time. Times are matched hour by hour: an hour begins with the
    last right row of the hours before it, so one task sees hours, never all times.
    """
    by = [by] if isinstance(by, str) else list(by or ())
    keys = [on, *by]
    payload = [c for c in right.columns if c not in keys]
    both = {c for c in payload if c in left.columns}
    fact = F.struct(F.col(on).alias("t"), *[F.col(c).alias(f"v_{c}") for c in payload])
    limit = microseconds(tolerance)

    def matched(rows: DataFrame, facts: DataFrame, part: list[str]) -> DataFrame:
        a = rows.withColumns({"__side": F.lit(1), "__r": F.lit(None).cast(facts.schema["__r"].dataType)})
        w = Window.partitionBy(*part).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
        seen = a.unionByName(facts, allowMissingColumns=True).withColumn("__r", F.last("__r", True).over(w))
        return seen.where(F.col("__side") == 1).select(*rows.columns, "__r")

    if by:
        joined = matched(left, right.select(*keys, fact.alias("__r"), F.lit(0).alias("__side")), by)
    else:
        order = F.struct(*[F.col(c) for c in ([ID] if ID in right.columns else payload[:1])])
        facts = right.groupBy(on).agg(F.max_by(fact, order).alias("__r"))
        times, part = left.select(on).where(F.col(on).isNotNull()).distinct(), []
        if left.schema[on].dataType.typeName().startswith("timestamp"):
            hour = F.date_trunc("hour", on).cast(left.schema[on].dataType)
            times, facts, part = times.withColumn("__hour", hour), facts.withColumn("__hour", hour), ["__hour"]
            last = facts.groupBy("__hour").agg(F.max_by("__r", on).alias("__r"))
            hours = last.unionByName(times.select("__hour").distinct(), allowMissingColumns=True).groupBy("__hour").agg(F.first("__r", True).alias("__r"))
            before = Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
            begin = hours.select(F.col("__hour").alias(on), "__hour", F.last("__r", True).over(before).alias("__r"))
            facts = facts.withColumn("__side", F.lit(0)).unionByName(begin.withColumn("__side", F.lit(-1)))
        else:
            facts = facts.withColumn("__side", F.lit(0))
        times = matched(times, facts, part).select(F.col(on).alias("__t"), "__r")
        joined = left.join(times, F.col(on) == F.col("__t"), "left").select(*left.columns, "__r")
    r = F.col("__r")
    if limit is not None:
        age = F.unix_micros(F.col(on).cast("timestamp")) - F.unix_micros(r["t"].cast("timestamp"))
        r = F.when(age <= limit, r)
    ours = [F.col(c).alias(c + suffix[0] if c in both else c) for c in left.columns]
    return joined.select(*ours, *[r[f"v_{c}"].alias(c + suffix[1] if c in both else c) for c in payload])
