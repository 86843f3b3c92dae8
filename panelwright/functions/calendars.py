"""Calendars: which days exist, and stepping over them, as Spark expressions."""

from __future__ import annotations

import bisect
import hashlib
from abc import ABC, abstractmethod
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.plans.keys import DATE


def as_date(x: date | datetime | str) -> date:
    if isinstance(x, str):
        return date.fromisoformat(x[:10])
    return x.date() if isinstance(x, datetime) else x


#: Pairs of days that are broadcast: 16 bytes each.
MAX_BROADCAST_DAYS = 100_000


def on_day(df: DataFrame, day: Column) -> Column:
    """The date key of ``df`` on another day; a time of day stays."""
    if df.schema[DATE].dataType.typeName() == "date":
        return day
    return F.col(DATE) + F.make_dt_interval(F.datediff(day, F.col(DATE).cast("date")))


class Calendar(ABC):
    """Subclass with ``contains`` and ``offset``; the rest follows.

    What follows lists the days of the range asked for, on the driver and in the plan, so
    its size is bounded by that range. The calendars below do without.
    """

    @abstractmethod
    def contains(self, d: date) -> bool: ...

    @abstractmethod
    def offset(self, d: date, n: int) -> date: ...

    def days(self, start: date, end: date) -> list[date]:
        """The calendar's days from ``start`` to ``end``, both included."""
        span = (as_date(end) - as_date(start)).days
        return [d for i in range(span + 1) if self.contains(d := as_date(start) + timedelta(i))]

    def sequence(self, low: Column, high: Column, start: date, end: date) -> Column:
        """The days between two dates, which lie in a range, as an array column."""
        listed = self.days(start, end)
        days = F.array(*[F.lit(d) for d in listed]) if listed else F.array().cast("array<date>")
        return F.filter(days, lambda d: (d >= low) & (d <= high))

    def shift(self, df: DataFrame, n: int, start: date, end: date) -> DataFrame:
        """``df``, whose dates lie in a range, with every date moved by ``n`` days of the
        calendar; rows on other days go, times of day stay."""
        return self._moved(df, [(d, self.offset(d, n)) for d in self.days(start, end)])

    def _moved(self, df: DataFrame, pairs: list[tuple[date, date]]) -> DataFrame:
        to = df.sparkSession.createDataFrame(pairs, "__from date, __to date")
        joined = df.join(F.broadcast(to) if len(pairs) <= MAX_BROADCAST_DAYS else to, F.col(DATE).cast("date") == F.col("__from"), "inner")
        return joined.select(*[on_day(df, F.col("__to")).alias(c) if c == DATE else F.col(c) for c in df.columns])

    def __repr__(self) -> str:
        """What the calendar is and holds: panels that differ in it have different keys."""
        held = ", ".join(f"{k}={v!r}" for k, v in sorted(vars(self).items()))
        return f"{type(self).__qualname__}({held})"


class AllDays(Calendar):
    def contains(self, d: date) -> bool:
        return True

    def offset(self, d: date, n: int) -> date:
        return as_date(d) + timedelta(n)

    def sequence(self, low: Column, high: Column, start: date, end: date) -> Column:
        return F.when(low <= high, F.sequence(low, high, F.expr("interval 1 day")))

    def shift(self, df: DataFrame, n: int, start: date, end: date) -> DataFrame:
        return df.withColumn(DATE, on_day(df, F.date_add(F.col(DATE).cast("date"), n)))


class Weekdays(Calendar):
    """Monday to Friday, no holidays. From a weekend the next weekday is one step away in
    either direction; zero steps leave a day as it is."""

    def contains(self, d: date) -> bool:
        return d.weekday() < 5

    def offset(self, d: date, n: int) -> date:
        d = as_date(d)
        if n == 0:
            return d
        at = d.weekday()
        if n < 0 and at > 4:
            d, at = d + timedelta(7 - at), 0
        weeks, left = divmod(min(at, 4) + n, 5)
        return d - timedelta(d.weekday()) + timedelta(7 * weeks + left)

    def offset_expression(self, d: Column, n: int) -> Column:
        if n == 0:
            return d
        at = F.weekday(d)
        if n < 0:
            d = F.when(at > 4, F.date_add(d, 7 - at)).otherwise(d)
            at = F.weekday(d)
        steps = F.least(at, F.lit(4)) + F.lit(n)
        monday = F.date_sub(d, F.weekday(d))
        return F.date_add(monday, (F.floor(steps / 5) * 7 + F.pmod(steps, F.lit(5))).cast("int"))

    def sequence(self, low: Column, high: Column, start: date, end: date) -> Column:
        days = F.when(low <= high, F.sequence(low, high, F.expr("interval 1 day")))
        return F.filter(days, lambda d: F.weekday(d) < 5)

    def shift(self, df: DataFrame, n: int, start: date, end: date) -> DataFrame:
        return df.withColumn(DATE, on_day(df, self.offset_expression(F.col(DATE).cast("date"), n)))


class DayList(Calendar):
    """A calendar given as a list of days; the list is what gets broadcast, never data."""

    def __init__(self, days):
        self.listed = sorted({as_date(d) for d in days})

    def contains(self, d: date) -> bool:
        i = bisect.bisect_left(self.listed, d)
        return i < len(self.listed) and self.listed[i] == d

    def offset(self, d: date, n: int) -> date:
        d = as_date(d)
        if n == 0:
            return d
        i = bisect.bisect_right(self.listed, d) - 1 if n > 0 else bisect.bisect_left(self.listed, d)
        # beyond the list's ends there is nothing to step to
        return self.listed[min(max(i + n, 0), len(self.listed) - 1)]

    def shift(self, df: DataFrame, n: int, start: date, end: date) -> DataFrame:
        """Rows whose day or target is not listed go."""
        size = len(self.listed)
        return self._moved(df, [(d, self.listed[i + n]) for i, d in enumerate(self.listed) if 0 <= i + n < size and as_date(start) <= d <= as_date(end)])

    def __repr__(self) -> str:
        listed = hashlib.sha256(" ".join(map(str, self.listed)).encode()).hexdigest()[:16]
        return f"DayList({len(self.listed)} days, {listed})"
