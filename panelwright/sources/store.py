"""Panels on disk: Parquet in chunks of dates, and a table of the dates that are there.

A store keeps the rows of different panels apart, by a fingerprint of what each computes.

Which dates were computed is kept apart from the rows, so a date without rows is known
to be empty, and no marker rows stand among the data. Dates come from a calendar, so
lists of them on the driver are bounded by the range asked for.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.plans.held import HELD
from panelwright.plans.keys import DATE, validate
from panelwright.plans.settings import default_parent_dirs, default_store_dir, get_logger, timed

UNITS = ("day", "week", "month", "year")
MODES = ("a", "l", "r", "w")


class CacheMissError(LookupError):
    """Dates were asked for that a read-only store lacks."""


class PanelStore:
    """A directory with ``data`` (partitioned by the first day of each chunk) and ``dates``."""

    def __init__(self, spark: SparkSession, path: str, chunk_by: str = "month"):
        if chunk_by not in UNITS:
            raise ValueError(f"chunk_by must be one of {UNITS}, not {chunk_by!r}")
        self.spark, self.path, self.chunk_by = spark, path.rstrip("/"), chunk_by

    def of(self, panel) -> PanelStore:
        """The part of the store that holds this panel's rows."""
        return PanelStore(self.spark, f"{self.path}/{panel.key}", self.chunk_by)

    def _exists(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _chunk(self, column: str = DATE):
        day = F.col(column).cast("date")
        return day if self.chunk_by == "day" else F.trunc(day, self.chunk_by)

    def dates(self, start: date, end: date) -> set[date]:
        """The dates of the range that were written, with rows or without."""
        if not self._exists("dates"):
            return set()
        rows = self.spark.read.parquet(f"{self.path}/dates").where(F.col("day").between(F.lit(start), F.lit(end))).distinct().collect()
        return {r["day"] for r in rows}

    def read(self, start: date, end: date) -> DataFrame | None:
        """The rows of the range; None if nothing was ever written. Whole chunks outside
        are not opened; ``HELD`` keeps ranges in memory where that is turned on."""
        if not self._exists("data"):
            return None
        return HELD.get((self.path, start, end), lambda: self._scan(start, end))

    def _scan(self, start: date, end: date) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/data")
        first, last = (first_day(d, self.chunk_by) for d in (start, end))
        df = df.where(F.col("chunk").between(F.lit(first), F.lit(last)))
        return df.where(F.col(DATE).cast("date").between(F.lit(start), F.lit(end))).drop("chunk")

    def write(self, df: DataFrame, days: list[date]) -> None:
        """Replace all rows of ``days`` by those of ``df``; other days of a chunk stay. The
        rows are computed once, into a folder beside the data, and checked there."""
        if not days:
            return
        with timed(f"store {self.path}: {len(days)} days", get_logger("panelwright.store")):
            staged = f"{self.path}/staged-{uuid.uuid4().hex[:12]}"
            try:
                df.where(F.col(DATE).cast("date").isin(days)).withColumn("chunk", self._chunk()).write.parquet(staged)
                fresh = validate(self.spark.read.parquet(staged))
                if self._exists("data"):
                    touched = sorted({first_day(d, self.chunk_by) for d in days})
                    old = self.spark.read.parquet(f"{self.path}/data")
                    kept = old.where(F.col("chunk").isin(touched) & ~F.col(DATE).cast("date").isin(days))
                    fresh = kept.unionByName(fresh, allowMissingColumns=True)
                # a chunk is one file if it is small, and several if it is large
                fresh = fresh.hint("rebalance", "chunk")
                fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{self.path}/data")
            finally:
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            self.spark.createDataFrame([(d,) for d in days], "day date").coalesce(1).write.mode("append").parquet(f"{self.path}/dates")
        HELD.invalidate(self.path)


def first_day(d: date, unit: str) -> date:
    """The day that names a date's chunk."""
    if unit == "week":
        return d - timedelta(d.weekday())
    return d if unit == "day" else d.replace(day=1) if unit == "month" else d.replace(month=1, day=1)


def default_store(chunk_by: str = "month") -> PanelStore:
    spark = SparkSession.active()
    return PanelStore(spark, default_store_dir(spark), chunk_by)


def default_parents(chunk_by: str = "month") -> tuple[PanelStore, ...]:
    return tuple(PanelStore(SparkSession.active(), p, chunk_by) for p in default_parent_dirs())


def through_store(panel, store: PanelStore, start: date, end: date, mode: str = "a", parents: tuple[PanelStore, ...] = ()) -> DataFrame:
    """Rows of the range under a cache mode.

    ``l``: computed, nothing read or written. ``w``: computed and written, whatever is
    there. ``a``: what is missing is computed and written. ``r``: ``CacheMissError`` if
    anything is missing. A date's rows all come from the first store that has the date,
    parents before the store itself; only the latter is written.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    store, parents = store.of(panel), tuple(p.of(panel) for p in parents)
    days = panel.calendar.days(start, end)
    listed = F.col(DATE).cast("date").isin(days) if days else F.lit(False)
    if mode == "l":
        return panel.df(start, end).where(listed)
    if mode == "w":
        if days:
            store.write(panel.df(start, end), days)
        levels: list[PanelStore] = [store]
    else:
        levels = [*parents, store]
        have = set().union(*[s.dates(start, end) for s in levels])
        missing = [d for d in days if d not in have]
        if missing and mode == "r":
            raise CacheMissError(f"{len(missing)} dates are missing, from {missing[0]} to {missing[-1]}")
        if missing:
            # windows have to see what they would see without a store: the whole range
            built = (missing[0], missing[-1]) if panel.local else (start, end)
            store.write(panel.df(*built), missing)
    out: DataFrame | None = None
    left = set(days)
    for s in levels:
        own = sorted(left & s.dates(start, end))
        left -= set(own)
        rows = s.read(start, end) if own else None
        if rows is not None:
            rows = rows.where(F.col(DATE).cast("date").isin(own))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return panel.df(start, end).where(F.lit(False)) if out is None else out
