"""Streams of panel rows into a store: each micro-batch replaces the dates it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.plans.keys import DATE, KEYS, value_columns
from panelwright.sources.store import PanelStore


def daily(stream: DataFrame, time_column: str, id_column: str, value_column: str, late: str = "1 day") -> DataFrame:
    """Sums and counts by day and id; rows later than ``late`` are left out by watermark."""
    day = F.window(time_column, "1 day").alias("w")
    found = stream.withWatermark(time_column, late).groupBy(day, F.col(id_column).alias("id"))
    found = found.agg(F.sum(value_column).alias("value"), F.count("*").alias("n"))
    return found.select(F.col("w.start").cast("date").alias(DATE), "id", "value", "n")


def into_store(stream: DataFrame, store: PanelStore, checkpoint: str):
    """Start a query that merges every micro-batch: rows of its keys replace older ones."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.persist()  # read three times; a lost part is computed again from the source
        try:
            days = sorted(r[0] for r in rows.select(F.col(DATE).cast("date")).distinct().collect())
            if not days:
                return
            old, merged = store.read(days[0], days[-1]), rows
            if old is not None:
                merged = rows.unionByName(old.join(rows.select(*KEYS), list(KEYS), "left_anti").where(F.col(DATE).isin(days)))
            store.write(merged.select(*KEYS, *value_columns(rows)), days)
        finally:
            rows.unpersist()

    return stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).start()
