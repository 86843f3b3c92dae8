"""Cross-sectional operators: each date on its own.

Means, deviations and quantiles are aggregated map-side and joined back to the rows, so
the panel itself is not shuffled into as many tasks as it has dates. The joined side
has a row for each date; it is broadcast only where the range asked for and the number
of columns bound its size. Exact quantiles keep a date's distinct values in a task's
memory, as counts that are added map-side; ranks sort a date in one task, which spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.expressions import clip
from panelwright.operators.windows import check_quantiles
from panelwright.plans.keys import DATE, each, numeric_columns

#: Bytes of statistics that are broadcast, and what a statistic takes at most.
MAX_BROADCAST, PER_VALUE = 8 << 20, 48


def per_date(df: DataFrame, stats: list, days: int | None) -> DataFrame:
    """``df`` with the aggregates of each row's date."""
    table = df.groupBy(F.col(DATE).alias("__date")).agg(*stats)
    if days is not None and days * (len(stats) + 1) * PER_VALUE <= MAX_BROADCAST and isinstance(df.schema[DATE].dataType, T.DateType):
        table = F.broadcast(table)
    return df.join(table, F.col(DATE) == F.col("__date"), "left")


def cs_demean(df: DataFrame, days: int | None = None) -> DataFrame:
    names = numeric_columns(df)
    joined = per_date(df, [F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in names], days)
    return joined.select(*[(F.col(c).cast("double") - F.col(f"__m_{c}")).alias(c) if c in names else F.col(c) for c in df.columns])


def cs_zscore(df: DataFrame, days: int | None = None) -> DataFrame:
    names = numeric_columns(df)
    stats = [f(F.col(c).cast("double")).alias(f"__{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    joined = per_date(df, stats, days)
    score = lambda c: (F.col(c).cast("double") - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))
    return joined.select(*[score(c).alias(c) if c in names else F.col(c) for c in df.columns])


def cs_winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99, days: int | None = None) -> DataFrame:
    check_quantiles(lower, upper)
    names = numeric_columns(df)
    both = F.array(F.lit(lower), F.lit(upper))
    joined = per_date(df, [F.percentile(F.col(c).cast("double"), both).alias(f"__q_{c}") for c in names], days)
    return joined.select(*[clip(F.col(c).cast("double"), F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]).alias(c) if c in names else F.col(c) for c in df.columns])


def cs_rank(df: DataFrame) -> DataFrame:
    """Average rank among a date's values, as a share of their number."""
    day = Window.partitionBy(DATE)

    def rank(c: str):
        x = F.col(c)
        ties = F.count(x).over(Window.partitionBy(DATE, c))
        place = F.rank().over(day.orderBy(x.asc_nulls_last())) + (ties - 1) / 2
        return F.when(x.isNotNull(), place / F.count(x).over(day))

    return each(df, numeric_columns(df), rank)
