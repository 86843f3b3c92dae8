"""Time-series operators over the rows of each id, in date order.

All windows partition by id and order by date, so a chain of them needs one shuffle.
Windows count rows that are present, not calendar days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.functions.expressions import clip, divide, known
from panelwright.plans.keys import DATE, ID, each, numeric_columns, value_columns


def by_id() -> WindowSpec:
    return Window.partitionBy(ID).orderBy(DATE)


def so_far() -> WindowSpec:
    return by_id().rowsBetween(Window.unboundedPreceding, 0)


def _median(c: Column, span: WindowSpec) -> Column:
    s = F.array_sort(F.collect_list(c).over(span))
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _rank(c: Column, span: WindowSpec) -> Column:
    """The place of the row's own value among the span's, ties sharing their mean place."""
    found = F.collect_list(c).over(span)
    return F.when(c.isNotNull(), F.size(F.filter(found, lambda x: x < c)) + (F.size(F.filter(found, lambda x: x == c)) + 1) / 2)


def _moment(c: Column, span: WindowSpec, name: str) -> Column:
    n = F.count(c).over(span).cast("double")
    if name == "skew":
        return F.when(n > 2, F.skewness(c).over(span) * F.sqrt(n * (n - 1)) / (n - 2))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c).over(span) + 6))


def aggregate(c: Column, span: WindowSpec, func: str, min_periods: int) -> Column:
    """``func`` over a span, missing with fewer than ``min_periods`` values in it."""
    c = c.cast("double")
    simple = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}
    n = F.count(c).over(span)
    if func == "count":  # of rows, missing or not, is asked for here
        return F.when(F.count(F.lit(1)).over(span) >= min_periods, n.cast("double"))
    if func in simple:
        out = simple[func](c).over(span)
        out = F.coalesce(out, F.lit(0.0)) if func == "sum" else out
    elif func == "median":
        out = _median(c, span)
    elif func == "rank":
        out = _rank(c, span)
    elif func in ("skew", "kurt"):
        out = _moment(c, span, func)
    elif func == "sem":
        out = F.stddev_samp(c).over(span) / F.sqrt(F.nullif(n - 1, F.lit(0)))
    else:
        raise ValueError(f"unknown window function: {func!r}")
    return F.when(n >= min_periods, known(out))


def rolling(df: DataFrame, window: int, func: str = "mean", min_periods: int | None = None) -> DataFrame:
    span = by_id().rowsBetween(-(window - 1), 0)
    return each(df, numeric_columns(df), lambda c: aggregate(F.col(c), span, func, min_periods or window))


def expanding(df: DataFrame, func: str = "mean", min_periods: int = 1) -> DataFrame:
    return each(df, numeric_columns(df), lambda c: aggregate(F.col(c), so_far(), func, min_periods))


def zscore(df: DataFrame, window: int, min_periods: int | None = None) -> DataFrame:
    span, least = by_id().rowsBetween(-(window - 1), 0), min_periods or window

    def score(c: str) -> Column:
        x = F.col(c).cast("double")
        z = (x - F.avg(x).over(span)) / F.nullif(F.stddev_samp(x).over(span), F.lit(0.0))
        return F.when(F.count(x).over(span) >= least, z)

    return each(df, numeric_columns(df), score)


def shift(df: DataFrame, periods: int = 1) -> DataFrame:
    w = by_id()
    return each(df, value_columns(df), lambda c: F.lag(c, periods).over(w))


def diff(df: DataFrame, periods: int = 1) -> DataFrame:
    w = by_id()
    return each(df, numeric_columns(df), lambda c: F.col(c).cast("double") - F.lag(c, periods).over(w).cast("double"))


def pct_change(df: DataFrame, periods: int = 1, fill: bool = True) -> DataFrame:
    """Relative change; with ``fill`` a missing value stands for the last one known."""
    w = by_id()
    names = numeric_columns(df)
    filled = each(df, names, lambda c: F.last(c, True).over(so_far()).cast("double")) if fill else df
    return each(filled, names, lambda c: divide(F.col(c), F.lag(c, periods).over(w)) - 1)


def forward_fill(df: DataFrame) -> DataFrame:
    return each(df, value_columns(df), lambda c: F.last(c, True).over(so_far()))


def back_fill(df: DataFrame) -> DataFrame:
    rest = by_id().rowsBetween(0, Window.unboundedFollowing)
    return each(df, value_columns(df), lambda c: F.first(c, True).over(rest))


def cumulative(df: DataFrame, func: str) -> DataFrame:
    """Running sum, product, maximum or minimum; missing rows stay missing."""
    make = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}[func]
    return each(df, numeric_columns(df), lambda c: F.when(F.col(c).isNotNull(), make(F.col(c).cast("double")).over(so_far())))


def check_quantiles(lower: float, upper: float) -> None:
    if not 0 <= lower < upper <= 1:
        raise ValueError("quantiles must satisfy 0 <= lower < upper <= 1")


def winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip at the quantiles of each id over the whole range. They are exact: counts of an
    id's distinct values are added map-side and kept in a task's memory, then joined back."""
    check_quantiles(lower, upper)
    names = numeric_columns(df)
    bounds = df.groupBy(F.col(ID).alias("__id")).agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(lower), F.lit(upper))).alias(f"__q_{c}") for c in names])
    joined = df.join(bounds, F.col(ID).eqNullSafe(F.col("__id")), "left")
    return joined.select(*[clip(F.col(c).cast("double"), F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]).alias(c) if c in names else F.col(c) for c in df.columns])


def ewm(df: DataFrame, span: float, func: str = "mean") -> DataFrame:
    """Exponentially weighted mean, var or std, weights adjusted, missing rows ageing them.

    With q = 1 - 2/(span + 1) a row's sum is q^j times a running sum of q^-i x_i inside a
    block of rows, plus what the end of the block before still weighs. A block is so long
    that what lies before that one weighs under e^-40; so sums stay in range and each row
    takes constant work, however long the series. Sums are asked for at rows with a value
    alone, so a gap of any length leaves the row after it a weight of 1 at least.
    """
    if func not in ("mean", "std", "var"):
        raise ValueError(f"unknown ewm function: {func!r}")
    if span < 1:
        raise ValueError("span must be at least 1")
    q = 1 - 2 / (span + 1)
    names = numeric_columns(df)
    if q == 0:  # only the row itself weighs
        last = forward_fill(df)
        return each(last, names, lambda c: F.col(c).cast("double") if func == "mean" else F.lit(None).cast("double"))
    block = max(1, math.ceil(40 / -math.log(q)))
    w = by_id()
    df0 = df.withColumn("__n", F.row_number().over(w) - 1)
    df1 = df0.withColumns({"__b": F.floor(F.col("__n") / block), "__j": (F.col("__n") % block).cast("double")})
    inside = Window.partitionBy(ID, "__b").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    middle = Window.partitionBy(ID)
    j, lq = F.col("__j"), math.log(q)
    terms: dict[str, tuple[Column, int]] = {}
    means = {}
    for c in names:
        x = F.col(c).cast("double")
        means[c] = F.coalesce(F.avg(x).over(middle), F.lit(0.0)) if func != "mean" else F.lit(0.0)
        seen = F.when(x.isNotNull(), 1.0).otherwise(0.0)
        d = F.coalesce(x - (F.col(f"__m_{c}") if func != "mean" else F.lit(0.0)), F.lit(0.0))
        terms |= {f"__w_{c}": (seen, 1), f"__x_{c}": (d, 1)}
        if func != "mean":
            terms |= {f"__v_{c}": (seen, 2), f"__y_{c}": (d * d, 1)}
    if func != "mean":
        df1 = df1.withColumns({f"__m_{c}": m for c, m in means.items()})
    local = {k: F.exp(j * (p * lq)) * F.sum(t * F.exp(-j * (p * lq))).over(inside) for k, (t, p) in terms.items()}
    df2 = df1.withColumns({f"{k}_l": e for k, e in local.items()})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carry = {k: F.col(f"{k}_l") + F.exp((j + 1) * (p * lq)) * F.coalesce(F.last(F.when(j == block - 1, F.col(f"{k}_l")), True).over(before), F.lit(0.0)) for k, (_, p) in terms.items()}
    df3 = df2.withColumns({**carry, **{f"__c_{c}": F.count(c).over(so_far()) for c in names}})

    def result(c: str) -> Column:
        weight = F.col(f"__w_{c}")
        mean = F.when(F.col(f"__c_{c}") > 0, F.col(f"__x_{c}") / weight)
        if func == "mean":
            return mean
        square = F.col(f"__y_{c}") / weight
        spread = square - mean * mean
        spread = F.when(spread > 1e-13 * square, spread).otherwise(0.0)  # below, it is rounding
        var = F.when(F.col(f"__c_{c}") > 1, spread * weight * weight / F.nullif(weight * weight - F.col(f"__v_{c}"), F.lit(0.0)))
        return var if func == "var" else F.sqrt(var)

    # weights that age alike change neither mean nor variance: a missing row repeats the last result
    found = df3.withColumns({f"__r_{c}": F.when(F.col(c).isNotNull(), F.struct(result(c).alias("r"))) for c in names})
    return found.select(*[F.last(f"__r_{c}", True).over(so_far())["r"].alias(c) if c in names else F.col(c) for c in df.columns])
