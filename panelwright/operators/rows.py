"""Selection, filtering, renaming, missing values, union and key-wise joins of panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.expressions import predicate
from panelwright.operators.windows import back_fill, forward_fill
from panelwright.plans.keys import KEYS, numeric_columns, value_columns

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[k for k in KEYS if k in df.columns], *[c for c in columns if c not in KEYS])


def where(df: DataFrame, filters: list[tuple]) -> DataFrame:
    return df.where(predicate(filters, df.columns))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Value columns under new names; unknown names are ignored."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in value_columns(df)})


def drop_missing(df: DataFrame, how: str = "any") -> DataFrame:
    if how not in ("any", "all"):
        raise ValueError(f"rows are dropped for 'any' or 'all' missing values; {how!r} is neither")
    return df.na.drop(how, subset=value_columns(df))


def fill_missing(df: DataFrame, value=None, method: str | None = None) -> DataFrame:
    """With a value, or forward or backward within each id."""
    if (value is None) == (method is None):
        raise ValueError("fill with a value or in a direction, one of them")
    if method is not None:
        if method not in ("ffill", "bfill"):
            raise ValueError(f"filling goes forward ('ffill') or backward ('bfill'); {method!r} is neither")
        return forward_fill(df) if method == "ffill" else back_fill(df)
    names = numeric_columns(df) if isinstance(value, int | float) and not isinstance(value, bool) else [c for c in value_columns(df) if c not in numeric_columns(df)]
    return df.na.fill(value, names) if names else df


def concat(tables: list[DataFrame]) -> DataFrame:
    """Bag union by name; a column that a side lacks is missing there."""
    if not tables:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def join(left: DataFrame, right: DataFrame, on: str | list[str] | None = None, how: str = "left", suffix: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Equi-join. Missing keys match each other; columns on both sides get both suffixes."""
    if how not in HOWS:
        raise ValueError(f"no join of the kind {how!r}; there are {sorted(HOWS)}")
    on = list(KEYS) if on is None else [on] if isinstance(on, str) else list(on)
    both = {c for c in left.columns if c in right.columns and c not in on}
    a = left.select(*[F.col(c).alias(f"__a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"__b_{c}") for c in right.columns])
    joined = a.join(b, reduce(lambda x, y: x & y, [F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")) for c in on]), HOWS[how])
    keys = [F.coalesce(F.col(f"__a_{c}"), F.col(f"__b_{c}")).alias(c) for c in on]
    ours = [F.col(f"__a_{c}").alias(c + suffix[0] if c in both else c) for c in left.columns if c not in on]
    theirs = [F.col(f"__b_{c}").alias(c + suffix[1] if c in both else c) for c in right.columns if c not in on]
    return joined.select(*keys, *ours, *theirs)
