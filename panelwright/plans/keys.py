"""Keys of a panel, value columns, and what missing means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE, ID = "as_of_date", "id"
KEYS = (DATE, ID)


class ValidationError(ValueError):
    """A table is not a panel: a key is absent or a key pair occurs twice."""


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in KEYS and isinstance(f.dataType, T.NumericType)]


def normalize(df: DataFrame) -> DataFrame:
    """NaN in floating value columns becomes NULL, once, where data enters."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType) and f.name not in KEYS]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def validate(df: DataFrame) -> DataFrame:
    """``df`` itself; raises ``ValidationError`` unless both keys exist and pairs are unique."""
    absent = [k for k in KEYS if k not in df.columns]
    if absent:
        raise ValidationError(f"missing key columns: {absent}")
    twice = df.groupBy(*KEYS).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValidationError(f"key pair occurs {twice[0]['count']} times: {twice[0][DATE]}, {twice[0][ID]}")
    return df


def each(df: DataFrame, names: list[str], make) -> DataFrame:
    """``df`` with ``make(name)`` in place of each named column, in one projection."""
    chosen = set(names)
    return df.select(*[make(c).alias(c) if c in chosen else F.col(c) for c in df.columns])
