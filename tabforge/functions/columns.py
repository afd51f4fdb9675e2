"""Column helpers: quoting, type classes, null/NaN normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def q(name: str) -> str:
    """Backtick-quote a column name (names may hold spaces, $, ?, -, dots)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def other_columns(df: DataFrame) -> list[str]:
    """Boolean, timestamp, date, nested: neither numeric nor categorical."""
    num, cat = set(numeric_columns(df)), set(categorical_columns(df))
    return [c for c in df.columns if c not in num and c not in cat]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def dtype_name(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def clean_float(c: Column) -> Column:
    """NaN and +-inf become null (pandas treats NaN as missing; Spark does not)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def normalise_missing(df: DataFrame) -> DataFrame:
    """One projection that maps NaN/+-inf to null in every float/double column."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(clean_float(col(f.name)).cast(f.dataType).alias(f.name))
            changed = True
        else:
            exprs.append(col(f.name))
    return df.select(*exprs) if changed else df
