"""Missing-value operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, DecimalType, DoubleType, IntegralType, StringType,
                               TimestampNTZType, TimestampType)
from pyspark.sql.window import Window

from tabforge.functions.columns import col
from tabforge.functions.quantiles import QuantileJob
from tabforge.operators.profile import value_frequencies

NUMERIC_STRATEGIES = ("mean", "median", "mode")


def null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: int(row[f"m{i}"]) for i, c in enumerate(cols)}


def fit_numeric(df: DataFrame, cols: list[str], strategy: str = "mean",
                only_with_nulls: bool = True) -> dict[str, float | None]:
    """Mean / median / mode of every numeric column that has nulls at fit.

    Null counts, means and the median sketch share one aggregate pass."""
    if strategy not in NUMERIC_STRATEGIES:
        raise ValueError(f"unknown numeric imputation {strategy!r}; use {NUMERIC_STRATEGIES}")
    if not cols:
        return {}
    if strategy == "mode":
        todo = [c for c, n in null_counts(df, cols).items() if n > 0] if only_with_nulls else cols
        return modes(df, todo)
    qjob = QuantileJob({c: [0.5] for c in cols}) if strategy == "median" else None
    aggs = [F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]
    if strategy == "mean":
        aggs += [F.avg(col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)]
    else:
        aggs += qjob.sketch_aggs()
    row = df.agg(*aggs).first()
    keep = [c for i, c in enumerate(cols) if int(row[f"m{i}"]) > 0 or not only_with_nulls]
    if strategy == "mean":
        return {c: row[f"a{cols.index(c)}"] for c in keep}
    med = qjob.finish(df, row)
    return {c: med[c][0] for c in keep}


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, ties -> smallest.

    Values are grouped with partial aggregation, then the winner per column is
    a ``min_by`` aggregate over (-count, value): no column's values meet in one
    task.  Values are grouped as they are: text as text, integers as 64-bit
    integers (large ids stay apart), other numbers as doubles."""
    out: dict[str, object] = {c: None for c in cols}
    groups: dict[str, list[str]] = {}
    for c in cols:
        t = df.schema[c].dataType
        kind = ("string" if isinstance(t, StringType) else "boolean" if isinstance(t, BooleanType)
                else "bigint" if isinstance(t, IntegralType) else "double")
        groups.setdefault(kind, []).append(c)
    for cast, group in groups.items():
        freq = (df.select(F.explode(F.array(*[
                    F.struct(F.lit(c).alias("column_name"), col(c).cast(cast).alias("value"))
                    for c in group])).alias("e")).select("e.*")
                  .where(F.col("value").isNotNull())
                  .groupBy("column_name", "value").count())
        for r in (freq.groupBy("column_name")
                  .agg(F.min_by("value", F.struct((-F.col("count")).alias("c"),
                                                  F.col("value").alias("v"))).alias("v"))
                  .collect()):
            out[r["column_name"]] = r["v"]
    return out


def fit_categorical(df: DataFrame, cols: list[str], only_with_nulls: bool = True) -> dict[str, str]:
    """R2: most frequent value of each text column that has nulls."""
    todo = [c for c, n in null_counts(df, cols).items() if n > 0] if only_with_nulls else cols
    return modes(df, todo)


def holds(dtype: DataType, value) -> bool:
    """Whether a column of this type can hold the number without losing its fraction."""
    if isinstance(value, float) and isinstance(dtype, (IntegralType, DecimalType)):
        return value.is_integer()
    return True


def apply_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """coalesce(c, fitted) for each fitted column, in place (one projection).

    An integer or decimal column whose fitted value has a fraction becomes
    double, so a mean is never cut to a whole number."""
    if not values:
        return df

    def filled(c: str):
        t, v = df.schema[c].dataType, values.get(c)
        if v is None:
            return col(c)
        if not holds(t, v):
            t = DoubleType()
        return F.coalesce(col(c).cast(t), F.lit(v).cast(t)).alias(c)

    return df.select(*[filled(c) for c in df.columns])


def emergency_fill(df: DataFrame) -> DataFrame:
    """Numeric -> 0, text -> 'missing'; every other column untouched."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            out.append(F.coalesce(col(f.name), F.lit("missing")).alias(f.name))
        elif t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"):
            out.append(F.coalesce(col(f.name), F.lit(0).cast(f.dataType)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def emergency_fill_except(df: DataFrame, skip: list[str]) -> DataFrame:
    """R21 on every column but ``skip`` (the target keeps its nulls)."""
    if not skip:
        return emergency_fill(df)
    return df.select(*[F.col(f"`{c}`") if c in skip else
                       _fill_one(df, c).alias(c) for c in df.columns])


def _fill_one(df: DataFrame, c: str):
    t = df.schema[c].dataType.simpleString()
    if t == "string":
        return F.coalesce(col(c), F.lit("missing"))
    if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"):
        return F.coalesce(col(c), F.lit(0).cast(df.schema[c].dataType))
    return col(c)


def drop_missing_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """R3 'drop': remove rows with a null in any of ``cols`` (fit only)."""
    return df.na.drop(subset=cols) if cols else df.na.drop()


ROWS_PER_RANGE = 50_000
MOST_RANGES = 1024


def _order_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases along the order of a column (null for null)."""
    t = df.schema[name].dataType
    if isinstance(t, DateType):
        return F.unix_date(col(name)).cast("double")
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if isinstance(t, StringType):  # the first six bytes
        head = F.rpad(F.substring(F.hex(F.encode(col(name), "UTF-8")), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return col(name).cast("double")


def _range_of(x: Column, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` lie at or below ``x``, by bisection; -1 for null (sorted first)."""
    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), cut(lo, mid)).otherwise(cut(mid + 1, hi))
    return F.when(x.isNull(), F.lit(-1)).otherwise(cut(0, len(bounds))).cast("int")


def _fill_directional(df: DataFrame, cols: list[str], partition_by: list[str],
                      order_by: str | list[str], forward: bool, ranges: int | None) -> DataFrame:
    """Forward/backward fill that survives a hot partition key.

    Rows of one key are cut into ranges of the first order column, whose bounds
    are quantiles of that column (about ``ROWS_PER_RANGE`` rows a range, so an
    odd value far away changes nothing).  The fill runs per (key, range), and
    the last (first) non-null value of the earlier (later) ranges is carried
    over from a table with one row per (key, range).  Null order keys come
    first, as in the window's order; null partition keys are a key of their own.
    """
    if df.isStreaming:
        raise ValueError("forward and backward fill need all rows of a key; a stream has none of them for certain")
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not cols:
        return df
    num = _order_number(df, order[0])
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, df.count() // ROWS_PER_RANGE))
    bounds = df.agg(F.percentile_approx(num, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] \
        if ranges > 1 else []
    keys = [col(k) for k in partition_by]
    base = df.withColumn("__b", _range_of(num, sorted(set(bounds or []))))
    okey = F.struct(*[col(c) for c in order])
    pick = F.max_by if forward else F.min_by
    summary = base.groupBy(*keys, "__b").agg(*[
        pick(col(c), F.when(col(c).isNotNull(), okey)).alias(f"__s{i}") for i, c in enumerate(cols)])
    agg_fn = F.last if forward else F.first
    wb = Window.partitionBy(*keys).orderBy("__b")
    wb = (wb.rowsBetween(Window.unboundedPreceding, -1) if forward
          else wb.rowsBetween(1, Window.unboundedFollowing))
    carry = summary.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), *[
        agg_fn(F.col(f"__s{i}"), ignorenulls=True).over(wb).alias(f"__c{i}") for i in range(len(cols))])
    wr = Window.partitionBy(*keys, "__b").orderBy(*[col(c) for c in order])
    wr = (wr.rowsBetween(Window.unboundedPreceding, 0) if forward
          else wr.rowsBetween(0, Window.unboundedFollowing))
    filled = base.select(*[col(c) for c in df.columns], "__b",
                         *[agg_fn(col(c), ignorenulls=True).over(wr).alias(f"__f{i}")
                           for i, c in enumerate(cols)])
    match = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        match = match & k.eqNullSafe(F.col(f"__k{i}"))
    joined = filled.join(carry, match, "left")
    return joined.select(*[
        F.coalesce(F.col(f"__f{cols.index(c)}"), F.col(f"__c{cols.index(c)}")).alias(c)
        if c in cols else col(c) for c in df.columns])


def forward_fill(df: DataFrame, cols: list[str], partition_by: list[str], order_by,
                 buckets: int | None = None) -> DataFrame:
    """R3 'forward_fill': last non-null value at or before the row, per key
    in ``order_by`` order (an order key is mandatory: rows have no order)."""
    return _fill_directional(df, cols, partition_by, order_by, True, buckets)


def backward_fill(df: DataFrame, cols: list[str], partition_by: list[str], order_by,
                  buckets: int | None = None) -> DataFrame:
    """R3 'backward_fill': next non-null value at or after the row."""
    return _fill_directional(df, cols, partition_by, order_by, False, buckets)
