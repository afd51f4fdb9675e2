"""Incremental profile from stored sketches (A2, A3, A5, A7): a new day costs one day.

Each part of a table (a day, a load) leaves one row a column: row and missing
counts, smallest and largest value, a HyperLogLog sketch of the values (as
text) and, for numbers, a KLL quantile sketch.  Sketches merge, so the profile
of all parts is an aggregate over these rows and never reads the table again.
Parts are folders of a Parquet table and a part that is added again replaces
what it held, so a repeated run changes nothing.

Errors: ``rank_error(k)`` bounds how far the rank of a reported quantile is
from the wanted one, as a share of the rows (99 % of the time); a part or a
window of at most ``k`` values is exact.  Distinct counts have a relative
standard error of 1.04 / sqrt(2^lg_k) or less.  Merging does not widen either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.columns import col, numeric_columns

K = 2048            # of the quantile sketches: a rank error of 0.14 %
LG_K = 14           # of the distinct sketches: a standard error of 0.8 %
RANKS = (0.25, 0.5, 0.75)


def rank_error(k: int = K) -> float:
    """Rank error of a KLL sketch at 99 % confidence (the sketch's published formula)."""
    return 2.296 / k ** 0.9723


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg_k / 2)


def present(c: Column) -> Column:
    """A number as double, NaN as missing."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def quantiles_of(sketch: Column, ranks: tuple[float, ...] = RANKS) -> Column:
    """Values at the ranks, as an array; null where the sketch holds nothing."""
    held = F.when(F.kll_sketch_get_n_double(sketch) > 0, sketch)
    return F.kll_sketch_get_quantile_double(held, F.array(*[F.lit(r) for r in ranks]))


def column_sketches(df: DataFrame, part: Column, cols: list[str] | None = None, k: int = K, lg_k: int = LG_K) -> DataFrame:
    """(part, column_name, n_rows, n_missing, min, max, distinct, values): one pass, one row a part and column."""
    cols = list(df.columns) if cols is None else list(cols)
    numbers = set(numeric_columns(df))
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    null_double, null_binary = F.lit(None).cast("double"), F.lit(None).cast("binary")
    for i, c in enumerate(cols):
        v = present(col(c)) if c in numbers else None
        missing = v.isNull() if v is not None else col(c).isNull()
        text = col(c).cast("string") if v is None else F.when(v.isNotNull(), col(c).cast("string"))
        aggs += [F.count_if(missing).alias(f"m{i}"), F.hll_sketch_agg(text, F.lit(lg_k)).alias(f"d{i}")]
        if v is not None:
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.kll_sketch_agg_double(v, k).alias(f"q{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("n_missing"),
                             (F.col(f"lo{i}") if v is not None else null_double).alias("min"),
                             (F.col(f"hi{i}") if v is not None else null_double).alias("max"),
                             F.col(f"d{i}").alias("distinct"),
                             (F.col(f"q{i}") if v is not None else null_binary).alias("values")))
    return (df.groupBy(part.cast("string").alias("part")).agg(*aggs)
            .select("part", F.explode(F.array(*rows)).alias("r")).select("part", "r.*"))


def add_parts(df: DataFrame, part: Column, path: str, cols: list[str] | None = None, k: int = K, lg_k: int = LG_K) -> None:
    """Sketches of the parts that ``df`` holds, into the table at ``path``; a part already there is replaced."""
    (column_sketches(df, part, cols, k, lg_k).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part").parquet(path))


def stored_profile(spark: SparkSession, path: str, parts: Column | None = None,
                   ranks: tuple[float, ...] = RANKS) -> DataFrame:
    """Profile of all stored parts, or of those for which ``parts`` (a condition on ``part``) holds."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return merged_profile(rows if parts is None else rows.where(parts), ranks)


def merged_profile(rows: DataFrame, ranks: tuple[float, ...] = RANKS) -> DataFrame:
    """(column_name, n_rows, n_missing, min, max, n_distinct, quantiles) from rows of ``column_sketches``."""
    out = rows.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
        F.kll_merge_agg_double("values").alias("values"))
    return out.withColumn("quantiles", quantiles_of(F.col("values"), ranks)).drop("values")
