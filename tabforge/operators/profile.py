"""Column profile (missing values, moments, quartiles, outliers, modes,
value counts, correlations, quality score).

Each function runs a fixed, small number of Spark jobs whatever the number of
columns, and returns a small DataFrame with one row per column (or pair).
Only aggregate rows (O(columns)) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabforge.functions.comoments import named_correlations, pairwise_correlations
from tabforge.functions.columns import (categorical_columns, col, dtype_name,
                                        numeric_columns)
from tabforge.functions.quantiles import QuantileJob
from tabforge.session import release, spread
from tabforge.trace import step

NUMERIC_PROFILE_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
    T.StructField("n_distinct", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("variance", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("lower_fence", T.DoubleType()),
    T.StructField("upper_fence", T.DoubleType()),
    T.StructField("n_outliers", T.LongType()),
    T.StructField("likely_categorical", T.BooleanType()),
    T.StructField("cv", T.DoubleType()),
])

# Fixed values of the reference's rules.
IQR_FOLD = 1.5                    # outlier fence multiplier
LIKELY_CATEGORICAL_BELOW = 20     # numeric column with fewer distinct values
CORR_THRESHOLD = 0.7              # |r| kept for supervised tasks
CORR_THRESHOLD_CLUSTERING = 0.9   # |r| kept for clustering
TOP_VALUES = 10                   # value counts reported per column


def numeric_profile(df: DataFrame, cols: list[str] | None = None, *,
                    fold: float = IQR_FOLD, approx_distinct: bool = False) -> DataFrame:
    """One row per numeric column: A1-A7, A11-A13."""
    spark = df.sparkSession
    cols = numeric_columns(df) if cols is None else list(cols)
    if not cols:
        return spark.createDataFrame([], NUMERIC_PROFILE_SCHEMA)
    # Pass 1: moments + quantile sketch.  Distinct counts are kept out of this
    # pass on purpose: Spark's distinct rewrite (Expand) would evaluate the
    # large sketch buffers once per distinct value group (measured 10x slower).
    src = df
    with step("profile.spread"):
        df = spread(df.select(*[col(c) for c in cols]))
    qjob = QuantileJob({c: [0.25, 0.5, 0.75] for c in cols})
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = col(c).cast("double")
        aggs += [F.count_if(v.isNull()).alias(f"m{i}"),
                 F.avg(v).alias(f"a{i}"),
                 F.stddev_samp(v).alias(f"s{i}"),
                 F.var_samp(v).alias(f"v{i}")]
    with step("profile.pass1 moments+sketch"):
        row = df.agg(*aggs, *qjob.sketch_aggs()).first()
    # Pass 2: exact quartiles from the sketch brackets.
    with step("profile.pass2 quartiles"):
        quart = qjob.finish(df, row)

    n_rows = int(row["__rows"])
    fences = {}
    for c in cols:
        q1, _, q3 = quart[c]
        if q1 is not None:
            iqr = q3 - q1
            fences[c] = (q1 - fold * iqr, q3 + fold * iqr)
    # Pass 3: outlier counts (strict) + distinct counts.
    p3 = []
    for i, c in enumerate(cols):
        v = col(c).cast("double")
        if c in fences:
            lo, hi = fences[c]
            p3.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}"))
        if approx_distinct:
            p3.append(F.approx_count_distinct(col(c)).alias(f"d{i}"))
    with step("profile.pass3 outliers"):
        r3 = df.agg(*p3).first().asDict() if p3 else {}
    if not approx_distinct:
        with step("profile.pass4 distinct"):
            exact = distinct_counts(df, cols)
        r3 |= {f"d{i}": exact[c] for i, c in enumerate(cols)}
    release(df)
    df = src
    out_counts = {c: int(r3[f"o{i}"]) for i, c in enumerate(cols) if c in fences}
    row = {**row.asDict(), **{f"d{i}": r3[f"d{i}"] for i in range(len(cols))}}

    rows = []
    for i, c in enumerate(cols):
        n_missing = int(row[f"m{i}"])
        mean = row[f"a{i}"]
        std = row[f"s{i}"]
        q1, med, q3 = quart[c]
        lo, hi = fences.get(c, (None, None))
        nd = int(row[f"d{i}"])
        rows.append((c, dtype_name(df, c), n_rows, n_missing,
                     (n_missing / n_rows * 100.0) if n_rows else None, nd,
                     row[f"{qjob.prefix}lo{i}"], row[f"{qjob.prefix}hi{i}"],
                     mean, std, row[f"v{i}"], q1, med, q3, lo, hi,
                     out_counts.get(c, 0), nd < LIKELY_CATEGORICAL_BELOW,
                     (std / mean) if (mean not in (None, 0) and std is not None) else None))
    return spark.createDataFrame(rows, NUMERIC_PROFILE_SCHEMA)


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """A3: exact number of distinct non-null values of each column, in one grouped pass.

    Values are compared as they are (integers as 64-bit integers, so large ids
    stay apart).  Cells become (column, value) rows that partial aggregation
    shrinks at once; a distinct aggregate per column would copy whole rows."""
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(cols):
        t = df.schema[c].dataType
        kind = "bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, T.FractionalType) else "string"
        kinds.setdefault(kind, []).append(i)
    out = dict.fromkeys(cols, 0)
    for kind, at in kinds.items():
        cells = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), col(cols[i]).cast(kind).alias("v")) for i in at])).alias("e")).select("e.*")
        for r in cells.where("v is not null").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect():
            out[cols[r["i"]]] = int(r["n"])
    return out


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value) for every cell of ``cols``, value as text (nulls kept)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value"))
        for c in cols])).alias("e")).select("e.column_name", "e.value")


def value_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, count) incl. the null group; partial aggregation
    on the map side, so a hot value costs one row per task, not one task."""
    return _long_values(df, cols).groupBy("column_name", "value").count()


def categorical_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: missing, distinct, mode (ties -> smallest), its count."""
    cols = categorical_columns(df) if cols is None else list(cols)
    freq = value_frequencies(df, cols)
    nn = F.col("value").isNotNull()
    prof = (freq.groupBy("column_name").agg(
        F.sum("count").alias("n_rows"),
        F.coalesce(F.sum(F.when(~nn, F.col("count"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.min_by(F.when(nn, F.col("value")),
                 F.when(nn, F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))))
         .alias("most_frequent"),
        F.max(F.when(nn, F.col("count"))).alias("top_count")))
    types = df.sparkSession.createDataFrame([(c, dtype_name(df, c)) for c in cols],
                                            "column_name string, dtype string")
    return (prof.join(F.broadcast(types), "column_name")  # one row per column: bounded
                .select("column_name", "dtype",
                        F.col("n_rows").cast("long").alias("n_rows"),
                        F.col("n_missing").cast("long").alias("n_missing"),
                        (F.col("n_missing") * 100.0 / F.col("n_rows")).alias("missing_pct"),
                        F.col("n_distinct").cast("long").alias("n_distinct"),
                        "most_frequent",
                        F.col("top_count").cast("long").alias("top_count")))


def value_counts(df: DataFrame, cols: list[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """Top-``top`` non-null values per column by count; ties -> smaller value (A10).

    ``row_number() <= top`` lets Catalyst insert a per-task group limit before
    the shuffle, so no column's full distinct set meets in one task.
    """
    cols = categorical_columns(df) if cols is None else list(cols)
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    return (value_frequencies(df, cols).where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top)
            .select("column_name", "value", F.col("count").cast("long").alias("count"),
                    F.col("rank").cast("long").alias("rank")))


def correlations(df: DataFrame, cols: list[str] | None = None,
                 threshold: float = CORR_THRESHOLD, keep_all: bool = False) -> DataFrame:
    """Pearson r of every numeric pair i<j, pairwise-complete; |r| > threshold.

    One aggregate pass for all pairs (the pairs are columns of a single row).
    """
    spark = df.sparkSession
    cols = numeric_columns(df) if cols is None else list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    schema = "pair string, column_a string, column_b string, correlation double"
    if not pairs:
        return spark.createDataFrame([], schema)
    if len(pairs) > MAX_PAIRS_PER_PASS:     # wide table: Gram blocks, one scan, no pair on the driver
        out = named_correlations(df, cols).drop("n")
        return out if keep_all else out.where(F.abs("correlation") > threshold)
    vals = pair_correlations(df, pairs)
    rows = []
    for k, (a, b) in enumerate(pairs):
        r = vals[k]
        if r is None:
            continue
        if keep_all or abs(r) > threshold:
            rows.append((f"{a}_vs_{b}", a, b, float(r)))
    return spark.createDataFrame(rows, schema)


MAX_PAIRS_PER_PASS = 10    # aggregate expressions of one pass; more pairs go through Gram blocks, a third of the time at 28 pairs


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> list[float | None]:
    """Pearson r per pair (pairwise-complete, as the ``corr`` aggregate), in one scan: as aggregate
    expressions, or, for more than ``MAX_PAIRS_PER_PASS`` pairs, from Gram blocks (``comoments``)."""
    if len(pairs) > MAX_PAIRS_PER_PASS:
        cols = list(dict.fromkeys(c for p in pairs for c in p))
        place = {c: k for k, c in enumerate(cols)}
        got = {(r["i"], r["j"]): r["r"] for r in pairwise_correlations(df, cols).collect()}
        return [got.get(tuple(sorted((place[a], place[b])))) for a, b in pairs]
    row = df.agg(*[F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]).first()
    return [row[f"r{k}"] for k in range(len(pairs))]


def missing_summary(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, missing_pct) for every column in one pass."""
    spark = df.sparkSession
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    n = int(row["__rows"])
    return spark.createDataFrame(
        [(c, int(row[f"m{i}"]), (int(row[f"m{i}"]) * 100.0 / n) if n else None)
         for i, c in enumerate(df.columns)],
        "column_name string, n_missing long, missing_pct double")


def quality_score(missing: DataFrame, numeric: DataFrame, n_rows: int) -> DataFrame:
    """A15 + A19 from the missing summary and the numeric profile (both tiny)."""
    m = missing.agg(F.avg("missing_pct").alias("total_missing"))
    o = numeric.agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).cast("long").alias("total_outliers"))
    comp = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.col("total_missing"), F.lit(0.0)))
    pen = F.least(F.lit(50.0), F.col("total_outliers") * 100.0 / F.lit(n_rows))
    overall = F.greatest(F.lit(0.0), F.least(F.lit(100.0), comp - pen))
    return (m.crossJoin(o)  # 1 x 1 rows
             .select(F.round(overall, 2).alias("overall_score"),
                     F.round(comp, 2).alias("completeness_score"),
                     F.round(F.coalesce(F.col("total_missing"), F.lit(0.0)), 2)
                      .alias("total_missing_percentage"),
                     F.col("total_outliers"),
                     F.round(F.col("total_outliers") * 100.0 / F.lit(n_rows), 2)
                      .alias("outlier_percentage"))
             .withColumn("quality_band", quality_band(F.col("overall_score"))))


def quality_band(score):
    """>= 80 Excellent, >= 60 Good, else Needs attention."""
    return (F.when(score >= 80, "Excellent").when(score >= 60, "Good")
             .otherwise("Needs attention"))


def describe(df: DataFrame) -> DataFrame:
    """describe(include='all') in long form, numeric and text columns together."""
    num = numeric_columns(df)
    cat = categorical_columns(df)
    parts = []
    if num:
        parts.append(numeric_profile(df, num).select(
            "column_name", (F.col("n_rows") - F.col("n_missing")).alias("count"),
            F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq"), "mean", "std", "min",
            F.col("q1").alias("p25"), F.col("median").alias("p50"), F.col("q3").alias("p75"), "max"))
    if cat:
        parts.append(categorical_profile(df, cat).select(
            "column_name", (F.col("n_rows") - F.col("n_missing")).alias("count"),
            F.col("n_distinct").alias("unique"), F.col("most_frequent").alias("top"),
            F.col("top_count").alias("freq"),
            *[F.lit(None).cast("double").alias(a) for a in
              ("mean", "std", "min", "p25", "p50", "p75", "max")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_count(df: DataFrame) -> int:
    return int(df.agg(F.count(F.lit(1))).first()[0])


def profile_report(df: DataFrame, target: str | None = None,
                   learning_type: str = "Classification") -> dict[str, DataFrame]:
    """``_build_report``: the profile tables of the feature columns (target excluded)."""
    feats = df.drop(target) if target else df
    threshold = CORR_THRESHOLD_CLUSTERING if learning_type == "Clustering" else CORR_THRESHOLD
    n = row_count(feats)
    num = numeric_profile(feats)
    miss = missing_summary(feats)
    return {
        "numeric": num,
        "categorical": categorical_profile(feats),
        "value_counts": value_counts(feats),
        "correlations": correlations(feats, threshold=threshold),
        "missing": miss,
        "quality": quality_score(miss, num, n),
    }


SAMPLE_VALUES = 5        # fixed value: distinct sample values reported per column


def sample_values(df: DataFrame, cols: list[str] | None = None, n: int = SAMPLE_VALUES) -> DataFrame:
    """A4: the ``n`` smallest distinct non-null values per column, as text
    (rows have no order, so "first seen" becomes "smallest").  Equal values
    share a rank, so ``rank() <= n`` keeps few rows of each task before the
    shuffle; only those are made distinct."""
    cols = list(df.columns) if cols is None else list(cols)
    num = set(numeric_columns(df))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 (col(c).cast("double") if c in num else F.lit(None).cast("double")).alias("num"),
                 col(c).cast("string").alias("value")) for c in cols])).alias("e")).select("e.*")
    w = Window.partitionBy("column_name").orderBy(F.col("num").asc_nulls_last(), F.col("value"))
    few = (long.where(F.col("value").isNotNull()).withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= n))
    d = few.select("column_name", "num", "value").distinct()
    return (d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
             .select("column_name", F.col("rank").cast("int").alias("rank"), "value"))


def memory_estimate_mb(df: DataFrame) -> float:
    """A16 (estimate): 8 bytes per numeric / temporal / boolean cell plus the
    UTF-8 length of every text cell, in MiB; one aggregate pass."""
    parts = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            parts.append(F.coalesce(F.sum(F.octet_length(col(f.name))), F.lit(0)))
        else:
            parts.append(F.count(F.lit(1)) * F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return float(df.agg(total.alias("b")).first()["b"]) / (1024.0 ** 2)


def dataset_summary(df: DataFrame) -> dict:
    """``dataset_summary``: per-column table (dtype, missing, distinct, sample
    values, numeric stats or mode) plus rows, column count and memory
    estimate.  A handful of jobs whatever the width."""
    num = numeric_columns(df)
    cat = [c for c in df.columns if c not in num]
    out = {"rows": row_count(df), "columns_count": len(df.columns),
           "memory_usage_mb": memory_estimate_mb(df),
           "numeric": numeric_profile(df, num) if num else None,
           "categorical": categorical_profile(df, categorical_columns(df)) if categorical_columns(df) else None,
           "value_counts": value_counts(df, categorical_columns(df)) if categorical_columns(df) else None,
           "sample_values": sample_values(df)}
    del cat
    return out


def insights(missing: DataFrame, numeric: DataFrame, corr: DataFrame,
             n_missing: int = 10, n_outliers: int = 10, n_corr: int = 8) -> DataFrame:
    """Columns with the most missing values (top 10), with the most
    outliers (top 10) and the strongest correlations (top 8); ties by name."""
    w_m = Window.orderBy(F.desc("value"), F.asc("column_name"))
    m = (missing.where(F.col("n_missing") > 0)
                .select(F.lit("missing").alias("list_name"), "column_name",
                        F.col("missing_pct").alias("value")))
    o = (numeric.where(F.col("n_outliers") > 0)
                .select(F.lit("outliers").alias("list_name"), "column_name",
                        F.col("n_outliers").cast("double").alias("value")))
    c = corr.select(F.lit("correlations").alias("list_name"), F.col("pair").alias("column_name"),
                    F.abs("correlation").alias("value"))
    parts = []
    for df_, k in ((m, n_missing), (o, n_outliers), (c, n_corr)):
        parts.append(df_.withColumn("rank", F.row_number().over(w_m)).where(F.col("rank") <= k))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("list_name", F.col("rank").cast("int").alias("rank"), "column_name", "value")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class (partial aggregation)."""
    return df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
