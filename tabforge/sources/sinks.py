"""Sinks (S10-S14): prepared tables, reports, fitted state, prediction
history, artifact manifest.  Everything is written through Spark, so a path
may be any filesystem the cluster reads (the shared checkpoint folder in
tests)."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.scalar import json_safe


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                **options) -> str:
    """Features / target / combined (= the un-split frame) as CSV or Parquet."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)
    return path


def json_clean(obj):
    """NaN / inf -> None recursively (driver-side, for small reports)."""
    if isinstance(obj, float):
        return None if math.isnan(obj) or math.isinf(obj) else obj
    if isinstance(obj, dict):
        return {str(k): json_clean(v) for k, v in obj.items()}
    if isinstance(obj, (list, tuple)):
        return [json_clean(v) for v in obj]
    return obj


def write_report(df: DataFrame, path: str) -> str:
    """A report table as JSON lines (a folder of part files, written by
    every task: no single-task funnel), doubles rounded and NaN/inf nulled."""
    out = df.select(*[json_safe(c).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
                      for c, t in df.dtypes])
    out.write.mode("overwrite").json(path)
    return path


def write_json(spark: SparkSession, obj, path: str) -> str:
    spark.createDataFrame([(json.dumps(json_clean(obj)),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)
    return path


def read_json_text(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()["value"])


def append_history(df: DataFrame, path: str) -> str:
    """Append prediction records with a timestamp."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
    return path


def history_last(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The last ``n`` records (a top-n, not a full sort); of records logged at the same time
    those with the largest values, column by column."""
    log = spark.read.parquet(path)
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in sorted(log.columns) if c != "logged_at"]
    return log.orderBy(F.col("logged_at").desc(), *rest).limit(n)


def history_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Which outputs exist (one row per artifact)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name, p in paths.items():
        hp = jvm.org.apache.hadoop.fs.Path(p)
        rows.append((name, p, bool(hp.getFileSystem(conf).exists(hp))))
    return spark.createDataFrame(rows, "artifact string, path string, exists boolean")
