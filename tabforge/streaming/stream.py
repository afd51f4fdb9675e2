"""Structured Streaming operators.

* ``score_stream`` (X1): the fitted preparation is a row-wise projection
  chain plus broadcast joins of small level maps, and MLlib models transform
  row-wise, so batch scoring code runs unchanged on ``readStream`` input.
* ``prediction_log`` (X2): append-only Parquet sink with a checkpoint in the
  shared folder (exactly-once file sink).
* ``windowed_profile`` (X3): per tumbling event-time window, row count,
  missing count, mean, min, max and sample sd of a value column.  Written in
  append mode (``closed_windows``) a window comes out once the watermark has
  passed its end, its state goes, and rows that come later are dropped; in
  complete mode (``run_to_memory``, for small results) all state stays.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tabforge.functions import sketches
from tabforge.functions.columns import col
from tabforge.session import checkpoint_dir
from tabforge.sources.loader import is_folder


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(_as_glob(spark, path))


def _as_glob(spark: SparkSession, path: str) -> str:
    """The file source takes a non-glob path as partition base directory; a
    single file is therefore given as a glob that matches just itself."""
    if any(ch in path for ch in "*?[{") or is_folder(spark, path):
        return path
    return f"{path[:-1]}[{path[-1]}]"


def windowed_profile(df: DataFrame, ts: str, value: str, window: str = "1 day",
                     watermark: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """X3 (also works on a batch frame: the batch twin)."""
    by = by or []
    ts_type = df.schema[ts].dataType.simpleString()
    w = df
    if df.isStreaming:
        # watermarks need TIMESTAMP (session time zone), not TIMESTAMP_NTZ
        w = w.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, watermark)
    v = col(value).cast("double")
    return (w.groupBy(F.window(col(ts), window).alias("w"), *[col(b) for b in by])
             .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_missing"),
                  F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
                  F.stddev_samp(v).alias("std"))
             .select(F.col("w.start").cast(ts_type).alias("window_start"),
                     F.col("w.end").cast(ts_type).alias("window_end"),
                     *by, "n_rows", "n_missing", "mean", "min", "max", "std"))


def windowed_quantiles(df: DataFrame, ts: str, value: str, window: str = "1 day", watermark: str = "1 day",
                       by: list[str] | None = None, ranks: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = 2048) -> DataFrame:
    """X3 with A5 and A7: quantiles per event-time window, also on a stream.

    The state of a window is a KLL sketch (some k numbers, whatever the window holds), merged across tasks and
    batches, so append mode with a watermark works as for ``windowed_profile``.  A reported value's rank is within
    ``sketches.rank_error(k)`` of the wanted one; a window of at most ``k`` values is exact.  Null and NaN are
    missing; a window without values has null quantiles.
    """
    by = by or []
    ts_type = df.schema[ts].dataType.simpleString()
    w = df
    if df.isStreaming:
        w = w.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, watermark)
    v = sketches.present(col(value))
    out = (w.groupBy(F.window(col(ts), window).alias("w"), *[col(b) for b in by])
           .agg(F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_values"), F.kll_sketch_agg_double(v, k).alias("sketch")))
    at = sketches.quantiles_of(F.col("sketch"), ranks)
    return out.select(F.col("w.start").cast(ts_type).alias("window_start"), F.col("w.end").cast(ts_type).alias("window_end"),
                      *by, "n_rows", "n_values",
                      *[F.get(at, F.lit(i)).alias(f"q{round(r * 100):02d}") for i, r in enumerate(ranks)])


def score_stream(stream: DataFrame, prep, model, keep: list[str] | None = None) -> DataFrame:
    """Same expressions as batch scoring."""
    from tabforge.operators.models import score
    return score(stream, prep, model, keep=keep)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def prediction_log(scored: DataFrame, path: str, checkpoint: str | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """Append each scored row with its arrival time to a Parquet log."""
    spark = scored.sparkSession
    checkpoint = checkpoint or scratch(spark, "prediction-log-ckpt")
    w = (scored.withColumn("logged_at", F.current_timestamp())
               .writeStream.format("parquet").outputMode("append")
               .option("path", path).option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def logged_once(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log that ``append_once`` wrote."""
    return spark.read.parquet(path)


def append_once(scored: DataFrame, path: str, run: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """An idempotent log.  Each micro-batch of ``run`` is a folder (run, batch) of its own, written whole by
    overwriting that folder alone: a batch that is replayed after a failure, or under a restored checkpoint, replaces
    itself, so its records are there once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumns({"logged_at": F.current_timestamp(), "run": F.lit(run), "batch": F.lit(batch_id)})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(path))

    w = scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


class ContractBroken(ValueError):
    """A stream's prepared rows broke the contract: rows were lost or made, or a feature holds nulls."""


class ContractListener(StreamingQueryListener):
    """Ends a query whose observed counts break R22's contract; ``broken`` says how."""

    def __init__(self, name: str, features: list[str]):
        self.name, self.features, self.broken, self.done = name, features, None, False

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.done = True

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics
        before, after = seen.get(f"{self.name}-in"), seen.get(f"{self.name}-out")
        if before is None or after is None:
            return
        holes = {c: after[f"n{i}"] for i, c in enumerate(self.features) if after[f"n{i}"]}
        if before["rows"] != after["rows"]:
            self.broken = self.broken or f"{before['rows']} rows became {after['rows']}"
        elif holes:
            self.broken = self.broken or f"prepared features hold nulls: {holes}"


def checked_stream(stream: DataFrame, transform, features: list[str], start, poll: float = 0.2) -> StreamingQuery:
    """R22 on a stream: ``transform(stream)`` is started by ``start(frame)`` and counted on the way, batch by batch,
    without a pass of its own; the first batch that breaks the contract stops the query and raises.  Returns the
    query once it has ended by itself (an available-now query) in good order."""
    spark, name = stream.sparkSession, f"contract-{uuid.uuid4().hex}"
    listener = ContractListener(name, features)
    out = transform(stream.observe(f"{name}-in", F.count(F.lit(1)).alias("rows")))
    out = out.observe(f"{name}-out", F.count(F.lit(1)).alias("rows"),
                      *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(features)])
    spark.streams.addListener(listener)
    try:
        query = start(out)
        while not query.awaitTermination(poll):
            if listener.broken:
                query.stop()
        for _ in range(50):     # events of the last batch come after its end
            if listener.broken or listener.done:
                break
            time.sleep(poll / 10)
    finally:
        spark.streams.removeListener(listener)
    if listener.broken:
        raise ContractBroken(listener.broken)
    return query


def closed_windows(df: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """X3 in append mode: drive a windowed stream over what is there now into a Parquet table and return
    that table.  Windows still open stay in the checkpoint for the next call with it."""
    spark = df.sparkSession
    q = (df.writeStream.format("parquet").outputMode("append").option("path", path)
           .option("checkpointLocation", checkpoint or scratch(spark, "windows-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_to_memory(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive a streaming frame to completion into a memory sink (tests and
    registered queries) and return the result as a batch frame."""
    spark = df.sparkSession
    name = f"tf_{uuid.uuid4().hex[:12]}"
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", scratch(spark, "memory-ckpt"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.table(name)
