"""Categorical encoders: one-hot, frequency, label, target.

Fitted level maps are small tables.  They are joined back with a broadcast
join only when their row count (known from the fit) is under
``BROADCAST_LEVELS``; larger maps use a shuffle join, with AQE splitting a
hot level's partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabforge.functions.columns import col, q
from tabforge.functions.scalar import as_level

BROADCAST_LEVELS = 200_000      # rows of a level map that may be broadcast
INLINE_LEVELS = 100_000         # rows kept inline in the fitted JSON state


@dataclass
class LevelMap:
    """level -> value for one column (frequency share, label index, target mean)."""
    column: str
    value_type: str                               # "double" | "bigint"
    rows: list[tuple[str, float]] | None = None   # inline when small
    path: str | None = None                       # parquet in the shared folder when large
    n_levels: int = 0
    default: float | None = None                  # value for an unseen level

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.rows is not None:
            return spark.createDataFrame(self.rows, f"level string, value {self.value_type}")
        return spark.read.parquet(self.path)

    def to_json(self) -> dict:
        return {"column": self.column, "value_type": self.value_type, "rows": self.rows,
                "path": self.path, "n_levels": self.n_levels, "default": self.default}

    @classmethod
    def from_json(cls, d: dict) -> LevelMap:
        rows = [tuple(r) for r in d["rows"]] if d.get("rows") is not None else None
        return cls(d["column"], d["value_type"], rows, d.get("path"), d["n_levels"], d.get("default"))


def _materialise(spark: SparkSession, column: str, table: DataFrame, value_type: str,
                 default, store_dir: str | None) -> LevelMap:
    n = int(table.count())
    if n <= INLINE_LEVELS:
        rows = [(r["level"], r["value"]) for r in table.collect()]  # bounded by INLINE_LEVELS
        return LevelMap(column, value_type, rows, None, n, default)
    if store_dir is None:
        from tabforge.session import checkpoint_dir
        store_dir = checkpoint_dir(spark)
    import uuid
    path = f"{store_dir.rstrip('/')}/levels-{uuid.uuid4().hex}"
    table.write.mode("overwrite").parquet(path)
    return LevelMap(column, value_type, None, path, n, default)


def join_levels(df: DataFrame, maps: list[LevelMap], out_names: dict[str, str] | None = None,
                replace: bool = True) -> DataFrame:
    """Replace (or add) each mapped column by its looked-up value."""
    spark = df.sparkSession
    out_names = out_names or {}
    cur = df
    for i, m in enumerate(maps):
        key, val = f"__k{i}", f"__v{i}"
        t = m.frame(spark).select(F.col("level").alias(key), F.col("value").alias(val))
        if m.n_levels <= BROADCAST_LEVELS:
            t = F.broadcast(t)
        cur = cur.withColumn(key, as_level(m.column)).join(t, on=key, how="left").drop(key)
        looked = F.col(val) if m.default is None else F.coalesce(F.col(val), F.lit(m.default))
        name = out_names.get(m.column, m.column)
        if replace and name == m.column:
            cur = cur.select(*[looked.cast(m.value_type).alias(c) if c == m.column else col(c)
                               for c in cur.columns if c != val])
        else:
            cur = cur.withColumn(name, looked.cast(m.value_type)).drop(val)
    return cur


# ------------------------------------------------------------------ one-hot
def fit_onehot(df: DataFrame, cols: list[str], max_levels: int | None = None) -> dict[str, list[str]]:
    """Sorted levels of each column (text, null -> 'missing'); one job.

    Every level becomes a column, so the levels are as many as the plan can
    hold; ``max_levels`` makes a column with more of them an error (asked of
    the counts, before the levels are read)."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), as_level(c).alias("level")) for c in cols])).alias("e"))
    grouped = long.select("e.*").distinct()
    if max_levels is not None:
        n = {r["column_name"]: r["n"] for r in grouped.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        if too_many := {c: k for c, k in n.items() if k > max_levels}:
            raise ValueError(f"more than {max_levels} levels: {too_many}; frequency or label encoding suits these columns")
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in grouped.collect():
        levels[r["column_name"]].append(r["level"])
    return {c: sorted(v) for c, v in levels.items()}


def apply_onehot(df: DataFrame, levels: dict[str, list[str]], drop_last: bool = False) -> DataFrame:
    """Original column dropped, one int column ``{col}_{level}`` per level
    appended; an unseen level gives all zeros."""
    if not levels:
        return df
    keep = [col(c) for c in df.columns if c not in levels]
    new = []
    for c, lv in levels.items():
        use = lv[:-1] if drop_last and len(lv) > 1 else lv
        x = as_level(c)
        new += [(x == F.lit(v)).cast("int").alias(f"{c}_{v}") for v in use]
    return df.select(*keep, *new)


# ------------------------------------------------------------------ shared level table
def _levels(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """(column_name, level, n, n_y, sum_y) for every level of every column in
    one grouped pass (partial aggregation: a hot level costs one row per task)."""
    y = col(target).cast("double") if target else F.lit(None).cast("double")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), as_level(c).alias("level")) for c in cols])).alias("e"),
        y.alias("__y")).select("e.*", "__y")
    return long.groupBy("column_name", "level").agg(
        F.count(F.lit(1)).alias("n"), F.count("__y").alias("n_y"), F.sum("__y").alias("sum_y"))


def _fit_maps(df: DataFrame, cols: list[str], value: str, value_type: str, default,
              store_dir: str | None, target: str | None = None, sort_index: bool = False,
              extra: dict | None = None) -> list[LevelMap]:
    """Level maps for many columns from one level table: sizes in one small
    job, all inline maps in one collect, large maps written per column."""
    from pyspark import StorageLevel
    spark = df.sparkSession
    lv = _levels(df, cols, target).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["column_name"]: (int(r["k"]), int(r["rows"])) for r in
             lv.groupBy("column_name").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).collect()}
    expr = F.expr(value) if isinstance(value, str) else value
    small = [c for c in cols if sizes.get(c, (0, 0))[0] <= INLINE_LEVELS]
    rows: dict[str, list] = {c: [] for c in small}
    if small:
        ctx = {c: sizes[c][1] for c in small}
        n_lit = F.create_map(*[x for c in small for x in (F.lit(c), F.lit(float(ctx[c])))])
        got = (lv.where(F.col("column_name").isin(small))
                 .select("column_name", "level", expr.alias("value"), F.element_at(n_lit, F.col("column_name"))
                         .alias("__rows"), "n", "n_y", "sum_y").collect())   # <= INLINE_LEVELS per column
        for r in got:
            rows[r["column_name"]].append(r)
    out = []
    for c in cols:
        k, n_rows = sizes.get(c, (0, 0))
        if c in small:
            if sort_index:
                pairs = [(lvl, i) for i, lvl in enumerate(sorted(r["level"] for r in rows[c]))]
            else:
                pairs = [(r["level"], _finish(r, value_type, n_rows, extra)) for r in rows[c]]
            out.append(LevelMap(c, value_type, pairs, None, k, default))
            continue
        one = lv.where(F.col("column_name") == c)
        if sort_index:
            table = (one.select("level").orderBy("level").rdd.zipWithIndex()
                     .map(lambda p: (p[0]["level"], int(p[1]))).toDF("level string, value bigint"))
        else:
            table = one.select("level", _finish_col(value_type, n_rows, extra).alias("value"))
        out.append(_materialise(spark, c, table, value_type, default, store_dir))
    lv.unpersist()
    return out


def _finish(r, value_type: str, n_rows: int, extra: dict | None):
    if extra and extra.get("kind") == "target":
        m, g = extra["smoothing"], extra["mean"]
        mu = (r["sum_y"] / r["n_y"]) if r["n_y"] else g
        return (r["n_y"] * mu + m * g) / (r["n_y"] + m)
    return r["n"] / float(n_rows)


def _finish_col(value_type: str, n_rows: int, extra: dict | None):
    if extra and extra.get("kind") == "target":
        m, g = extra["smoothing"], extra["mean"]
        mu = F.coalesce(F.col("sum_y") / F.col("n_y"), F.lit(g))
        return (F.col("n_y") * mu + F.lit(m * g)) / (F.col("n_y") + F.lit(m))
    return F.col("n") / F.lit(float(n_rows))


# ------------------------------------------------------------------ frequency
def fit_frequency(df: DataFrame, cols: list[str], store_dir: str | None = None) -> list[LevelMap]:
    """Level -> share of rows; unseen -> 0."""
    if not cols:
        return []
    return _fit_maps(df, cols, "n", "double", 0.0, store_dir)


# ------------------------------------------------------------------ label
def fit_label(df: DataFrame, cols: list[str], store_dir: str | None = None) -> list[LevelMap]:
    """R12 'label': index of the level in sorted order (0-based); unseen -> -1.

    Small level sets are sorted on the driver; large ones are range-sorted and
    numbered with ``zipWithIndex`` (no global window, so no single task holds
    all levels)."""
    if not cols:
        return []
    return _fit_maps(df, cols, "n", "bigint", -1, store_dir, sort_index=True)


# ------------------------------------------------------------------ target
def fit_target(df: DataFrame, cols: list[str], target: str, smoothing: float = 10.0,
               store_dir: str | None = None) -> list[LevelMap]:
    """R12 'target': smoothed mean of the target per level,
    (n_l * mean_l + m * mean) / (n_l + m); unseen -> the global mean."""
    if not cols:
        return []
    g = df.agg(F.avg(col(target).cast("double")).alias("m")).first()["m"]
    return _fit_maps(df, cols, "n", "double", g, store_dir, target=target,
                     extra={"kind": "target", "smoothing": smoothing, "mean": g})


def target_out_of_fold(df: DataFrame, cols: list[str], target: str, folds: int, smoothing: float = 10.0) -> DataFrame:
    """R12 for training rows: each column becomes the smoothed target mean of its level over the rows of
    the other folds (a level that only occurs in the own fold gets their overall mean).

    Folds are a hash of the whole row.  Sums per (column, level, fold) are one
    grouped pass; a row's value is the level's total less its own fold's."""
    own = "__fold"
    rows = df.withColumn(own, F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(folds)).cast("int"))
    y = col(target).cast("double")
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), as_level(c).alias("level"))
                                            for c in cols])).alias("e"), own, y.alias("__y")).select("e.*", own, "__y")
    parts = cells.groupBy("column_name", "level", own).agg(F.count("__y").alias("n"), F.sum("__y").alias("s"))
    level = Window.partitionBy("column_name", "level")  # at most ``folds`` rows
    rest = parts.select("column_name", "level", own, (F.sum("n").over(level) - F.col("n")).alias("n"),
                        (F.coalesce(F.sum("s").over(level), F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("s"))
    total = rows.groupBy(own).agg(F.count(y).alias("n"), F.sum(y).alias("s")).collect()  # one row per fold
    n, s = sum(r["n"] for r in total), sum(r["s"] or 0.0 for r in total)
    means = {r[own]: (s - (r["s"] or 0.0)) / (n - r["n"]) if n > r["n"] else s / max(n, 1) for r in total}
    mean = F.element_at(F.create_map(*[F.lit(x) for kv in means.items() for x in kv]), F.col(own)) if means else F.lit(0.0)
    value = (F.col("s") + F.lit(smoothing) * mean) / (F.col("n") + F.lit(smoothing)) if smoothing else \
        F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(mean)
    rest = rest.select("column_name", "level", own, value.alias("value"))
    for c in cols:
        one = rest.where(F.col("column_name") == c).select(F.col("level").alias("__l"), F.col(own).alias("__f"),
                                                           F.col("value").alias("__v"))
        rows = rows.join(one, (as_level(c) == F.col("__l")) & (F.col(own) == F.col("__f")), "left").select(
            *[F.col("__v").alias(x) if x == c else col(x) for x in rows.columns])
    return rows.drop(own)


__all__ = ["LevelMap", "fit_onehot", "apply_onehot", "fit_frequency", "fit_label", "fit_target",
           "join_levels", "target_out_of_fold", "q"]
