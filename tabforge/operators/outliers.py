"""Outlier operators: winsorising (iqr / gaussian / mad / quantiles), fixed
clip bounds, row removal (R6-R9, R24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import col
from tabforge.functions.quantiles import exact_quantiles
from tabforge.functions.scalar import clip
from tabforge.operators.impute import holds

CAPPING_METHODS = ("iqr", "gaussian", "mad", "quantiles")
# Fixed values of the eligibility rule: few distinct values and a low ratio.
LOW_DISTINCT = 10
LOW_RATIO = 0.05


def eligible(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    """Skip std = 0, and skip <= 10 distinct with distinct/rows < 0.05."""
    if not cols:
        return [], []
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    n = int(row["n"])
    # the rule asks for at most 10 distinct values: only columns near that are counted exactly,
    # from one grouped table (a distinct per column would copy every row once per column)
    near = [c for i, c in enumerate(cols) if row[f"d{i}"] <= 4 * LOW_DISTINCT]
    exact = {}
    if near:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("v")) for c in near])).alias("e")).select("e.*")
        exact = {r["name"]: int(r["n"]) for r in long.where("v is not null").distinct()
                 .groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    ok, skipped = [], []
    for i, c in enumerate(cols):
        sd, nd = row[f"s{i}"], exact.get(c, 0) if c in near else int(row[f"d{i}"])
        if sd is None or sd == 0 or (nd <= LOW_DISTINCT and (nd / n if n else 0) < LOW_RATIO):
            skipped.append(c)
        else:
            ok.append(c)
    return ok, skipped


def fit_fences(df: DataFrame, cols: list[str], method: str = "iqr", fold: float = 1.5
               ) -> dict[str, tuple[float | None, float | None]]:
    """(low, high) caps per column."""
    if method not in CAPPING_METHODS:
        raise ValueError(f"unknown capping method {method!r}; use {CAPPING_METHODS}")
    if not cols:
        return {}
    out = {}
    if method == "iqr":
        qs = exact_quantiles(df, {c: [0.25, 0.75] for c in cols})
        for c in cols:
            q1, q3 = qs[c]
            out[c] = (None, None) if q1 is None else (q1 - fold * (q3 - q1), q3 + fold * (q3 - q1))
    elif method == "gaussian":
        row = df.agg(*[F.avg(col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}")
                       for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            m, s = row[f"a{i}"], row[f"s{i}"]
            out[c] = (None, None) if m is None else (m - fold * (s or 0.0), m + fold * (s or 0.0))
    elif method == "mad":
        med = exact_quantiles(df, {c: [0.5] for c in cols})
        dev = df.select(*[F.abs(col(c).cast("double") - F.lit(med[c][0])).alias(c)
                          for c in cols if med[c][0] is not None])
        mad = exact_quantiles(dev, {c: [0.5] for c in dev.columns})
        for c in cols:
            m = med[c][0]
            out[c] = (None, None) if m is None else (m - fold * mad[c][0], m + fold * mad[c][0])
    else:  # quantiles: fold is the tail share, e.g. 0.05 -> [p5, p95]
        qs = exact_quantiles(df, {c: [fold, 1.0 - fold] for c in cols})
        for c in cols:
            out[c] = tuple(qs[c])
    return out


def apply_clip(df: DataFrame, fences: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """F9 on each fenced column, in place.  The column keeps its type where
    that can hold both fences, else it becomes double."""
    if not fences:
        return df

    def clipped(c: str):
        if c not in fences:
            return col(c)
        t, x = df.schema[c].dataType, clip(c, *fences[c])
        return (x.cast(t) if all(holds(t, v) for v in fences[c]) else x).alias(c)

    return df.select(*[clipped(c) for c in df.columns])


def remove_outside(df: DataFrame, fences: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """R9 'remove': keep rows inside every fence (nulls kept); fit time only."""
    cond = F.lit(True)
    for c, (lo, hi) in fences.items():
        x = col(c).cast("double")
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (x >= F.lit(lo))
        if hi is not None:
            inside = inside & (x <= F.lit(hi))
        cond = cond & (x.isNull() | inside)
    return df.where(cond)


def count_outside(df: DataFrame, fences: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Strict < low or > high (a value on the fence is not counted)."""
    if not fences:
        return {}
    row = df.agg(*[F.count_if((col(c).cast("double") < F.lit(lo)) | (col(c).cast("double") > F.lit(hi)))
                   .alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(fences.items())]).first()
    return {c: int(row[f"o{i}"]) for i, c in enumerate(fences)}
