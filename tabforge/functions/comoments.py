"""Pairwise co-moments of many columns in one scan (A14 for wide tables).

Per Arrow batch, the values (missing ones as 0, centred by the batch's mean)
and their presence make matrices X and M; the products M'M, X'M, (X^2)'M and
X'X are, for every pair of columns, the count, sums and products over the rows
where both are present.  They become (n, means, centred squares, centred
product), which merge exactly and stably, batch by batch in a task and then by
block of columns in a second stage.  A task holds six numbers a pair of one
column block with all the columns at a time it works on, and the pairs leave
the second stage as rows; the driver sees none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import col

BLOCK = 128             # columns of a block: a pair of blocks is one key of the second stage
ROWS = 4096             # rows that are multiplied at once
# a centred square below this share of n mean^2 is the rounding of a constant
CONSTANT = 1e-24
PARTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


def _batch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Six matrices (rows: columns of x, columns: those of y) of a batch; missing values are NaN."""
    def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = ~np.isnan(v)
        n = np.maximum(there.sum(axis=0), 1)
        # the mean of equal values may differ from them in the last digit
        low, high = np.nanmin(np.where(there, v, np.inf), axis=0), np.nanmax(np.where(there, v, -np.inf), axis=0)
        shift = np.where(low >= high, np.where(np.isfinite(low), low, 0.0), np.where(there, v, 0).sum(axis=0) / n)
        return np.where(there, v - shift, 0.0), there.astype(np.float64), shift

    x0, mx, sx = centred(x)
    y0, my, sy = centred(y)
    n = mx.T @ my
    safe = np.maximum(n, 1)
    ax, ay = x0.T @ my / safe, mx.T @ y0 / safe  # means within the pair, from the shifts
    cxx = np.maximum((x0 * x0).T @ my - n * ax * ax, 0)
    cyy = np.maximum(mx.T @ (y0 * y0) - n * ay * ay, 0)
    return np.stack([n, ax + sx[:, None], ay + sy[None, :], cxx, cyy, x0.T @ y0 - n * ax * ay])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both parts as one; a part with no rows of a pair leaves the other's numbers."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = np.where(a[0] * b[0] > 0, b[1] - a[1], 0.0), np.where(a[0] * b[0] > 0, b[2] - a[2], 0.0)
    w = a[0] * share
    first = a[0] > 0
    return np.stack([n, np.where(first, a[1] + dx * share, b[1]), np.where(first, a[2] + dy * share, b[2]),
                     a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def correlation_of(m: np.ndarray) -> np.ndarray:
    """Pearson r from the six matrices; NaN where fewer than two rows or a constant column leave it undefined."""
    n, mx, my, cxx, cyy, cxy = m
    with np.errstate(invalid="ignore", divide="ignore"):
        r = cxy / np.sqrt(cxx * cyy)
        return np.where((n < 2) | (cxx <= CONSTANT * n * mx * mx) | (cyy <= CONSTANT * n * my * my), np.nan, np.clip(r, -1, 1))


def pairwise_correlations(df: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """(i, j, n, r) of every pair i < j of ``cols`` (their places), pairwise-complete: one scan of ``df``.

    Null and NaN are missing; r is null where it is undefined.  No rows of ``df`` give no pairs.
    """
    d = len(cols)
    starts = list(range(0, d, block))
    keys = [(a, b) for a in range(len(starts)) for b in range(a, len(starts))]
    data = df.select(*[col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                for key in keys:
                    i, j = (starts[k] for k in key)
                    m = _batch(x[:, i:i + block], x[:, j:j + block])
                    total[key] = _merged(total[key], m) if key in total else m
        for (i, j), m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([m.tobytes()])],
                                             ["bi", "bj", "m"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, data_ in zip(*(b.column(c).to_pylist() for c in ("bi", "bj", "m")), strict=True):
                wide = min(block, d - starts[i])
                m = np.frombuffer(data_, np.float64).reshape(6, wide, -1)
                total[i, j] = _merged(total[i, j], m) if (i, j) in total else m
        for (bi, bj), m in total.items():
            i, j = (starts[bi] + np.arange(m.shape[1]))[:, None], (starts[bj] + np.arange(m.shape[2]))[None, :]
            upper = i < j
            i, j = np.broadcast_to(i, upper.shape)[upper], np.broadcast_to(j, upper.shape)[upper]
            r = correlation_of(m)[upper]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(m[0][upper].astype(np.int64)), pa.array(r, mask=np.isnan(r))],
                                             ["i", "j", "n", "r"])

    parts = data.mapInArrow(partial, "bi int, bj int, m binary")
    return (parts.repartition(min(len(keys), 256), "bi", "bj").mapInArrow(finish, "i int, j int, n long, r double"))


def named_correlations(df: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """(pair, column_a, column_b, correlation, n) of every pair for which r is defined."""
    names = F.array(*[F.lit(c) for c in cols])
    out = pairwise_correlations(df, cols, block).where(F.col("r").isNotNull())
    a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    return out.select(F.concat(a, F.lit("_vs_"), b).alias("pair"), a.alias("column_a"), b.alias("column_b"),
                      F.col("r").alias("correlation"), "n")
