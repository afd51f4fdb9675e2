"""Embedding whitening by shifted CholeskyQR.

Vectors become fixed-point: ``x = floor(64 c) + 1000000`` for every entry.
The fit list holds each distinct x-vector once.  Its centred rows A (from the
exact integers n x - S, divided by n) are orthogonalised in passes over the
fit list: a pass sums the Gram matrix of A R1^-1 ... Rk^-1, each block of rows
solved against the triangular factors in turn, and its Cholesky factor is the
next R; the first pass adds the shift 11 (n d + d (d + 1)) u trace(G), and so
does any later one whose factor does not exist.  R = Rk ... R1 then has the
singular values and right singular vectors of A (the Gram matrix left over by
the last pass takes part, so columns without variance do no harm): the
components are the right singular vectors and e = s^2 / n.

A task sends one d x d matrix, added up by rows in a second stage; the driver
holds d x d numbers, never rows.  ``MOST_DIMENSIONS`` bounds d.

Cases with a defined result: null and empty vectors, vectors with null or
non-finite entries, with entries whose 64-fold passes 2^62, and vectors of
another length than the most frequent one (ties: the longer) take no part;
null and repeated ids are kept, each row by itself; a component without
variance (singular value below 1e-12 of the largest) has no whitened value
and is left out, so equal vectors alone, or an empty table, give an empty
result; a deviation beyond a long is null; only the id and the vector column
are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

# The fixed-point form of an entry.
SCALE, OFFSET = 64, 1_000_000

MOST_DIMENSIONS = 4096
MOST_PASSES = 4
ORTHOGONAL = 1e-12  # no further pass once the Gram matrix is this near to the identity
NO_VARIANCE = 1e-12
UNIT = 2.0 ** -53


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: sizes, exact sums, components (columns), eigenvalues, and how well it whitens."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def fixed_point(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``x`` of the rows that take part."""
    v = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    most = float(2 ** 62)
    v = v.where(F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(SCALE * c) < most)), F.lit(False)))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; at most {MOST_DIMENSIONS} are whitened")
    return v.where(F.size("v") == d).select("id", _fixed(F.col("v")).alias("x"))


def _fixed(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(SCALE * c).cast("long") + F.lit(OFFSET).cast("long"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _numerators(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: as longs where they fit, else as Python integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < 2 ** 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _numerators(x, n, sums).astype(np.float64) / n


def _solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 for an upper triangular r, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows of the fit list and the exact sum of each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & (2 ** 31 - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(high)), pa.int32()), pa.array(np.full(len(high), n), pa.int64()),
                 pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["i", "n", "high", "low"])

    parts = fit.mapInArrow(tidy(add), "i int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low")).collect()
    got.sort(key=lambda r: r["i"])
    return (got[0]["n"] if got else 0), tuple((int(r["high"]) << 31) + int(r["low"]) for r in got)


def _summed(fit: DataFrame, block, d: int) -> np.ndarray:
    """Sum over the fit list of ``block(x)``, a matrix of d rows for a block of vectors."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = block(_matrix(b.column("x")))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()),
                                              pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), _matrix(b.column("row")), strict=True):
                rows[i] = rows[i] + row if i in rows else row
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()),
                                              pa.array(list(rows.values()), pa.list_(pa.float64()))], ["i", "row"])

    schema = "i int, row array<double>"
    parts = fit.mapInArrow(tidy(partial), schema).repartition(min(d, 64), "i").mapInArrow(tidy(add), schema)
    return np.array([r["row"] for r in sorted(parts.collect(), key=lambda r: r["i"])])


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular factor of a Gram matrix, shifted at once or where it has none without."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * UNIT * np.trace(gram) * np.eye(d)
    try:
        return np.linalg.cholesky(gram + shift if shifted else gram).T
    except np.linalg.LinAlgError:
        if shifted:
            raise
        return np.linalg.cholesky(gram + shift).T


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Whitening of the ``x`` of ``rows``, every distinct one once; None where nothing varies."""
    vectors = written(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(vectors)
    if not n:
        return None
    d, factors = len(sums), []

    def gram(x: np.ndarray) -> np.ndarray:
        q = _centred(x, n, sums)
        for r in factors:
            q = _solved(q, r)
        return q.T @ q

    g = _summed(vectors, gram, d)
    spread = float(np.trace(g))
    if not spread:
        return None
    while len(factors) < MOST_PASSES:
        factors.append(_factor(g, n, shifted=not factors))
        g = _summed(vectors, gram, d)
        if np.abs(g - np.eye(d)).max() < ORTHOGONAL:
            break
    r = np.eye(d)
    for f in factors:
        r = f @ r
    # A = Q R with Q'Q = g: the right singular vectors of g^(1/2) R are those of A
    values, vectors_of = np.linalg.eigh(g)
    root = (vectors_of * np.sqrt(np.maximum(values, 0))) @ vectors_of.T
    _, s, vt = np.linalg.svd(root @ r)
    k = min(components, int((s > NO_VARIANCE * s[0]).sum()))
    v, e = vt[:k].T, s[:k] ** 2 / n
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)  # a fixed sign

    def second(x: np.ndarray) -> np.ndarray:
        w = np.hstack([_centred(x, n, sums) @ v / np.sqrt(e), np.ones((len(x), 1))])
        return w.T @ w

    m = _summed(vectors, second, k + 1)
    mean = m[k, :k] / n
    error = float(np.abs(m[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, sums, v, e, e * n / spread, error, len(factors))


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """One row for each row and component: id, component (from 1), deviation, whitened, explained."""
    schema = "id long, component int, deviation long, whitened double, explained double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                num = _numerators(_matrix(part.column("x")), model.n, model.sums)
                w = num.astype(np.float64) / model.n @ model.components / np.sqrt(model.eigenvalues)
                m = len(w)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(_deviation(num), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(w.ravel()), pa.array(np.tile(model.explained, m))],
                    ["id", "component", "deviation", "whitened", "explained"])

    return rows.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(tidy(project), schema)


def _deviation(num: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond a long."""
    if num.dtype != object and int(np.abs(num).max(initial=0)) ** 2 * num.shape[1] < 2 ** 63:
        return (num * num).sum(axis=1).tolist()
    exact = (num.astype(object) ** 2).sum(axis=1)
    return [v if v < 2 ** 63 else None for v in exact]
