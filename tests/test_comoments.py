import numpy as np
import pytest

from tabforge.functions import comoments as co
from tabforge.operators import profile as prof
from tabforge.operators import select


def plain(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if both.sum() < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return both.sum(), None
    a, b = a - a.mean(), b - b.mean()
    return both.sum(), float(a @ b / np.sqrt((a @ a) * (b @ b)))


def frame(spark, x):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(x.shape[1])))


def gaps(rng, n, d):
    base = rng.normal(size=(n, 3))
    x = base @ rng.normal(size=(3, d)) + rng.normal(size=(n, d))
    x[:, 1] = x[:, 0] * 2 + 1
    x[:, 2] = 0.1                                   # constant
    x[:, 3] += 1e9                                  # far from zero
    x[rng.random((n, d)) < 0.2] = np.nan
    x[:, 4] = np.nan                                # empty
    x[:, 5] = np.where(np.arange(n) < 2, 1.0 + np.arange(n), np.nan)
    return x


@pytest.mark.parametrize("block,parts", [(3, 5), (128, 1), (4, 13)])
def test_pairs_equal_plain_numbers(spark, block, parts):
    x = gaps(np.random.default_rng(4), 400, 11)
    df = frame(spark, x).repartition(parts)
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in co.pairwise_correlations(df, df.columns, block).collect()}
    assert set(got) == {(i, j) for i in range(11) for j in range(i + 1, 11)}
    for (i, j), (n, r) in got.items():
        want_n, want = plain(x, i, j)
        assert n == want_n and (r is None) == (want is None)
        assert r is None or abs(r - want) < 1e-6 if 3 in (i, j) else r is None or abs(r - want) < 1e-12


def test_merge_is_stable_far_from_zero():
    """Values around 1e9 with a spread of 1: parts merge without losing digits."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2)) + 1e9
    x[:, 1] += x[:, 0] - 1e9
    parts = [co._batch(x[s:s + 100, :1], x[s:s + 100, 1:]) for s in range(0, 5000, 100)]
    total = parts[0]
    for p in parts[1:]:
        total = co._merged(total, p)
    want = np.corrcoef((x - 1e9).T)[0, 1]
    assert abs(co.correlation_of(total)[0, 0] - want) < 1e-7


def test_wide_table_in_one_scan(spark):
    """500 columns: one scan of the table, threshold and greedy selection work from it."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 500))
    x[:, 7] = x[:, 3] + rng.normal(size=60) * 0.01
    x[5, 7] = np.nan
    df = frame(spark, x)
    out = prof.correlations(df, threshold=0.9)
    assert [(r["column_a"], r["column_b"]) for r in out.collect()] == [("c3", "c7")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan") == 1
    assert select.correlated(df, threshold=0.9) == ["c7"]


def test_no_rows_and_one_column(spark):
    empty = frame(spark, np.zeros((1, 3))).limit(0)
    assert co.pairwise_correlations(empty, empty.columns).count() == 0
    assert co.pairwise_correlations(frame(spark, np.zeros((4, 1))), ["c0"]).count() == 0
