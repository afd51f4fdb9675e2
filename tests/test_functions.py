import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions import scalar as fx
from tabforge.functions.columns import normalise_missing
from tabforge.functions.quantiles import exact_quantiles


def test_quantiles_match_numpy_linear(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), rng.integers(0, 5, 2000)]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)] * 7, "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, {"x": probs})["x"]
    exp = np.quantile(vals, probs, method="linear")
    assert np.allclose(got, exp, rtol=0, atol=1e-12)


def test_quantiles_refinement_path_is_exact(spark):
    vals = np.arange(20000, dtype=float) ** 1.5
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    got = exact_quantiles(df, {"x": [0.25, 0.5, 0.75]}, collect_cap=20, accuracy=100)["x"]
    assert np.allclose(got, np.quantile(vals, [0.25, 0.5, 0.75]), atol=1e-9)


def test_quantiles_all_null_and_single_row(spark):
    df = spark.createDataFrame([(None, 3.0)], "a double, b double")
    got = exact_quantiles(df, {"a": [0.5], "b": [0.25, 0.75]})
    assert got["a"] == [None]
    assert got["b"] == [3.0, 3.0]


def test_divide_by_zero_and_inf_to_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (None, 1.0), (1e308, 1e-308)], "a double, b double")
    out = [r[0] for r in df.select(fx.binary_feature("divide", ["a", "b"])).collect()]
    assert out == [None, 2.0, None, None]


def test_binary_guards():
    with pytest.raises(ValueError):
        fx.binary_feature("power", ["a", "b"])
    with pytest.raises(ValueError):
        fx.binary_feature("add", ["a"])
    with pytest.raises(ValueError):
        fx.binary_feature("add", ["a", "zz"], columns=["a", "b"])


def test_parse_operation_ignores_symbols_in_names():
    assert fx.parse_operation(["df['x'] = df['a-b'] * df['c/d']"], ["a-b", "c/d"]) == "multiply"
    assert fx.parse_operation(["a / b"], ["a", "b"]) == "divide"
    assert fx.parse_operation(["x = a + b - c"]) == "add"
    assert fx.parse_operation(["nothing here"]) is None
    assert fx.parse_operation([]) is None


def test_nan_and_inf_normalised(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (None,)], "x double")
    assert [r.x for r in normalise_missing(df).collect()] == [None, None, None, 1.0, None]


def test_yeo_johnson_matches_formula(spark):
    xs = [-3.0, -0.5, 0.0, 0.7, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for lam in (-1.2, 0.0, 0.5, 2.0, 3.1):
        got = [r[0] for r in df.select(fx.yeo_johnson("x", lam)).collect()]
        for x, g in zip(xs, got):
            if x >= 0:
                e = math.log1p(x) if lam == 0 else ((x + 1) ** lam - 1) / lam
            else:
                e = -math.log1p(-x) if lam == 2 else -(((1 - x) ** (2 - lam)) - 1) / (2 - lam)
            assert g == pytest.approx(e, rel=1e-12, abs=1e-12)


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (5.0,), (50.0,)], "x double")
    assert [r[0] for r in df.select(fx.clip("x", 0.0, 10.0)).collect()] == [None, 0.0, 5.0, 10.0]


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"),), (1.23456789,)], "x double")
    assert [r[0] for r in df.select(fx.json_safe("x")).collect()] == [None, 1.234568]


def test_quantiles_many_intervals_duplicates_nulls(spark):
    """Several disjoint brackets per column (gaps between them are counted in
    the same pass), heavy duplicates and nulls; exact against numpy."""
    rng = np.random.default_rng(3)
    n = 5000
    cont = rng.normal(size=n)
    dup = rng.integers(0, 7, size=n).astype(float)
    gaps = np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n))
    rows = [(float(a), float(b), None if np.isnan(c) else float(c)) for a, b, c in zip(cont, dup, gaps)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    probs = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = exact_quantiles(df, {"a": probs, "b": probs, "c": probs}, accuracy=200)
    for name, vals in (("a", cont), ("b", dup), ("c", gaps[~np.isnan(gaps)])):
        assert np.allclose(got[name], np.quantile(vals, probs, method="linear"), atol=1e-12), name
