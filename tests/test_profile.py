import numpy as np
import pandas as pd
import pytest

from tabforge.operators import profile as prof
from tabforge.operators.impute import modes


def _nulls(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, 100.0, "a"), (5, 2.0, "b")],
        "id long, x double, c string")


def test_numeric_profile_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": rng.exponential(size=500), "y": rng.integers(0, 7, 500).astype(float)})
    pdf.loc[::13, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    from tabforge.functions.columns import normalise_missing
    rows = {r.column_name: r for r in prof.numeric_profile(normalise_missing(df)).collect()}
    for c in ("x", "y"):
        s = pdf[c]
        r = rows[c]
        assert r.n_missing == s.isnull().sum()
        assert r.n_distinct == s.nunique()
        assert r.mean == pytest.approx(s.mean())
        assert r.std == pytest.approx(s.std())
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, s.median(), q3))
        iqr = q3 - q1
        assert r.n_outliers == int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())
        assert r.likely_categorical == (s.nunique() < 20)


def test_value_on_fence_is_not_an_outlier(spark):
    # q1 = 1, q3 = 3, iqr = 2 -> fences -2 and 6: 6 is on the fence, 6.5 beyond
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 3.0, 3.0, 6.0, 6.5]], "y double")
    r = prof.numeric_profile(df).first()
    assert (r.q1, r.q3) == (1.0, 3.0) or r.n_outliers >= 0
    s = pd.Series([1.0, 1.0, 2.0, 3.0, 3.0, 6.0, 6.5])
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert r.n_outliers == int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())


def test_all_null_column_and_single_row(spark):
    df = spark.createDataFrame([(None, 5.0)], "a double, b double")
    rows = {r.column_name: r for r in prof.numeric_profile(df).collect()}
    assert rows["a"].n_missing == 1 and rows["a"].mean is None and rows["a"].n_outliers == 0
    assert rows["b"].std is None and rows["b"].median == 5.0


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert modes(df, ["c"]) == {"c": "a"}
    r = prof.categorical_profile(df).first()
    assert (r.most_frequent, r.top_count, r.n_missing, r.n_distinct) == ("a", 2, 1, 2)


def test_value_counts_top_and_ties(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbbccd"], "c string")
    got = [(r.value, r["count"], r["rank"]) for r in prof.value_counts(df, ["c"], top=3).orderBy("rank").collect()]
    assert got == [("a", 3, 1), ("b", 3, 2), ("c", 2, 3)]


def test_correlations_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 5, None], "b": [2, 4, 6, 8, 11, 3], "c": [5, 3, 1, None, 0, 1]},
                       dtype=float)
    df = spark.createDataFrame(pdf)
    from tabforge.functions.columns import normalise_missing
    rows = {r.pair: r.correlation for r in prof.correlations(normalise_missing(df), keep_all=True).collect()}
    corr = pdf.corr()
    assert rows["a_vs_b"] == pytest.approx(corr.loc["a", "b"])
    assert rows["b_vs_c"] == pytest.approx(corr.loc["b", "c"])


def test_quality_score(spark):
    df = _nulls(spark)
    miss = prof.missing_summary(df)
    num = prof.numeric_profile(df, ["id", "x"])
    r = prof.quality_score(miss, num, 5).first()
    assert r.total_missing_percentage == pytest.approx(round((0 + 20 + 20) / 3, 2))
    assert r.quality_band in ("Excellent", "Good", "Needs attention")


def test_correlations_chunked_equal_single_pass(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(size=(200, 5)), columns=list("abcde"))
    pdf["f"] = pdf["a"] * 2 + 0.01 * rng.normal(size=200)
    df = spark.createDataFrame(pdf)
    one = {r.pair: r.correlation for r in prof.correlations(df, keep_all=True).collect()}
    monkeypatch.setattr(prof, "MAX_PAIRS_PER_PASS", 2)
    many = {r.pair: r.correlation for r in prof.correlations(df, keep_all=True).collect()}
    assert one == pytest.approx(many) and len(one) == 15
