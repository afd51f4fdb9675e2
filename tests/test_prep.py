import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import encode, impute, outliers, select, transform
from tabforge.operators import target as tgt
from tabforge.plans import prep as pp
from tabforge.plans.plan import Plan, TaskConfig, build_plan, detect_task
from tabforge.queries import ORDERS_PLAN, _orders_config
from tabforge.sources.tables import fixture, table

from conftest import SF_SMALL


def test_unseen_levels(spark):
    fit_df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    lv = encode.fit_onehot(fit_df, ["c"])
    oh = encode.apply_onehot(new, lv).collect()
    assert [tuple(r) for r in oh] == [(1, 0), (0, 0), (0, 0)]
    fr = encode.join_levels(new, encode.fit_frequency(fit_df, ["c"])).collect()
    assert sorted(r.c for r in fr) == [0.0, 0.0, pytest.approx(2 / 3)]
    lab = encode.join_levels(new, encode.fit_label(fit_df, ["c"])).collect()
    assert sorted(r.c for r in lab) == [-1, -1, 0]


def test_target_labels_unknown(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "t string")
    st, kept = tgt.fit_target(df, "t", "classification")
    assert st.classes == ["x", "y"] and kept.count() == 3
    new = spark.createDataFrame([("y",), ("q",)], "t string")
    enc = new.select(tgt.encode_target(st).alias("i"))
    assert [r.i for r in enc.collect()] == [1, -1]
    back = enc.select(tgt.decode_label(st, F.col("i")).alias("b"))
    assert [r.b for r in back.collect()] == ["y", "UNKNOWN"]


def test_duplicates_keep_first(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, None), (2.0, 2.0, 2.0, None), (None, None, 1.0, None)],
                               "a double, b double, c double, d double")
    assert select.duplicates(df) == ["b"]


def test_quasi_constant(spark):
    rows = [(0.0, "k") for _ in range(199)] + [(1.0, "j")]
    df = spark.createDataFrame(rows, "x double, s string")
    assert select.quasi_constant(df, tol=0.99) == ["x", "s"]
    assert select.quasi_constant(df, tol=0.999) == []


def test_winsor_eligibility(spark):
    df = spark.createDataFrame([(float(i % 3), float(i)) for i in range(200)], "few double, many double")
    ok, skipped = outliers.eligible(df, ["few", "many"])
    assert ok == ["many"] and skipped == ["few"]


def test_yeo_johnson_lambda_near_numpy_mle(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = transform.fit_yeo_johnson(df, ["x"])["x"]

    def llf(lmb):
        psi = np.log1p(x) if abs(lmb) < 1e-12 else ((x + 1) ** lmb - 1) / lmb
        return -len(x) / 2 * np.log(psi.var()) + (lmb - 1) * np.sum(np.log1p(x))
    grid = np.linspace(-2, 2, 40001)
    best = grid[np.argmax([llf(g) for g in grid])]
    assert abs(lam - best) < 2e-3


def test_forward_fill_hot_key(spark):
    rows = [(1 if i % 3 else 2, i, float(i) if i % 5 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    got = {r.t: r.v for r in impute.forward_fill(df, ["v"], ["k"], ["t"], buckets=7).collect()}
    last = {}
    for k, t, v in rows:
        if v is not None:
            last[k] = v
        assert got[t] == last.get(k)


def test_prepare_contracts_and_roundtrip(spark):
    og = fixture(spark, SF_SMALL, "orders_gaps")
    fp, out = pp.fit(og, ORDERS_PLAN, _orders_config())
    n = og.count()
    assert out.count() == n
    nulls = out.select([F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in out.columns]).first()
    assert sum(nulls) == 0
    again = pp.FittedPrep.from_json(fp.to_json())
    t1 = sorted(tuple(r) for r in fp.transform(og).collect())
    t2 = sorted(tuple(r) for r in again.transform(og.repartition(7)).collect())
    assert t1 == t2 == sorted(tuple(r) for r in out.collect())
    json.loads(fp.to_json())


def test_plan_rules_and_validation(spark):
    cust = fixture(spark, SF_SMALL, "customer_gaps")
    cfg = TaskConfig("Supervised", "Classification", target="c_mktsegment")
    p = build_plan(cust, cfg)
    assert "c_custkey" in p["columns_to_drop"]["column_list"]
    assert "c_mktsegment" not in p["columns_to_keep"]["column_list"]
    with pytest.raises(ValueError):
        Plan({"columns_to_drop": {}}).validate()
    with pytest.raises(ValueError):
        TaskConfig("Supervised", "Classification")
    with pytest.raises(ValueError):
        TaskConfig("Supervised", "Sorting", target="x")
    with pytest.raises(ValueError):
        TaskConfig("Supervised", "Regression", target="x", acceleration_hardware="TPU")
    cfg = TaskConfig("Unsupervised", "Clustering", processing_type="Training-Alone", hyper_parameter_tuning=True)
    assert TaskConfig(**cfg.__dict__) == cfg


def test_detect_task(spark):
    assert detect_task(table(spark, SF_SMALL, "part"))[0] == "Regression"
    one = spark.createDataFrame([(1, "a"), (2, "a")], "x long, y string")
    assert detect_task(one) == ("Clustering", None)


def test_constant_and_duplicates_shared_passes(spark):
    rows = [(float(i), float(i), 0.0, 0.0, "k", float(i % 7)) for i in range(300)]
    rows[5] = (5.0, 5.0, 1.0, 1.0, "k", 5.0)
    df = spark.createDataFrame(rows, "a double, b double, z double, z2 double, s string, c double")
    const, dup = select.constant_and_duplicates(df, df.columns, tol=0.99)
    assert const == ["z", "z2", "s"]
    assert dup == ["b"]
    assert select.quasi_constant(df, tol=0.99) == const
    assert [c for c in select.duplicates(df) if c not in const] == dup


def test_large_level_maps_written_and_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i % 7}", float(i)) for i in range(70)], "id long, c string, y double")
    inline = {
        "freq": {r.id: r.c for r in encode.join_levels(df, encode.fit_frequency(df, ["c"])).collect()},
        "label": {r.id: r.c for r in encode.join_levels(df, encode.fit_label(df, ["c"])).collect()},
        "target": {r.id: r.c for r in encode.join_levels(df, encode.fit_target(df, ["c"], "y")).collect()},
    }
    monkeypatch.setattr(encode, "INLINE_LEVELS", 3)
    monkeypatch.setattr(encode, "BROADCAST_LEVELS", 3)
    maps = encode.fit_frequency(df, ["c"])
    assert maps[0].rows is None and maps[0].path
    big = {
        "freq": {r.id: r.c for r in encode.join_levels(df, maps).collect()},
        "label": {r.id: r.c for r in encode.join_levels(df, encode.fit_label(df, ["c"])).collect()},
        "target": {r.id: r.c for r in encode.join_levels(df, encode.fit_target(df, ["c"], "y")).collect()},
    }
    assert big["label"] == inline["label"]
    for k in ("freq", "target"):
        assert big[k] == pytest.approx(inline[k])
