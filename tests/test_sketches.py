import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions import sketches as sk
from tabforge.streaming import stream as stm


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=9000), np.full(1000, 0.25)]
    rows = [(i % 10, float(v) if i % 7 else None, f"u{int(i) * 37 % 3000}", float("nan") if i % 5 == 0 else 1.0)
            for i, v in enumerate(rng.permutation(x))]
    return spark.createDataFrame(rows, "day int, x double, name string, y double").repartition(6)


def test_merged_parts_keep_the_bounds_of_one_sketch(spark, days, tmp_path):
    path = f"{tmp_path}/p"
    for lo in (0, 5):
        sk.add_parts(days.where(F.col("day").between(lo, lo + 4)), F.col("day"), path, ["x", "name", "y"], k=200)
    got = {r["column_name"]: r for r in sk.stored_profile(spark, path, ranks=(0.1, 0.5, 0.9)).collect()}
    one = {r["column_name"]: r for r in sk.merged_profile(sk.column_sketches(days, F.lit("all"), ["x", "name", "y"], k=200)).collect()}
    x = np.array([r["x"] for r in days.select("x").where("x is not null").collect()])
    assert got["x"]["n_rows"] == 10_000 and got["x"]["n_missing"] == 10_000 - len(x)
    assert got["x"]["min"] == x.min() and got["x"]["max"] == x.max()
    for r, q in zip((0.1, 0.5, 0.9), got["x"]["quantiles"], strict=True):
        assert (x < q).mean() <= r + sk.rank_error(200) and (x <= q).mean() >= r - sk.rank_error(200)
    for c, n in (("x", len(set(x))), ("name", 3000)):  # merged or not, within four standard errors
        for table in (got, one):
            assert abs(table[c]["n_distinct"] - n) <= 4 * sk.distinct_error() * n
    assert abs(got["name"]["n_distinct"] - 3000) <= 4 * sk.distinct_error() * 3000 and got["name"]["quantiles"] is None
    assert got["y"]["n_missing"] == 2000 and got["y"]["quantiles"] == [1.0] * 3


def test_a_part_again_replaces_itself_and_parts_can_be_chosen(spark, days, tmp_path):
    path = f"{tmp_path}/p"
    for _ in range(2):
        sk.add_parts(days, F.col("day"), path, ["x"])
    sk.add_parts(days.where("day = 3").limit(10), F.col("day"), path, ["x"])
    n = {r["column_name"]: r["n_rows"] for r in sk.stored_profile(spark, path).collect()}
    assert n == {"x": 9010}
    some = sk.stored_profile(spark, path, F.col("part").isin("1", "2")).first()
    x = sorted(r["x"] for r in days.where("day in (1, 2) and x is not null").collect())
    assert some["n_rows"] == 2000 and some["quantiles"][1] == x[int(np.ceil(len(x) * 0.5)) - 1]  # fewer than K: exact


def test_window_quantiles_of_a_stream(spark, tmp_path):
    """Stream equals batch, quantiles keep the bound, late rows are left out, empty windows have null quantiles."""
    rng = np.random.default_rng(8)
    t0 = dt.datetime(2024, 1, 1)
    first = [(t0 + dt.timedelta(minutes=int(m)), "a", float(v)) for m, v in zip(rng.integers(0, 2880, 4000), rng.normal(size=4000), strict=True)]
    first += [(t0, "b", None), (t0, "b", float("nan"))]
    later = [(t0 + dt.timedelta(days=9), "a", 1.0)]
    late = [(t0, "a", 1e9)]
    schema = "ts timestamp, g string, v double"
    src = f"{tmp_path}/src"
    out = f"{tmp_path}/out"
    ckpt = f"{tmp_path}/ck"
    for i, rows in enumerate((first, later, late, [(t0 + dt.timedelta(days=30), "a", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        s = stm.windowed_quantiles(stm.read_stream(spark, src, spark.read.schema(schema).parquet(src).schema), "ts", "v",
                                   "1 day", "1 day", ["g"], k=200)
        got = stm.closed_windows(s, out, ckpt)
    rows = {(r["window_start"], r["g"]): r for r in got.collect()}
    x = np.array([r[2] for r in first if r[1] == "a" and r[0] < t0 + dt.timedelta(days=1)])
    a = rows[t0, "a"]
    assert a["n_values"] == len(x)          # the late row was dropped
    for r, c in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert (x < a[c]).mean() <= r + sk.rank_error(200) and (x <= a[c]).mean() >= r - sk.rank_error(200)
    assert rows[t0, "b"]["n_rows"] == 2 and rows[t0, "b"]["n_values"] == 0 and rows[t0, "b"]["q50"] is None
    assert os.path.isdir(ckpt)
