"""Column types, caps and contracts of the preparation, and the loader's odd files."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabforge.functions import scalar as fx
from tabforge.operators import encode, impute, outliers, profile, select
from tabforge.plans import plan as pl
from tabforge.plans import prep as pp
from tabforge.sources import loader


def write(text, suffix):
    path = os.path.join(tempfile.mkdtemp(prefix="tabforge-io-"), "f" + suffix)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_integer_mean_keeps_its_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "x int")
    out = impute.apply_fill(df, impute.fit_numeric(df, ["x"], "mean"))
    assert sorted(r.x for r in out.collect()) == [1, 2, 7 / 3, 4]
    assert dict(impute.apply_fill(df, {"x": 2.0}).dtypes)["x"] == "int"  # a whole value keeps the type
    dec = spark.createDataFrame([(1,), (None,)], "x int").select(F.col("x").cast("decimal(5,1)").alias("x"))
    assert sorted(r.x for r in impute.apply_fill(dec, {"x": 0.25}).collect()) == [0.25, 1.0]


def test_integer_fences_keep_their_fraction(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 100]], "x bigint")
    assert max(r.x for r in outliers.apply_clip(df, {"x": (None, 32.5)}).collect()) == 32.5
    assert dict(outliers.apply_clip(df, {"x": (0.0, 32.0)}).dtypes)["x"] == "bigint"


def test_large_ids_stay_apart(spark):
    df = spark.createDataFrame([(2 ** 53,), (2 ** 53 + 1,), (2 ** 53 + 1,), (2 ** 53 + 2,)], "id bigint")
    assert profile.distinct_counts(df, ["id"]) == {"id": 3}
    assert profile.numeric_profile(df).first()["n_distinct"] == 3
    assert impute.modes(df, ["id"]) == {"id": 2 ** 53 + 1}


def test_no_row_copies_for_distinct_counts(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 3 * 0.5).alias("b"))
    assert outliers.eligible(df, ["id", "a", "b"])[0] == ["id", "a"]
    assert profile.distinct_counts(df, ["id", "a", "b"]) == {"id": 100, "a": 7, "b": 3}


def test_booleans_and_dates_survive(spark):
    rows = [(i, None if i % 5 == 0 else i % 3 == 0, None if i % 7 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=i),
             float(i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, flag boolean, day date, y double")
    cfg = pl.TaskConfig("Supervised", "Regression", target="y", index_column="id")
    fp, train = pp.fit(df, pl.Plan.default(["flag", "day"]), cfg)
    assert fp.output_columns == ["flag", "day"]
    out = pp.FittedPrep.from_json(fp.to_json()).transform(df).collect()
    assert len(out) == 60 and all(r.flag is not None and r.day is not None for r in out)


def test_constant_columns_may_stay(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 5), float(i)) for i in range(50)], "id int, c double, x double, y double")
    plan = pl.Plan.default(["c", "x"])
    plan["pipeline_recommendation"] = {"step_6_feature_selection": {"drop_constant": False}}
    cfg = pl.TaskConfig("Supervised", "Regression", target="y", index_column="id")
    assert pp.fit(df, plan, cfg)[0].output_columns == ["c", "x"]


def test_fingerprints_do_not_overflow(spark):
    df = spark.range(60_000_000).select(F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit(2).alias("c"))
    assert select.duplicates(df) == ["b"]


def test_onehot_has_no_fixed_limit(spark):
    df = spark.range(1500).select(F.concat(F.lit("l"), F.col("id")).alias("v"))
    assert len(encode.fit_onehot(df, ["v"])["v"]) == 1500
    with pytest.raises(ValueError, match="1499"):
        encode.fit_onehot(df, ["v"], max_levels=1499)


def fill(spark, rows, schema, buckets, **kw):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in impute.forward_fill(df, ["v"], ["k"], "t", buckets=buckets, **kw).collect()), key=str)


def test_forward_fill_dates_nulls_and_skew(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a" if i % 2 else None, day + dt.timedelta(days=i), float(i) if i % 4 < 2 else None) for i in range(40)]
    rows.append(("a", None, 99.0))  # a null order key comes first
    rows.append(("a", dt.date(9000, 1, 1), None))  # far away
    want = []
    for k in (None, "a"):
        carried = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or day)):
            carried = r[2] if r[2] is not None else carried
            want.append((r[0], r[1], carried))
    for buckets in (1, 5, 17):
        assert fill(spark, rows, "k string, t date, v double", buckets) == sorted(want, key=str)


def test_forward_fill_by_text_order(spark):
    rows = [("a", f"key{i:03d}", float(i) if i % 3 == 0 else None) for i in range(30)]
    want = sorted(((k, t, float(i // 3 * 3)) for i, (k, t, _) in enumerate(rows)), key=str)
    assert fill(spark, rows, "k string, t string, v double", 6) == want


def test_fills_refuse_streams(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="stream"):
        impute.forward_fill(stream, ["value"], [], "timestamp")


def test_plan_is_checked_and_not_changed():
    plan = pl.Plan.default(["a", "b", "y"])
    before = json.dumps(plan)
    assert plan.validate(target="y")["columns_to_keep"]["column_list"] == ["a", "b"]
    assert json.dumps(plan) == before
    with pytest.raises(ValueError, match="b, y"):
        plan.validate(columns=["a"])
    with pytest.raises(ValueError, match="summary|columns_to_drop"):
        pl.Plan({}).validate()


def test_checked_transform_and_report(spark):
    rows = [(i, float(i) if i % 4 else None, "xyz"[i % 3], float(i * 2)) for i in range(40)] + [(99, 1.0, "x", None)]
    df = spark.createDataFrame(rows, "id int, a double, c string, y double")
    cfg = pl.TaskConfig("Supervised", "Regression", target="y", index_column="id")
    plan = pl.Plan.default(["a", "c"])
    plan["pipeline_recommendation"] = {"step_3_encoding": {"onehot_columns": ["c"]}}
    fp, _ = pp.fit(df, plan, cfg)
    seen = []
    fp.transform_checked(df, lambda out: seen.append(out.collect()))
    assert len(seen[0]) == 41
    got = {r.field: r.value for r in fp.preparation_report(df).collect()}
    assert (got["rows"], got["missing"], got["prepared_missing"], got["target_rows_dropped"]) == ("41", "10", "0", "1")
    broken = pp.FittedPrep.from_json(fp.to_json())
    broken.output_columns = [*fp.output_columns]
    broken._features = lambda d, upto="end": fp._features(d, upto).where(F.col("a") > 0)
    with pytest.raises(ValueError, match="41 rows became"):
        broken.transform_checked(df, lambda out: out.collect())


def test_guards_of_features():
    assert fx.feature_problem("add", ["a", "b"], ["a", "b"]) is None
    assert "zz" in fx.feature_problem("add", ["a", "zz"], ["a", "b"])


def test_quoted_delimiter(spark):
    path = write('a;b\n"x;y";2\n"p,q,r";3\n', ".csv")
    assert loader.detect_delimiter(spark, path) == ";"
    assert sorted(tuple(r) for r in loader.load_table(spark, path).collect()) == [("p,q,r", 3), ("x;y", 2)]


def test_blank_header_promotes_first_record(spark):
    df = loader.load_table(spark, write(",,\nid,name,score\n1,a,2.5\n2,b,\n", ".csv"))
    assert df.columns == ["id", "name", "score"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double"}
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a", 2.5), (2, "b", None)]


def test_json_forms(spark):
    assert loader.load_table(spark, write('{\n  "a": 1,\n  "b": "x"\n}\n', ".json")).count() == 1
    assert loader.load_table(spark, write('{"a": 1,\n "b": "x"}', ".json")).count() == 1
    assert loader.load_table(spark, write('{"a": 1}\n{"a": 2}\n', ".json")).count() == 2
    bad = write('{"a": 1}\nnonsense\n{"a": 2}\n', ".json")
    df = loader.load_table(spark, bad)
    assert df.columns == ["a"] and sorted(r.a for r in df.collect()) == [1, 2]


def test_schema_path_and_bad_rows(spark):
    path = write("a,b\n1,2\n3,4,5\n", ".csv")
    assert loader.read_csv(spark, path, schema="a int, b int").count() == 2
    assert [r.a for r in loader.read_csv(spark, path, schema="a int, b int", bad_rows="drop").collect()] == [1]


def test_folder_without_extension_is_parquet(spark):
    folder = tempfile.mkdtemp(prefix="tabforge-io-") + "/t"
    spark.range(5).write.parquet(folder)
    assert loader.load_table(spark, folder).count() == 5


def test_late_rows(spark):
    """A row older than the watermark is dropped; one within it is counted."""
    from tabforge.streaming import stream as stm
    folder, out, ckpt = (tempfile.mkdtemp(prefix="tabforge-st-") for _ in range(3))
    at = lambda d: dt.datetime(2024, 1, d, 12)

    def batch(rows):
        spark.createDataFrame(rows, "ts timestamp, v double").coalesce(1).write.mode("append").parquet(folder)
        s = stm.read_stream(spark, folder, "ts timestamp, v double")
        return stm.closed_windows(stm.windowed_profile(s, "ts", "v", "1 day", "1 day"), out + "/o", ckpt)

    batch([(at(1), 1.0), (at(3), 2.0), (at(10), 3.0)])
    got = batch([(at(2), 50.0), (at(9), 7.0), (at(20), 8.0)])  # the 2nd is late, the 9th is not
    rows = {r.window_start.day: (r.n_rows, r.mean) for r in got.collect()}
    assert rows[1] == (1, 1.0) and rows[3] == (1, 2.0) and 2 not in rows and rows[9] == (1, 7.0) and rows[10] == (1, 3.0)


def test_target_means_leave_out_the_own_fold(spark):
    rows = [(i, "abc"[i % 3], float(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, c string, y double")
    got = encode.target_out_of_fold(df, ["c"], "y", 4, 5.0).collect()
    fold = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64("id", "c", "y"), F.lit(4)).alias("f")).collect()}
    for r in got:
        i = r["id"]
        rest = [(c, y) for j, c, y in rows if fold[j] != fold[i]]
        own = [y for c, y in rest if c == rows[i][1]]
        mean = sum(y for _, y in rest) / len(rest)
        assert abs(r["c"] - (sum(own) + 5.0 * mean) / (len(own) + 5.0)) < 1e-9
    plan = pl.Plan.default(["c"])
    plan["pipeline_recommendation"] = {"step_3_encoding": {"target_columns": ["c"], "target_folds": 4, "smoothing": 5.0}}
    fp, train = pp.fit(df, plan, pl.TaskConfig("Supervised", "Regression", target="y", index_column="id"))
    assert train.select("c").distinct().count() > 3 and fp.transform(df).select("c").distinct().count() == 3


def test_saved_state_holds_large_level_maps(spark, monkeypatch):
    monkeypatch.setattr(encode, "INLINE_LEVELS", 2)
    df = spark.createDataFrame([(i, f"v{i % 9}", float(i)) for i in range(50)], "id int, c string, y double")
    plan = pl.Plan.default(["c"])
    plan["pipeline_recommendation"] = {"step_3_encoding": {"frequency_columns": ["c"]}}
    fp, _ = pp.fit(df, plan, pl.TaskConfig("Supervised", "Regression", target="y", index_column="id"))
    folder = tempfile.mkdtemp(prefix="tabforge-io-") + "/state"
    fp.save(folder)
    again = pp.FittedPrep.load(folder)
    assert again.level_maps[0]["path"].startswith(folder)
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, fp.transform(df).collect()))


def test_exact_quantiles_narrow_wide_brackets(spark):
    import numpy as np

    from tabforge.functions.quantiles import QuantileJob
    rng = np.random.default_rng(4)
    values = {"x": rng.normal(size=20_000), "few": rng.integers(0, 5, 20_000).astype(float)}
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(values["x"], values["few"], strict=True)], "x double, few double")
    got = QuantileJob({c: [0.25, 0.5, 0.9] for c in values}, accuracy=50, collect_cap=40).run(df)
    for c, v in values.items():
        assert np.allclose(got[c], np.quantile(v, [0.25, 0.5, 0.9]))


def test_promoted_header_keeps_equal_data_rows(spark, tmp_path):
    """Only the header itself goes, in each file that has one."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text(";;\nid;name;x\n1;ann;2.5\nid;name;x\nid;name;x\n")
    got = loader.load_table(spark, f"{tmp_path}/a", fmt="csv")
    assert got.columns == ["id", "name", "x"]
    assert sorted(tuple(r) for r in got.collect()) == [("1", "ann", "2.5"), ("id", "name", "x"), ("id", "name", "x")]
    (tmp_path / "a" / "2.csv").write_text(";;\nid;name;x\n2;bob;3.5\n")
    got = loader.load_table(spark, f"{tmp_path}/a", fmt="csv")
    assert got.count() == 4
    (tmp_path / "b.csv").write_text(";;\nid;name;x\n1;ann;2.5\n")
    got = loader.load_table(spark, f"{tmp_path}/b.csv", fmt="csv")
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double")] and got.count() == 1
