"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame computed by Spark from
the whole given tables.  Doubles are rounded (``ROUND``) to a fixed number of
places so that the order of floating-point summation cannot change a value
hash; the oracle SQL rounds the same columns the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.operators import profile as prof
from tabforge.sources.tables import fixture, table

# Decimals kept in query outputs.
DECIMALS = 6
COARSE = {"variance": 2}

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def fix_round(c, d: int):
    """round(x * 10^d) / 10^d: the product is the same IEEE double in every
    engine, so the oracle's ROUND(x * 1e{d}) / 1e{d} gives the same value even
    on an exact decimal half (which a decimal-based ROUND(x, d) may not)."""
    m = float(10 ** d)
    return F.round(c * F.lit(m), 0) / F.lit(m) + F.lit(0.0)   # + 0.0 turns -0.0 into 0.0


def rounded(df: DataFrame, coarse: dict[str, int] | None = None) -> DataFrame:
    coarse = {**COARSE, **(coarse or {})}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(fix_round(F.col(f.name), coarse.get(f.name, DECIMALS)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


CHARGE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "disc_price", "charge"]
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TEXT = ["l_returnflag", "l_linestatus"]
ORDERS_TEXT = ["o_orderstatus", "o_orderpriority"]


# ---------------------------------------------------------------- profile
@query("numeric_profile")
def q_numeric_profile(spark, sf_dir):
    """A1-A7, A11-A13 on lineitem with rule-made gaps."""
    return rounded(prof.numeric_profile(fixture(spark, sf_dir, "lineitem_gaps"), LINEITEM_NUMERIC))


@query("categorical_profile")
def q_categorical_profile(spark, sf_dir):
    """A2, A3, A9 on the text columns of orders with gaps."""
    return rounded(prof.categorical_profile(fixture(spark, sf_dir, "orders_gaps"), ORDERS_TEXT))


@query("value_counts_top10")
def q_value_counts(spark, sf_dir):
    """A10 on the text columns of part (p_name has 64 values: the cut matters)."""
    return prof.value_counts(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query("correlations")
def q_correlations(spark, sf_dir):
    """All numeric pairs of lineitem with gaps, |r| > 0.7."""
    return rounded(prof.correlations(fixture(spark, sf_dir, "lineitem_gaps"), LINEITEM_NUMERIC))


@query("correlations_charges")
def q_correlations_charges(spark, sf_dir):
    """A14 with pairs above the threshold: lineitem with its derived
    discounted price and charge (which follow the extended price)."""
    return rounded(prof.correlations(fixture(spark, sf_dir, "lineitem_charges"), CHARGE_NUMERIC))


@query("correlation_pairs")
def q_correlation_pairs(spark, sf_dir):
    """A14 without the threshold: the full upper triangle."""
    return rounded(prof.correlations(fixture(spark, sf_dir, "lineitem_gaps"), LINEITEM_NUMERIC,
                                     keep_all=True))


@query("correlation_blocks")
def q_correlation_blocks(spark, sf_dir):
    """A14 as wide tables go: every pair and its number of complete rows from Gram blocks (of two columns here)."""
    from tabforge.functions.comoments import named_correlations
    return rounded(named_correlations(fixture(spark, sf_dir, "lineitem_gaps"), LINEITEM_NUMERIC, block=2))


@query("missing_summary")
def q_missing(spark, sf_dir):
    """A2/S8 over every column of lineitem with gaps."""
    return rounded(prof.missing_summary(fixture(spark, sf_dir, "lineitem_gaps")))


@query("quality_score")
def q_quality(spark, sf_dir):
    """A15 + A19 of lineitem with gaps."""
    df = fixture(spark, sf_dir, "lineitem_gaps")
    num = prof.numeric_profile(df, LINEITEM_NUMERIC)
    return rounded(prof.quality_score(prof.missing_summary(df), num, prof.row_count(df)))


@query("describe_all")
def q_describe(spark, sf_dir):
    """A8 on customer with gaps (numeric and text columns)."""
    return rounded(prof.describe(fixture(spark, sf_dir, "customer_gaps")))


# ---------------------------------------------------------------- preparation
from tabforge.functions import scalar as fx  # noqa: E402
from tabforge.operators import encode, engineer, impute, outliers, scale, select, transform  # noqa: E402
from tabforge.operators import target as tgt  # noqa: E402


def _li_gaps(spark, sf_dir, cols):
    return fixture(spark, sf_dir, "lineitem_gaps").select(*cols)


@query("impute_mean")
def q_impute_mean(spark, sf_dir):
    """R1 mean."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_discount", "l_tax"])
    return rounded(impute.apply_fill(df, impute.fit_numeric(df, ["l_discount", "l_tax"], "mean")))


@query("impute_median")
def q_impute_median(spark, sf_dir):
    """R1 median (exact, distributed)."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_discount", "l_tax"])
    return rounded(impute.apply_fill(df, impute.fit_numeric(df, ["l_discount", "l_tax"], "median")))


@query("impute_mode")
def q_impute_mode(spark, sf_dir):
    """R2 most frequent (text) and R3 'mode' for a numeric column."""
    df = fixture(spark, sf_dir, "orders_gaps").select("o_orderkey", "o_orderpriority", "o_totalprice")
    fills = {**impute.fit_categorical(df, ["o_orderpriority"]),
             **impute.fit_numeric(df, ["o_totalprice"], "mode")}
    return rounded(impute.apply_fill(df, fills))


@query("forward_fill")
def q_forward_fill(spark, sf_dir):
    """R3 forward_fill per user in (ts, event_id) order."""
    df = fixture(spark, sf_dir, "events_gaps").select("event_id", "user_id", "ts", "value")
    return rounded(impute.forward_fill(df, ["value"], ["user_id"], ["ts", "event_id"]))


@query("backward_fill")
def q_backward_fill(spark, sf_dir):
    """R3 backward_fill per user in (ts, event_id) order."""
    df = fixture(spark, sf_dir, "events_gaps").select("event_id", "user_id", "ts", "value")
    return rounded(impute.backward_fill(df, ["value"], ["user_id"], ["ts", "event_id"]))


@query("drop_missing_rows")
def q_drop_missing(spark, sf_dir):
    """R3 drop: rows with a missing discount or tax removed."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_discount", "l_tax"])
    return rounded(impute.drop_missing_rows(df, ["l_discount", "l_tax"]))


ENGINEERING_RULES = [
    {"new_feature": "unit_price", "source_columns": ["l_extendedprice", "l_quantity"],
     "transformation": ["df['unit_price'] = df['l_extendedprice'] / df['l_quantity']"]},
    {"new_feature": "tax_per_discount", "source_columns": ["l_tax", "l_discount"],
     "transformation": ["l_tax / l_discount"]},
    {"new_feature": "discount_value", "source_columns": ["l_extendedprice", "l_discount"],
     "transformation": ["l_extendedprice * l_discount"]},
    {"new_feature": "tax_plus_discount", "source_columns": ["l_tax", "l_discount"],
     "transformation": ["l_tax + l_discount"]},
    {"new_feature": "qty_minus_line", "source_columns": ["l_quantity", "l_linenumber"],
     "transformation": ["l_quantity - l_linenumber"]},
    {"new_feature": "unit_price_x_qty", "source_columns": ["unit_price", "l_quantity"],
     "operation": "multiply"},
    {"new_feature": "skipped", "source_columns": ["l_quantity", "no_such_column"],
     "transformation": ["a / b"]},
]


@query("feature_engineering")
def q_feature_engineering(spark, sf_dir):
    """Four operations, division by zero -> null, a layered rule,
    and a rule with a missing source skipped."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                  "l_discount", "l_tax"])
    rules = engineer.accept(ENGINEERING_RULES, df.columns)
    return rounded(engineer.apply(df, rules).drop("l_extendedprice", "l_discount", "l_tax"),
                   {"discount_value": 4, "unit_price_x_qty": 4})


WINSOR_COLS = ["l_extendedprice", "l_quantity", "l_discount", "l_linenumber"]


def _winsor(spark, sf_dir, method, fold):
    df = _li_gaps(spark, sf_dir, ["l_orderkey", *WINSOR_COLS])
    ok, _ = outliers.eligible(df, WINSOR_COLS)
    return rounded(outliers.apply_clip(df, outliers.fit_fences(df, ok, method, fold)))


@query("winsorize_iqr")
def q_winsor_iqr(spark, sf_dir):
    """R6 + R7: IQR fences, fold 1.5, on the eligible columns only."""
    return _winsor(spark, sf_dir, "iqr", 1.5)


@query("winsorize_gaussian")
def q_winsor_gauss(spark, sf_dir):
    """R8 gaussian: mean +- 2 sd."""
    return _winsor(spark, sf_dir, "gaussian", 2.0)


@query("winsorize_mad")
def q_winsor_mad(spark, sf_dir):
    """R8 mad: median +- 2 MAD."""
    return _winsor(spark, sf_dir, "mad", 2.0)


@query("winsorize_quantiles")
def q_winsor_quant(spark, sf_dir):
    """R8 quantiles: [p5, p95]."""
    return _winsor(spark, sf_dir, "quantiles", 0.05)


@query("outlier_remove")
def q_outlier_remove(spark, sf_dir):
    """R9 remove: rows outside the IQR fence of the price are removed."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return rounded(outliers.remove_outside(df, outliers.fit_fences(df, ["l_extendedprice"], "iqr", 0.25)))


@query("onehot_encode")
def q_onehot(spark, sf_dir):
    """All levels, null -> 'missing' level, original column dropped."""
    df = fixture(spark, sf_dir, "orders_gaps").select("o_orderkey", "o_orderpriority")
    return encode.apply_onehot(df, encode.fit_onehot(df, ["o_orderpriority"]))


@query("onehot_drop_last")
def q_onehot_drop_last(spark, sf_dir):
    """R10 for clustering: the last level dropped."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return encode.apply_onehot(df, encode.fit_onehot(df, ["o_orderstatus"]), drop_last=True)


@query("frequency_encode")
def q_frequency(spark, sf_dir):
    """Level -> share of rows."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return rounded(encode.join_levels(df, encode.fit_frequency(df, ["p_brand", "p_type"])))


@query("label_encode")
def q_label(spark, sf_dir):
    """R12 label: sorted level index."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return encode.join_levels(df, encode.fit_label(df, ["p_brand", "p_type"]))


@query("target_encode")
def q_target_enc(spark, sf_dir):
    """R12 target: smoothed mean of p_retailprice per brand (m = 10)."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    maps = encode.fit_target(df, ["p_brand"], "p_retailprice", 10.0)
    return rounded(encode.join_levels(df, maps))


@query("log_transform")
def q_log(spark, sf_dir):
    """ln(x + shift), shift = 1 - min when min <= 0 (stored)."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(transform.apply_log(df, transform.fit_log_shift(
        df, ["l_extendedprice", "l_discount", "l_tax"])))


YJ_FIXED = [("l_quantity", 0.5), ("l_discount", -0.7), ("centred_qty", 1.5), ("centred_qty0", 0.0),
            ("centred_qty2", 2.0)]


@query("yeo_johnson_fixed")
def q_yj(spark, sf_dir):
    """F8 for fixed lambdas on positive and negative values (incl. 0 and 2)."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])
    df = df.select("*", (F.col("l_quantity") - 25.5).alias("centred_qty"),
                   (F.col("l_quantity") - 25.5).alias("centred_qty0"),
                   (F.col("l_quantity") - 25.5).alias("centred_qty2"))
    return rounded(transform.apply_yeo_johnson(df, dict(YJ_FIXED)), {"centred_qty2": 3})


@query("box_cox_sqrt")
def q_boxcox(spark, sf_dir):
    """Box-Cox with fixed lambdas (x <= 0 -> null) and square root."""
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                  "l_extendedprice"])
    df = transform.apply_box_cox(df, {"l_quantity": 0.3, "l_discount": 0.0})
    return rounded(transform.apply_sqrt(df, ["l_extendedprice"]))


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scaled(spark, sf_dir, method):
    df = _li_gaps(spark, sf_dir, ["l_orderkey", "l_linenumber", *SCALE_COLS])
    return rounded(scale.apply_scaler(df, scale.fit_scaler(df, SCALE_COLS, method)))


@query("scale_standard")
def q_scale_std(spark, sf_dir):
    """(x - mean) / population sd."""
    return _scaled(spark, sf_dir, "standard")


@query("scale_minmax")
def q_scale_mm(spark, sf_dir):
    """(x - min) / (max - min)."""
    return _scaled(spark, sf_dir, "minmax")


@query("scale_robust")
def q_scale_rb(spark, sf_dir):
    """(x - median) / IQR."""
    return _scaled(spark, sf_dir, "robust")


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@query("drop_constant")
def q_drop_constant(spark, sf_dir):
    """Columns whose top value holds >= 99 % of rows."""
    df = fixture(spark, sf_dir, "lineitem_selection")
    return _names(spark, select.quasi_constant(df, tol=0.99))


@query("drop_constant_clustering")
def q_drop_constant_cl(spark, sf_dir):
    """R18 with the clustering tolerance 0.98."""
    df = fixture(spark, sf_dir, "lineitem_selection")
    return _names(spark, select.quasi_constant(df, tol=0.98))


@query("drop_duplicates")
def q_drop_dup(spark, sf_dir):
    """Columns equal to an earlier column, keep first."""
    return _names(spark, select.duplicates(fixture(spark, sf_dir, "lineitem_selection")))


@query("drop_correlated")
def q_drop_corr(spark, sf_dir):
    """Greedy keep-first above |r| = 0.95."""
    df = fixture(spark, sf_dir, "lineitem_selection")
    return _names(spark, select.correlated(df, ["l_quantity", "l_extendedprice", "l_discount",
                                                "qty_copy", "price_copy", "flag_rare"], 0.95))


@query("target_label_roundtrip")
def q_target_label(spark, sf_dir):
    """Classes of o_orderstatus (sorted) applied to lineitem
    flags: unknown -> -1 -> 'UNKNOWN'."""
    st, _ = tgt.fit_target(table(spark, sf_dir, "orders"), "o_orderstatus", "classification")
    li = table(spark, sf_dir, "lineitem")
    fi = tgt.encode_target(st, F.col("l_returnflag"))
    si = tgt.encode_target(st, F.col("l_linestatus"))
    return li.select("l_orderkey", "l_linenumber", fi.alias("flag_idx"),
                     tgt.decode_label(st, fi).alias("flag_back"), si.alias("status_idx"),
                     tgt.decode_label(st, si).alias("status_back"))


@query("target_regression_fences")
def q_target_reg(spark, sf_dir):
    """Regression target capped at 3 IQR when any value lies beyond."""
    df = fixture(spark, sf_dir, "orders_gaps").select("o_orderkey", "o_totalprice")
    st, kept = tgt.fit_target(df, "o_totalprice", "regression")
    return rounded(kept.select("o_orderkey", tgt.encode_target(st).alias("o_totalprice")))


# ---------------------------------------------------------------- split, metrics, neighbours
from tabforge.operators import dbscan as dbs  # noqa: E402
from tabforge.operators import metrics as met  # noqa: E402
from tabforge.operators import neighbors as nbr  # noqa: E402
from tabforge.operators import split as spl  # noqa: E402
from tabforge.plans import plan as pl  # noqa: E402
from tabforge.plans import prep as pp  # noqa: E402


@query("split_stratified")
def q_split(spark, sf_dir):
    """M1: exact per-class test counts round(0.2 * n_class), deterministic."""
    s = spl.assign_split(table(spark, sf_dir, "orders"), 0.2, "o_orderstatus")
    return (s.groupBy("o_orderstatus")
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(spl.SPLIT_COL) == "train").alias("n_train"),
                  F.count_if(F.col(spl.SPLIT_COL) == "test").alias("n_test")))


@query("regression_metrics")
def q_reg_metrics(spark, sf_dir):
    """M17 for the prediction 'mean price of the (returnflag, linestatus) group'."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("yhat"))
    # no broadcast hint: AQE broadcasts the group table after measuring it
    pred = li.join(g, ["l_returnflag", "l_linestatus"])
    return rounded(met.regression_metrics(pred, "l_extendedprice", "yhat"))


@query("classification_metrics")
def q_cls_metrics(spark, sf_dir):
    """M18 for the prediction 'most frequent status of the order's priority'."""
    o = table(spark, sf_dir, "orders")
    freq = o.groupBy("o_orderpriority", "o_orderstatus").count()
    mode = freq.groupBy("o_orderpriority").agg(F.min_by("o_orderstatus", F.struct(
        (-F.col("count")).alias("c"), F.col("o_orderstatus").alias("s"))).alias("yhat"))
    pred = o.join(mode, "o_orderpriority")  # AQE broadcasts it once measured small
    return rounded(met.classification_metrics(pred, "o_orderstatus", "yhat"))


@query("clustering_metrics")
def q_cluster_metrics(spark, sf_dir):
    """M19-M21 for the given embedding labels taken as clusters."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(met.clustering_metrics(e, "embedding", "label", noise_label=None),
                   {"calinski_harabasz": 4})


@query("knn_neighbors")
def q_knn(spark, sf_dir):
    """M10 core: exact 5 nearest other vectors of every embedding."""
    e = table(spark, sf_dir, "embeddings")
    nb = nbr.knn(e, "vec_id", e, "vec_id", "embedding", k=5, exclude_self=True)
    return rounded(nb.select(F.col("qid").alias("vec_id"), "rank", F.col("rid").alias("neighbor_id"),
                             F.col("dist").alias("distance")))


@query("knn_classify")
def q_knn_cls(spark, sf_dir):
    """Leave-one-out 5-NN vote of the embedding labels."""
    e = table(spark, sf_dir, "embeddings")
    p = nbr.knn_classify(e, "vec_id", e, "vec_id", "embedding", "label", k=5, exclude_self=True)
    return p.select(F.col("qid").alias("vec_id"), F.col("prediction").cast("int").alias("prediction"),
                    "votes")


def _customer_std(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    st = c.agg(F.avg("c_acctbal").alias("ma"), F.stddev_pop("c_acctbal").alias("sa"),
               F.avg("c_nationkey").alias("mn"), F.stddev_pop("c_nationkey").alias("sn")).first()
    return c.select("c_custkey", ((F.col("c_acctbal") - st["ma"]) / st["sa"]).alias("a"),
                    ((F.col("c_nationkey") - st["mn"]) / st["sn"]).alias("b"))


@query("dbscan")
def q_dbscan(spark, sf_dir):
    """DBSCAN(eps 0.15, min 4) on standardised (balance, nation)."""
    return dbs.dbscan(_customer_std(spark, sf_dir), "c_custkey", ["a", "b"], eps=0.15, min_samples=4)


TASK_TABLES = ["orders", "lineitem", "customer", "part", "supplier", "nation", "events"]


@query("task_detection")
def q_task(spark, sf_dir):
    """T1 on the last column of each table."""
    rows = []
    for t in TASK_TABLES:
        lt, target = pl.detect_task(table(spark, sf_dir, t))
        rows.append((t, lt, target))
    return spark.createDataFrame(rows, "table_name string, learning_type string, target string")


ORDERS_PLAN = {
    "columns_to_drop": {"column_list": ["o_orderdate"], "reasons": {}},
    "columns_to_keep": {"column_list": ["o_custkey", "o_totalprice", "o_orderpriority"], "details": {}},
    "feature_engineering_suggestions": [
        {"new_feature": "price_per_cust", "source_columns": ["o_totalprice", "o_custkey"],
         "transformation": ["df['price_per_cust'] = df['o_totalprice'] / df['o_custkey']"]}],
    "pipeline_recommendation": {
        "step_1_missing_values": {"numeric_strategy": "mean", "categorical_strategy": "mode"},
        "step_2_outliers": {"method": "winsorize", "columns_affected": ["o_totalprice"],
                            "parameters": {"capping_method": "iqr", "fold": 1.5}},
        "step_3_encoding": {"onehot_columns": ["o_orderpriority"], "frequency_columns": []},
        "step_4_transformation": {"log_transform": [], "yeo_johnson": []},
        "step_5_scaling": {"method": "standard", "columns": []},
        "step_6_feature_selection": {"drop_constant": True},
    },
}


def _orders_config():
    return pl.TaskConfig("Supervised", "Classification", target="o_orderstatus", index_column="o_orderkey")


@query("prepare_orders")
def q_prepare_orders(spark, sf_dir):
    """Whole preparation chain (target, drop, impute, engineer, post-fill,
    winsorise, one-hot, scale, select) fitted on orders with gaps."""
    _, out = pp.fit(fixture(spark, sf_dir, "orders_gaps"), ORDERS_PLAN, _orders_config())
    return rounded(out)


@query("prepare_orders_transform")
def q_prepare_orders_t(spark, sf_dir):
    """Fitted state saved as JSON, reloaded, and applied to new rows (the
    orders without gaps): row count kept, no nulls left (R22)."""
    fp, _ = pp.fit(fixture(spark, sf_dir, "orders_gaps"), ORDERS_PLAN, _orders_config())
    again = pp.FittedPrep.from_json(fp.to_json())
    return rounded(again.transform(table(spark, sf_dir, "orders")))


# ---------------------------------------------------------------- training runs (rows-only checks)
from tabforge.operators import models as mdl  # noqa: E402
from tabforge.plans import automl  # noqa: E402

CLS_FAST = ["LogisticRegression", "KNN", "DecisionTree", "RandomForest"]
CLS_BOOST = ["GradientBoosting", "SecondOrderBoosting"]
REG_FAST = ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "RandomForest"]
REG_BOOST = ["GradientBoosting", "SecondOrderBoosting"]


ROUNDS = 20     # of the second-order boosting in these queries: a level is a job, so 100 rounds take minutes at any size


def _cls_run(spark, sf_dir, only):
    return automl.run_supervised(fixture(spark, sf_dir, "orders_gaps"), _orders_config(), ORDERS_PLAN,
                                 only=only, boost_rounds=ROUNDS)


def _leaderboard(lb: DataFrame) -> DataFrame:
    return lb.drop("fit_time", "hyperparameters", "error")


@query("train_classification")
def q_train_cls(spark, sf_dir):
    """Split, prepare on train, fit, rank."""
    return _leaderboard(_cls_run(spark, sf_dir, CLS_FAST).result.leaderboard)


@query("train_classification_boosted")
def q_train_cls_boost(spark, sf_dir):
    """M7/M8: boosted trees (one-vs-rest above two classes)."""
    return _leaderboard(_cls_run(spark, sf_dir, CLS_BOOST).result.leaderboard)


def _reg_config():
    return pl.TaskConfig("Supervised", "Regression", target="l_extendedprice")


def _reg_run(spark, sf_dir, only):
    df = fixture(spark, sf_dir, "lineitem_gaps").drop("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    return automl.run_supervised(df, _reg_config(), None, only=only, boost_rounds=ROUNDS)


@query("train_regression")
def q_train_reg(spark, sf_dir):
    """M2-M6, M17, M24 with the rule-built plan (T3) on lineitem."""
    r = _reg_run(spark, sf_dir, REG_FAST)
    return _leaderboard(r.result.leaderboard).join(r.advice.select("model_name", "verdict"), "model_name")


@query("train_regression_boosted")
def q_train_reg_boost(spark, sf_dir):
    """M7/M8 regression."""
    return _leaderboard(_reg_run(spark, sf_dir, REG_BOOST).result.leaderboard)


@query("train_clustering")
def q_train_clu(spark, sf_dir):
    """M12-M14, M16, M19-M22 on customer with the rule-built plan."""
    df = fixture(spark, sf_dir, "customer_gaps").drop("c_name")
    cfg = pl.TaskConfig("Unsupervised", "Clustering", index_column="c_custkey")
    return _leaderboard(automl.run_clustering(df, cfg).result.leaderboard)


@query("predict_batch")
def q_predict(spark, sf_dir):
    """Score raw orders with the fitted preparation and a logistic model:
    decoded class and confidence per order."""
    r = _cls_run(spark, sf_dir, ["LogisticRegression"])
    model = r.result.models["LogisticRegression"]
    return mdl.score(table(spark, sf_dir, "orders"), r.prep, model, keep=["o_orderkey"])


@query("predict_knn")
def q_predict_knn(spark, sf_dir):
    """The market segment of every customer by 5 neighbours among those whose key is not divisible
    by 4; the fitted index is stored, opened again and scored through the preparation."""
    import uuid

    from tabforge.session import checkpoint_dir
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    cfg = pl.TaskConfig("Supervised", "Classification", target="c_mktsegment", index_column="c_custkey")
    plan = {"columns_to_drop": {"column_list": []}, "columns_to_keep": {"column_list": []},
            "pipeline_recommendation": {"step_5_scaling": {"method": "standard", "columns": ["c_acctbal", "c_nationkey"]}}}
    train = c.where(F.col("c_custkey") % 4 != 0)
    prep, _ = pp.fit(train, pl.Plan(plan), cfg)
    path = f"{checkpoint_dir(spark).rstrip('/')}/knn-{uuid.uuid4().hex}"
    mdl.save_model(spark, mdl.KNNModelSpec(5).fit(mdl.training_vectors(train, prep, "c_custkey")), path)
    return mdl.score(c, prep, mdl.load_model(spark, path), keep=["c_custkey"])


@query("boosting_first_split")
def q_boosting(spark, sf_dir):
    """M8: the root of the first boosted tree on lineitem and its leaves' weights; the count of rows in each leaf."""
    from pyspark.ml.feature import VectorAssembler

    from tabforge.operators import boosting as bst
    names = ["l_quantity", "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select(*names, F.col("l_extendedprice").alias("label"))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(li)
    model = bst.SecondOrderBoosting("squared", bst.BoostParams(rounds=1, depth=1)).fit(data)
    tree = model.trees[0][0]
    name, edge = names[tree.feature[0]], tree.edge[0]
    out = model.transform(data).groupBy((F.col(name) <= edge).alias("left")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("prediction").alias("prediction"))
    return rounded(out.select(F.lit(name).alias("feature"), F.lit(edge).alias("edge"), "left", "n_rows", "prediction"),
                   {"prediction": 3, "edge": 4})


@query("plan_rules")
def q_plan(spark, sf_dir):
    """The rule-built plan of customer (classification on segment),
    one row per (section, column)."""
    cfg = pl.TaskConfig("Supervised", "Classification", target="c_mktsegment")
    p = pl.build_plan(fixture(spark, sf_dir, "customer_gaps"), cfg)
    pr = p["pipeline_recommendation"]
    rows = [("drop", c, "; ".join(p["columns_to_drop"]["reasons"].get(c, [])))
            for c in p["columns_to_drop"]["column_list"]]
    rows += [("keep", c, p["columns_to_keep"]["details"][c]["priority"])
             for c in p["columns_to_keep"]["column_list"]]
    for step, body in pr.items():
        for k, v in body.items():
            if isinstance(v, list):
                rows += [(f"{step}.{k}", c, "") for c in v]
            elif not isinstance(v, dict):
                rows.append((f"{step}.{k}", "", str(v)))
    return spark.createDataFrame(rows, "section string, column_name string, value string")


@query("infer_types")
def q_types(spark, sf_dir):
    """T2 + P6: every orders column written as text, types inferred back and
    applied (a column is cast only when every value parses)."""
    o = table(spark, sf_dir, "orders")
    txt = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])
    types = pl.infer_types(txt)
    back = pl.apply_types(txt, types)
    return spark.createDataFrame([(c, types.get(c), t) for c, t in back.dtypes],
                                 "column_name string, inferred string, applied string")


# ---------------------------------------------------------------- streaming
from tabforge.streaming import stream as stm  # noqa: E402


@query("stream_window_profile")
def q_stream_profile(spark, sf_dir):
    """Daily window profile of events.value per event type, computed by a
    streaming query over the events parquet (watermark 1 day)."""
    stream = stm.read_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    gapped = stream.select("event_id", "user_id", "ts", "event_type",
                           F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("value"))
                           .alias("value"))
    out = stm.run_to_memory(stm.windowed_profile(gapped, "ts", "value", "1 day", "1 day", ["event_type"]),
                            mode="complete")
    return rounded(out)


@query("stream_window_profile_batch")
def q_stream_profile_batch(spark, sf_dir):
    """X3 batch twin (same operator on a batch frame)."""
    return rounded(stm.windowed_profile(fixture(spark, sf_dir, "events_gaps"), "ts", "value", "1 day",
                                        "1 day", ["event_type"]))


@query("stream_score")
def q_stream_score(spark, sf_dir):
    """X1 + X2: orders read as a stream, scored with the batch-fitted
    preparation and model, appended to a Parquet prediction log."""
    r = _cls_run(spark, sf_dir, ["LogisticRegression"])
    stream = stm.read_stream(spark, f"{sf_dir}/orders.parquet", table(spark, sf_dir, "orders").schema)
    scored = stm.score_stream(stream, r.prep, r.result.models["LogisticRegression"], keep=["o_orderkey"])
    path = stm.scratch(spark, "prediction-log")
    stm.prediction_log(scored, path).awaitTermination()
    return spark.read.parquet(path).drop("logged_at")


# ---------------------------------------------------------------- sources and sinks
from tabforge.sources import loader, sinks  # noqa: E402


def _roundtrip(spark, sf_dir, fmt, **write_opts):
    c = table(spark, sf_dir, "customer")
    path = stm.scratch(spark, f"customer-{fmt}") + ("." + fmt if fmt != "parquet" else "")
    if fmt == "xml":
        c.write.format("xml").option("rootTag", "customers").option("rowTag", "customer").save(path)
        back = loader.load_table(spark, path, fmt="xml", row_tag="customer")
    else:
        sinks.write_table(c, path, fmt, **write_opts)
        back = loader.load_table(spark, path, fmt=fmt)
    back = pl.apply_types(back, {f.name: f.dataType.simpleString() for f in c.schema.fields})
    return rounded(back.select(*c.columns))


@query("source_csv")
def q_csv(spark, sf_dir):
    """Customer written as ';'-separated CSV, read back with
    delimiter detection and inferred types, re-typed (P6)."""
    return _roundtrip(spark, sf_dir, "csv", sep=";")


@query("source_json")
def q_json(spark, sf_dir):
    """JSON lines round trip."""
    return _roundtrip(spark, sf_dir, "json")


@query("source_parquet")
def q_parquet(spark, sf_dir):
    """S3: Parquet round trip."""
    return _roundtrip(spark, sf_dir, "parquet")


@query("source_xml")
def q_xml(spark, sf_dir):
    """XML round trip (row per element, all text, then re-typed)."""
    return _roundtrip(spark, sf_dir, "xml")


@query("prediction_history")
def q_history(spark, sf_dir):
    """Append two batches to a history table; count and last 10."""
    path = stm.scratch(spark, "history")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    # two batches that together hold every order: finished ones, then the rest
    sinks.append_history(o.where(F.col("o_orderstatus") == "F"), path)
    sinks.append_history(o.where(F.col("o_orderstatus") != "F"), path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- summary extras
@query("sample_values")
def q_samples(spark, sf_dir):
    """A4: five smallest distinct values of every lineitem column (with gaps)."""
    return prof.sample_values(fixture(spark, sf_dir, "lineitem_gaps"))


@query("memory_estimate")
def q_memory(spark, sf_dir):
    """A1 + A16: rows, columns and the memory estimate of lineitem with gaps."""
    df = fixture(spark, sf_dir, "lineitem_gaps")
    return rounded(spark.createDataFrame(
        [(prof.row_count(df), len(df.columns), prof.memory_estimate_mb(df))],
        "n_rows long, n_columns int, memory_mb double"))


@query("profile_insights")
def q_insights(spark, sf_dir):
    """Top missing / outlier columns and strongest correlations."""
    df = fixture(spark, sf_dir, "lineitem_gaps")
    ins = prof.insights(prof.missing_summary(df), prof.numeric_profile(df, LINEITEM_NUMERIC),
                        prof.correlations(df, LINEITEM_NUMERIC, keep_all=True))
    return rounded(ins)


@query("class_counts")
def q_class_counts(spark, sf_dir):
    """Class counts of the order status (stratification input)."""
    return prof.class_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("prep_report")
def q_prep_report(spark, sf_dir):
    """T8 + A17: columns added / removed and missing values before and after
    preparation of orders with gaps."""
    og = fixture(spark, sf_dir, "orders_gaps")
    fp, out = pp.fit(og, ORDERS_PLAN, _orders_config())
    feats = [c for c in og.columns if c not in ("o_orderstatus", "o_orderkey")]
    before = og.select(*feats).agg(*[F.count_if(F.col(c).isNull()) for c in feats]).first()
    after = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in out.columns]).first()
    rows = [("added", c, None) for c in fp.report["columns_added"]]
    rows += [("removed", c, None) for c in fp.report["columns_removed"]]
    rows += [("missing_before", None, int(sum(before))), ("missing_after", None, int(sum(after)))]
    return spark.createDataFrame(rows, "item string, column_name string, n long")


# ---------------------------------------------------------------- column types, closed windows, blank headers
@query("impute_integers")
def q_impute_integers(spark, sf_dir):
    """R1 on an integer column: the mean keeps its fraction."""
    df = fixture(spark, sf_dir, "lineitem_int_gaps")
    return rounded(impute.apply_fill(df, impute.fit_numeric(df, ["qty"], "mean")))


@query("winsorize_integers")
def q_winsor_integers(spark, sf_dir):
    """R8 on an integer column: fences with a fraction."""
    df = fixture(spark, sf_dir, "lineitem_spikes")
    return rounded(outliers.apply_clip(df, outliers.fit_fences(df, ["qty"], "gaussian", 1.5)))


@query("large_ids")
def q_large_ids(spark, sf_dir):
    """A3 and A9 on ids beyond 2^53, which doubles can't tell apart."""
    df = fixture(spark, sf_dir, "lineitem_large_ids")
    n, mode = prof.distinct_counts(df, ["id"])["id"], impute.modes(df, ["id"])["id"]
    return spark.createDataFrame([(n, mode)], "n_distinct long, mode long")


@query("prepare_types")
def q_prepare_types(spark, sf_dir):
    """Default plan (T4) on a boolean and a date, both with gaps: 0/1 and days, mean fill, standard scale."""
    df = fixture(spark, sf_dir, "orders_typed")
    cfg = pl.TaskConfig("Supervised", "Regression", target="o_totalprice", index_column="o_orderkey")
    fp, _ = pp.fit(df, pl.Plan.default(["urgent", "day"]), cfg)
    return rounded(fp.transform(df, keep_target=False))


@query("stream_windows_closed")
def q_stream_closed(spark, sf_dir):
    """X3 in append mode with a file sink: the windows that the watermark (one day) has closed."""
    stream = stm.read_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    return rounded(stm.closed_windows(stm.windowed_profile(stream, "ts", "value", "1 day", "1 day", ["event_type"]),
                                      stm.scratch(spark, "windows")))


@query("stream_window_quantiles")
def q_stream_quantiles(spark, sf_dir):
    """X3 with A5/A7 in append mode: quartiles of the closed daily windows from mergeable sketches, large enough to be
    exact for up to 32 768 values a window."""
    stream = stm.read_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    return rounded(stm.closed_windows(stm.windowed_quantiles(stream, "ts", "value", "1 day", "1 day", ["event_type"], k=32768),
                                      stm.scratch(spark, "window-quantiles")))


@query("incremental_profile")
def q_incremental(spark, sf_dir):
    """A2, A3, A5, A7 of orders from the sketches of its years: counts and extremes, and whether the distinct count and
    the ranks of the quartiles keep their bounds against the whole table."""
    from tabforge.functions import sketches as sk
    from tabforge.operators import profile as prof
    cols = ["o_custkey", "o_totalprice", "o_orderstatus"]
    o = table(spark, sf_dir, "orders")
    path = stm.scratch(spark, "profile-parts")
    year = F.year("o_orderdate")
    half = o.where(year < 1995)
    sk.add_parts(half, year, path, cols)
    sk.add_parts(o.where(year >= 1995), year, path, cols)
    sk.add_parts(half.where(year == 1993), year, path, cols)     # a part that comes again replaces itself
    got = sk.stored_profile(spark, path)
    checks = []
    for c in cols[:2]:
        v, m = F.col(c).cast("double"), F.lit(got.where(F.col("column_name") == c).first()["quantiles"][1])
        checks.append(o.agg(F.lit(c).alias("column_name"), F.count_distinct(c).alias("exact"),
                            F.avg((v < m).cast("int")).alias("below"), F.avg((v <= m).cast("int")).alias("upto")))
    checks.append(o.agg(F.lit(cols[2]).alias("column_name"), F.count_distinct(cols[2]).alias("exact"),
                        F.lit(None).cast("double").alias("below"), F.lit(None).cast("double").alias("upto")))
    off = sk.rank_error()
    return rounded(got.join(checks[0].unionByName(checks[1]).unionByName(checks[2]), "column_name").select(
        "column_name", "n_rows", "n_missing", "min", "max",
        (F.abs(F.col("n_distinct") - F.col("exact")) <= 4 * sk.distinct_error() * F.col("exact")).alias("distinct_within"),
        ((F.col("below") <= 0.5 + off) & (F.col("upto") >= 0.5 - off)).alias("median_within")))


@query("stream_log_once")
def q_stream_log(spark, sf_dir):
    """Orders logged as a stream, and the whole run replayed under a new checkpoint: each record is there once."""
    path = stm.scratch(spark, "log")
    for _ in range(2):
        s = stm.read_stream(spark, f"{sf_dir}/orders.parquet", table(spark, sf_dir, "orders").schema)
        stm.append_once(s.select("o_orderkey", "o_orderstatus"), path, "daily", stm.scratch(spark, "log-ckpt")).awaitTermination()
    return stm.logged_once(spark, path).select("o_orderkey", "o_orderstatus", F.col("run").cast("string").alias("run"))


@query("source_csv_blank_header")
def q_csv_blank_header(spark, sf_dir):
    """A file whose header row is blank takes its first record as header."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    lines = (n.select(F.concat_ws(";", *n.columns).alias("value"))
             .unionByName(spark.createDataFrame([(";".join([""] * 3),), (";".join(n.columns),)], "value string")))
    path = stm.scratch(spark, "blank-header")
    # the blank row and the names sort before the digits of the keys
    lines.orderBy(F.when(F.col("value").startswith(";"), 0).when(F.col("value").startswith("n_"), 1).otherwise(2),
                  "value").coalesce(1).write.text(path)
    return loader.load_table(spark, path, fmt="csv")


@query("history_last")
def q_history_last(spark, sf_dir):
    """The last 10 records of a history of two batches (a top-k report)."""
    path = stm.scratch(spark, "history")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append_history(o.where(F.col("o_orderstatus") == "F"), path)
    sinks.append_history(o.where(F.col("o_orderstatus") != "F"), path)
    return sinks.history_last(spark, path).drop("logged_at")


@query("linear_models")
def q_linear_models(spark, sf_dir):
    """M2, M3 and M25 on one feature: slope, intercept and summed predictions of the zoo's linear and ridge models."""
    from pyspark.ml.feature import VectorAssembler
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("label"))
    s = li.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("sd")).first()
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(li)
    zoo = mdl.regression_zoo(mdl.Context(n=s["n"], label_sd=s["sd"]))
    rows = []
    for name in ("LinearRegression", "Ridge"):
        m = zoo[name].fit(data)
        rows.append((name, float(m.coefficients[0]), float(m.intercept),
                     float(m.transform(data).agg(F.avg("prediction")).first()[0])))
    return rounded(spark.createDataFrame(rows, "model string, slope double, intercept double, mean_prediction double"),
                   {"slope": 3, "intercept": 2, "mean_prediction": 3})


@query("advice_rules")
def q_advice(spark, sf_dir):
    """Ranking and verdicts of a leaderboard whose scores come from the orders' statuses."""
    lb = fixture(spark, sf_dir, "orders_scores")
    return rounded(mdl.advice(mdl.rank_leaderboard(lb, "val_f1"), "Classification"))
