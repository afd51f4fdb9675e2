"""Fit a preparation plan on training rows and apply it to any rows.

``fit`` runs the fixed step order (target -> drop -> impute -> engineer ->
post-fill -> outliers -> encode -> transform -> scale -> select -> rename),
one or two aggregate passes per step, each over the lazily prepared frame of
the steps before.  The result, ``FittedPrep``, is pure data (numbers and
level lists, large level maps as parquet in the shared folder) and is saved
as JSON.  ``transform`` is one lazy chain of projections and level-map joins:
row-wise, so it keeps the row count, and the same code scores a stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, TimestampNTZType, TimestampType

from tabforge.functions.columns import col, normalise_missing, numeric_columns
from tabforge.functions.quantiles import exact_quantiles
from tabforge.functions.scalar import binary_feature, parse_operation
from tabforge.operators import encode, impute, outliers, scale, select, transform
from tabforge.operators.target import TargetState, apply_target, fit_target
from tabforge.plans.plan import Plan, TaskConfig
from tabforge.session import release, spread
from tabforge.trace import step

SANITISE = {"[": "_", "]": "_", "<": "_", ">": "_"}   # fixed: characters replaced in names


def sanitise(name: str) -> str:
    """P8."""
    for a, b in SANITISE.items():
        name = name.replace(a, b)
    return name


def as_numbers(df: DataFrame, skip: list[str]) -> DataFrame:
    """Booleans as 0 and 1, dates as days and timestamps as seconds since 1970, so that the steps for
    numbers apply to them."""
    def number(f):
        if f.name in skip:
            return col(f.name)
        if isinstance(f.dataType, BooleanType):
            return col(f.name).cast("int").alias(f.name)
        if isinstance(f.dataType, DateType):
            return F.unix_date(col(f.name)).alias(f.name)
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            return (F.unix_micros(col(f.name).cast("timestamp")) / F.lit(1e6)).alias(f.name)
        return col(f.name)

    kinds = (BooleanType, DateType, TimestampType, TimestampNTZType)
    if not any(isinstance(f.dataType, kinds) and f.name not in skip for f in df.schema.fields):
        return df
    return df.select(*[number(f) for f in df.schema.fields])


@dataclass
class FittedPrep:
    config: dict
    target: dict | None = None
    dropped: list = field(default_factory=list)
    num_fill: dict = field(default_factory=dict)
    cat_fill: dict = field(default_factory=dict)
    fill_steps: list = field(default_factory=list)        # forward/backward fill specs
    features: list = field(default_factory=list)          # [new, a, b, op]
    post_fill: dict = field(default_factory=dict)
    fences: dict = field(default_factory=dict)
    onehot: dict = field(default_factory=dict)
    drop_last: bool = False
    level_maps: list = field(default_factory=list)        # LevelMap json (frequency, label, target)
    log_shift: dict = field(default_factory=dict)
    yeo_johnson: dict = field(default_factory=dict)
    box_cox: dict = field(default_factory=dict)
    sqrt: list = field(default_factory=list)
    scaler: dict = field(default_factory=dict)
    scaler_method: str = "standard"
    selected_out: list = field(default_factory=list)
    rename: dict = field(default_factory=dict)
    input_columns: list = field(default_factory=list)
    output_columns: list = field(default_factory=list)
    target_folds: int = 0        # training rows get target means of the other folds
    target_columns: list = field(default_factory=list)
    smoothing: float = 10.0
    report: dict = field(default_factory=dict)

    # ------------------------------------------------------------ apply
    @property
    def task(self) -> TaskConfig:
        return TaskConfig(**self.config)

    @property
    def target_state(self) -> TargetState | None:
        return TargetState.from_json(self.target) if self.target else None

    def _features(self, df: DataFrame, upto: str = "end", folds: int = 0) -> DataFrame:
        """Apply the fitted steps in order; ``upto`` stops before a step (fit).  With ``folds``
        (training rows with the encoded target) target means leave out each row's own fold."""
        order = ["drop", "impute", "engineer", "post_fill", "outliers", "encode", "transform",
                 "scale", "select", "rename"]
        stop = order.index(upto) if upto in order else len(order)
        cfg = self.task
        if cfg.index_column and cfg.index_column in df.columns:
            df = df.drop(cfg.index_column)
        if 0 < stop:
            df = as_numbers(df.drop(*[c for c in self.dropped if c in df.columns]),
                            [self.target["name"]] if self.target else [])
        if 1 < stop:
            df = impute.apply_fill(df, {**self.num_fill, **self.cat_fill})
            for spec in self.fill_steps:
                fn = impute.forward_fill if spec["kind"] == "forward_fill" else impute.backward_fill
                df = fn(df, spec["columns"], spec["partition_by"], spec["order_by"])
        if 2 < stop:
            for new, a, b, op in self.features:
                if a in df.columns and b in df.columns:
                    df = df.withColumn(new, binary_feature(op, [a, b]))
        if 3 < stop:
            df = impute.apply_fill(df, self.post_fill)
        if 4 < stop:
            df = outliers.apply_clip(df, {c: tuple(v) for c, v in self.fences.items()})
        if 5 < stop:
            df = encode.apply_onehot(df, self.onehot, self.drop_last)
            maps = [encode.LevelMap.from_json(m) for m in self.level_maps]
            if folds:
                df = encode.target_out_of_fold(df, self.target_columns, self.target["name"], folds, self.smoothing)
                maps = [m for m in maps if m.column not in self.target_columns]
            df = encode.join_levels(df, maps)
        if 6 < stop:
            df = transform.apply_log(df, self.log_shift)
            df = transform.apply_yeo_johnson(df, self.yeo_johnson)
            df = transform.apply_box_cox(df, self.box_cox)
            df = transform.apply_sqrt(df, self.sqrt)
        if 7 < stop:
            df = scale.apply_scaler(df, {c: tuple(v) for c, v in self.scaler.items()})
        if 8 < stop:
            df = df.drop(*[c for c in self.selected_out if c in df.columns])
        if 9 < stop and self.rename:
            df = df.select(*[col(c).alias(self.rename.get(c, c)) for c in df.columns])
        return df

    def transform_training(self, df: DataFrame) -> DataFrame:
        """``transform`` of the training rows.  Where the plan asks for ``target_folds``, a row's
        target means come from the other folds, so its own target does not leak into its features."""
        if not self.target_folds or not self.target_columns:
            return self.transform(df)
        t = self.target_state
        out = self._features(apply_target(normalise_missing(df), t), folds=self.target_folds)
        out = impute.emergency_fill_except(out, [t.name])
        return out.select(*[col(c) for c in [*self.output_columns, t.name] if c in out.columns])

    def transform(self, df: DataFrame, keep_target: bool = True) -> DataFrame:
        """Prepared rows: never drops a row (R22); the target, when present
        and ``keep_target``, is encoded with the fitted state (R25).  Row by
        row, except that forward and backward fills look at the rows around
        (and so refuse a stream)."""
        df = normalise_missing(df)
        tstate = self.target_state
        if tstate and tstate.name in df.columns:
            df = apply_target(df, tstate) if keep_target else df.drop(tstate.name)
        out = self._features(df)
        out = impute.emergency_fill_except(out, [tstate.name] if tstate else [])
        keep = [c for c in self.output_columns if c in out.columns]
        if tstate and keep_target and tstate.name in out.columns:
            keep.append(tstate.name)
        return out.select(*[col(c) for c in keep])

    def transform_checked(self, df: DataFrame, action: Callable[[DataFrame], object]) -> DataFrame:
        """``transform`` whose contract is checked while ``action`` (a write, say) runs: as many
        rows out as in, and no null in a feature.  Counted on the way, without a pass of its own."""
        before, after = Observation(), Observation()
        out = self.transform(df.observe(before, F.count(F.lit(1)).alias("rows")))
        features = [c for c in self.output_columns if c in out.columns]
        out = out.observe(after, F.count(F.lit(1)).alias("rows"),
                          *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(features)])
        action(out)
        got = after.get
        if got["rows"] != before.get["rows"]:
            raise ValueError(f"{before.get['rows']} rows became {got['rows']}")
        holes = {c: got[f"n{i}"] for i, c in enumerate(features) if got[f"n{i}"]}
        if holes:
            raise ValueError(f"prepared features hold nulls: {holes}")
        return out

    def preparation_report(self, df: DataFrame) -> DataFrame:
        """(field, value) rows on shapes, missing values before and after, and the target."""
        def shape(frame: DataFrame, names: list[str]) -> tuple[int, int]:
            row = frame.agg(F.count(F.lit(1)).alias("rows"),
                            *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]).first()
            return row["rows"], sum(row[f"n{i}"] for i in range(len(names)))

        raw = normalise_missing(df)
        features = [c for c in self.input_columns if c in raw.columns and c != (self.target or {}).get("name")]
        (rows, missing), (rows_out, left) = shape(raw, features), shape(self.transform(df), self.output_columns)
        t = self.target or {}
        found = [("rows", rows), ("features", len(features)), ("missing", missing), ("prepared_rows", rows_out),
                 ("prepared_features", len(self.output_columns)), ("prepared_missing", left),
                 ("target", t.get("name", "")), ("target_rows_dropped", t.get("info", {}).get("dropped", 0)),
                 ("target_winsorised", bool(t.get("fences"))), ("target_classes", json.dumps(t.get("classes") or []))]
        return df.sparkSession.createDataFrame([(k, str(v)) for k, v in found], "field string, value string")

    def transform_target(self, df: DataFrame) -> DataFrame:
        return apply_target(df, self.target_state)

    # ------------------------------------------------------------ persistence
    def to_json(self) -> str:
        return json.dumps(self.__dict__, default=str)

    @classmethod
    def from_json(cls, text: str) -> FittedPrep:
        return cls(**json.loads(text))

    def save(self, path: str) -> None:
        """JSON state (no pickle) in ``path``/state and each level map that is a
        table in ``path``/levels-<i>, so that the folder is all one needs.  Written
        through Spark, so the path may be any filesystem the cluster reads."""
        from pyspark.sql import SparkSession
        spark, path = SparkSession.getActiveSession(), path.rstrip("/")
        state = json.loads(self.to_json())
        for i, m in enumerate(state["level_maps"]):
            if m.get("path"):
                spark.read.parquet(m["path"]).write.mode("overwrite").parquet(f"{path}/levels-{i}")
                m["path"] = f"levels-{i}"
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> FittedPrep:
        from pyspark.sql import SparkSession
        spark, path = SparkSession.getActiveSession(), path.rstrip("/")
        fp = cls.from_json(spark.read.text(f"{path}/state").first()["value"])
        for m in fp.level_maps:
            if m.get("path"):
                m["path"] = f"{path}/{m['path']}"
        return fp


def fit(df: DataFrame, plan: Plan | dict, config: TaskConfig, store_dir: str | None = None
        ) -> tuple[FittedPrep, DataFrame]:
    """Fit on training rows; returns the fitted state and the prepared training
    rows (rows with a missing target are removed, as at fit in the reference)."""
    plan = Plan(plan).validate(columns=df.columns, target=config.target)
    fp = FittedPrep(config=config.__dict__.copy())
    held = df = spread(normalise_missing(df))   # narrow inputs only; see session.spread
    fp.input_columns = [c for c in df.columns if c != config.index_column]
    tname = config.target if config.supervised else None
    if tname:
        with step("fit.target"):
            tstate, df = fit_target(df, tname, config.learning_type.lower())
        fp.target = tstate.to_json()
    elif config.target and config.target in df.columns:
        df = df.drop(config.target)

    def feats(d: DataFrame) -> list[str]:
        return [c for c in d.columns if c != tname]

    def numeric(d: DataFrame) -> list[str]:
        return [c for c in numeric_columns(d) if c != tname]

    def text(d: DataFrame) -> list[str]:
        return [c for c in d.columns if c != tname and d.schema[c].dataType.simpleString() == "string"]

    base = df.drop(config.index_column) if config.index_column and config.index_column in df.columns else df
    original = feats(base)
    pr = plan["pipeline_recommendation"]

    # step 0: drop
    fp.dropped = [c for c in plan["columns_to_drop"].get("column_list", []) if c in original]
    cur = fp._features(df, upto="impute")

    # step 1: missing values
    m = pr.get("step_1_missing_values", {}) or {}
    strategy = m.get("numeric_strategy", "median" if config.clustering else "mean")
    if strategy == "drop":
        cur_cols = feats(cur)
        df = impute.drop_missing_rows(df, [c for c in cur_cols])
        cur = fp._features(df, upto="impute")
    elif strategy in ("forward_fill", "backward_fill"):
        order_by, part = m.get("order_by"), m.get("partition_by", [])
        if not order_by:
            raise ValueError(f"{strategy} needs 'order_by' in step_1_missing_values")
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        nulls = impute.null_counts(cur, [c for c in feats(cur) if c not in part and c not in order])
        fp.fill_steps = [{"kind": strategy, "columns": [c for c, n in nulls.items() if n > 0],
                          "partition_by": part, "order_by": order_by}]
    else:
        with step("fit.impute_numeric"):
            fp.num_fill = impute.fit_numeric(cur, numeric(cur), strategy)
    cat_strategy = m.get("categorical_strategy", "mode")
    if cat_strategy in ("mode", "most_frequent", "frequent"):
        with step("fit.impute_text"):
            fp.cat_fill = impute.fit_categorical(cur, text(cur))
    cur = fp._features(df, upto="engineer")

    # step 2: feature engineering (a rule may use an earlier new column)
    for s in plan.get("feature_engineering_suggestions", []) or []:
        src = s.get("source_columns", [])
        if len(src) != 2 or not all(c in cur.columns for c in src):
            continue
        op = s.get("operation") or parse_operation(s.get("transformation", []), src)
        if op is None:
            continue
        fp.features.append([s["new_feature"], src[0], src[1], op])
        cur = cur.withColumn(s["new_feature"], binary_feature(op, src))

    # post-engineering fill: fitted imputer value, else fit-time median / 'missing'
    with step("fit.post_fill_nulls"):
        nulls = impute.null_counts(cur, feats(cur))
    holes = [c for c, n in nulls.items() if n > 0]
    num_holes = [c for c in holes if c in numeric(cur) and c not in fp.num_fill]
    med = exact_quantiles(cur, {c: [0.5] for c in num_holes}) if num_holes else {}
    for c in holes:
        if c in fp.num_fill:
            fp.post_fill[c] = fp.num_fill[c]
        elif c in med:
            fp.post_fill[c] = med[c][0] if med[c][0] is not None else 0.0
        else:
            fp.post_fill[c] = "missing"
    cur = fp._features(df, upto="outliers")

    # step 3: outliers
    o = pr.get("step_2_outliers", {}) or {}
    method = o.get("method", "winsorize")
    engineered = [c for c in numeric(cur) if c not in original]
    cand = list(dict.fromkeys([c for c in o.get("columns_affected", []) if c in numeric(cur)] + engineered))
    with step("fit.outlier_eligible"):
        ok, skipped = outliers.eligible(cur, cand)
    params = o.get("parameters", {}) or {}
    fold = float(params.get("fold", 1.5))
    if config.clustering:
        fold = max(fold, 2.0)
    if ok:
        if method == "winsorize":
            with step("fit.fences"):
                fp.fences = {c: list(v) for c, v in outliers.fit_fences(
                    cur, ok, params.get("capping_method", "iqr"), fold).items()}
        elif method == "clip":
            lo, hi = params.get("lower"), params.get("upper")
            fp.fences = {c: [lo, hi] for c in ok}
        elif method == "remove":
            fences = outliers.fit_fences(cur, ok, params.get("capping_method", "iqr"), fold)
            df = _filter_like(df, fp, fences)
        else:
            raise ValueError(f"unknown outlier method {method!r}")
    fp.report["outliers_skipped"] = skipped
    cur = fp._features(df, upto="encode")

    # step 4: encoding
    e = pr.get("step_3_encoding", {}) or {}
    onehot_cols = [c for c in e.get("onehot_columns", []) if c in cur.columns and c != tname]
    with step("fit.onehot"):
        fp.onehot = encode.fit_onehot(cur, onehot_cols)
    fp.drop_last = config.clustering
    maps = []
    maps += encode.fit_frequency(cur, [c for c in e.get("frequency_columns", [])
                                       if c in cur.columns and c != tname], store_dir)
    maps += encode.fit_label(cur, [c for c in e.get("label_columns", [])
                                   if c in cur.columns and c != tname], store_dir)
    tcols = [c for c in e.get("target_columns", []) if c in cur.columns and c != tname]
    if tcols and tname:
        enc_t = apply_target(cur, TargetState.from_json(fp.target))
        maps += encode.fit_target(enc_t, tcols, tname, float(e.get("smoothing", 10.0)), store_dir)
        fp.target_folds = int(e.get("target_folds", 0))
        fp.smoothing = float(e.get("smoothing", 10.0))
        fp.target_columns = tcols
    fp.level_maps = [mp.to_json() for mp in maps]
    cur = fp._features(df, upto="transform")

    # step 5: transformations (supervised only, as in the reference)
    t = pr.get("step_4_transformation", {}) or {}
    if config.supervised:
        nums = set(numeric(cur))
        fp.log_shift = transform.fit_log_shift(cur, [c for c in t.get("log_transform", []) if c in nums])
        fp.yeo_johnson = transform.fit_yeo_johnson(
            cur, [c for c in t.get("yeo_johnson", t.get("yeo-johnson", [])) if c in nums])
        fp.box_cox = transform.fit_box_cox(cur, [c for c in t.get("boxcox", []) if c in nums])
        fp.sqrt = [c for c in t.get("sqrt", []) if c in nums]
    cur = fp._features(df, upto="scale")

    # step 6: scaling
    s = pr.get("step_5_scaling", {}) or {}
    fp.scaler_method = s.get("method", "standard")
    cols = [c for c in s.get("columns", []) if c in cur.columns and c != tname]
    if not cols:
        cols = numeric(cur)
    with step("fit.scaler"):
        fp.scaler = {c: list(v) for c, v in scale.fit_scaler(cur, cols, fp.scaler_method).items()}
    cur = fp._features(df, upto="select")

    # step 7: feature selection
    sel = pr.get("step_6_feature_selection", {}) or {}
    out = []
    fcols = feats(cur)
    if len(fcols) >= 2:
        tol = select.CONSTANT_TOL_CLUSTERING if config.clustering else select.CONSTANT_TOL
        with step("fit.constant+duplicates"):
            const, dup = select.constant_and_duplicates(
                cur, fcols, tol if sel.get("drop_constant", True) else None,
                drop_dup=sel.get("drop_duplicates", True))
        out += const + dup
        rest = [c for c in fcols if c not in out]
        if sel.get("drop_correlated", False) and len(rest) >= 2:
            out += select.correlated(cur, [c for c in rest if c in numeric(cur)],
                                     float(sel.get("correlation_threshold", 0.95)))
    fp.selected_out = out
    cur = fp._features(df, upto="rename")
    fp.rename = {c: sanitise(c) for c in feats(cur) if sanitise(c) != c}
    final = [fp.rename.get(c, c) for c in feats(cur)]
    if len(set(final)) != len(final):
        raise ValueError(f"column names clash after sanitising: {final}")
    fp.output_columns = final
    fp.report.update({
        "learning_type": config.learning_type,
        "original_columns": original, "final_columns": final,
        "columns_added": sorted(set(final) - set(original)),
        "columns_removed": sorted(set(original) - set(final)),
        "transformers_applied": [k for k, v in [
            ("dropped_columns", fp.dropped), ("numeric_imputer", fp.num_fill),
            ("categorical_imputer", fp.cat_fill), ("winsorizer", fp.fences),
            ("onehot_encoder", fp.onehot), ("level_maps", fp.level_maps),
            ("log_transformer", fp.log_shift), ("yeo_johnson_transformer", fp.yeo_johnson),
            ("scaler", fp.scaler), ("feature_selection", fp.selected_out)] if v],
    })
    release(held)
    return fp, fp.transform_training(df)


def _filter_like(df: DataFrame, fp: FittedPrep, fences) -> DataFrame:
    """Remove (at fit) the training rows whose prepared value lies outside a
    fence.  The condition is evaluated on the prepared columns, and the raw
    columns are kept."""
    cond = F.lit(True)
    for c, (lo, hi) in fences.items():
        x = col(c).cast("double")
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (x >= F.lit(lo))
        if hi is not None:
            inside = inside & (x <= F.lit(hi))
        cond = cond & (x.isNull() | inside)
    # prepared is a row-wise projection of df: carry the raw columns through it
    raw = [c for c in df.columns]
    tagged = df.select(*[col(c) for c in raw],
                       F.struct(*[col(c) for c in raw]).alias("__raw"))
    prepared = fp._features(tagged, upto="outliers")
    return prepared.where(cond).select("__raw.*")


__all__ = ["FittedPrep", "fit", "sanitise"]
