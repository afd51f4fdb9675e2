"""Task configuration, task detection, type inference and the preparation
plan (T1-T10).

The plan keeps the reference's JSON shape (``columns_to_drop``,
``columns_to_keep``, ``feature_engineering_suggestions``,
``pipeline_recommendation`` with ``step_1`` .. ``step_6``, ``summary``).
Where the reference asked a language model for it, ``build_plan`` derives it
by fixed rules from the profile tables.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.columns import (INTEGRAL_TYPES, categorical_columns, col,
                                        numeric_columns)

ML_TYPES = ("Supervised", "Unsupervised")
LEARNING_TYPES = ("Regression", "Classification", "Clustering")
# The reference's settings that are stored but read by no operator.
PROCESSING_TYPES = ("Training-Alone", "Pre-Processes+Training")
HARDWARE = ("CPU", "GPU", "Hybrid")
REQUIRED_KEYS = ("columns_to_drop", "columns_to_keep", "pipeline_recommendation")

# Fixed values of the reference's rules.
CLASSIFICATION_MAX_DISTINCT = 20      # T1: last column with <= 20 distinct values ...
CLASSIFICATION_MAX_RATIO = 0.05       # ... and distinct/rows < 0.05 is a class label
DROP_MISSING_PCT = 60.0               # T3: drop a column with more than 60 % missing
ONEHOT_MAX_DISTINCT = 10              # T3 rule: one-hot up to 10 levels, else frequency
SKEW_LIMIT = 1.0                      # T3 rule: |skewness| above this is transformed
CATEGORY_RATIO = 0.5                  # T2: text with < 50 % unique values is a category
PRIORITY_RANK = {"high": 3, "medium": 2, "low": 1}


@dataclass
class TaskConfig:
    """Validated task configuration."""
    ml_type: str = "Supervised"
    learning_type: str = "Classification"
    target: str | None = None
    index_column: str | None = None
    test_size: float = 0.2
    # stored with the run (as in the reference); no operator reads them
    processing_type: str = "Pre-Processes+Training"
    acceleration_hardware: str = "CPU"
    hyper_parameter_tuning: bool = False

    def __post_init__(self):
        if self.ml_type not in ML_TYPES:
            raise ValueError(f"ml_type must be one of {ML_TYPES}, got {self.ml_type!r}")
        if self.learning_type not in LEARNING_TYPES:
            raise ValueError(f"learning_type must be one of {LEARNING_TYPES}, got {self.learning_type!r}")
        if self.ml_type == "Supervised" and not self.target:
            raise ValueError("a supervised task needs a target column")
        if not 0.05 <= self.test_size <= 0.5:
            raise ValueError("test_size must lie in [0.05, 0.5]")
        if self.processing_type not in PROCESSING_TYPES:
            raise ValueError(f"processing_type must be one of {PROCESSING_TYPES}, got {self.processing_type!r}")
        if self.acceleration_hardware not in HARDWARE:
            raise ValueError(f"acceleration_hardware must be one of {HARDWARE}, got {self.acceleration_hardware!r}")

    @property
    def clustering(self) -> bool:
        return self.learning_type == "Clustering"

    @property
    def supervised(self) -> bool:
        return self.learning_type in ("Regression", "Classification")


def detect_task(df: DataFrame) -> tuple[str, str | None]:
    """Look at the last column (one aggregate pass)."""
    last = df.columns[-1]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col(last)).alias("d")).first()
    n, d = int(r["n"]), int(r["d"])
    if n == 0:
        raise ValueError("empty input")
    if d == 1:
        return "Clustering", None
    if d <= CLASSIFICATION_MAX_DISTINCT and d / n < CLASSIFICATION_MAX_RATIO:
        return "Classification", last
    if last in numeric_columns(df):
        return "Regression", last
    return "Classification", last


# ---------------------------------------------------------------- T2 types
_INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767),
               ("int", -2**31, 2**31 - 1), ("bigint", -2**63, 2**63 - 1)]


def infer_types(df: DataFrame) -> dict[str, str]:
    """Deterministic dtype rules, one aggregate pass.

    Integers -> smallest sufficient integer type; text whose every non-null
    value parses -> bigint / double / boolean / timestamp; other text stays
    string ('category' when < 50 % of values are unique)."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL_TYPES)]
    txt = categorical_columns(df)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(ints):
        aggs += [F.min(col(c)).alias(f"imin{i}"), F.max(col(c)).alias(f"imax{i}")]
    for i, c in enumerate(txt):
        v = F.trim(col(c))
        aggs += [F.count(v).alias(f"tn{i}"),
                 F.count(v.try_cast("bigint")).alias(f"tl{i}"),
                 F.count(v.try_cast("double")).alias(f"td{i}"),
                 F.count_if(F.lower(v).isin("true", "false")).alias(f"tb{i}"),
                 F.count(F.try_to_timestamp(v)).alias(f"tt{i}"),
                 F.approx_count_distinct(v).alias(f"tu{i}")]
    r = df.agg(*aggs).first()
    out: dict[str, str] = {}
    for i, c in enumerate(ints):
        lo, hi = r[f"imin{i}"], r[f"imax{i}"]
        if lo is None:
            continue
        for name, a, b in _INT_RANGES:
            if a <= lo and hi <= b:
                out[c] = name
                break
    for i, c in enumerate(txt):
        n = r[f"tn{i}"]
        if not n:
            continue
        if r[f"tl{i}"] == n:
            out[c] = "bigint"
        elif r[f"td{i}"] == n:
            out[c] = "double"
        elif r[f"tb{i}"] == n:
            out[c] = "boolean"
        elif r[f"tt{i}"] == n:
            out[c] = "timestamp"
        elif r[f"tu{i}"] < CATEGORY_RATIO * n:
            out[c] = "category"
        else:
            out[c] = "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast by a name -> type map; unknown names ignored; a column is cast
    only if no non-null value fails (pandas keeps the old dtype otherwise)."""
    todo = {c: ("string" if t == "category" else t) for c, t in types.items() if c in df.columns}
    todo = {c: t for c, t in todo.items() if df.schema[c].dataType.simpleString() != t}
    if not todo:
        return df
    r = df.agg(*[F.count_if(col(c).isNotNull() & F.trim(col(c)).try_cast(t).isNull()).alias(f"f{i}")
                 if df.schema[c].dataType.simpleString() == "string"
                 else F.count_if(col(c).isNotNull() & col(c).try_cast(t).isNull()).alias(f"f{i}")
                 for i, (c, t) in enumerate(todo.items())]).first()
    ok = {c: t for i, (c, t) in enumerate(todo.items()) if int(r[f"f{i}"]) == 0}
    return df.select(*[(F.trim(col(c)) if df.schema[c].dataType.simpleString() == "string"
                        else col(c)).try_cast(ok[c]).alias(c) if c in ok else col(c)
                       for c in df.columns])


# ---------------------------------------------------------------- plan
class Plan(dict):
    """A preparation plan (plain JSON-shaped dict) with validation helpers."""

    @classmethod
    def default(cls, columns: list[str]) -> Plan:
        """T4: drop nothing, keep all, empty pipeline."""
        return cls({
            "columns_to_drop": {"column_list": [], "reasons": {}},
            "columns_to_keep": {"column_list": list(columns), "details": {}},
            "feature_engineering_suggestions": [],
            "pipeline_recommendation": {},
            "summary": {"original_features": len(columns), "recommended_features": len(columns),
                        "features_dropped": 0, "new_features_created": 0,
                        "expected_model_improvement": "Default plan", "key_insights": []},
        })

    @classmethod
    def from_json(cls, text: str | dict) -> Plan:
        d = json.loads(text) if isinstance(text, str) else copy.deepcopy(text)
        return cls(d).validate()

    def to_json(self) -> str:
        return json.dumps(self, indent=2, sort_keys=False, default=str)

    def validate(self, columns: list[str] | None = None, target: str | None = None) -> Plan:
        """T5 + P9: the plan has all sections and names only ``columns`` (when
        given); returns a copy whose drop and keep lists lack the target."""
        absent = sorted(set(REQUIRED_KEYS) - set(self))
        if absent:
            raise ValueError(f"the plan lacks {', '.join(absent)}")
        if columns is not None:
            levels = tuple(f"{c}_" for c in (self["pipeline_recommendation"].get("step_3_encoding") or {})
                           .get("onehot_columns", []))  # later steps may name the columns of single levels
            unknown = sorted(c for c in self.named_columns() - set(columns) if not (levels and c.startswith(levels)))
            if unknown:
                raise ValueError(f"the plan names columns that the table lacks: {', '.join(unknown)}")
        out = Plan(copy.deepcopy(dict(self)))
        if target:
            for section in ("columns_to_drop", "columns_to_keep"):
                out[section]["column_list"] = [c for c in out[section].get("column_list", []) if c != target]
        return out

    def named_columns(self) -> set[str]:
        """Input columns that the plan names (columns that it makes itself excluded)."""
        made = {s.get("new_feature") for s in self.get("feature_engineering_suggestions", []) or []}
        named = {c for k in ("columns_to_drop", "columns_to_keep") for c in self[k].get("column_list", [])}
        named |= {c for s in self.get("feature_engineering_suggestions", []) or [] for c in s.get("source_columns", [])}
        for part in (self.get("pipeline_recommendation", {}) or {}).values():
            named |= {c for v in (part or {}).values() if isinstance(v, list) for c in v if isinstance(c, str)}
        return named - made

    def step(self, name: str) -> dict:
        return self["pipeline_recommendation"].get(name, {}) or {}


def build_plan(df: DataFrame, config: TaskConfig, report: dict[str, DataFrame] | None = None) -> Plan:
    """Preparation plan by fixed rules from the profile.

    Rules: drop identifiers (distinct == rows, integer or text), columns with
    > 60 % missing, constant columns; impute median (mean when no numeric
    outliers, median always for clustering), mode for text; winsorise columns
    with IQR outliers; one-hot text up to 10 levels, else frequency; log (min
    > 0) or Yeo-Johnson for |skew| > 1; standard scaling (mandatory for
    clustering); drop quasi-constant columns."""
    from tabforge.operators.profile import categorical_profile, numeric_profile
    feats = [c for c in df.columns if c not in (config.target, config.index_column)]
    fdf = df.select(*[col(c) for c in feats])
    num_cols = numeric_columns(fdf)
    txt_cols = categorical_columns(fdf)
    num = {r["column_name"]: r.asDict() for r in
           (report["numeric"] if report else numeric_profile(fdf, num_cols)).collect()}
    cat = {r["column_name"]: r.asDict() for r in
           (report["categorical"] if report else categorical_profile(fdf, txt_cols)).collect()} \
        if txt_cols else {}
    skew = {}
    if num_cols:
        r = fdf.agg(*[F.skewness(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(num_cols)]).first()
        skew = {c: r[f"s{i}"] for i, c in enumerate(num_cols)}
    n_rows = next(iter(num.values()))["n_rows"] if num else (
        next(iter(cat.values()))["n_rows"] if cat else 0)

    drop, reasons = [], {}
    for c in feats:
        p = num.get(c) or cat.get(c)
        if p is None:
            drop.append(c)
            reasons[c] = ["unsupported type for modelling"]
            continue
        why = []
        is_int = c in num and p["dtype"] in ("tinyint", "smallint", "int", "bigint")
        if (is_int or c in cat) and n_rows and p["n_distinct"] == n_rows:
            why.append("identifier: every value unique")
        if p["missing_pct"] is not None and p["missing_pct"] > DROP_MISSING_PCT:
            why.append(f"{p['missing_pct']:.1f}% missing values")
        if p["n_distinct"] <= 1:
            why.append("constant: no variance")
        if why:
            drop.append(c)
            reasons[c] = why
    keep = [c for c in feats if c not in drop]
    details = {}
    for c in keep:
        p = num.get(c) or cat.get(c)
        mp = p["missing_pct"] or 0.0
        details[c] = {"reason": "kept by rule", "priority":
                      "high" if mp < 5 else ("medium" if mp < 30 else "low"),
                      "confidence": round(1.0 - mp / 100.0, 3),
                      "evidence": {"missing_pct": mp, "unique_count": p["n_distinct"],
                                   "dtype": p["dtype"], "outliers": p.get("n_outliers", 0)}}
    k_num = [c for c in keep if c in num]
    k_txt = [c for c in keep if c in cat]
    has_out = any((num[c]["n_outliers"] or 0) > 0 for c in k_num)
    strategy = "median" if (config.clustering or has_out) else "mean"
    winsor = [c for c in k_num if (num[c]["n_outliers"] or 0) > 0]
    onehot = [c for c in k_txt if cat[c]["n_distinct"] <= ONEHOT_MAX_DISTINCT]
    freq = [c for c in k_txt if c not in onehot]
    log_cols, yj_cols = [], []
    for c in k_num:
        s = skew.get(c)
        if s is not None and abs(s) > SKEW_LIMIT and c not in winsor:
            (log_cols if (num[c]["min"] or 0) > 0 else yj_cols).append(c)
    plan = Plan({
        "columns_to_drop": {"column_list": drop, "reasons": reasons},
        "columns_to_keep": {"column_list": keep, "details": details},
        "feature_engineering_suggestions": [],
        "pipeline_recommendation": {
            "step_1_missing_values": {"numeric_strategy": strategy, "categorical_strategy": "mode",
                                      "columns_affected": keep},
            "step_2_outliers": {"method": "winsorize", "columns_affected": winsor,
                                "parameters": {"capping_method": "iqr", "fold": 1.5}},
            "step_3_encoding": {"onehot_columns": onehot, "frequency_columns": freq,
                                "parameters": {"drop": "first"}},
            "step_4_transformation": {"log_transform": log_cols, "yeo_johnson": yj_cols},
            "step_5_scaling": {"method": "standard", "columns": []},
            "step_6_feature_selection": {"drop_correlated": False, "correlation_threshold": 0.95,
                                         "drop_constant": True},
        },
        "summary": {"original_features": len(feats),
                    "recommended_features": len(keep), "features_dropped": len(drop),
                    "new_features_created": 0,
                    "expected_model_improvement": "rule-based plan", "key_insights": []},
    })
    return plan.validate(target=config.target)


def ranked_columns(spark: SparkSession, plan: Plan, k: int = 6) -> DataFrame:
    """The ``k`` kept columns of the highest priority (ties by confidence, then name)."""
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY_RANK.items() for x in kv])
    rows = [(c, d.get("priority", "low"), float(d.get("confidence") or 0.0), d.get("reason", ""))
            for c, d in plan["columns_to_keep"].get("details", {}).items()]
    kept = spark.createDataFrame(rows, "column_name string, priority string, confidence double, reason string")
    rank = F.coalesce(F.try_element_at(ranks, F.col("priority")), F.lit(0))
    return kept.orderBy(rank.desc(), F.col("confidence").desc(), "column_name").limit(k)


def plan_steps(spark: SparkSession, plan: Plan) -> DataFrame:
    """What the plan does, one row per (step, column or setting)."""
    rows = [("drop", c, "; ".join(plan["columns_to_drop"].get("reasons", {}).get(c, [])))
            for c in plan["columns_to_drop"].get("column_list", [])]
    for name, part in (plan.get("pipeline_recommendation", {}) or {}).items():
        for setting, v in (part or {}).items():
            rows += [(name, c, setting) for c in v] if isinstance(v, list) else [(name, setting, str(v))]
    return spark.createDataFrame(rows, "step string, subject string, detail string")


def text_report(plan: Plan, config: TaskConfig, n_rows: int, n_cols: int, score: float) -> str:
    """A plan in words, as Markdown."""
    s = plan.get("summary", {})
    kept = sorted(plan["columns_to_keep"].get("details", {}).items(),
                  key=lambda kv: (-PRIORITY_RANK.get(kv[1].get("priority", "low"), 0), kv[0]))
    out = [f"# Preparation of {n_rows} rows by {n_cols} columns", "",
           f"{config.learning_type} task" + (f" on `{config.target}`" if config.target else " without a target")
           + f"; table quality {score} of 100.",
           f"{s.get('recommended_features', 0)} of {s.get('original_features', 0)} features stay, "
           f"{s.get('new_features_created', 0)} are made."]
    for c in plan["columns_to_drop"].get("column_list", []):
        why = plan["columns_to_drop"].get("reasons", {}).get(c, [])
        out.append(f"* without `{c}`" + (f" ({', '.join(why)})" if why else ""))
    for c, d in kept[:5]:
        out.append(f"* with `{c}` ({d.get('priority', 'low')} priority, confidence {d.get('confidence')})")
    return "\n".join(out)
