"""Oracle SQL (DuckDB dialect, ANSI where possible) for the registered queries.

Every statement reads the pre-registered table views; fixture views are
inlined as CTEs from the same SQL text Spark runs.
"""

from __future__ import annotations

from tabforge.sources.tables import fixture_cte

ORACLE: dict[str, str] = {}

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                  "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                  "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                  "l_linestatus": "string", "l_shipdate": "timestamp"}
LINEITEM_ALL = list(LINEITEM_TYPES)


def _r(expr: str, d: int = 6) -> str:
    return f"ROUND({expr}, {d})"


def _numeric_profile_sql(src: str, cols: list[str], types: dict[str, str], fold: float = 1.5) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
        SELECT '{c}' AS column_name, '{types[c]}' AS dtype,
               COUNT(*) AS n_rows, COUNT(*) - COUNT({x}) AS n_missing,
               (COUNT(*) - COUNT({x})) * 100.0 / COUNT(*) AS missing_pct,
               COUNT(DISTINCT {c}) AS n_distinct,
               MIN({x}) AS min, MAX({x}) AS max, AVG({x}) AS mean,
               STDDEV_SAMP({x}) AS std, VAR_SAMP({x}) AS variance,
               QUANTILE_CONT({x}, 0.25) AS q1, QUANTILE_CONT({x}, 0.5) AS median,
               QUANTILE_CONT({x}, 0.75) AS q3
        FROM {src}""")
    stats = " UNION ALL ".join(parts)
    outl = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM {src}" for c in cols)
    return f"""
    , stats AS ({stats}),
    fenced AS (SELECT *, q1 - {fold} * (q3 - q1) AS lower_fence,
                         q3 + {fold} * (q3 - q1) AS upper_fence FROM stats),
    cells AS ({outl}),
    outl AS (SELECT f.column_name,
                    COUNT(c.x) FILTER (WHERE c.x < f.lower_fence OR c.x > f.upper_fence) AS n_outliers
             FROM fenced f JOIN cells c ON c.column_name = f.column_name
             GROUP BY f.column_name)
    , prof AS (
    SELECT f.column_name, f.dtype, f.n_rows, f.n_missing, {_r('f.missing_pct')} AS missing_pct,
           f.n_distinct, {_r('f.min')} AS min, {_r('f.max')} AS max, {_r('f.mean')} AS mean,
           {_r('f.std')} AS std, {_r('f.variance', 2)} AS variance,
           {_r('f.q1')} AS q1, {_r('f.median')} AS median, {_r('f.q3')} AS q3,
           {_r('f.lower_fence')} AS lower_fence, {_r('f.upper_fence')} AS upper_fence,
           COALESCE(o.n_outliers, 0) AS n_outliers, f.n_distinct < 20 AS likely_categorical,
           {_r("CASE WHEN f.mean <> 0 THEN f.std / f.mean END")} AS cv
    FROM fenced f LEFT JOIN outl o ON o.column_name = f.column_name)"""


ORACLE["numeric_profile"] = (fixture_cte("lineitem_gaps")[:-1]
                             + _numeric_profile_sql("lineitem_gaps", LINEITEM_NUMERIC, LINEITEM_TYPES)
                             + " SELECT * FROM prof")


def _cat_profile_sql(src: str, cols: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {src}" for c in cols)
    return f"""
    , cells AS ({cells}),
    freq AS (SELECT column_name, value, COUNT(*) AS cnt FROM cells GROUP BY column_name, value),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name
                        ORDER BY cnt DESC, value ASC) AS rn
               FROM freq WHERE value IS NOT NULL)
    SELECT f.column_name, 'string' AS dtype, SUM(f.cnt) AS n_rows,
           COALESCE(SUM(f.cnt) FILTER (WHERE f.value IS NULL), 0) AS n_missing,
           ROUND(COALESCE(SUM(f.cnt) FILTER (WHERE f.value IS NULL), 0) * 100.0 / SUM(f.cnt), 6)
             AS missing_pct,
           COUNT(f.value) AS n_distinct,
           MAX(r.value) AS most_frequent, MAX(r.cnt) AS top_count
    FROM freq f LEFT JOIN ranked r ON r.column_name = f.column_name AND r.rn = 1
    GROUP BY f.column_name"""


ORACLE["categorical_profile"] = (fixture_cte("orders_gaps")[:-1]
                                 + _cat_profile_sql("orders_gaps", ["o_orderstatus", "o_orderpriority"]))

ORACLE["value_counts_top10"] = """
WITH cells AS (
    SELECT 'p_name' AS column_name, p_name AS value FROM part UNION ALL
    SELECT 'p_brand', p_brand FROM part UNION ALL
    SELECT 'p_type', p_type FROM part),
freq AS (SELECT column_name, value, COUNT(*) AS cnt FROM cells
         WHERE value IS NOT NULL GROUP BY column_name, value),
ranked AS (SELECT column_name, value, cnt,
                  ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY cnt DESC, value ASC) AS rn
           FROM freq)
SELECT column_name, value, cnt AS count, rn AS rank FROM ranked WHERE rn <= 10"""


def _corr_sql(src: str, cols: list[str], threshold: float = 0.7) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}_vs_{b}' AS pair, '{a}' AS column_a, '{b}' AS column_b, "
                         f"CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {src}")
    return f"""
    , pairs AS ({' UNION ALL '.join(parts)})
    SELECT pair, column_a, column_b, ROUND(r, 6) AS correlation
    FROM pairs WHERE r IS NOT NULL AND ABS(r) > {threshold}"""


ORACLE["correlations"] = fixture_cte("lineitem_gaps")[:-1] + _corr_sql("lineitem_gaps", LINEITEM_NUMERIC)
ORACLE["correlations_charges"] = (fixture_cte("lineitem_charges")[:-1]
                                  + _corr_sql("lineitem_charges", ["l_quantity", "l_extendedprice", "l_discount",
                                                                   "l_tax", "disc_price", "charge"]))
ORACLE["correlation_pairs"] = (fixture_cte("lineitem_gaps")[:-1]
                               + _corr_sql("lineitem_gaps", LINEITEM_NUMERIC, threshold=-1.0))

ORACLE["correlation_blocks"] = fixture_cte("lineitem_gaps")[:-1] + f"""
    , pairs AS ({' UNION ALL '.join(
        f"SELECT '{a}_vs_{b}' AS pair, '{a}' AS column_a, '{b}' AS column_b, COUNT(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        f"CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM lineitem_gaps"
        for i, a in enumerate(LINEITEM_NUMERIC) for b in LINEITEM_NUMERIC[i + 1:])})
    SELECT pair, column_a, column_b, n, ROUND(r, 6) AS correlation FROM pairs WHERE r IS NOT NULL"""

ORACLE["missing_summary"] = fixture_cte("lineitem_gaps") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_missing, "
    f"ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6) AS missing_pct FROM lineitem_gaps"
    for c in LINEITEM_ALL)


def _quality_sql() -> str:
    miss = " UNION ALL ".join(
        f"SELECT (COUNT(*) - COUNT({c})) * 100.0 / COUNT(*) AS pct FROM lineitem_gaps"
        for c in LINEITEM_ALL)
    return (fixture_cte("lineitem_gaps")[:-1]
            + _numeric_profile_sql("lineitem_gaps", LINEITEM_NUMERIC, LINEITEM_TYPES)
            + f"""
    , miss AS ({miss}),
    agg AS (SELECT (SELECT AVG(pct) FROM miss) AS tm,
                   (SELECT SUM(n_outliers) FROM prof) AS tout,
                   (SELECT COUNT(*) FROM lineitem_gaps) AS n),
    sc AS (SELECT tm, tout, n, GREATEST(0.0, 100.0 - tm) AS comp FROM agg),
    fin AS (SELECT *, GREATEST(0.0, LEAST(100.0, comp - LEAST(50.0, tout * 100.0 / n))) AS overall FROM sc)
    SELECT ROUND(overall, 2) AS overall_score, ROUND(comp, 2) AS completeness_score,
           ROUND(tm, 2) AS total_missing_percentage, CAST(tout AS BIGINT) AS total_outliers,
           ROUND(tout * 100.0 / n, 2) AS outlier_percentage,
           CASE WHEN ROUND(overall, 2) >= 80 THEN 'Excellent'
                WHEN ROUND(overall, 2) >= 60 THEN 'Good' ELSE 'Needs attention' END AS quality_band
    FROM fin""")


ORACLE["quality_score"] = _quality_sql()


def _describe_sql() -> str:
    num = ["c_custkey", "c_nationkey", "c_acctbal"]
    txt = ["c_name", "c_mktsegment"]
    parts = []
    for c in num:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, COUNT({x}) AS count, CAST(NULL AS BIGINT) AS "unique",
            CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
            ROUND(AVG({x}), 6) AS mean, ROUND(STDDEV_SAMP({x}), 6) AS std, ROUND(MIN({x}), 6) AS min,
            ROUND(QUANTILE_CONT({x}, 0.25), 6) AS p25, ROUND(QUANTILE_CONT({x}, 0.5), 6) AS p50,
            ROUND(QUANTILE_CONT({x}, 0.75), 6) AS p75, ROUND(MAX({x}), 6) AS max FROM customer_gaps""")
    for c in txt:
        parts.append(f"""SELECT '{c}', (SELECT COUNT({c}) FROM customer_gaps),
            (SELECT COUNT(DISTINCT {c}) FROM customer_gaps),
            (SELECT {c} FROM customer_gaps WHERE {c} IS NOT NULL GROUP BY {c}
             ORDER BY COUNT(*) DESC, {c} ASC LIMIT 1),
            (SELECT COUNT(*) FROM customer_gaps WHERE {c} IS NOT NULL GROUP BY {c}
             ORDER BY COUNT(*) DESC, {c} ASC LIMIT 1),
            CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
            CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)""")
    return fixture_cte("customer_gaps") + " UNION ALL ".join(parts)


ORACLE["describe_all"] = _describe_sql()


# ---------------------------------------------------------------- preparation
_LG = fixture_cte("lineitem_gaps")

ORACLE["impute_mean"] = _LG + """
SELECT l_orderkey, l_linenumber,
       ROUND(COALESCE(l_discount, (SELECT AVG(l_discount) FROM lineitem_gaps)), 6) AS l_discount,
       ROUND(COALESCE(l_tax, (SELECT AVG(l_tax) FROM lineitem_gaps)), 6) AS l_tax
FROM lineitem_gaps"""

ORACLE["impute_median"] = _LG + """
SELECT l_orderkey, l_linenumber,
       ROUND(COALESCE(l_discount, (SELECT QUANTILE_CONT(l_discount, 0.5) FROM lineitem_gaps)), 6) AS l_discount,
       ROUND(COALESCE(l_tax, (SELECT QUANTILE_CONT(l_tax, 0.5) FROM lineitem_gaps)), 6) AS l_tax
FROM lineitem_gaps"""

ORACLE["impute_mode"] = fixture_cte("orders_gaps") + """
SELECT o_orderkey,
       COALESCE(o_orderpriority, (SELECT o_orderpriority FROM orders_gaps WHERE o_orderpriority IS NOT NULL
                                  GROUP BY o_orderpriority ORDER BY COUNT(*) DESC, o_orderpriority LIMIT 1))
         AS o_orderpriority,
       ROUND(COALESCE(o_totalprice, (SELECT o_totalprice FROM orders_gaps WHERE o_totalprice IS NOT NULL
                                     GROUP BY o_totalprice ORDER BY COUNT(*) DESC, o_totalprice LIMIT 1)), 6)
         AS o_totalprice
FROM orders_gaps"""

ORACLE["forward_fill"] = fixture_cte("events_gaps") + """
SELECT event_id, user_id, ts,
       ROUND(LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value
FROM events_gaps"""

ORACLE["backward_fill"] = fixture_cte("events_gaps") + """
SELECT event_id, user_id, ts,
       ROUND(FIRST_VALUE(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value
FROM events_gaps"""

ORACLE["drop_missing_rows"] = _LG + """
SELECT l_orderkey, l_linenumber, ROUND(l_discount, 6) AS l_discount, ROUND(l_tax, 6) AS l_tax
FROM lineitem_gaps WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL"""

ORACLE["feature_engineering"] = _LG + """
SELECT l_orderkey, l_linenumber, ROUND(l_quantity, 6) AS l_quantity,
       ROUND(l_extendedprice / NULLIF(l_quantity, 0), 6) AS unit_price,
       ROUND(l_tax / NULLIF(l_discount, 0), 6) AS tax_per_discount,
       ROUND(l_extendedprice * l_discount, 4) AS discount_value,
       ROUND(l_tax + l_discount, 6) AS tax_plus_discount,
       ROUND(CAST(l_quantity AS DOUBLE) - l_linenumber, 6) AS qty_minus_line,
       ROUND((l_extendedprice / NULLIF(l_quantity, 0)) * l_quantity, 4) AS unit_price_x_qty
FROM lineitem_gaps"""


def _winsor_sql(lo_expr: str, hi_expr: str) -> str:
    """Eligibility (sd > 0; not <= 10 distinct with ratio < 0.05) + clip."""
    cols = ["l_extendedprice", "l_quantity", "l_discount", "l_linenumber"]
    stats = ",\n".join(
        f"(SELECT {lo_expr.format(x=f'CAST({c} AS DOUBLE)', c=c)} FROM lineitem_gaps) AS lo_{c}, "
        f"(SELECT {hi_expr.format(x=f'CAST({c} AS DOUBLE)', c=c)} FROM lineitem_gaps) AS hi_{c}, "
        f"(SELECT STDDEV_SAMP({c}) > 0 AND NOT (COUNT(DISTINCT {c}) <= 10 AND "
        f"COUNT(DISTINCT {c}) * 1.0 / COUNT(*) < 0.05) FROM lineitem_gaps) AS ok_{c}"
        for c in cols)
    sel = ",\n".join(
        f"ROUND(CASE WHEN s.ok_{c} AND {c} IS NOT NULL THEN LEAST(GREATEST(CAST({c} AS DOUBLE), s.lo_{c}), "
        f"s.hi_{c}) ELSE {c} END, 6) AS {c}" if c != "l_linenumber" else
        f"CASE WHEN s.ok_{c} AND {c} IS NOT NULL THEN CAST(LEAST(GREATEST(CAST({c} AS DOUBLE), s.lo_{c}), "
        f"s.hi_{c}) AS INTEGER) ELSE {c} END AS {c}"
        for c in cols)
    return _LG[:-1] + f""", s AS (SELECT {stats})
SELECT l_orderkey, {sel} FROM lineitem_gaps, s"""


ORACLE["winsorize_iqr"] = _winsor_sql(
    "QUANTILE_CONT({x}, 0.25) - 1.5 * (QUANTILE_CONT({x}, 0.75) - QUANTILE_CONT({x}, 0.25))",
    "QUANTILE_CONT({x}, 0.75) + 1.5 * (QUANTILE_CONT({x}, 0.75) - QUANTILE_CONT({x}, 0.25))")
ORACLE["winsorize_gaussian"] = _winsor_sql("AVG({x}) - 2.0 * STDDEV_SAMP({x})",
                                           "AVG({x}) + 2.0 * STDDEV_SAMP({x})")
ORACLE["winsorize_mad"] = _winsor_sql(
    "QUANTILE_CONT({x}, 0.5) - 2.0 * (SELECT QUANTILE_CONT(ABS(CAST(g.{c} AS DOUBLE) - "
    "(SELECT QUANTILE_CONT(CAST(h.{c} AS DOUBLE), 0.5) FROM lineitem_gaps h)), 0.5) FROM lineitem_gaps g)",
    "QUANTILE_CONT({x}, 0.5) + 2.0 * (SELECT QUANTILE_CONT(ABS(CAST(g.{c} AS DOUBLE) - "
    "(SELECT QUANTILE_CONT(CAST(h.{c} AS DOUBLE), 0.5) FROM lineitem_gaps h)), 0.5) FROM lineitem_gaps g)")
ORACLE["winsorize_quantiles"] = _winsor_sql("QUANTILE_CONT({x}, 0.05)", "QUANTILE_CONT({x}, 0.95)")

ORACLE["outlier_remove"] = _LG[:-1] + """, f AS (
  SELECT QUANTILE_CONT(l_extendedprice, 0.25) - 0.25 * (QUANTILE_CONT(l_extendedprice, 0.75)
           - QUANTILE_CONT(l_extendedprice, 0.25)) AS lo,
         QUANTILE_CONT(l_extendedprice, 0.75) + 0.25 * (QUANTILE_CONT(l_extendedprice, 0.75)
           - QUANTILE_CONT(l_extendedprice, 0.25)) AS hi FROM lineitem_gaps)
SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice, 6) AS l_extendedprice
FROM lineitem_gaps, f WHERE l_extendedprice IS NULL OR (l_extendedprice >= lo AND l_extendedprice <= hi)"""

# The order priorities of the test tables and the text of a missing one.
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "missing"]

ORACLE["onehot_encode"] = fixture_cte("orders_gaps") + "SELECT o_orderkey, " + ", ".join(
    f"CAST(COALESCE(o_orderpriority, 'missing') = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\""
    for v in ORDER_PRIORITIES) + " FROM orders_gaps"

ORACLE["onehot_drop_last"] = """
SELECT o_orderkey,
       CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F,
       CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O
FROM orders"""

ORACLE["frequency_encode"] = """
SELECT p.p_partkey, ROUND(b.f, 6) AS p_brand, ROUND(t.f, 6) AS p_type
FROM part p
JOIN (SELECT p_brand, COUNT(*) * 1.0 / (SELECT COUNT(*) FROM part) AS f FROM part GROUP BY p_brand) b
  ON b.p_brand = p.p_brand
JOIN (SELECT p_type, COUNT(*) * 1.0 / (SELECT COUNT(*) FROM part) AS f FROM part GROUP BY p_type) t
  ON t.p_type = p.p_type"""

ORACLE["label_encode"] = """
SELECT p_partkey, CAST(DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand,
       CAST(DENSE_RANK() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type
FROM part"""

ORACLE["target_encode"] = """
WITH g AS (SELECT AVG(p_retailprice) AS m FROM part),
     b AS (SELECT p_brand, COUNT(p_retailprice) AS n, AVG(p_retailprice) AS mu FROM part GROUP BY p_brand)
SELECT p.p_partkey, ROUND((b.n * b.mu + 10.0 * g.m) / (b.n + 10.0), 6) AS p_brand,
       ROUND(p.p_retailprice, 6) AS p_retailprice
FROM part p JOIN b ON b.p_brand = p.p_brand, g"""

ORACLE["log_transform"] = _LG[:-1] + """, s AS (
  SELECT CASE WHEN MIN(l_extendedprice) <= 0 THEN 1 - MIN(l_extendedprice) ELSE 0 END AS se,
         CASE WHEN MIN(l_discount) <= 0 THEN 1 - MIN(l_discount) ELSE 0 END AS sd,
         CASE WHEN MIN(l_tax) <= 0 THEN 1 - MIN(l_tax) ELSE 0 END AS st FROM lineitem_gaps)
SELECT l_orderkey, l_linenumber,
       ROUND(CASE WHEN l_extendedprice + se > 0 THEN LN(l_extendedprice + se) END, 6) AS l_extendedprice,
       ROUND(CASE WHEN l_discount + sd > 0 THEN LN(l_discount + sd) END, 6) AS l_discount,
       ROUND(CASE WHEN l_tax + st > 0 THEN LN(l_tax + st) END, 6) AS l_tax
FROM lineitem_gaps, s"""


def _yj(x: str, lam: float) -> str:
    pos = f"LN(1 + {x})" if lam == 0 else f"(POWER({x} + 1, {lam}) - 1) / {lam}"
    neg = f"-LN(1 - {x})" if lam == 2 else f"-(POWER(1 - {x}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


ORACLE["yeo_johnson_fixed"] = _LG + f"""
SELECT l_orderkey, l_linenumber,
       ROUND({_yj('l_quantity', 0.5)}, 6) AS l_quantity,
       ROUND({_yj('l_discount', -0.7)}, 6) AS l_discount,
       ROUND({_yj('(l_quantity - 25.5)', 1.5)}, 6) AS centred_qty,
       ROUND({_yj('(l_quantity - 25.5)', 0.0)}, 6) AS centred_qty0,
       ROUND({_yj('(l_quantity - 25.5)', 2.0)}, 3) AS centred_qty2
FROM lineitem_gaps"""

ORACLE["box_cox_sqrt"] = _LG + """
SELECT l_orderkey, l_linenumber,
       ROUND(CASE WHEN l_quantity > 0 THEN (POWER(l_quantity, 0.3) - 1) / 0.3 END, 6) AS l_quantity,
       ROUND(CASE WHEN l_discount > 0 THEN LN(l_discount) END, 6) AS l_discount,
       ROUND(CASE WHEN l_extendedprice >= 0 THEN SQRT(l_extendedprice) END, 6) AS l_extendedprice
FROM lineitem_gaps"""


def _scale_sql(centre: str, spread: str) -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    stats = ", ".join(f"{centre.format(x=c)} AS c_{c}, "
                      f"CASE WHEN {spread.format(x=c)} = 0 OR {spread.format(x=c)} IS NULL THEN 1.0 "
                      f"ELSE {spread.format(x=c)} END AS s_{c}" for c in cols)
    sel = ", ".join(f"ROUND(({c} - c_{c}) / s_{c}, 6) AS {c}" for c in cols)
    return _LG[:-1] + f""", s AS (SELECT {stats} FROM lineitem_gaps)
SELECT l_orderkey, l_linenumber, {sel} FROM lineitem_gaps, s"""


ORACLE["scale_standard"] = _scale_sql("AVG({x})", "STDDEV_POP({x})")
ORACLE["scale_minmax"] = _scale_sql("MIN({x})", "(MAX({x}) - MIN({x}))")
ORACLE["scale_robust"] = _scale_sql("QUANTILE_CONT({x}, 0.5)",
                                    "(QUANTILE_CONT({x}, 0.75) - QUANTILE_CONT({x}, 0.25))")

_SEL_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "flag_rare", "rare_txt",
             "qty_copy", "price_copy"]


def _constant_sql(tol: float) -> str:
    parts = [f"""SELECT '{c}' AS column_name FROM (SELECT MAX(n) * 1.0 / SUM(n) AS share FROM
              (SELECT COUNT(*) AS n FROM lineitem_selection WHERE {c} IS NOT NULL GROUP BY {c})) x
              WHERE share >= {tol}""" for c in _SEL_COLS]
    return fixture_cte("lineitem_selection") + " UNION ALL ".join(parts)


ORACLE["drop_constant"] = _constant_sql(0.99)
ORACLE["drop_constant_clustering"] = _constant_sql(0.98)


def _dup_sql() -> str:
    parts = []
    for j, b in enumerate(_SEL_COLS):
        earlier = " OR ".join(
            f"(SELECT COUNT(*) FROM lineitem_selection WHERE CAST({a} AS VARCHAR) IS DISTINCT FROM "
            f"CAST({b} AS VARCHAR)) = 0" for a in _SEL_COLS[:j]) or "FALSE"
        parts.append(f"SELECT '{b}' AS column_name WHERE {earlier}")
    return fixture_cte("lineitem_selection") + " UNION ALL ".join(parts)


ORACLE["drop_duplicates"] = _dup_sql()

ORACLE["target_label_roundtrip"] = """
WITH cls AS (SELECT o_orderstatus AS c, CAST(ROW_NUMBER() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS i
             FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL))
SELECT l.l_orderkey, l.l_linenumber,
       COALESCE(f.i, -1) AS flag_idx, COALESCE(f.c, 'UNKNOWN') AS flag_back,
       COALESCE(s.i, -1) AS status_idx, COALESCE(s.c, 'UNKNOWN') AS status_back
FROM lineitem l LEFT JOIN cls f ON f.c = l.l_returnflag LEFT JOIN cls s ON s.c = l.l_linestatus"""

ORACLE["target_regression_fences"] = fixture_cte("orders_gaps")[:-1] + """, k AS (
  SELECT * FROM orders_gaps WHERE o_totalprice IS NOT NULL),
q AS (SELECT QUANTILE_CONT(o_totalprice, 0.25) AS q1, QUANTILE_CONT(o_totalprice, 0.75) AS q3 FROM k),
f AS (SELECT q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi FROM q),
e AS (SELECT COUNT(*) AS n FROM k, f WHERE o_totalprice < lo OR o_totalprice > hi)
SELECT o_orderkey, ROUND(CASE WHEN (SELECT n FROM e) > 0 THEN LEAST(GREATEST(o_totalprice, lo), hi)
                              ELSE o_totalprice END, 6) AS o_totalprice
FROM k, f"""


def _ieee_round(sql: str) -> str:
    """Rewrite every two-argument ``ROUND(expr, d)`` as
    ``(ROUND((expr) * 10^d) / 10^d + 0.0)``, the form the Spark queries use
    (``+ 0.0`` turns -0.0 into 0.0)."""
    out, i, key = [], 0, "ROUND("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + len(key):k - 1]
        if comma < 0:
            out.append(key + _ieee_round(inner) + ")")
        else:
            expr = _ieee_round(sql[j + len(key):comma])
            d = int(sql[comma + 1:k - 1].strip())
            m = float(10 ** d)
            out.append(f"(ROUND(({expr}) * {m}) / {m} + 0.0)")
        i = k


ORACLE = {k: _ieee_round(v) for k, v in ORACLE.items()}


# ---------------------------------------------------------------- split, metrics, neighbours
ORACLE["split_stratified"] = """
SELECT o_orderstatus, COUNT(*) AS n_rows,
       CAST(COUNT(*) - FLOOR(COUNT(*) * 0.2 + 0.5) AS BIGINT) AS n_train,
       CAST(FLOOR(COUNT(*) * 0.2 + 0.5) AS BIGINT) AS n_test
FROM orders GROUP BY o_orderstatus"""

ORACLE["regression_metrics"] = _ieee_round("""
WITH g AS (SELECT l_returnflag, l_linestatus, AVG(l_extendedprice) AS yhat FROM lineitem
           GROUP BY l_returnflag, l_linestatus),
p AS (SELECT l.l_extendedprice AS y, g.yhat FROM lineitem l JOIN g USING (l_returnflag, l_linestatus)),
a AS (SELECT COUNT(*) AS n, SUM((y - yhat) * (y - yhat)) AS sse, SUM(ABS(y - yhat)) AS sae,
             VAR_POP(y) AS vp FROM p)
SELECT ROUND(CASE WHEN vp * n = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / (vp * n) END, 6) AS r2,
       ROUND(SQRT(sse / n), 6) AS rmse, ROUND(sae / n, 6) AS mae FROM a""")

ORACLE["classification_metrics"] = _ieee_round("""
WITH f AS (SELECT o_orderpriority, o_orderstatus, COUNT(*) AS cnt FROM orders GROUP BY 1, 2),
m AS (SELECT o_orderpriority, o_orderstatus AS yhat FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY cnt DESC, o_orderstatus) rn FROM f)
      WHERE rn = 1),
p AS (SELECT o.o_orderstatus AS t, m.yhat AS p FROM orders o JOIN m USING (o_orderpriority)),
cls AS (SELECT t AS c FROM p UNION SELECT p FROM p),
per AS (SELECT c, (SELECT COUNT(*) FROM p WHERE t = c) AS support, (SELECT COUNT(*) FROM p WHERE p.p = c) AS npred,
               (SELECT COUNT(*) FROM p WHERE t = c AND p.p = c) AS tp FROM cls),
pr AS (SELECT *, CASE WHEN npred > 0 THEN tp * 1.0 / npred ELSE 0 END AS prec,
                 CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0 END AS rec FROM per),
f1 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM pr)
SELECT ROUND(SUM(tp) * 1.0 / SUM(support), 6) AS accuracy, ROUND(SUM(f1 * support) / SUM(support), 6) AS f1,
       ROUND(SUM(prec * support) / SUM(support), 6) AS precision,
       ROUND(SUM(rec * support) / SUM(support), 6) AS recall FROM f1""")

ORACLE["clustering_metrics"] = _ieee_round("""
WITH e AS (SELECT vec_id, label AS k, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, k, UNNEST(x) AS v, UNNEST(generate_series(1, len(x))) AS i FROM e),
n AS (SELECT k, COUNT(*) AS nk FROM e GROUP BY k),
c AS (SELECT k, i, AVG(v) AS cv FROM u GROUP BY k, i),
psi AS (SELECT k, SUM(v * v) AS psi FROM u GROUP BY k),
sq AS (SELECT vec_id, SUM(v * v) AS sq FROM u GROUP BY vec_id),
dp AS (SELECT u.vec_id, c.k AS kk, SUM(u.v * c.cv) AS dp FROM u JOIN c ON u.i = c.i GROUP BY u.vec_id, c.k),
diss AS (SELECT dp.vec_id, dp.kk, sq.sq + psi.psi / n.nk - 2 * dp.dp AS dd
         FROM dp JOIN sq ON sq.vec_id = dp.vec_id JOIN psi ON psi.k = dp.kk JOIN n ON n.k = dp.kk),
pt AS (SELECT e.vec_id, e.k, MAX(n.nk) AS nk,
              MAX(CASE WHEN d.kk = e.k THEN d.dd * n.nk / (n.nk - 1) END) AS a,
              MIN(CASE WHEN d.kk <> e.k THEN d.dd END) AS b
       FROM e JOIN diss d ON d.vec_id = e.vec_id JOIN n ON n.k = e.k GROUP BY e.vec_id, e.k),
sil AS (SELECT AVG(CASE WHEN nk <= 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS s
        FROM pt),
own AS (SELECT u.vec_id, u.k, SUM((u.v - c.cv) * (u.v - c.cv)) AS cd FROM u JOIN c ON c.k = u.k AND c.i = u.i
        GROUP BY u.vec_id, u.k),
sk AS (SELECT k, AVG(SQRT(cd)) AS s FROM own GROUP BY k),
mij AS (SELECT a.k AS ki, b.k AS kj, SQRT(SUM((a.cv - b.cv) * (a.cv - b.cv))) AS m
        FROM c a JOIN c b ON a.i = b.i AND a.k <> b.k GROUP BY a.k, b.k),
db AS (SELECT AVG(r) AS db FROM (SELECT mij.ki, MAX((si.s + sj.s) / mij.m) AS r FROM mij
        JOIN sk si ON si.k = mij.ki JOIN sk sj ON sj.k = mij.kj GROUP BY mij.ki)),
g AS (SELECT i, SUM(c.cv * n.nk) / (SELECT COUNT(*) FROM e) AS gv FROM c JOIN n ON n.k = c.k GROUP BY i),
bw AS (SELECT SUM(n.nk * (c.cv - g.gv) * (c.cv - g.gv)) AS b FROM c JOIN n ON n.k = c.k JOIN g ON g.i = c.i),
wi AS (SELECT SUM(cd) AS w FROM own),
kk AS (SELECT COUNT(*) AS kk, (SELECT COUNT(*) FROM e) AS nn FROM n)
SELECT CAST(kk.kk AS INTEGER) AS n_clusters, ROUND(sil.s, 6) AS silhouette_sq, ROUND(db.db, 6) AS davies_bouldin,
       ROUND((bw.b / (kk.kk - 1)) / (wi.w / (kk.nn - kk.kk)), 4) AS calinski_harabasz
FROM sil, db, bw, wi, kk""")

_KNN_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS rid, list_distance(a.x, b.x) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM p)"""

ORACLE["knn_neighbors"] = _ieee_round(_KNN_SQL + """
SELECT qid AS vec_id, CAST(rk AS INTEGER) AS rank, rid AS neighbor_id, ROUND(dist, 6) AS distance
FROM r WHERE rk <= 5""")

ORACLE["knn_classify"] = _KNN_SQL + """,
v AS (SELECT r.qid, l.label, COUNT(*) AS votes FROM r JOIN embeddings l ON l.vec_id = r.rid
      WHERE rk <= 5 GROUP BY r.qid, l.label),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS o FROM v)
SELECT qid AS vec_id, CAST(label AS INTEGER) AS prediction, CAST(votes AS INTEGER) AS votes FROM b WHERE o = 1"""

ORACLE["dbscan"] = """
WITH RECURSIVE st AS (SELECT AVG(c_acctbal) AS ma, STDDEV_POP(c_acctbal) AS sa,
                             AVG(c_nationkey) AS mn, STDDEV_POP(c_nationkey) AS sn FROM customer),
pts AS (SELECT c_custkey AS id, (c_acctbal - ma) / sa AS a, (c_nationkey - mn) / sn AS b FROM customer, st),
nb AS (SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q
       ON SQRT((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) <= 0.15),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING COUNT(*) >= 4),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON c1.id = nb.a JOIN core c2 ON c2.id = nb.b),
reach(a, b) AS (SELECT a, b FROM ce UNION SELECT r.a, ce.b FROM reach r JOIN ce ON ce.a = r.b),
comp AS (SELECT a AS id, MIN(b) AS lbl FROM reach GROUP BY a),
border AS (SELECT nb.a AS id, MIN(comp.lbl) AS lbl FROM nb JOIN comp ON comp.id = nb.b
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
allc AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT lbl, CAST(DENSE_RANK() OVER (ORDER BY lbl) - 1 AS INTEGER) AS cluster
        FROM (SELECT DISTINCT lbl FROM allc))
SELECT p.id AS c_custkey, COALESCE(num.cluster, -1) AS cluster
FROM pts p LEFT JOIN allc ON allc.id = p.id LEFT JOIN num ON num.lbl = allc.lbl"""


def _task_sql() -> str:
    last = {"orders": ("o_orderpriority", False), "lineitem": ("l_shipdate", False),
            "customer": ("c_mktsegment", False), "part": ("p_retailprice", True),
            "supplier": ("s_acctbal", True), "nation": ("n_regionkey", True), "events": ("props", False)}
    parts = []
    for t, (c, is_num) in last.items():
        parts.append(f"""SELECT '{t}' AS table_name,
          CASE WHEN COUNT(DISTINCT {c}) = 1 THEN 'Clustering'
               WHEN COUNT(DISTINCT {c}) <= 20 AND COUNT(DISTINCT {c}) * 1.0 / COUNT(*) < 0.05 THEN 'Classification'
               WHEN {str(is_num).upper()} THEN 'Regression' ELSE 'Classification' END AS learning_type,
          CASE WHEN COUNT(DISTINCT {c}) = 1 THEN NULL ELSE '{c}' END AS target FROM {t}""")
    return " UNION ALL ".join(parts)


ORACLE["task_detection"] = _task_sql()


def _prepare_orders_sql(source: str, fit_src: str = "og") -> str:
    lv = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    num = ["o_custkey", "o_totalprice", "price_per_cust"] + [f"o_orderpriority_{v}" for v in lv]
    onehot = ",\n".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\"" for v in lv)
    stats = ", ".join(f"AVG(\"{c}\") AS m{i}, CASE WHEN STDDEV_POP(\"{c}\") = 0 THEN 1.0 "
                      f"ELSE STDDEV_POP(\"{c}\") END AS s{i}" for i, c in enumerate(num))
    scaled = ",\n".join(f"ROUND((\"{c}\" - m{i}) / s{i}, 6) AS \"{c}\"" for i, c in enumerate(num))
    # the chain is fitted on og (orders with gaps) and applied to `source`
    return f"""
WITH og AS ({FIXTURE_SQL_ORDERS_GAPS}),
fit_imp AS (SELECT AVG(o_totalprice) AS m_tp,
                   (SELECT o_orderpriority FROM og WHERE o_orderpriority IS NOT NULL GROUP BY 1
                    ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS m_pr FROM og),
imp_f AS (SELECT o_custkey, COALESCE(o_totalprice, m_tp) AS o_totalprice,
                 COALESCE(o_orderpriority, m_pr) AS o_orderpriority FROM og, fit_imp),
eng_f AS (SELECT *, o_totalprice / NULLIF(CAST(o_custkey AS DOUBLE), 0) AS price_per_cust FROM imp_f),
fit_pf AS (SELECT COUNT(*) - COUNT(price_per_cust) AS holes, QUANTILE_CONT(price_per_cust, 0.5) AS med FROM eng_f),
pf_f AS (SELECT o_custkey, o_totalprice, o_orderpriority,
                CASE WHEN holes > 0 THEN COALESCE(price_per_cust, med) ELSE price_per_cust END AS price_per_cust
         FROM eng_f, fit_pf),
fit_w AS (SELECT QUANTILE_CONT(o_totalprice, 0.25) AS a1, QUANTILE_CONT(o_totalprice, 0.75) AS a3,
                 QUANTILE_CONT(price_per_cust, 0.25) AS b1, QUANTILE_CONT(price_per_cust, 0.75) AS b3 FROM pf_f),
win_f AS (SELECT o_custkey, LEAST(GREATEST(o_totalprice, a1 - 1.5 * (a3 - a1)), a3 + 1.5 * (a3 - a1)) AS o_totalprice,
                 LEAST(GREATEST(price_per_cust, b1 - 1.5 * (b3 - b1)), b3 + 1.5 * (b3 - b1)) AS price_per_cust,
                 {onehot}
          FROM pf_f, fit_w),
fit_s AS (SELECT {stats} FROM win_f),
src AS ({source}),
imp AS (SELECT o_custkey, COALESCE(o_totalprice, m_tp) AS o_totalprice,
               COALESCE(o_orderpriority, m_pr) AS o_orderpriority, o_orderstatus FROM src, fit_imp),
eng AS (SELECT *, o_totalprice / NULLIF(CAST(o_custkey AS DOUBLE), 0) AS price_per_cust FROM imp),
pf AS (SELECT o_custkey, o_totalprice, o_orderpriority, o_orderstatus,
              CASE WHEN holes > 0 THEN COALESCE(price_per_cust, med) ELSE price_per_cust END AS price_per_cust
       FROM eng, fit_pf),
win AS (SELECT o_custkey, LEAST(GREATEST(o_totalprice, a1 - 1.5 * (a3 - a1)), a3 + 1.5 * (a3 - a1)) AS o_totalprice,
               LEAST(GREATEST(price_per_cust, b1 - 1.5 * (b3 - b1)), b3 + 1.5 * (b3 - b1)) AS price_per_cust,
               {onehot}, o_orderstatus
        FROM pf, fit_w)
SELECT {scaled},
       CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS INTEGER) AS o_orderstatus
FROM win, fit_s"""


from tabforge.sources.tables import FIXTURE_SQL as _FX  # noqa: E402

FIXTURE_SQL_ORDERS_GAPS = _FX["orders_gaps"]
ORACLE["prepare_orders"] = _ieee_round(_prepare_orders_sql("SELECT * FROM og"))
ORACLE["prepare_orders_transform"] = _ieee_round(_prepare_orders_sql("SELECT * FROM orders"))


# ---------------------------------------------------------------- streaming, sources
_WIN_SQL = _ieee_round(fixture_cte("events_gaps") + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       event_type, COUNT(*) AS n_rows, COUNT(*) - COUNT(value) AS n_missing,
       ROUND(AVG(value), 6) AS mean, ROUND(MIN(value), 6) AS min, ROUND(MAX(value), 6) AS max,
       ROUND(STDDEV_SAMP(value), 6) AS std
FROM events_gaps GROUP BY 1, 2, 3""")
ORACLE["stream_window_profile"] = _WIN_SQL
ORACLE["stream_window_profile_batch"] = _WIN_SQL

_CUST = _ieee_round("SELECT c_custkey, c_name, c_nationkey, ROUND(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
for _k in ("source_csv", "source_json", "source_parquet", "source_xml"):
    ORACLE[_k] = _CUST

ORACLE["prediction_history"] = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"


# ---------------------------------------------------------------- summary extras
def _samples_sql() -> str:
    num = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"}
    parts = []
    for c in LINEITEM_ALL:
        n = f"CAST({c} AS DOUBLE)" if c in num else "CAST(NULL AS DOUBLE)"
        v = (f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
             else ("strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')" if c == "l_shipdate" else f"CAST({c} AS VARCHAR)"))
        parts.append(f"SELECT DISTINCT '{c}' AS column_name, {n} AS num, {v} AS value FROM lineitem_gaps "
                     f"WHERE {c} IS NOT NULL")
    return fixture_cte("lineitem_gaps")[:-1] + f""", d AS ({' UNION ALL '.join(parts)}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY num ASC NULLS LAST, value) AS rk FROM d)
SELECT column_name, CAST(rk AS INTEGER) AS rank, value FROM r WHERE rk <= 5"""


ORACLE["sample_values"] = _samples_sql()

ORACLE["memory_estimate"] = _ieee_round(fixture_cte("lineitem_gaps") + """
SELECT COUNT(*) AS n_rows, 11 AS n_columns,
       ROUND((COUNT(*) * 8 * 9 + COALESCE(SUM(STRLEN(l_returnflag)), 0)
              + COALESCE(SUM(STRLEN(l_linestatus)), 0)) / 1048576.0, 6) AS memory_mb
FROM lineitem_gaps""")


def _insights_sql() -> str:
    prof_cte = _numeric_profile_sql("lineitem_gaps", LINEITEM_NUMERIC, LINEITEM_TYPES)
    miss = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_missing, "
        f"(COUNT(*) - COUNT({c})) * 100.0 / COUNT(*) AS pct FROM lineitem_gaps" for c in LINEITEM_ALL)
    pairs = []
    for i, a in enumerate(LINEITEM_NUMERIC):
        for b in LINEITEM_NUMERIC[i + 1:]:
            pairs.append(f"SELECT '{a}_vs_{b}' AS column_name, ABS(CORR(CAST({a} AS DOUBLE), "
                         f"CAST({b} AS DOUBLE))) AS value FROM lineitem_gaps")
    return _ieee_round(fixture_cte("lineitem_gaps")[:-1] + prof_cte + f"""
    , miss AS ({miss}),
    cor AS ({' UNION ALL '.join(pairs)}),
    lists AS (
      SELECT 'missing' AS list_name, column_name, pct AS value FROM miss WHERE n_missing > 0
      UNION ALL SELECT 'outliers', column_name, CAST(n_outliers AS DOUBLE) FROM prof WHERE n_outliers > 0
      UNION ALL SELECT 'correlations', column_name, value FROM cor WHERE value IS NOT NULL),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY list_name ORDER BY value DESC, column_name) AS rk FROM lists)
    SELECT list_name, CAST(rk AS INTEGER) AS rank, column_name, ROUND(value, 6) AS value FROM ranked
    WHERE (list_name = 'missing' AND rk <= 10) OR (list_name = 'outliers' AND rk <= 10)
       OR (list_name = 'correlations' AND rk <= 8)""")


ORACLE["profile_insights"] = _insights_sql()

ORACLE["class_counts"] = "SELECT o_orderstatus AS label, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"

ORACLE["prep_report"] = fixture_cte("orders_gaps") + """
SELECT 'added' AS item, c AS column_name, CAST(NULL AS BIGINT) AS n
FROM (VALUES ('o_orderpriority_1-URGENT'), ('o_orderpriority_2-HIGH'), ('o_orderpriority_3-MEDIUM'),
             ('o_orderpriority_4-NOT SPECIFIED'), ('o_orderpriority_5-LOW'), ('price_per_cust')) t(c)
UNION ALL SELECT 'removed', c, NULL FROM (VALUES ('o_orderdate'), ('o_orderpriority')) t(c)
UNION ALL SELECT 'missing_before', NULL,
       (SELECT SUM(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END + CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END
                 + CASE WHEN o_orderdate IS NULL THEN 1 ELSE 0 END + CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END)
        FROM orders_gaps)
UNION ALL SELECT 'missing_after', NULL, 0"""


def _correlated_sql() -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "qty_copy", "price_copy", "flag_rare"]
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i + 1:], i + 1):
            pairs.append(f"SELECT {i + 1} AS ai, {j + 1} AS bi, CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r "
                         f"FROM lineitem_selection")
    names = ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(cols))
    return fixture_cte("lineitem_selection")[:-1] + f""",
cols(i, name) AS (VALUES {names}),
hi AS (SELECT ai, bi FROM ({' UNION ALL '.join(pairs)}) WHERE r IS NOT NULL AND ABS(r) > 0.95),
g(j, kept) AS (
  SELECT 0, CAST([] AS INTEGER[])
  UNION ALL
  SELECT g.j + 1,
         CASE WHEN EXISTS (SELECT 1 FROM hi WHERE hi.bi = g.j + 1 AND list_contains(g.kept, hi.ai))
              THEN g.kept ELSE list_append(g.kept, g.j + 1) END
  FROM g WHERE g.j < {len(cols)})
SELECT name AS column_name FROM cols, (SELECT kept FROM g WHERE j = {len(cols)}) k
WHERE NOT list_contains(k.kept, cols.i)"""


ORACLE["drop_correlated"] = "WITH RECURSIVE " + _correlated_sql()[len("WITH "):]
ORACLE["prediction_history"] = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"


def _infer_types_sql() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    parts = []
    for c in cols:
        v = f"TRIM(CAST({c} AS VARCHAR))"
        parts.append(f"""SELECT '{c}' AS column_name, COUNT({v}) AS n,
            COUNT(*) FILTER (WHERE regexp_full_match({v}, '[+-]?[0-9]+')
                             AND TRY_CAST({v} AS BIGINT) IS NOT NULL) AS nl,
            COUNT(TRY_CAST({v} AS DOUBLE)) AS nd,
            COUNT(*) FILTER (WHERE LOWER({v}) IN ('true', 'false')) AS nb,
            COUNT(TRY_CAST({v} AS TIMESTAMP)) AS nt, COUNT(DISTINCT {v}) AS nu FROM orders""")
    return f"""WITH s AS ({' UNION ALL '.join(parts)}),
t AS (SELECT column_name, CASE WHEN nl = n THEN 'bigint' WHEN nd = n THEN 'double'
                               WHEN nb = n THEN 'boolean' WHEN nt = n THEN 'timestamp'
                               WHEN nu < 0.5 * n THEN 'category' ELSE 'string' END AS inferred FROM s)
SELECT column_name, inferred, CASE WHEN inferred = 'category' THEN 'string' ELSE inferred END AS applied FROM t"""


ORACLE["infer_types"] = _infer_types_sql()


def _plan_rules_sql() -> str:
    """T3 rules over the customer profile (target c_mktsegment excluded):
    per-column statistics, then each plan entry derived from them."""
    num = {"c_custkey": True, "c_nationkey": True, "c_acctbal": False}   # column -> integer type
    txt = ["c_name"]
    parts = []
    for c, is_int in num.items():
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
        SELECT '{c}' AS column_name, 'num' AS kind, {str(is_int).upper()} AS is_int,
               COUNT(*) AS n_rows, COUNT(*) - COUNT({x}) AS n_missing, COUNT(DISTINCT {x}) AS n_distinct,
               MIN({x}) AS mn, QUANTILE_CONT({x}, 0.25) AS q1, QUANTILE_CONT({x}, 0.75) AS q3,
               AVG({x}) AS mean FROM customer_gaps""")
    for c in txt:
        parts.append(f"""
        SELECT '{c}', 'txt', FALSE, COUNT(*), COUNT(*) - COUNT({c}), COUNT(DISTINCT {c}),
               NULL, NULL, NULL, NULL FROM customer_gaps""")
    cells = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM customer_gaps"
                               for c in num)
    return fixture_cte("customer_gaps")[:-1] + f""",
base AS ({" UNION ALL ".join(parts)}),
cells AS ({cells}),
moments AS (
  SELECT b.column_name,
         COUNT(c.x) FILTER (WHERE c.x < b.q1 - 1.5 * (b.q3 - b.q1) OR c.x > b.q3 + 1.5 * (b.q3 - b.q1))
           AS n_outliers,
         AVG(POWER(c.x - b.mean, 3)) / POWER(AVG(POWER(c.x - b.mean, 2)), 1.5) AS skew
  FROM base b JOIN cells c ON c.column_name = b.column_name AND c.x IS NOT NULL
  GROUP BY b.column_name),
st AS (
  SELECT b.*, b.n_missing * 100.0 / b.n_rows AS pct, COALESCE(m.n_outliers, 0) AS n_outliers, m.skew
  FROM base b LEFT JOIN moments m ON m.column_name = b.column_name),
judged AS (
  SELECT *, CONCAT_WS('; ',
           CASE WHEN (is_int OR kind = 'txt') AND n_distinct = n_rows THEN 'identifier: every value unique' END,
           CASE WHEN pct > 60 THEN PRINTF('%.1f%% missing values', pct) END,
           CASE WHEN n_distinct <= 1 THEN 'constant: no variance' END) AS reason
  FROM st),
keep AS (SELECT * FROM judged WHERE reason = ''),
wins AS (SELECT column_name FROM keep WHERE kind = 'num' AND n_outliers > 0)
SELECT 'drop' AS section, column_name, reason AS value FROM judged WHERE reason <> ''
UNION ALL SELECT 'keep', column_name,
                 CASE WHEN pct < 5 THEN 'high' WHEN pct < 30 THEN 'medium' ELSE 'low' END FROM keep
UNION ALL SELECT 'step_1_missing_values.numeric_strategy', '',
                 CASE WHEN EXISTS (SELECT 1 FROM wins) THEN 'median' ELSE 'mean' END
UNION ALL SELECT 'step_1_missing_values.categorical_strategy', '', 'mode'
UNION ALL SELECT 'step_1_missing_values.columns_affected', column_name, '' FROM keep
UNION ALL SELECT 'step_2_outliers.method', '', 'winsorize'
UNION ALL SELECT 'step_2_outliers.columns_affected', column_name, '' FROM wins
UNION ALL SELECT 'step_3_encoding.onehot_columns', column_name, '' FROM keep
          WHERE kind = 'txt' AND n_distinct <= 10
UNION ALL SELECT 'step_3_encoding.frequency_columns', column_name, '' FROM keep
          WHERE kind = 'txt' AND n_distinct > 10
UNION ALL SELECT 'step_4_transformation.log_transform', column_name, '' FROM keep
          WHERE kind = 'num' AND ABS(skew) > 1 AND column_name NOT IN (SELECT column_name FROM wins)
                AND COALESCE(mn, 0) > 0
UNION ALL SELECT 'step_4_transformation.yeo_johnson', column_name, '' FROM keep
          WHERE kind = 'num' AND ABS(skew) > 1 AND column_name NOT IN (SELECT column_name FROM wins)
                AND COALESCE(mn, 0) <= 0
UNION ALL SELECT 'step_5_scaling.method', '', 'standard'
UNION ALL SELECT 'step_6_feature_selection.drop_correlated', '', 'False'
UNION ALL SELECT 'step_6_feature_selection.correlation_threshold', '', '0.95'
UNION ALL SELECT 'step_6_feature_selection.drop_constant', '', 'True'"""


ORACLE["plan_rules"] = _plan_rules_sql()


# ---------------------------------------------------------------- column types, closed windows, blank headers
ORACLE["impute_integers"] = _ieee_round(fixture_cte("lineitem_int_gaps") + """
SELECT l_orderkey, l_linenumber, ROUND(COALESCE(qty, (SELECT AVG(qty) FROM lineitem_int_gaps)), 6) AS qty
FROM lineitem_int_gaps""")

ORACLE["winsorize_integers"] = _ieee_round(fixture_cte("lineitem_spikes") + """
, f AS (SELECT AVG(qty) - 1.5 * STDDEV_SAMP(qty) AS lo, AVG(qty) + 1.5 * STDDEV_SAMP(qty) AS hi FROM lineitem_spikes)
SELECT l_orderkey, l_linenumber, ROUND(LEAST(GREATEST(qty, lo), hi), 6) AS qty FROM lineitem_spikes, f""")

ORACLE["large_ids"] = fixture_cte("lineitem_large_ids") + """
SELECT COUNT(DISTINCT id) AS n_distinct,
       (SELECT id FROM lineitem_large_ids GROUP BY id ORDER BY COUNT(*) DESC, id LIMIT 1) AS mode
FROM lineitem_large_ids"""

ORACLE["prepare_types"] = _ieee_round(fixture_cte("orders_typed") + """
, n AS (SELECT CAST(urgent AS INTEGER) AS urgent, date_diff('day', DATE '1970-01-01', day) AS day FROM orders_typed),
i AS (SELECT COALESCE(urgent, (SELECT AVG(urgent) FROM n)) AS urgent, COALESCE(day, (SELECT AVG(day) FROM n)) AS day FROM n)
SELECT ROUND((urgent - (SELECT AVG(urgent) FROM i)) / (SELECT STDDEV_POP(urgent) FROM i), 6) AS urgent,
       ROUND((day - (SELECT AVG(day) FROM i)) / (SELECT STDDEV_POP(day) FROM i), 6) AS day
FROM i""")

ORACLE["stream_windows_closed"] = _ieee_round("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       event_type, COUNT(*) AS n_rows, COUNT(*) - COUNT(value) AS n_missing,
       ROUND(AVG(value), 6) AS mean, ROUND(MIN(value), 6) AS min, ROUND(MAX(value), 6) AS max,
       ROUND(STDDEV_SAMP(value), 6) AS std
FROM events GROUP BY 1, 2, 3
HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""")

ORACLE["stream_window_quantiles"] = _ieee_round("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       event_type, COUNT(*) AS n_rows, COUNT(value) AS n_values,
       ROUND(QUANTILE_DISC(value, 0.25), 6) AS q25, ROUND(QUANTILE_DISC(value, 0.5), 6) AS q50, ROUND(QUANTILE_DISC(value, 0.75), 6) AS q75
FROM events GROUP BY 1, 2, 3
HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""")

# The sketches' bounds hold, so both flags are true wherever a column has them.
ORACLE["incremental_profile"] = _ieee_round(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_missing, {lo} AS min, {hi} AS max, "
    f"TRUE AS distinct_within, {flag} AS median_within FROM orders" for c, lo, hi, flag in (
        ("o_custkey", "CAST(MIN(o_custkey) AS DOUBLE)", "CAST(MAX(o_custkey) AS DOUBLE)", "TRUE"),
        ("o_totalprice", "ROUND(MIN(o_totalprice), 6)", "ROUND(MAX(o_totalprice), 6)", "TRUE"),
        ("o_orderstatus", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS BOOLEAN)"))))

ORACLE["stream_log_once"] = "SELECT o_orderkey, o_orderstatus, 'daily' AS run FROM orders"

ORACLE["source_csv_blank_header"] = """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"""

ORACLE["history_last"] = """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'
ORDER BY o_orderkey DESC, o_orderstatus DESC LIMIT 10"""

ORACLE["linear_models"] = _ieee_round("""
WITH s AS (SELECT COUNT(*) AS n, AVG(l_quantity) AS mx, AVG(l_extendedprice) AS my,
                  REGR_SXY(l_extendedprice, l_quantity) AS sxy, REGR_SXX(l_extendedprice, l_quantity) AS sxx FROM lineitem),
m AS (SELECT 'LinearRegression' AS model, sxy / sxx AS slope, mx, my FROM s
      UNION ALL SELECT 'Ridge', sxy / (sxx + 1.0), mx, my FROM s)
SELECT model, ROUND(slope, 3) AS slope, ROUND(my - slope * mx, 2) AS intercept, ROUND(my, 3) AS mean_prediction FROM m""")

ORACLE["advice_rules"] = _ieee_round(fixture_cte("orders_scores") + """
, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY val_f1 DESC NULLS LAST, model_name) AS rank FROM orders_scores)
SELECT model_name, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_best, ROUND(train_f1 - val_f1, 6) AS gap,
       CASE WHEN status <> 'ok' THEN 'failed' WHEN train_f1 - val_f1 > 0.1 THEN 'overfitting'
            WHEN val_f1 < 0.5 THEN 'underfitting' ELSE 'good fit' END AS verdict
FROM r""")


ORACLE["predict_knn"] = """
WITH st AS (SELECT AVG(c_acctbal) AS ma, STDDEV_POP(c_acctbal) AS sa, AVG(c_nationkey) AS mn, STDDEV_POP(c_nationkey) AS sn
            FROM customer WHERE c_custkey % 4 <> 0),
p AS (SELECT c_custkey, c_mktsegment, (c_acctbal - ma) / sa AS a, (c_nationkey - mn) / sn AS b FROM customer, st),
r AS (SELECT q.c_custkey AS qid, t.c_mktsegment AS label,
             ROW_NUMBER() OVER (PARTITION BY q.c_custkey ORDER BY SQRT((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b)),
                                t.c_custkey) AS rk
      FROM p q, p t WHERE t.c_custkey % 4 <> 0),
v AS (SELECT qid, label, COUNT(*) AS votes FROM r WHERE rk <= 5 GROUP BY qid, label),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS o FROM v)
SELECT qid AS c_custkey, label AS prediction FROM b WHERE o = 1"""

# Squared loss: g = mean - y and h = 1, so G and H of a side are its count and sum; ridge 1, rate 0.1.
ORACLE["boosting_first_split"] = _ieee_round("""
WITH base AS (SELECT AVG(l_extendedprice) AS m, COUNT(*) AS n FROM lineitem),
x AS (SELECT UNNEST([1, 2, 3]) AS f, UNNEST(['l_quantity', 'l_discount', 'l_tax']) AS feature,
             UNNEST([l_quantity, l_discount, l_tax])::DOUBLE AS v, m - l_extendedprice AS g FROM lineitem, base),
h AS (SELECT f, feature, v, SUM(g) AS g, COUNT(*) AS h FROM x GROUP BY f, feature, v),
c AS (SELECT f, feature, v AS edge, SUM(g) OVER w AS gl, SUM(h) OVER w AS hl, SUM(g) OVER t AS tg, SUM(h) OVER t AS th FROM h
      WINDOW w AS (PARTITION BY f ORDER BY v), t AS (PARTITION BY f)),
s AS (SELECT *, (gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1)) / 2 AS gain FROM c WHERE th > hl),
b AS (SELECT * FROM s ORDER BY gain DESC, f, edge LIMIT 1)
SELECT feature, ROUND(edge, 4) AS edge, l AS "left", CAST(CASE WHEN l THEN hl ELSE th - hl END AS BIGINT) AS n_rows,
       ROUND(m - 0.1 * CASE WHEN l THEN gl / (hl + 1) ELSE (tg - gl) / (th - hl + 1) END, 3) AS prediction
FROM b, base, (VALUES (TRUE), (FALSE)) sides(l)""")
