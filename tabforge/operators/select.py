"""Feature selection (R18-R20): quasi-constant, duplicate and correlated
columns.  Each rule is a fixed number of aggregate passes over all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import col, numeric_columns
from tabforge.operators.impute import modes

# The predominant-value share that makes a column "constant".
CONSTANT_TOL = 0.99
CONSTANT_TOL_CLUSTERING = 0.98
CORRELATION_THRESHOLD = 0.95


def quasi_constant(df: DataFrame, cols: list[str] | None = None, tol: float = CONSTANT_TOL,
                   accuracy: int = 10000) -> list[str]:
    """Columns whose most frequent value holds >= ``tol`` of non-null rows.

    A value holding a share >= tol >= 0.5 of the rows covers every rank from
    (1 - tol) to tol, so its column has equal quantiles at both ends; one
    sketch pass finds those candidates and one count pass confirms them.
    Text columns use the grouped mode (partial aggregation)."""
    cols = list(df.columns) if cols is None else list(cols)
    if not cols:
        return []
    num = [c for c in cols if c in set(numeric_columns(df))]
    txt = [c for c in cols if c not in num]
    cand: dict[str, object] = {}
    if num:
        lo_p, hi_p = min(0.5, 1.0 - tol + 2.0 / accuracy), max(0.5, tol - 2.0 / accuracy)
        row = df.agg(*[F.percentile_approx(col(c).cast("double"), [lo_p, hi_p], accuracy).alias(f"p{i}")
                       for i, c in enumerate(num)]).first()
        for i, c in enumerate(num):
            p = row[f"p{i}"]
            if p is not None and p[0] == p[1]:
                cand[c] = p[0]
    if txt:
        cand.update({c: v for c, v in modes(df, txt).items() if v is not None})
    if not cand:
        return []
    names = list(cand)
    aggs = []
    for i, c in enumerate(names):
        x = col(c).cast("double") if c in num else col(c).cast("string")
        aggs += [F.count_if(x == F.lit(cand[c])).alias(f"t{i}"), F.count(x).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(names):
        n = int(r[f"n{i}"])
        if n and int(r[f"t{i}"]) / n >= tol:
            out.append(c)
    return [c for c in cols if c in out]


def _print(c: str):
    """Fingerprint of a column; summed as a decimal, which no row count overflows."""
    return F.sum(F.xxhash64(F.col("__h"), col(c).cast("string")).cast("decimal(38,0)"))


def duplicates(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Columns equal (null-safe, row by row) to an earlier column; keep first.

    Pass 1 fingerprints each column as sum(xxhash64(row hash, value)), where the
    row hash covers all listed columns, so equal columns get equal prints and a
    mere permutation does not.  Pass 2 confirms candidate pairs exactly with
    count_if(NOT a <=> b) = 0."""
    cols = list(df.columns) if cols is None else list(cols)
    if len(cols) < 2:
        return []
    rowh = F.xxhash64(*[col(c) for c in cols])
    types = {c: df.schema[c].dataType.simpleString() for c in cols}
    fp = df.select(rowh.alias("__h"), *[col(c) for c in cols]).agg(*[
        _print(c).alias(f"f{i}") for i, c in enumerate(cols)]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(cols):
        groups.setdefault((fp[f"f{i}"],), []).append(c)
    pairs = []
    for members in groups.values():
        for m in members[1:]:
            pairs.append((members[0], m))
    if not pairs:
        return []
    r = df.agg(*[F.count_if(~col(a).cast("string").eqNullSafe(col(b).cast("string"))).alias(f"x{k}")
                 for k, (a, b) in enumerate(pairs)]).first()
    dup = {b for k, (a, b) in enumerate(pairs) if int(r[f"x{k}"]) == 0 and types[a] == types[b]}
    return [c for c in cols if c in dup]


def constant_and_duplicates(df: DataFrame, cols: list[str], tol: float | None = CONSTANT_TOL,
                            drop_dup: bool = True, accuracy: int = 10000) -> tuple[list[str], list[str]]:
    """R18 + R19 sharing their passes: one aggregate holds the quantile probes
    of every numeric column and the fingerprint of every column; a second one
    confirms the constant candidates and the duplicate pairs together.
    Duplicates are looked for among the columns that are not constant; with
    ``tol`` None no column counts as constant."""
    num = [c for c in cols if c in set(numeric_columns(df))] if tol is not None else []
    txt = [c for c in cols if c not in num] if tol is not None else []
    tol = 1.0 if tol is None else tol
    lo_p, hi_p = min(0.5, 1.0 - tol + 2.0 / accuracy), max(0.5, tol - 2.0 / accuracy)
    rowh = F.xxhash64(*[col(c) for c in cols])
    aggs = [F.percentile_approx(col(c).cast("double"), [lo_p, hi_p], accuracy).alias(f"p{i}")
            for i, c in enumerate(num)]
    if drop_dup and len(cols) >= 2:
        aggs += [_print(c).alias(f"f{i}") for i, c in enumerate(cols)]
    base = df.select(rowh.alias("__h"), *[col(c) for c in cols])
    r1 = base.agg(*aggs).first() if aggs else None
    cand: dict[str, object] = {}
    for i, c in enumerate(num):
        p = r1[f"p{i}"]
        if p is not None and p[0] == p[1]:
            cand[c] = p[0]
    if txt:
        cand.update({c: v for c, v in modes(df, txt).items() if v is not None})
    groups: dict = {}
    if drop_dup and len(cols) >= 2:
        for i, c in enumerate(cols):
            groups.setdefault(r1[f"f{i}"], []).append(c)
    pairs = [(m[0], x) for m in groups.values() for x in m[1:]]
    types = {c: df.schema[c].dataType.simpleString() for c in cols}
    aggs2 = []
    names = list(cand)
    for i, c in enumerate(names):
        x = col(c).cast("double") if c in num else col(c).cast("string")
        aggs2 += [F.count_if(x == F.lit(cand[c])).alias(f"t{i}"), F.count(x).alias(f"n{i}")]
    aggs2 += [F.count_if(~col(a).cast("string").eqNullSafe(col(b).cast("string"))).alias(f"x{k}")
              for k, (a, b) in enumerate(pairs)]
    r2 = df.agg(*aggs2).first() if aggs2 else None
    const = {c for i, c in enumerate(names)
             if int(r2[f"n{i}"]) and int(r2[f"t{i}"]) / int(r2[f"n{i}"]) >= tol}
    # duplicates among the non-constant columns, keep first
    same = {(a, b) for k, (a, b) in enumerate(pairs) if int(r2[f"x{k}"]) == 0 and types[a] == types[b]}
    dup = set()
    for members in groups.values():
        # columns proven equal to the group's first member (identical columns
        # are constant together); the first one not dropped as constant stays
        ident = [members[0]] + [b for b in members[1:] if (members[0], b) in same]
        live = [c for c in ident if c not in const]
        dup.update(live[1:])
    return [c for c in cols if c in const], [c for c in cols if c in dup]


def correlated(df: DataFrame, cols: list[str] | None = None,
               threshold: float = CORRELATION_THRESHOLD) -> list[str]:
    """Greedy keep-first: walking the columns in order, a kept column
    drops every later column with |r| > threshold.  One pass for all pairs."""
    cols = numeric_columns(df) if cols is None else list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return []
    from tabforge.operators.profile import pair_correlations
    corr = dict(zip(pairs, pair_correlations(df, pairs)))
    dropped: set[str] = set()
    for i, a in enumerate(cols):
        if a in dropped:
            continue
        for b in cols[i + 1:]:
            v = corr[(a, b)]
            if b not in dropped and v is not None and abs(v) > threshold:
                dropped.add(b)
    return [c for c in cols if c in dropped]
