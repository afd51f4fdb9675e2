"""Feature engineering (R4): a list of (new column, [a, b], operation) rules.

Rules whose sources are missing or whose operation cannot be parsed are
skipped; the accepted list is what ``transform`` replays.  A rule may use a
column created by an earlier rule (``withColumn`` in order)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabforge.functions.scalar import binary_feature, parse_operation


def accept(suggestions: list[dict], columns: list[str]) -> list[list[str]]:
    """Validate suggestions against the columns available in order."""
    cols = list(columns)
    out = []
    for s in suggestions or []:
        src = s.get("source_columns", [])
        if len(src) != 2 or not all(c in cols for c in src):
            continue
        op = s.get("operation") or parse_operation(s.get("transformation", []), src)
        if op is None:
            continue
        out.append([s["new_feature"], src[0], src[1], op])
        cols.append(s["new_feature"])
    return out


def apply(df: DataFrame, rules: list[list[str]]) -> DataFrame:
    for new, a, b, op in rules:
        if a in df.columns and b in df.columns:
            df = df.withColumn(new, binary_feature(op, [a, b]))
    return df
