"""Exact quantiles (linear interpolation, as pandas ``quantile`` / SQL
``quantile_cont``) that never put a whole column into one task.

Spark's exact ``percentile`` aggregate keeps a value->count map of the whole
column in the single final-merge task, which does not survive a 100 TB
column.  Here:

1. sketch: ``count``/``min``/``max`` and ``percentile_approx`` probes just
   below and above each wanted probability (GK sketch, bounded memory).  These
   aggregates can ride along in a caller's own aggregate pass;
2. proof: one pass of ``count_if`` per bracket (rows below it, rows inside
   it) shows the bracket holds the wanted ranks; a bracket that misses falls
   back to the full range.  An HLL estimate gives the distinct values inside;
3. refine: brackets holding more than ``collect_cap`` distinct values get a further
   sketch restricted to the bracket rows (each round shrinks a bracket by
   about ``accuracy / 8``), then step 2 again;
4. collect: the bracket rows are grouped by value (partial aggregation) and at
   most ``collect_cap`` (value, count) pairs per bracket reach the driver,
   from which the order statistics are read.

Fast path (the common case): per column the brackets are merged into
disjoint intervals, and one pass places every row in a gap or an interval:
gap rows are only counted (partial aggregation folds them per task), rows
inside an interval are grouped by value (at most ``collect_cap`` groups per
interval are collected).  The counts prove (or refute) that an interval holds
its ranks; only refuted or oversized brackets go through the loop above.  So
the common case is 2 light Spark jobs, 1 when the sketch rides along in a
caller's aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabforge.functions.columns import col

DEFAULT_ACCURACY = 5000
DEFAULT_COLLECT_CAP = 100_000   # values of a bracket that come to the driver; wider brackets are narrowed first


@dataclass(eq=False)
class _Target:
    column: str
    ranks: tuple[int, ...]          # 0-based order statistics wanted, ascending
    lo: float = -math.inf           # bracket, inclusive
    hi: float = math.inf
    below: int | None = None        # rows with value < lo
    inside: int | None = None       # rows with lo <= value <= hi
    distinct: int | None = None     # approx distinct values inside (what collect brings back)
    stalled: bool = False           # last refinement did not narrow the bracket
    values: dict[int, float] = field(default_factory=dict)


def _dbl(name: str) -> Column:
    return col(name).cast("double")


class QuantileJob:
    """Exact quantiles of several columns; see module docstring."""

    def __init__(self, probs: dict[str, list[float]], prefix: str = "__q",
                 accuracy: int = DEFAULT_ACCURACY, collect_cap: int = DEFAULT_COLLECT_CAP):
        self.probs = {c: list(ps) for c, ps in probs.items()}
        self.cols = list(self.probs)
        self.prefix = prefix
        self.accuracy = accuracy
        self.collect_cap = collect_cap
        self.margin = 4.0 / accuracy

    # ---- step 1 ---------------------------------------------------------
    def _probe_list(self, c: str) -> list[float]:
        out = []
        for p in self.probs[c]:
            out += [max(0.0, p - self.margin), min(1.0, p + self.margin)]
        return out

    def sketch_aggs(self) -> list[Column]:
        aggs = []
        for i, c in enumerate(self.cols):
            v = _dbl(c)
            aggs += [F.count(v).alias(f"{self.prefix}n{i}"),
                     F.min(v).alias(f"{self.prefix}lo{i}"),
                     F.max(v).alias(f"{self.prefix}hi{i}"),
                     F.percentile_approx(v, self._probe_list(c), self.accuracy)
                      .alias(f"{self.prefix}p{i}")]
        return aggs

    # ---- steps 2-4 ------------------------------------------------------
    def finish(self, df: DataFrame, row: Row) -> dict[str, list[float | None]]:
        targets: list[_Target] = []
        counts: dict[str, int] = {}
        per_col: dict[str, list[_Target]] = {}
        for i, c in enumerate(self.cols):
            n = int(row[f"{self.prefix}n{i}"])
            counts[c] = n
            if n == 0:
                continue
            mn, mx = float(row[f"{self.prefix}lo{i}"]), float(row[f"{self.prefix}hi{i}"])
            probes = row[f"{self.prefix}p{i}"]
            per_col[c] = []
            for j, p in enumerate(self.probs[c]):
                h = (n - 1) * p
                t = _Target(c, tuple(sorted({math.floor(h), math.ceil(h)})))
                lo, hi = float(probes[2 * j]), float(probes[2 * j + 1])
                t.lo = mn if p - self.margin <= 0 else lo
                t.hi = mx if p + self.margin >= 1 else hi
                targets.append(t)
                per_col[c].append(t)

        # the sketch has told how many rows a bracket holds: where those are too many to collect,
        # the pass that lists them is left out and the bracket is narrowed first
        wide = [t for t in targets if counts[t.column] * 2 * self.margin > self.collect_cap]
        few = [t for t in targets if t not in wide]
        slow = wide + (self._fast(df, few) if few else [])
        while slow:
            self._verify(df, slow)
            big = [t for t in slow if t.inside > self.collect_cap and t.lo < t.hi
                   and not (t.distinct is not None and t.distinct <= self.collect_cap)]
            if not big:
                self._collect(df, slow)
                break
            if all(t.stalled for t in big):  # a finer sketch narrows further
                self.accuracy *= 4
                self.margin = 4.0 / self.accuracy
            self._refine(df, big)

        out: dict[str, list[float | None]] = {}
        for c in self.cols:
            n = counts[c]
            if n == 0:
                out[c] = [None] * len(self.probs[c])
                continue
            vals = []
            for p, t in zip(self.probs[c], per_col[c]):
                h = (n - 1) * p
                k = math.floor(h)
                lo_v, hi_v = t.values[k], t.values[math.ceil(h)]
                d = h - k
                vals.append(lo_v if d == 0 else lo_v + (hi_v - lo_v) * d)
            out[c] = vals
        return out

    def run(self, df: DataFrame) -> dict[str, list[float | None]]:
        return self.finish(df, df.agg(*self.sketch_aggs()).first())

    def _fast(self, df: DataFrame, targets: list[_Target]) -> list[_Target]:
        """One light pass: per column, each row is placed in a gap between the
        merged intervals or inside one of them.  Gap rows carry no value, so
        partial aggregation folds them into one row per (column, gap) per
        task; rows inside an interval are grouped by value (at most
        ``collect_cap`` groups per interval are collected).  The rows below an
        interval are the prefix sum of the positions before it.  Returns the
        targets whose interval does not hold their ranks (left for the slow
        loop)."""
        by_col: dict[str, list[_Target]] = {}
        for t in targets:
            by_col.setdefault(t.column, []).append(t)
        layout = []      # per column: list of [lo, hi, [targets]]
        for c, ts in by_col.items():
            ivs: list[list] = []
            for t in sorted(ts, key=lambda t: t.lo):
                if ivs and t.lo <= ivs[-1][1]:
                    ivs[-1][1] = max(ivs[-1][1], t.hi)
                    ivs[-1][2].append(t)
                else:
                    ivs.append([t.lo, t.hi, [t]])
            layout.append((c, ivs))
        entries = []
        for ci, (c, ivs) in enumerate(layout):
            v = _dbl(c)
            # position: 2k = gap below interval k, 2k + 1 = inside interval k
            pos = None
            for k, (lo, hi, _) in enumerate(ivs):
                pos = (F.when(v < F.lit(lo), F.lit(2 * k)) if pos is None
                       else pos.when(v < F.lit(lo), F.lit(2 * k)))
                pos = pos.when(v <= F.lit(hi), F.lit(2 * k + 1))
            pos = pos.otherwise(F.lit(2 * len(ivs)))
            entries.append(F.when(v.isNotNull(), F.struct(
                F.lit(ci).alias("c"), pos.alias("s"),
                F.when(pos % 2 == 1, v).alias("v"))))
        n_iv = sum(len(ivs) for _, ivs in layout)
        limit = self.collect_cap * n_iv + n_iv + len(layout)   # values + gap rows
        grouped = (df.select(F.explode(F.array(*entries)).alias("e"))
                     .where(F.col("e").isNotNull())
                     .groupBy("e.c", "e.s", "e.v").count())
        got = grouped.limit(limit + 1).collect()   # bounded by construction
        if len(got) > limit:
            return targets
        per_pos: dict[tuple[int, int], int] = {}
        segs: dict[tuple[int, int], list[tuple]] = {}
        for r in got:
            ci, sp, n = int(r["c"]), int(r["s"]), int(r["count"])
            per_pos[(ci, sp)] = per_pos.get((ci, sp), 0) + n
            if sp % 2 == 1:
                segs.setdefault((ci, sp // 2), []).append((r["v"], n))
        slow = []
        for ci, (c, ivs) in enumerate(layout):
            for k, (lo, hi, ts) in enumerate(ivs):
                b = sum(per_pos.get((ci, sp), 0) for sp in range(2 * k + 1))
                pairs = sorted(segs.get((ci, k), []))
                inside = sum(n for _, n in pairs)
                for t in ts:
                    if b <= t.ranks[0] and b + inside > t.ranks[-1]:
                        pos_, j = b, 0
                        for rk in t.ranks:
                            while pos_ + pairs[j][1] <= rk:
                                pos_ += pairs[j][1]
                                j += 1
                            t.values[rk] = float(pairs[j][0])
                    else:
                        t.lo, t.hi = -math.inf, math.inf
                        slow.append(t)
        return slow

    def _verify(self, df: DataFrame, targets: list[_Target]) -> None:
        todo = [t for t in targets if t.below is None]
        while todo:
            aggs = []
            for i, t in enumerate(todo):
                v = _dbl(t.column)
                aggs.append(F.count_if(v < F.lit(t.lo)).alias(f"b{i}"))
                inb = (v >= F.lit(t.lo)) & (v <= F.lit(t.hi))
                aggs.append(F.count_if(inb).alias(f"n{i}"))
                if t.stalled:  # the sketch could not shrink it: many duplicates?
                    aggs.append(F.approx_count_distinct(F.when(inb, v), 0.02).alias(f"d{i}"))
            r = df.agg(*aggs).first()
            retry = []
            for i, t in enumerate(todo):
                b, n = int(r[f"b{i}"]), int(r[f"n{i}"])
                if b <= t.ranks[0] and b + n > t.ranks[-1]:
                    t.below, t.inside = b, n
                    t.distinct = int(r[f"d{i}"]) if t.stalled else None
                else:  # sketch error beyond its bound: take the full range
                    t.lo, t.hi = -math.inf, math.inf
                    retry.append(t)
            todo = retry

    def _refine(self, df: DataFrame, targets: list[_Target]) -> None:
        aggs, probes = [], []
        for i, t in enumerate(targets):
            ps = []
            for k in (t.ranks[0], t.ranks[-1]):
                rel = (k - t.below + 0.5) / t.inside
                ps += [min(1.0, max(0.0, rel - self.margin)), min(1.0, max(0.0, rel + self.margin))]
            ps = [min(ps), max(ps)]
            probes.append(ps)
            v = _dbl(t.column)
            inb = F.when((v >= F.lit(t.lo)) & (v <= F.lit(t.hi)), v)
            aggs.append(F.percentile_approx(inb, ps, self.accuracy).alias(f"p{i}"))
        r = df.agg(*aggs).first()
        for i, t in enumerate(targets):
            got = r[f"p{i}"]
            lo = t.lo if probes[i][0] <= 0.0 else float(got[0])
            hi = t.hi if probes[i][1] >= 1.0 else float(got[1])
            t.stalled = (lo, hi) == (t.lo, t.hi)
            t.lo, t.hi, t.below, t.inside = lo, hi, None, None

    def _collect(self, df: DataFrame, targets: list[_Target]) -> None:
        entries = []
        for i, t in enumerate(targets):
            v = _dbl(t.column)
            entries.append(F.when((v >= F.lit(t.lo)) & (v <= F.lit(t.hi)),
                                  F.struct(F.lit(i).alias("t"), v.alias("v"))))
        grouped = (df.select(F.explode(F.array(*entries)).alias("e"))
                     .where(F.col("e").isNotNull())
                     .select("e.t", "e.v")
                     .groupBy("t", "v").count())
        pairs: dict[int, list[tuple[float, int]]] = {}
        for r in grouped.collect():  # bounded by collect_cap per bracket
            pairs.setdefault(int(r["t"]), []).append((float(r["v"]), int(r["count"])))
        for i, t in enumerate(targets):
            ps = sorted(pairs.get(i, []))
            pos, j = t.below, 0
            for k in t.ranks:
                while pos + ps[j][1] <= k:
                    pos += ps[j][1]
                    j += 1
                t.values[k] = ps[j][0]


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]], **kw) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column (``None`` for all-null columns)."""
    if not probs:
        return {}
    return QuantileJob(probs, **kw).run(df)


def medians(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    res = exact_quantiles(df, {c: [0.5] for c in cols}, **kw)
    return {c: v[0] for c, v in res.items()}
