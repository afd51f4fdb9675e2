"""Mixing sources to target weights by capped water-filling.

``plan_mix`` gives one row per source: how many words of it the mix wants
(``target``), how often each of its documents is taken for sure (``whole``)
and up to which hash value a document is taken once more (``cut``; ``more``
lists ranges of hashes above it from which documents up to a size are taken
too, ``extra`` is the hash of one further document that fills the last gap).
The decision about a document is then a function of its own row and its source's
plan row, so ``apply_mix`` needs no shuffle of texts.

Cases with a defined result: null and empty texts have size 0 and take 0
words; a null source is a source of its own; sources without weight or words
get target 0; an empty table gives empty results.  Only rows equal in id and
text share a hash; the last one up to the target decides for all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, unit_hash, word_count, written

HASH_BITS = 60
RANGES = "array<struct<lo: bigint, hi: bigint, most: double>>"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: int = 17) -> DataFrame:
    """Narrow rows (doc_id, source, size, u) of all documents; one scan of the texts."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"),
                       unit_hash(seed, F.col(id_col), F.col(text_col)).alias("u"))


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """``sources`` (source, ...) with ``weight``: ``weights`` repeating over the sources in code point order, null last.

    Ranks are distributed: the sorted table's partitions are counted and each
    row adds the rows of the partitions before its own.
    """
    at = (sources.select("source").distinct().orderBy(F.col("source").asc_nulls_last())
          .withColumn("at", F.monotonically_increasing_id()))
    at = written(at.select("source", F.shiftright("at", 33).alias("part"),
                           F.col("at").bitwiseAND((1 << 33) - 1).alias("nth")), "sources")
    # one row per partition of the sort, not per source
    before = (at.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    nth = (F.col("nth") + F.col("before")) % len(weights)
    return (at.join(before, "part")
            .select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (nth + 1).cast("int")).alias("weight")))


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Targets for (source, source_size, weight): shares of ``budget`` by weight, none above
    ``max_epochs`` times its source.

    Each round shares what is left among the sources that are not clamped; the
    level (words per unit of weight) only rises, so the clamped sources of a
    round are those whose cap lies below the level, and a round is one
    aggregate.  When every source is clamped the budget can't be met and each
    gets its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    level, clamped = None, -1
    while True:
        under = F.lit(False) if level is None else cap <= F.lit(level) * weight
        row = sources.agg(F.sum(F.when(under & (weight > 0), cap)).alias("full"),
                          F.sum(F.when(~under, weight)).alias("w"),
                          F.sum(F.when(under & (weight > 0), 1)).alias("n")).first()
        left = row["w"] or 0.0
        if left <= 0.0:
            level = math.inf if clamped >= 0 else 0.0
            break
        if (row["n"] or 0) == clamped:
            break
        level, clamped = (budget - (row["full"] or 0.0)) / left, row["n"] or 0
    share = cap if level == math.inf else F.least(cap, F.lit(level) * weight)
    return sources.withColumn("target", F.when(weight > 0, share).otherwise(F.lit(0.0)))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left.source.eqNullSafe(right.source)


def fill_gaps(rows: DataFrame, plan: DataFrame, within: float, shift: int) -> DataFrame:
    """``plan`` with ``more`` and a smaller ``gap``: as if each source went on in hash order and took every document that still fits.

    A round takes, from where the last one was stopped, the documents no larger
    than the gap, up to the first that overshoots it; that one fits no later gap
    either, so the next round starts after it.  A round is two bucketed sums as
    in ``plan_mix``.  A source is done when its gap is at most ``within`` of its
    target or no document is left that fits.
    """
    end = (1 << HASH_BITS) - 1
    bucket = F.shiftright("u", shift)
    plan = plan.withColumns({"more": F.array().cast(RANGES), "at": F.col("cut")})
    while True:
        plan = written(plan, "gaps")
        short = plan.where((F.col("gap") > within * F.col("target")) & (F.col("at") < end)).select("source", "gap", "at")
        if short.isEmpty():
            return plan.drop("at")
        left = (rows.join(short, _same(rows, short))
                .where((F.col("u") > F.col("at")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
                .select(rows.source, "u", "size", "gap", bucket.alias("bucket")))
        sums = left.groupBy("source", "gap", "bucket").agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
        fits = F.col("upto") <= F.col("gap")
        edge = written(sums.withColumn("upto", upto).groupBy("source")
                       .agg(F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("before"),
                            F.min(F.when(~fits, F.col("bucket"))).alias("edge")), "edges")
        near = (left.join(edge, _same(left, edge) & (left.bucket == edge.edge))
                .groupBy(left.source, "gap", "before", "u").agg(F.sum("size").alias("s")))
        near = near.withColumn("upto", F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy("u")))
        near = near.groupBy("source").agg(F.max(F.when(fits, F.col("u"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("upto"),
                                          F.min(F.when(~fits, F.col("u"))).alias("stop"))
        found = (edge.join(near, _same(edge, near), "left")
                 .select(edge.source, F.coalesce("last", F.shiftleft("edge", shift) - 1, F.lit(end)).alias("hi"),
                         F.coalesce("upto", "before").alias("got"), F.coalesce("stop", F.lit(end)).alias("stop")))
        found = written(found, "found")
        taken = F.array(F.struct(F.col("at").alias("lo"), F.col("hi"), F.col("gap").alias("most"))).cast(RANGES)
        active = (F.col("gap") > within * F.col("target")) & (F.col("at") < end)
        plan = (plan.join(found, _same(plan, found), "left")
                .select(*[plan[c] for c in plan.columns if c not in ("gap", "more", "at")],
                        (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap"),
                        F.when(F.col("got") > 0, F.concat("more", taken)).otherwise(F.col("more")).alias("more"),
                        F.when(active, F.coalesce("stop", F.lit(end))).otherwise(F.col("at")).alias("at")))


def plan_mix(rows: DataFrame, weights: DataFrame, share: float = 1.5, max_epochs: float = 2.0,
             within: float | None = None) -> DataFrame:
    """(source, source_size, target, whole, cut, extra, more) from ``sized`` rows and (source, weight).

    ``share``: the mix's size as a multiple of all sizes.  The fractional part
    of a target is filled in hash order: sizes are summed per (source, hash
    range), then only the range in which the target falls is summed row by
    row.  There are about sqrt(rows) ranges, so neither level puts a whole
    source into one task.  The gap that the next document would overshoot is
    filled by the one document (``extra``) whose size comes nearest to it; with
    ``within``, a gap above that share of the target is first filled by the
    documents further on that fit (``fill_gaps``).
    """
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")),
                      "sizes")
    total = sources.agg(F.sum("source_size").alias("s"), F.max("n").alias("n")).first()
    sources = sources.join(weights, sources.source.eqNullSafe(weights.source), "left").select(sources["*"], "weight")
    plan = fill(sources, share * float(total["s"] or 0), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = (plan.withColumn("whole", whole.cast("long"))
            .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))))
    plan = written(plan.select("source", "source_size", "target", "whole", "rest"), "targets")

    bits = max(4, math.ceil(math.log2(max(total["n"] or 1, 1)) / 2))
    shift = HASH_BITS - bits
    bucket = F.shiftright("u", shift)
    key = lambda left, right: left.source.eqNullSafe(right.source)
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("s"))
    before = F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")
    sums = sums.withColumn("before", before)
    edge = (sums.join(plan, key(sums, plan))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s")))
            .select(plan.source, "bucket", "before", "rest"))
    edge = written(edge, "edges")
    near = (rows.withColumn("bucket", bucket).alias("r")
            .join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source"))
                  & (F.col("r.bucket") == F.col("e.bucket")))
            .groupBy("e.source", "e.bucket", "e.before", "e.rest", "r.u").agg(F.sum("r.size").alias("s")))
    upto = F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy("u"))
    near = near.withColumn("upto", upto)
    fits = F.col("upto") <= F.col("rest")
    cut = near.groupBy("source", "bucket", "before").agg(F.max(F.when(fits, F.col("u"))).alias("c"),
                                                         F.max(F.when(fits, F.col("upto"))).alias("got"))
    cut = cut.select("source", F.coalesce("c", F.shiftleft("bucket", shift) - 1).alias("cut"),
                     F.coalesce("got", "before").alias("got"))
    plan = written(plan.join(cut, key(plan, cut), "left")
                   .select(plan["*"], F.coalesce("cut", F.lit(-1)).cast("long").alias("cut"),
                           (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap")), "cuts")
    plan = with_extra(rows, plan.withColumn("more", F.array().cast(RANGES)))
    if within is not None:
        # a source keeps its first cut where going on ends further from the target
        on = with_extra(rows, fill_gaps(rows, plan.select("source", "target", "cut", "gap"), within, shift))
        closer = F.when(on.miss < plan.miss, True).otherwise(False)
        plan = (plan.join(on, _same(plan, on))
                .select(*[plan[c] for c in plan.columns if c not in ("more", "extra")],
                        *[F.when(closer, on[c]).otherwise(plan[c]).alias(c) for c in ("more", "extra")]))
    return written(plan.select("source", "source_size", "target", "whole", "cut", "extra", "more"), "mix")


def with_extra(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``extra`` (-1: none) and ``miss``, how far from the target the source then is."""
    off = F.abs(F.col("r.size") - F.col("p.gap"))
    extra = (rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
             .where((F.col("r.u") > F.col("p.cut")) & (off < F.col("p.gap"))
                    & ~in_ranges(F.col("r.u"), F.col("r.size"), F.col("p.more")))
             .groupBy(F.col("p.source").alias("of")).agg(F.min(F.struct(off.alias("off"), F.col("r.u").alias("u"))).alias("best")))
    return written(plan.join(extra, F.col("source").eqNullSafe(F.col("of")), "left")
                   .select(*plan.columns, F.coalesce("best.u", F.lit(-1)).cast("long").alias("extra"),
                           F.coalesce("best.off", "gap").alias("miss")), "extras")


def in_ranges(u: Column, size: Column, more: Column) -> Column:
    """Whether one of the ranges takes a document."""
    return F.exists(more, lambda x: (u > x["lo"]) & (u <= x["hi"]) & (size > 0) & (size <= x["most"]))


def repeats(u: Column, whole: Column, cut: Column, extra: Column, size: Column | None = None, more: Column | None = None) -> Column:
    """How often the mix takes a document."""
    once = (u <= cut) | (u == extra)
    return whole + F.when(once if more is None else once | in_ranges(u, size, more), 1).otherwise(0)


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (same columns)."""
    names = list(docs.columns)
    free = {}
    for k in ("mix_source", "mix_whole", "mix_cut", "mix_extra", "mix_more", "mix_times"):
        free[k] = free_name(names, k)
        names.append(free[k])
    p = plan.select(*[F.col(k[4:]).alias(free[k]) for k in list(free)[:5]])
    own = {c: docs[f"`{c}`"] for c in docs.columns}
    d = docs.join(p, own[source_col].cast("string").eqNullSafe(p[free["mix_source"]]))
    times = repeats(unit_hash(seed, own[id_col], own[text_col]), *[p[free[k]] for k in ("mix_whole", "mix_cut", "mix_extra")],
                    word_count(own[text_col]), p[free["mix_more"]])
    return (d.withColumn(free["mix_times"], times).where(F.col(free["mix_times"]) > 0)
            .withColumn(free["mix_times"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(free["mix_times"]).cast("long"))))
            .select(*own.values()))
