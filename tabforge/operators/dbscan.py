"""DBSCAN (M14) by cells of side eps / sqrt(d), without the pairs within eps.

1. Points of one cell lie within eps of each other, so all points of a cell
   with ``min_samples`` points or more are core points; only points of
   smaller cells count their neighbours, in the cells whose boxes lie within
   eps.  Those pairs of cells come from the exact range join of ``neighbors``
   over the cells' middles.
2. Core points of a cell are linked to its smallest id.  Two cells are linked
   if two of their outermost core points lie within eps; pairs of cells that
   stay in different components after that are compared point by point.  So
   clusters are exact, and dense data costs rows, not pairs.  Components come
   from min-label propagation with pointer jumping, checkpointed every round.
3. Border points take the smallest label among their core neighbours.  The
   rest is noise (-1), as are points with missing or infinite values.

Labels are numbered 0.. in order of the smallest point id of each cluster,
which is the discovery order of a scan in id order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import col
from tabforge.operators.metrics import sqdist, to_array
from tabforge.operators.neighbors import WIDE, PivotIndex, range_pairs
from tabforge.operators.boosting import _written

INLINE_LABELS = 100_000
SLACK = 1e-6              # share by which cells are smaller than eps allows, beyond any rounding of their bounds
FAR = float(1 << 28)      # cell numbers beyond this lose digits; such values are cells of their own


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; a checkpoint keeps constraints on columns that a later union can't name."""
    return _written(df, "dbscan")


def _distance(a: str, b: str, d: int) -> Column:
    """Distance of two array columns of length ``d``."""
    if d > WIDE:
        return F.sqrt(sqdist(F.col(a), F.col(b)))
    return F.sqrt(sum(((F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(d)), F.lit(0.0)))


def _box_distance(lo1: str, hi1: str, lo2: str, hi2: str, d: int) -> Column:
    """Distance of two boxes (or of a point, given as both bounds, and a box)."""
    gap = lambda i: F.greatest(F.col(lo1)[i] - F.col(hi2)[i], F.col(lo2)[i] - F.col(hi1)[i], F.lit(0.0))
    return F.sqrt(sum((gap(i) * gap(i) for i in range(d)), F.lit(0.0)))


def _box(d: int) -> list[Column]:
    return [F.array(*[F.min(F.col("x")[i]) for i in range(d)]).alias("lo"), F.array(*[F.max(F.col("x")[i]) for i in range(d)]).alias("hi")]


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, lbl): the smallest id that links (a, b) lead to."""
    links = links.where("a <> b")
    edges = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("lbl")))
    while True:  # labels only fall, so this ends; pointer jumping makes it a logarithmic number of rounds
        nb = (edges.join(labels.withColumnRenamed("id", "b").withColumnRenamed("lbl", "nl"), "b")
                   .groupBy("a").agg(F.min("nl").alias("nl")))
        new = (labels.join(nb.withColumnRenamed("a", "id"), "id", "left")
                     .select("id", F.least("lbl", F.coalesce("nl", "lbl")).alias("lbl")))
        # pointer jumping: take the label of your label (halves path lengths)
        new = (new.alias("p").join(new.alias("q"), F.col("p.lbl") == F.col("q.id"), "left")
                  .select(F.col("p.id").alias("id"),
                          F.least(F.col("p.lbl"), F.coalesce(F.col("q.lbl"), F.col("p.lbl"))).alias("lbl")))
        new = cut_lineage(new)
        changed = new.join(labels.withColumnRenamed("lbl", "old"), "id").where(
            F.col("lbl") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            return labels


def _cells(pts: DataFrame, eps: float, d: int) -> tuple[DataFrame, DataFrame]:
    """(id, x, cid, n) of every point and (cid, n, lo, hi) of every cell."""
    side = eps / math.sqrt(d) * (1 - SLACK)
    far = lambda v: F.abs(v) > side * FAR if side > 0 else F.lit(True)
    number = lambda v: F.floor(v / side).cast("double") if side > 0 else v
    keyed = pts.withColumn("key", F.concat(F.transform("x", lambda v: F.when(far(v), F.lit(0.0)).otherwise(number(v))),
                                           F.transform("x", lambda v: F.when(far(v), v).otherwise(F.lit(0.0)))))
    cells = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *_box(d))
                        .withColumn("cid", F.monotonically_increasing_id()))
    return (cut_lineage(keyed.join(cells.select("key", "cid", "n"), "key").select("id", "x", "cid", "n")),
            cells.drop("key"))


def _adjacent(cells: DataFrame, eps: float, d: int) -> DataFrame:
    """(a, b) of all pairs of cells whose boxes lie within eps, both ways and each with itself."""
    most = cells.agg(F.max(_distance("lo", "hi", d))).first()[0] or 0.0
    mid = cells.select("cid", F.zip_with("lo", "hi", lambda p, q: p + (q - p) / 2).alias("mid"))
    near = range_pairs(PivotIndex(mid, "cid", "mid"), mid, "cid", "mid", (eps + most) * (1 + 1e-9), self_join=True)
    box = lambda k: cells.select(F.col("cid").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}"))
    near = near.select(F.col("qid").alias("a"), F.col("rid").alias("b")).join(box("a"), "a").join(box("b"), "b")
    return cut_lineage(near.where(_box_distance("lo_a", "hi_a", "lo_b", "hi_b", d) <= eps * (1 + 1e-9)).select("a", "b"))


def _near(some: DataFrame, adjacent: DataFrame, others: DataFrame, eps: float, d: int) -> DataFrame:
    """(id, other) of every row of ``some`` with the rows of ``others`` within eps."""
    left = some.select("id", "x", F.col("cid").alias("a")).join(adjacent, "a")
    right = others.select(F.col("id").alias("other"), F.col("x").alias("y"), F.col("cid").alias("b"))
    return left.join(right, "b").where(_distance("x", "y", d) <= eps).select("id", "other")


def _across(core: DataFrame, adjacent: DataFrame, eps: float, d: int) -> DataFrame:
    """(id, lbl) of the core points ``core`` (id, x, cid)."""
    outer = [f(F.col("x"), F.col("x")[i]) for i in range(d) for f in (F.min_by, F.max_by)]
    cells = cut_lineage(core.groupBy("cid").agg(F.min("id").alias("first"), *_box(d), F.array(*outer).alias("outer")))
    side = lambda k: cells.select(F.col("cid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("first", "lo", "hi", "outer")])
    pairs = (adjacent.where("a < b").join(side("a"), "a").join(side("b"), "b")
             .where(_box_distance("lo_a", "hi_a", "lo_b", "hi_b", d) <= eps * (1 + 1e-9)))
    met = F.exists("outer_a", lambda p: F.exists("outer_b", lambda q: F.sqrt(sqdist(p, q)) <= F.lit(eps)))
    pairs = cut_lineage(pairs.select("a", "b", "first_a", "first_b", "lo_a", "hi_a", "lo_b", "hi_b", met.alias("met")))
    nodes = cut_lineage(core.select("id").distinct())
    links = (core.join(cells.select("cid", F.col("first")), "cid").select(F.col("id").alias("a"), F.col("first").alias("b"))
             .unionByName(pairs.where("met").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))))
    labels = _labels(nodes, links)
    # pairs of cells that are still apart: point by point, of the points near the other's box
    named = lambda k: labels.select(F.col("id").alias(f"first_{k}"), F.col("lbl").alias(f"lbl_{k}"))
    rest = cut_lineage(pairs.where("not met").join(named("a"), "first_a").join(named("b"), "first_b").where("lbl_a <> lbl_b"))
    if rest.isEmpty():
        return labels
    one = (core.select(F.col("cid").alias("a"), "x").join(rest.select("a", "b", "lo_b", "hi_b"), "a")
           .where(_box_distance("x", "x", "lo_b", "hi_b", d) <= eps * (1 + 1e-9)).select("a", "b", "x"))
    two = (core.select(F.col("cid").alias("b"), F.col("x").alias("y")).join(rest.select("a", "b", "lo_a", "hi_a"), "b")
           .where(_box_distance("y", "y", "lo_a", "hi_a", d) <= eps * (1 + 1e-9)).select("a", "b", "y"))
    found = one.join(two, ["a", "b"]).where(_distance("x", "y", d) <= eps).select("a", "b").distinct()
    found = cut_lineage(found.join(rest.select("a", "b", "lbl_a", "lbl_b"), ["a", "b"])
                        .select(F.col("lbl_a").alias("a"), F.col("lbl_b").alias("b")))
    return _labels(nodes, links.unionByName(found))


def dbscan(df: DataFrame, id_col: str, features, eps: float = 0.5, min_samples: int = 5,
           index: PivotIndex | None = None) -> DataFrame:
    """Returns (id, cluster) for every row of ``df``; ids must be integers.  Points come from ``index`` where given."""
    eps = float(eps)
    pts = (df.select(col(id_col).cast("long").alias("id"), to_array(df, features).alias("x")) if index is None
           else index.points.select(F.col("rid").alias("id"), "x"))
    d = max(pts.agg(F.max(F.size("x"))).first()[0] or 1, 1)
    pts = pts.where((F.size("x") == d) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    pts, cells = _cells(pts, eps, d)
    adjacent = _adjacent(cells, eps, d)
    # 1. core points: all of a full cell, and what counts enough neighbours
    few = pts.where(F.col("n") < min_samples)
    counts = _near(few, adjacent, pts, eps, d).groupBy("id").count().where(F.col("count") >= min_samples).select("id")
    ids = cut_lineage(pts.where(F.col("n") >= min_samples).select("id").unionByName(counts).where("id is not null").distinct())
    core = cut_lineage(pts.join(ids, "id", "left_semi").select("id", "x", "cid"))
    # 2. components of the core points
    labels = _across(core, adjacent, eps, d)
    # 3. border points: smallest label among their core neighbours
    others = few.where("id is not null").join(ids, "id", "left_anti")
    border = (_near(others, adjacent, core, eps, d).join(labels.select(F.col("id").alias("other"), "lbl"), "other")
              .groupBy("id").agg(F.min("lbl").alias("lbl")))
    assigned = cut_lineage(labels.unionByName(border))
    comps = assigned.select("lbl").distinct()
    n = comps.count()
    spark = df.sparkSession
    if n <= INLINE_LABELS:
        order = sorted(r["lbl"] for r in comps.collect())
        num = F.broadcast(spark.createDataFrame([(int(v), i) for i, v in enumerate(order)],
                                                "lbl long, cluster int"))   # <= INLINE_LABELS rows
    else:
        num = (comps.orderBy("lbl").rdd.zipWithIndex()
               .map(lambda p: (int(p[0]["lbl"]), int(p[1]))).toDF("lbl long, cluster int"))
    out = assigned.join(num, "lbl").select("id", "cluster")
    return (df.select(col(id_col).cast("long").alias("id")).join(out, "id", "left")
              .select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster")))
