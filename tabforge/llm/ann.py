"""Approximate nearest neighbours by robust-pruned directed graphs.

The distinct vectors are dealt over shards of bounded size by their hash.
Each shard is a graph over unit vectors, built in one task: a greedy beam
search from the medoid proposes neighbours of a vector; pruning goes through
them from near to far and drops those that a neighbour already chosen lies
much closer to (a distance of 1/ALPHA or less), which keeps diverse edges;
vectors of one direction (scaled copies) share a node, whose members are all
scored when a search finds it;
edges are added backwards too and pruned again where a node gets too many.
Vectors join in batches whose searches run side by side.  Two passes are made,
the first with ALPHA = 1.

A query searches every shard by beam search and the best finds of all shards
are ranked by their exact cosine.  Shards keep their size as the data grows;
queries go to them in blocks.

Cases with a defined result: rows whose vector is null, empty, zero or holds a
null or non-finite component, and rows without an id, take no part; vectors
only meet vectors of their own length; equal vectors are one node, which
holds as many of its smallest ids as any query can need, and ties go to the
smaller id; empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS = 8192
DEGREE = 32
BEAM = 64  # of the searches that propose neighbours
SEARCH_BEAM = 96  # of queries
ALPHA = 1.2
BATCH = 512
SCORED = 100_000  # exact cosines that a task computes at once


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def beam_search(unit: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Greedy beam search for several queries side by side.

    Returns the beam (nodes, -1 where empty; distances, ascending) and each
    query's expanded nodes.  ``edges`` is -1 where a node has fewer neighbours.
    """
    q, n = len(queries), len(unit)
    nodes = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no node
    seen[:, n] = True
    nodes[:, 0], dist[:, 0], done[:, 0] = start, 1 - queries @ unit[start], False
    seen[:, start] = True
    visited: list[tuple[np.ndarray, np.ndarray]] = []
    active = np.arange(q)
    width = 4  # nodes that a query expands in one step
    while len(active):
        d = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(d, min(width, beam - 1), axis=1)[:, :width] if beam > width else np.argsort(d, axis=1)
        use = np.take_along_axis(d, pick, axis=1) < np.inf
        some = use.any(axis=1)
        active, pick, use = active[some], pick[some], use[some]
        if not len(active):
            break
        rows, cols = np.nonzero(use)
        who, at = active[rows], pick[rows, cols]
        done[who, at] = True
        visited.append((who, nodes[who, at]))
        near = np.full((len(active), use.shape[1], edges.shape[1]), n, np.int64)
        near[rows, cols] = np.where(edges[nodes[who, at]] < 0, n, edges[nodes[who, at]])
        near = near.reshape(len(active), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[np.take_along_axis(seen[active], near, axis=1)] = n
        r, c = np.nonzero(near < n)
        fresh = near[r, c]
        seen[active[r], fresh] = True
        nd = np.full(near.shape, np.inf)
        nd[r, c] = 1 - np.einsum("ij,ij->i", unit[fresh], queries[active[r]])
        keep = min(beam, nd.shape[1])
        if nd.shape[1] > keep:
            part = np.argpartition(nd, keep - 1, axis=1)[:, :keep]
            nd, near = np.take_along_axis(nd, part, axis=1), np.take_along_axis(near, part, axis=1)
        all_d = np.concatenate([dist[active], nd], axis=1)
        all_n = np.concatenate([nodes[active], np.where(np.isfinite(nd), near, -1)], axis=1)
        all_f = np.concatenate([done[active], ~np.isfinite(nd)], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active], nodes[active] = np.take_along_axis(all_d, order, axis=1), np.take_along_axis(all_n, order, axis=1)
        done[active] = np.take_along_axis(all_f, order, axis=1)
    out: list[list[np.ndarray]] = [[] for _ in range(q)]
    if visited:
        who, what = np.concatenate([w for w, _ in visited]), np.concatenate([x for _, x in visited])
        order = np.argsort(who, kind="stable")
        ends = np.cumsum(np.bincount(who, minlength=q))
        out = np.split(what[order], ends[:-1])
    return nodes, dist, list(out)


def robust_prune(unit: np.ndarray, node: int, found: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of ``node`` among ``found``."""
    found = np.unique(found)
    found = found[found != node]
    if not len(found):
        return found
    d = 1 - unit[found] @ unit[node]
    order = np.argsort(d, kind="stable")
    found, d = found[order], d[order]
    among = 1 - unit[found] @ unit[found].T
    alive, chosen = np.ones(len(found), bool), []
    for i in range(len(found)):
        if alive[i]:
            chosen.append(i)
            if len(chosen) == degree:
                break
            alive &= alpha * among[i] > d
    return found[chosen]


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH,
          seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, start) of the graph over unit vectors; ``edges`` has -1 where a node has fewer neighbours."""
    n = len(unit)
    edges = np.full((n, degree), -1, np.int64)
    mean = unit.mean(axis=0)
    start = int((unit @ mean).argmax())
    rng = np.random.default_rng(seed)
    used = np.zeros(n, np.int64)

    def put(node: int, to: np.ndarray) -> None:
        edges[node, :len(to)], edges[node, len(to):], used[node] = to, -1, len(to)

    for a in (1.0, alpha):
        order = rng.permutation(n)
        at = 0
        while at < n:
            # while few vectors are in the graph, few join at a time
            size = min(batch, max(1, at)) if a == 1.0 else batch
            some = order[at:at + size]
            at += size
            _, _, visited = beam_search(unit, edges, start, unit[some], beam)
            back: dict[int, list[int]] = {}
            for node, seen in zip(some.tolist(), visited, strict=True):
                chosen = robust_prune(unit, node, np.r_[seen, edges[node, :used[node]]], a, degree)
                put(node, chosen)
                for x in chosen.tolist():
                    back.setdefault(x, []).append(node)
            for node, new in back.items():
                own = edges[node, :used[node]]
                add = np.setdiff1d(new, own)
                if len(own) + len(add) <= degree:
                    put(node, np.r_[own, add])
                else:
                    put(node, robust_prune(unit, node, np.r_[own, add], a, degree))
    return edges, start


def unit_vectors(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def directions(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative row of each direction, direction of each row): rows equal in single precision are one.

    Scaled copies of a vector then are one node, as no distance tells them apart; distances between nodes are
    taken in double precision, so that nodes of a dense group still have near and far neighbours."""
    _, first, inverse = np.unique(unit.astype(np.float32), axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; each value depends on its two vectors only."""
    s, t = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    a, b = a / s, b / t
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def index(vectors: DataFrame, k: int, id_col: str, vector_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards as a written table: (shard, dim, node, vec_ids, vector, edges, start)."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    # one node per distinct vector; the k + 1 smallest ids suffice to answer any query, its own left out
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = written(rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
                    .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids")), "vectors")
    nodes = nodes.withColumn("dim", F.size("vector"))
    counts = written(nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")), "shards")  # a row per length
    shards = counts.agg(F.sum("shards")).first()[0] or 1
    nodes = nodes.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))

    def graph(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_ids", key=lambda s: s.map(lambda x: x[0])).reset_index(drop=True)
        unit = unit_vectors(part["vector"].tolist())
        first, node = directions(unit)
        edges, start = build(unit[first])
        held = [None] * len(part)  # with the representative of a node
        for i, e in zip(first.tolist(), edges, strict=True):
            held[i] = e[e >= 0]
        return pd.DataFrame({"shard": part["shard"], "dim": part["dim"], "node": node.astype(np.int32),
                             "vec_ids": part["vec_ids"], "vector": part["vector"], "edges": held, "start": start})

    schema = "shard int, dim int, node int, vec_ids array<bigint>, vector array<double>, edges array<bigint>, start int"
    # by ranges, so that shards get tasks of their own however small their data is
    parted = nodes.select("dim", "shard", "vec_ids", "vector").repartitionByRange(int(shards), "dim", "shard")
    return written(parted.groupBy("dim", "shard").applyInPandas(graph, schema), "graph")


def search(graph: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector",
           beam: int = SEARCH_BEAM, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest finds of every usable query.

    Every shard answers each block of at most about ``block`` queries in a task.
    """
    wanted = (queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"))
              .where(F.col("query_id").isNotNull() & usable(F.col("q"))).distinct().withColumn("dim", F.size("q")))
    wanted = written(wanted, "queries")
    blocks = max(1, -(-wanted.count() // block))
    shards = graph.select(F.col("dim").alias("d"), F.col("shard").alias("s")).distinct()
    asked = (wanted.withColumn("b", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int"))
             .join(shards, F.col("dim") == F.col("d")).select("d", "s", "b", "query_id", "q"))
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(nodes: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if nodes.empty or some.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        nodes = nodes.sort_values("node", kind="stable")
        vectors, node = np.array(nodes["vector"].tolist(), np.float64), nodes["node"].to_numpy()
        reps = nodes["edges"].notna().to_numpy()
        unit, lists = unit_vectors(vectors[reps].tolist()), nodes["edges"][reps]
        edges = np.full((len(unit), max(1, lists.map(len).max())), -1, np.int64)
        for i, e in enumerate(lists):
            edges[i, :len(e)] = e
        members = np.bincount(node, minlength=len(unit))
        begin = np.cumsum(members) - members
        ids, start, out = nodes["vec_ids"].tolist(), int(nodes["start"].iloc[0]), []
        for at in range(0, len(some), 512):
            part = some.iloc[at:at + 512]
            asked, own = np.array(part["q"].tolist(), np.float64), part["query_id"].to_numpy()
            found, _, _ = beam_search(unit, edges, start, unit_vectors(part["q"].tolist()), max(beam, 2 * k))
            # all members of the nodes found are scored, for a bounded number of them at a time
            sizes = np.where(found >= 0, members[found], 0).sum(axis=1)
            for rows_of in np.split(np.arange(len(part)), np.flatnonzero(np.diff(np.cumsum(sizes) // SCORED)) + 1):
                r, c = np.nonzero(found[rows_of] >= 0)
                r = rows_of[r]
                hit = found[r, c]
                n = members[hit]
                at_member = np.repeat(begin[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                r = np.repeat(r, n)
                score = cosine(asked[r], vectors[at_member])
                rows = [(own[i], x, s) for i, m, s in zip(r, at_member, score, strict=True) for x in ids[m] if x != own[i]]
                frame = pd.DataFrame(rows, columns=columns).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(frame.groupby("query_id").head(k))
        return pd.concat(out)

    found = (held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("d", "s", "b"))
             .applyInPandas(answer, "query_id bigint, vec_id bigint, score double"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
