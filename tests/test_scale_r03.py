"""Findings of round 3: bounded batches and work that does not grow with the square of a group."""

import numpy as np
import pandas as pd

from tabforge.operators import neighbors as nbr


def _queries(x: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"qid": np.arange(len(x)), "x": list(x), "own": np.zeros(len(x), np.int32),
                         "lim": np.full(len(x), np.inf)})


def test_candidates_leave_in_bounded_batches():
    pivots = np.random.default_rng(0).normal(size=(40, 64))
    fn = nbr._cand_fn(pivots, np.full(40, 100.0), np.full(40, 5))
    out = list(fn(iter([_queries(np.zeros((3000, 64)))])))
    assert sum(map(len, out)) == 3000 * 39                   # every cell but the own one
    assert max(map(len, out)) <= nbr.COPIES_AT_ONCE
    assert len(pd.concat(out)[["qid", "cell"]].drop_duplicates()) == 3000 * 39


def test_located_rows_carry_no_distances(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(100, 3)))],
                               "id long, x array<double>")
    assert nbr.PivotIndex(df, "id", "x").locate(df, "id", "x").columns == ["qid", "x", "own"]


def test_wide_knn_with_copies_and_ties(spark):
    """Vectors far from the origin (products lose digits), groups of copies, ties to the smaller id."""
    rng = np.random.default_rng(2)
    x = 1000.0 + rng.normal(size=(60, 40)).round(3)
    x = np.concatenate([x, x[:20], np.tile(x[3], (30, 1))])
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "id long, x array<double>")
    got = {(r["qid"], r["rank"]): r["rid"] for r in nbr.knn(df, "id", df, "id", "x", k=4, exclude_self=True, n_pivots=6,
                                                            block=16).collect()}
    for i, q in zip(ids, x, strict=True):
        dist = np.sqrt(((x - q) ** 2).sum(axis=1))
        want = [o for _, o in sorted((d, o) for d, o in zip(dist.tolist(), ids, strict=True) if o != i)][:4]
        assert [got[i, k + 1] for k in range(4)] == want


def test_correlations_of_eight_columns_need_no_expression_a_pair(spark, monkeypatch):
    from tabforge.operators import profile as prof
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    x[:, 5] += 2 * x[:, 1]
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"v{i}" for i in range(8)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"{c} double" for c in names))
    want = {}
    for i in range(8):
        for j in range(i + 1, 8):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want[names[i], names[j]] = np.corrcoef(x[both, i], x[both, j])[0, 1]
    monkeypatch.setattr(prof, "pair_correlations", None)
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in prof.correlations(df, names, keep_all=True).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert [r["pair"] for r in prof.correlations(df, names).collect()] == ["v1_vs_v5"]


def test_letters_are_words_without_the_pattern(monkeypatch):
    import public_tokenizers

    from tabforge.llm.wordsplit import PartIds, Splitter
    split = Splitter(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    words = split.words
    monkeypatch.setattr(split, "words", lambda p: asked.append(p) or words(p))
    ids = PartIds(split, lambda new: [w.encode("utf-32-le") for w in new])
    text = "plain Words don't 42nd x_y ünder 'tis"
    _, got = ids([text])
    assert "plain" not in asked and "words" not in asked and {"don't", "42nd", "x_y"} <= set(asked)
    want = [w for p in text.lower().split() for w in words(p)]
    assert got.tobytes().decode("utf-32-le") == "".join(want)


def test_large_groups_join_each_class_once(spark, monkeypatch):
    """Groups beyond a block: what is known of a class joins one row for it, and its keys unfold once."""
    from tabforge.llm import near_dedup
    seen, write = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(near_dedup, "written", lambda df, tag: seen.setdefault(tag, []).append(write(df, tag)) or seen[tag][-1])
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1:]]) for i in range(24)] + ["alone in the world of words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, size=2, percent=80).collect()}
    assert got == {i: 0 if i < 24 else 24 for i in range(25)}
    (keys,), (state,) = seen["keys"], seen["state"]
    assert keys.count() == 24 == keys.select("cid").distinct().count() and state.count() > 24


def test_memory_goes_back_after_a_task(monkeypatch):
    from tabforge.llm import common
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.tidy(lambda it: it)(iter([1, 2]))) == [1, 2] and calls == [1]
    monkeypatch.undo()
    common.give_back()


def test_dbscan_cells_against_brute_force(spark):
    """Dense copies, chains, noise, border points, and clusters whose cells touch without a link."""
    from tabforge.operators.dbscan import dbscan
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(scale=0.3, size=(60, 3)), 3 + rng.normal(scale=0.2, size=(40, 3)), np.tile([[9.0, 9, 9]], (6, 1)),
                        rng.uniform(-4, 8, size=(50, 3)), [[9.0, 9, 9 + 0.5 * i] for i in range(1, 5)], [[9.0, 9.4, 9.0]]])
    eps, least = 0.5, 4
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        label = np.where(core, np.where(near & core[None], label[None], len(x)).min(axis=1), len(x))
    border = np.where(near & core[None], label[None], len(x)).min(axis=1)
    names = {v: i for i, v in enumerate(sorted(set(label[core].tolist())))}
    want = {i: names.get(int(b), -1) for i, b in enumerate(border)}
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, x array<double>")
    assert {r["id"]: r["cluster"] for r in dbscan(df, "id", "x", eps=eps, min_samples=least).collect()} == want


def test_knn_tasks_follow_the_distances(spark, monkeypatch):
    monkeypatch.setattr(nbr, "TASK_CELLS", 500)
    pts = [(i, [float(i * 37 % 101), float(i * 53 % 97)]) for i in range(300)]
    df = spark.createDataFrame(pts, "id long, x array<double>").coalesce(1)
    index = nbr.PivotIndex(df, "id", "x")
    cells = index.as_queries().withColumnRenamed("own", "cell")
    assert index.pairs(cells, k=3).rdd.getNumPartitions() >= sum(n * n for n in index.count) / 500 > 8
    got = {(r["qid"], r["rank"]): r["rid"] for r in nbr.knn(None, "id", df, "id", "x", 3, index=index).collect()}
    for i, x in pts:
        near = sorted((((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2) ** 0.5, j) for j, y in pts)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in near]
