import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabforge.llm import chat, fm_index, phrases, queries, whitening

from llm_cases import EDGE, LONG, VECTORS, edge_dir, empty_dir  # noqa: F401


def ngrams(ids, n):
    found = Counter(tuple(ids[i:i + n].tolist()) for i in range(len(ids) - n + 1))
    return {k: v for k, v in found.items() if 0 not in k}


@pytest.mark.parametrize("sides", [("right", "left", "right"), ("left", "right", "left"), ("left", "left", "left")])
def test_interval_extension(sides):
    rng = np.random.default_rng(len(sides[0]))
    ids = np.append(rng.integers(0, 5, 700), 0)
    index = fm_index.Index.unpack(fm_index.Index.build(ids).pack())
    state = index.words(np.arange(1, 5))
    for n, side in enumerate(sides, 2):
        state = index.extend(state, side)
        got = {tuple(w.tolist()): int(k) for w, k in zip(state.words, state.size, strict=True)}
        assert got == ngrams(ids, n)


def test_interval_extension_of_wanted_ids_and_of_one_word():
    ids = np.array([1, 2, 1, 2, 3, 0, 2, 3, 0])
    index = fm_index.Index.build(ids)
    pairs = index.extend(index.words(np.array([2])), "right", lambda which, c: c == 3)
    assert pairs.words.tolist() == [[2, 3]] and pairs.size.tolist() == [2]
    alone = fm_index.Index.build(np.array([1, 0]))
    assert len(alone.extend(alone.words(np.array([1])), "left").size) == 0


def brute_counts(docs):
    """f(phrase) by language and length, all occurrences within pieces."""
    found = defaultdict(Counter)
    for _, text, lang, *_ in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    found[lang or "und", n][tuple(words[i:i + n])] += 1
    return found


def docs_of_phrases():
    rng = np.random.default_rng(5)
    words = np.array(["Ab", "ab", "c", "É", "d.e", "f!", "g\x0bh", "中", "i\u00a0j", "k\tl"])
    docs = [(i, " ".join(rng.choice(words, 40)), ["x", "y", None][i % 3], "s") for i in range(60)]
    return docs + [(None, None, None, None), (7, "", "x", "s"), (8, "?!", "z", "s"), (9, LONG, "x", "s")] + docs[:2]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("n", [2, 3, 4])
def test_shards_send_packed_counts(n):
    """A row a bucket and a few bytes a phrase leave a shard, and sums over shards are those of single counts."""
    rng = np.random.default_rng(n)
    want, size, tables = Counter(), 0, []
    holders = defaultdict(set)
    for shard in range(4):
        words = np.unique(rng.zipf(1.3, size=(20000, n)).clip(max=40) * (2 ** 31 // 40 - 1), axis=0).astype(np.int64)
        count = rng.integers(1, 12, len(words))
        k1 = (words[:, 0] << 32) | words[:, 1]
        k2 = (words[:, 2] << 32) | (words[:, 3] if n > 3 else 0) if n > 2 else np.zeros(len(words), np.int64)
        packed = phrases._packed(shard, n, k1, k2, count, 7)
        assert packed.num_rows <= 7
        tables.append(packed)
        size += len(words)
        for a, b, c in zip(k1.tolist(), k2.tolist(), count.tolist(), strict=True):
            want[a, b] += c
            holders[a, b].add(shard)
    assert sum(len(b) for t in tables for b in t.column("counts").to_pylist()) < 12 * size
    got = []
    for _, rows in pa.concat_tables(tables).to_pandas().groupby("bucket"):
        got += phrases._totals(n)(pa.Table.from_pandas(rows)).to_pylist()
    assert sorted((r["k1"], r["k2"], r["shard"], r["total"]) for r in got) == sorted(
        (a, b, s, c) for (a, b), c in want.items() for s in holders[a, b])
    none = np.zeros(0, np.int64)
    assert phrases._packed(0, n, none, none, none, 7).num_rows == 0



@pytest.mark.parametrize("parts", [1, 7])
def test_phrase_counts_across_shards(spark, parts):
    docs = docs_of_phrases()
    want = brute_counts(docs)
    index = phrases.build(frame(spark, docs).repartition(parts), least=10)
    assert index.shards.count() >= parts
    spell = {r["id"]: (r["lang"], r["word"], r["total"]) for r in index.words.collect()}
    assert {(lang, w): t for lang, w, t in spell.values()} == {
        (lang, g[0]): c for (lang, n), f in want.items() if n == 1 for g, c in f.items() if c >= 10}
    for n in (2, 3, 4):
        got = {}
        for r in index.phrases[n].collect():
            ids = [r["k1"] >> 32, r["k1"] & 0xFFFFFFFF, r["k2"] >> 32, r["k2"] & 0xFFFFFFFF][:n]
            got[spell[ids[0]][0], tuple(spell[i][1] for i in ids)] = r["total"]
        assert got == {(lang, g): c for (lang, m), f in want.items() if m == n for g, c in f.items() if c >= 10}
        assert len(got) > 0
    beside = {(r["side"], r["word"]): r["count"] for r in phrases.extensions(index, "ab C", "x").collect()}
    plain = Counter()
    for g, c in want["x", 3].items():
        if g[1:] == ("ab", "c"):
            plain["left", g[0]] += c
        if g[:2] == ("ab", "c"):
            plain["right", g[2]] += c
    assert beside == plain


def test_small_parts_and_shards_count_the_same(spark, monkeypatch):
    """Texts cut at piece ends, and builders closed early, change nothing."""
    docs = docs_of_phrases()
    words = [w for t in docs if t[1] for part in phrases._parts(t[1]) for w in part]
    monkeypatch.setattr(phrases, "PART", 50)
    cut = [w for t in docs if t[1] for part in phrases._parts(t[1]) for w in part]
    assert cut == words
    builder = phrases._Builder()
    for part in phrases._parts(docs[0][1]):
        builder.add(part)
    ids = np.concatenate(builder.parts)
    assert ids[-1] == 0 and builder.size == len(ids)


def test_ties_in_scores_are_ordered_by_phrase(spark):
    docs = [(i, "b a. a b. c d", "x", None) for i in range(30)]
    got = [r.asDict() for r in phrases.collocations(phrases.build(frame(spark, docs), least=30), top=2).orderBy("rank").collect()]
    assert [r["phrase"] for r in got] == ["c d", "a b"]
    assert [r["score"] for r in got] == [1_000_000, 2_000_000 * 30 // 120]


def test_chat_round_trip_and_machine(spark, edge_dir):
    rows = spark.read.parquet(f"{edge_dir}/conversations.parquet")
    out = chat.format_conversations(rows).withColumn("read", chat.turns_read(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.collect()}
    by = defaultdict(list)
    for r in rows.collect():
        by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    for conv, turns in by.items():
        assert [tuple(t) for t in got[conv]["read"]] == [t[2:] for t in sorted(turns)]
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        flagged = [s["loss"] for s in got[conv]["segments"]]
        assert flagged[1::3] == [t[2] == "assistant" for t in sorted(turns)] and not any(flagged[::3] + flagged[2::3])
    assert {c: (r["valid"], r["refused_turn"]) for c, r in got.items()} == {
        1: (True, None), 2: (False, 0), 3: (False, 0), None: (True, None), 4: (True, None), 5: (True, None)}


def test_another_template(spark):
    with pytest.raises(ValueError):  # the opener repeats its first character
        chat.Template(opener="[[", begin="[[a", end="[[b")
    t = chat.Template(opener="{%", begin="{%turn ", end="{%end%}", transitions={"start": {"bot": "start"}},
                      accepting=("start",), trained=("bot",))
    rows = spark.createDataFrame([(1, 0, "bot", r"{%end%} $1 \ {\%turn "), (1, 1, "bot", "{")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(rows, t).select("*", chat.turns_read(F.col("formatted"), t).alias("read"),
                                                  chat.loss_text(F.col("segments"), t).alias("loss")).first()
    assert r["valid"] and [x["text"] for x in r["read"]] == [r"{%end%} $1 \ {\%turn ", "{"]
    assert r["loss"] == r"{%end%} $1 \ {\%turn " + "{"


def plain_whitening(vectors, k=16):
    ok = [(i, [int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in vectors
          if v and all(c is not None and abs(64 * c) < 2 ** 62 for c in v)]
    d = max(Counter(len(x) for _, x in ok).items(), key=lambda c: (c[1], c[0]))[0]
    ok = [(i, x) for i, x in ok if len(x) == d]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[float(n * c - t) / n for c, t in zip(x, s, strict=True)] for x in fit])
    e, v = np.linalg.eigh(a.T @ a / n)
    return ok, n, s, e[::-1][:k], v[:, ::-1][:, :k], np.trace(a.T @ a / n)


@pytest.mark.parametrize("case", ["edge", "random", "flat"])
def test_whitening(spark, case):
    rng = np.random.default_rng(1)
    vectors = {"edge": VECTORS, "random": [(i, (rng.normal(size=20) * 2.0 ** rng.integers(-2, 8)).tolist()) for i in range(300)],
               "flat": [(i, [float(i), 3.0, 2.0 * i, 1e9]) for i in range(50)]}[case]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).repartition(5)
    rows = whitening.fixed_point(df, "vec_id", "embedding")
    model = whitening.fit(rows)
    ok, n, s, e, v, trace = plain_whitening(vectors)
    assert model.n == n and list(model.sums) == s
    k = len(model.eigenvalues)
    assert k == {"edge": 3, "random": 16, "flat": 1}[case]
    np.testing.assert_allclose(model.eigenvalues, e[:k], rtol=1e-9)
    np.testing.assert_allclose(model.explained, e[:k] / trace, rtol=1e-9)
    np.testing.assert_allclose(np.abs(np.sum(model.components * v[:, :k], axis=0)), 1, atol=1e-7)
    assert model.identity_error < 1e-8
    got = whitening.transform(rows, model).collect()
    assert len(got) == len(ok) * k
    dev = Counter((i, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))) for i, x in ok)
    assert Counter((r["id"], r["deviation"]) for r in got if r["component"] == 1) == dev


def test_whitening_of_huge_entries_is_exact(spark):
    vectors = [(1, [2.0 ** 55, 0.0]), (2, [-2.0 ** 55, 1.0]), (3, [0.0, 5.0])]
    rows = whitening.fixed_point(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    model = whitening.fit(rows)
    assert model.n == 3 and model.sums[0] == 3_000_000
    assert {r["deviation"] for r in whitening.transform(rows, model).collect() if r["id"] != 3} == {None}


def test_whitening_without_variance(spark):
    rows = whitening.fixed_point(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"),
                                 "vec_id", "embedding")
    assert whitening.fit(rows) is None and whitening.transform(rows, None).count() == 0
