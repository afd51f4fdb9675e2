import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabforge.llm import ann, bpe, exact_dedup, language_id, mixing, near_dedup, queries, sharding, token_counts, token_files
from tabforge.llm.common import WORD, shared_path, written

from llm_brute import WORD as WORDS
from llm_brute import near_components
from llm_cases import EDGE, SMALL, VECTORS, edge_dir, empty_dir, small_docs  # noqa: F401

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
assert WORD == WORDS.pattern


def rows(df):
    return [r.asDict() for r in df.collect()]


def multiset(items):
    return Counter(map(tuple, items))


@pytest.fixture(scope="module")
def docs_of(small_docs):
    return {"edge": EDGE, "small": small_docs}


@pytest.fixture(params=["edge", "small"])
def case(request, edge_dir, docs_of):
    return {"edge": edge_dir, "small": SMALL}[request.param], docs_of[request.param]


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_empty_tables(spark, empty_dir, name):
    # the chat query adds a conversation of its own
    assert queries.REGISTRY[name](spark, empty_dir).count() == (name == "op12_chat")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, case, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{case[0]}/{table}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.REGISTRY[name](spark, case[0]).select(*names)
    assert multiset(got.collect()) == multiset(want.fetchall())


def test_mix_meets_targets(spark):
    got = rows(queries.op1_mix(spark, SMALL))
    by = defaultdict(list)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert math.isclose(sum(v[0]["target"] for v in by.values()), 1.5 * total, rel_tol=1e-6)
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-3
        # the gap is never larger than the largest document
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
    assert rows(queries.op1_mix(spark, SMALL).orderBy("doc_id")) == sorted(got, key=lambda r: r["doc_id"])


def test_fill_by_rounds(spark):
    src = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0), ("d", 0, 5.0), ("e", 50, 0.0)],
                                "source string, source_size bigint, weight double")
    got = {r["source"]: r["target"] for r in mixing.fill(src, 300.0, 2.0).collect()}
    # a is clamped at 20; 280 by 2 : 1 puts b below its cap of 200
    assert got["a"] == 20 and got["d"] == 0 and got["e"] == 0
    assert math.isclose(got["b"], 280 * 2 / 3) and math.isclose(got["c"], 280 / 3)
    got = {r["source"]: r["target"] for r in mixing.fill(src, 1e9, 2.0).collect()}
    assert got == {"a": 20, "b": 200, "c": 2000, "d": 0, "e": 0}


def test_apply_mix_repeats_rows(spark, edge_dir):
    docs = queries.documents(spark, edge_dir)
    sized = written(mixing.sized(docs), "t")
    plan = mixing.plan_mix(sized, mixing.cycle_weights(sized), within=0.001)
    out = mixing.apply_mix(docs, plan)
    assert out.columns == docs.columns
    want = {(r["doc_id"], r["source"], r["size"]): r["taken"] // r["size"] for r in rows(queries.op1_mix(spark, edge_dir)) if r["size"]}
    got = Counter((r["doc_id"], r["source"], len(WORDS.findall(r["text"] or ""))) for r in out.collect() if r["text"])
    repeated = Counter((d, s, len(WORDS.findall(t or ""))) for d, t, _, s in EDGE)
    for k, n in want.items():
        assert got[k] == n * repeated[k]


def test_mix_goes_on_past_a_huge_document(spark):
    """One document of 200,000 words among 500 ordinary ones, in many sources; equal rows share a hash."""
    rng = np.random.default_rng(3)
    data = []
    for s in range(12):
        sizes = [200_000, 0, *rng.integers(50, 1200, 498).tolist()]
        hashes = rng.integers(0, 1 << 60, 500).tolist()
        data += [(f"s{s}" if s else None, n, u) for n, u in zip(sizes, hashes, strict=True)] + [(f"s{s}" if s else None, sizes[9], hashes[9])]
    rows_ = written(spark.createDataFrame(data, "source string, size bigint, u bigint"), "t")
    weights = rows_.select("source").distinct().withColumn("weight", F.lit(1.0))
    plan = mixing.plan_mix(rows_, weights, share=0.43, within=0.001)
    got = rows(rows_.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
               .select("p.*", "r.size", "r.u").withColumn("times", mixing.repeats(*[F.col(c) for c in ("u", "whole", "cut", "extra", "size", "more")])))
    by = defaultdict(int)
    for r in got:
        by[r["target"], r["source_size"], r["whole"], r["cut"], r["extra"]] += r["size"] * r["times"]
    assert len(by) == 12 and sum(len(r["more"]) > 0 for r in got) > 0
    for (target, *_), taken in by.items():
        assert abs(taken - target) <= 0.001 * target


def test_mix_ends_near_its_targets(spark):
    """A source misses its target by a thousandth, or by at most half of its largest document (the gap that no document
    fits is closed by the one of the nearest size); the pipeline takes the same."""
    target, taken, got, most = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows(queries.op1_mix(spark, SMALL)):
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.001 * t, most[s] / 2) and abs(taken[s] - t) <= 0.13 * t
    for r in corpus_pipeline.mix(spark, queries.documents(spark, SMALL), SMALL).select("source", "text").collect():
        got[r["source"]] += len(WORDS.findall(r["text"] or ""))
    assert got == taken


def test_shards(spark, case):
    got = rows(queries.op2_shard(spark, case[0]))
    want = multiset((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in case[1])
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["grown_shard"] is None
        by[r["shard"]].append(r)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    if len(got) > 100:  # near equal, up to one document
        loads = [sum(r["size"] for r in v) for v in by.values()]
        assert len(by) == 24 and max(loads) - min(loads) <= max(r["size"] for r in got)


def test_equal_rows_spread_over_shards(spark):
    """20 000 rows with one id and text among others: law bytes holds."""
    docs = spark.range(20_500).select(F.when(F.col("id") < 20_000, 1).otherwise(F.col("id")).alias("doc_id"),
                                      F.when(F.col("id") < 20_000, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_by_bytes(docs.repartition(7), 24, shared_path(spark, "map"))
    loads = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert got.count() == 20_500 and len(loads) == 24 and max(loads) <= 1.02 * min(loads)
    slots = got.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["rows"] == r["m"] + 1 for r in slots)


def test_slot_map_versions(spark):
    docs = queries.documents(spark, SMALL)
    path = shared_path(spark, "t")
    sharding.shard_by_bytes(docs, 4, path, slots=256)
    v1 = {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, 1).collect()}
    loads = sharding.slot_loads(sharding.sized(docs, slots=256), 256)
    v2 = sharding.store_map(sharding.rebalance(sharding.load_map(spark, path, 1), loads, 5), path, 2)
    v2 = {r["vslot"]: r["shard"] for r in v2.collect()}
    assert set(v1) == set(v2) == set(range(256)) and set(v2.values()) == set(range(5))
    size = {r["vslot"]: r["bytes"] for r in loads.collect()}
    moved = sum(size[s] for s in v1 if v1[s] != v2[s])
    per = [sum(size[s] for s in v2 if v2[s] == k) for k in range(5)]
    assert moved <= 0.3 * sum(size.values()) and max(per) - min(per) <= max(size.values())


def brute_neighbours(vectors, k):
    ok = [(i, v) for i, v in vectors if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    ok = list(dict.fromkeys((i, tuple(v)) for i, v in ok))
    out = {}
    for q, v in ok:
        if q % 50 == 0:
            a, scored = np.array(v) / max(map(abs, v)), []
            for i, w in ok:
                if i != q and len(w) == len(v):
                    b = np.array(w) / max(map(abs, w))
                    scored.append((-float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), i))
            out[q] = sorted(scored)[:k]
    return out


def test_neighbours_edge(spark, edge_dir):
    got = defaultdict(list)
    for r in queries.op3_neighbours(spark, edge_dir).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["score"]))
    want = brute_neighbours(VECTORS, 5)
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [r for r, _ in v] == list(range(1, len(want[q]) + 1))
        assert np.allclose([s for _, s in v], [-s for s, _ in want[q]], atol=1e-12)


def test_neighbours_of_equal_vectors(spark, edge_dir):
    got = [r["vec_id"] for r in queries.op3_neighbours(spark, edge_dir).where("query_id = 0").orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]  # ties: smaller ids first, its own left out


def test_neighbours_recall(spark):
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in table], 5)
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    graph = ann.index(vectors, 5, "vec_id", "embedding", shard_rows=120)  # several shards
    got = defaultdict(set)
    for r in ann.search(graph, vectors.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", block=4).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("noise", [0.0, 1e-5, 1e-3])
def test_neighbours_in_a_dense_group(spark, noise):
    """400 scaled or noisy copies of one vector among 2000 others: true neighbours by their exact cosine."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    v = np.r_[rng.normal(size=(2000, 64)), base * rng.uniform(0.1, 9, (400, 1)) + rng.normal(size=(400, 64)) * noise]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    graph = ann.index(df, 5, "vec_id", "embedding")
    got = defaultdict(list)
    for r in ann.search(graph, df.where("vec_id % 50 = 0"), 5, "vec_id", "embedding").orderBy("rank").collect():
        got[r["query_id"]].append(r["score"])
    hits = total = 0
    for q, scores in got.items():
        best = np.sort(np.delete(ann.cosine(np.repeat(v[q:q + 1], len(v), axis=0), v), q))[::-1][:5]
        hits += sum(s >= best[-1] - 1e-13 for s in scores)
        total += 5
    assert len(got) == 48 and hits >= 0.9 * total


def test_graph_recall_in_one_shard():
    rng = np.random.default_rng(3)
    unit = ann.unit_vectors(list(rng.normal(size=(3000, 32))))
    edges, start = ann.build(unit)
    found, _, _ = ann.beam_search(unit, edges, start, unit[:100], ann.BEAM)
    best = np.argsort(-(unit[:100] @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(f[:6]) & set(b)) / 6 for f, b in zip(found, best, strict=True)]) >= 0.95


def test_token_counts(spark, case):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = multiset((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t, *_ in case[1])
    assert multiset(queries.op4_tokens(spark, case[0]).collect()) == want


def test_token_cache_encodes_misses_once(spark, small_docs):
    cache = shared_path(spark, "t")
    docs = queries.documents(spark, SMALL)
    some = token_counts.count_tokens(docs.where("doc_id < 100"), PIECES, cache)
    held = token_counts.open_cache(spark, cache)
    assert held.count() == len({t for d, t, *_ in small_docs if d < 100})
    before = held.count()
    token_counts.count_tokens(docs.where("doc_id < 100"), PIECES, cache)
    assert token_counts.open_cache(spark, cache).count() == before
    every = token_counts.count_tokens(docs, PIECES, cache)
    assert token_counts.open_cache(spark, cache).count() == len({t for _, t, *_ in small_docs})
    assert set(some.collect()) <= set(every.collect())


def test_near_duplicates(spark, case):
    got = queries.op6_minhash(spark, case[0]).collect()
    want = multiset((d, c) for (d, *_), c in zip(case[1], near_components(case[1], 2, 80), strict=True))
    assert multiset((r["doc_id"], r["component_id"]) for r in got) == want
    for r in got:
        assert r["kept"] == (None if r["doc_id"] is None else r["doc_id"] == r["component_id"])


def test_near_duplicates_chains_and_hot_groups(spark):
    """Groups whose members link by way of others only, strangers that share most words, and many copies."""
    base = [f"w{i}" for i in range(60)]
    docs = []
    for step in range(25):  # each differs from the one before in two words
        docs.append((len(docs), " ".join(f"x{i}" if i < 2 * step else w for i, w in enumerate(base)), "en", "a"))
    rng = np.random.default_rng(0)
    for _ in range(150):  # about 0.7 alike
        own = [w if rng.random() > 0.09 else f"r{rng.integers(9999)}" for w in base]
        docs.append((len(docs), " ".join(own), "en", "a"))
    docs += [(len(docs) + i, "the same text again and again", "en", "a") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").repartition(5)
    for size in (2, 5):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, size, 80).collect()}
        assert got == dict(zip([d[0] for d in docs], near_components(docs, size, 80), strict=True))


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    test_near_duplicates_chains_and_hot_groups(spark)


def test_keep_one_of_each_group(spark):
    """Ids that repeat or are missing: still one row of each group stays, and the others' rows are left alone."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text + " x"), (5, "something else entirely that is here"), (None, text + " y"),
            (None, "no id " * 9), (None, "no id " * 9), (7, ""), (8, None), (3, "something else entirely that is here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = near_dedup.keep_one(docs, written(near_dedup.near_duplicates(docs), "t")).collect()
    assert sorted(((r[0], r[1]) for r in got), key=str)[1:] and len(got) == 5
    assert {(r[0], r[1]) for r in got} >= {(3, rows[8][1]), (None, rows[4][1]), (8, None), (7, "")}
    assert [r[0] for r in got if r[1] and r[1].startswith("w0")] == [5]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for shared, own in ((400, 50), (30, 10), (3, 1), (500, 500)):
        a, b = (np.unique(rng.integers(0, 2 ** 63, shared + own).astype(np.uint64)) for _ in range(2))
        b[:shared] = a[:shared]
        b = np.unique(b)
        s = near_dedup.sketch(np.array([0, len(a), len(a) + len(b)]), np.r_[a, b], 400)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (s != np.uint64(2 ** 64 - 1)).all()
        assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 199), (7, 7)]
    got = {r["id"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}


def library(text):
    tk = library.tk = getattr(library, "tk", None) or Tokenizer.from_file(WORD_BPE)
    ids = tk.encode(text or "", add_special_tokens=False).ids
    return ids, tk.decode(ids, skip_special_tokens=False)


def hexed(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe(spark, case):
    want = []
    for d, t, *_ in case[1]:
        ids, text = library(t)
        want.append((d, len(ids), hexed(" ".join(map(str, ids))), hexed(text)))
    assert multiset(queries.op7_bpe(spark, case[0]).collect()) == multiset(want)


def test_encode_then_decode(spark, edge_dir):
    docs = queries.documents(spark, edge_dir)
    apart = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE).collect()
    assert multiset((r[0], tuple(r[1]), r[2]) for r in apart) == multiset(
        (r[0], tuple(r[1]), r[2]) for r in bpe.round_trip(docs, WORD_BPE).collect())
    odd = spark.createDataFrame([(1, [518, 99_999, -1, 49407]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r[0]: r[2] for r in bpe.decode(odd, WORD_BPE).collect()} == {1: "the</w> <|endoftext|>", 2: "", 3: ""}


def test_bpe_remembers_few_parts_where_asked():
    texts = [" ".join(f"some{i * 97 + j} word{j}" for j in range(100)) for i in range(60)]
    few, many = bpe._part_ids(WORD_BPE, 1000), bpe._part_ids(WORD_BPE)
    for t in texts:
        assert all((a == b).all() for a, b in zip(few([t]), many([t]), strict=True))
        assert len(few.known) <= 1000 + 200 + len(few.added)


def test_bpe_random_texts():
    encode, rng = bpe._part_ids(WORD_BPE), np.random.default_rng(2)
    letters = list("aaabbceinotrhs'   \n\t.,!0123ABéèßÄ²½ σΣςİıǅ\x1c\x85\xa0中文😀́한글क_<|>ﬁẞ\x00\x7f")
    words = [w.replace("</w>", "") for w in Tokenizer.from_file(WORD_BPE).get_vocab()]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(800)]
    texts += ["".join(rng.choice(words, 3)) for _ in range(800)] + ["".join(rng.choice(list("aehinorst"), 12)) for _ in range(800)]
    for some in (texts, [t for t in texts if t.isascii()], [None, "", " "]):
        offsets, ids = encode(some)
        for t, a, b in zip(some, offsets[:-1], offsets[1:], strict=True):
            assert ids[a:b].tolist() == library(t)[0], repr(t)


def test_language(spark, case):
    got = queries.op8_language(spark, case[0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in case[1])
    unknown = Counter(d for d, t, *_ in case[1] if not any(c.isalpha() for c in t or ""))
    assert Counter(r["doc_id"] for r in got if r["lang_pred"] == "und") == unknown
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] == 0 if r["lang_pred"] == "und" else r["score"] > 0)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    got = [r for r in queries.op8_language(spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) >= 0.98


def test_bands_miss_hardly_any_borderline_pair():
    assert (1 - 0.8 ** near_dedup.ROWS) ** near_dedup.BANDS < 2e-7


def test_language_model_leaves_no_language_out(spark):
    """A rare language keeps trigrams of its own, one id for all rows leaves documents to learn from, and too many are an error."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters for b in letters for c in letters[::5]]
    data = [(i, " ".join(words[i * 13 % 3000:][:60]), "en") for i in range(60)] + [(100, "привет мир как дела", "ru"), (101, "мир и привет", "ru")]
    model = language_id.fit(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), max_features=40)
    found = language_id.predict(spark.createDataFrame([(0, "привет"), (1, words[5])], "doc_id bigint, text string"), model)
    assert len(model.features) <= 40 and {r["doc_id"]: r["lang_pred"] for r in found.collect()} == {0: "ru", 1: "en"}
    data = [(int(lang), f"{letters[int(lang)] * 3} {i}" if int(lang) < 6 else "same", lang) for lang in "01234567" for i in range(40)]
    model = language_id.fit(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), max_docs=1)
    assert model.languages == list("01234567") and (model.log_p.max(axis=0) > model.log_p.min(axis=0)).all()
    with pytest.raises(ValueError, match="max_languages=7"):
        language_id.fit(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), max_languages=7)


def test_language_mixture(spark, small_docs):
    docs = queries.documents(spark, SMALL)
    model = language_id.fit(docs)
    by = defaultdict(list)
    for _, t, lang, _ in small_docs:
        by[lang].append(t)
    join = lambda lang, n: " ".join(by[lang])[:n]
    mixed = spark.createDataFrame([(0, join("en", 6000) + " " + join("de", 3000)), (1, join("fr", 4000))], "doc_id bigint, text string")
    got = {r["doc_id"]: {x["lang"]: x["share"] for x in r["mix"]} for r in language_id.predict(mixed, model).collect()}
    assert set(got[0]) == {"de", "en"} and abs(got[0]["en"] - 2 / 3) < 0.1
    assert got[1].keys() == {"fr"}


def test_token_files(spark, case):
    order = sorted(range(len(case[1])), key=lambda i: (case[1][i][0] is not None, case[1][i][0] or 0))
    at, want = 0, []
    for i in order:
        ids = library(case[1][i][1])[0] + [2]
        want.append((case[1][i][0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = queries.op9_token_files(spark, case[0]).orderBy("start").collect()
    assert multiset((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == multiset(want)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_token_reader(spark, tmp_path, small_docs):
    folder = f"file://{tmp_path}/ids"
    index = written(token_files.write(queries.documents(spark, SMALL), folder, WORD_BPE, 2), "t")
    wanted = {5, 17, 123}
    got = {r["doc_id"]: r["ids"] for r in token_files.read(index, folder, sorted(wanted)).collect()}
    assert got == {d: library(t)[0] + [2] for d, t, *_ in small_docs if d in wanted}
    name = index.first()["file"]
    reader = token_files.Reader(f"{folder}/{name}")
    assert reader.n_frames > 1
    reader.ids(len(reader.table) - 1)
    assert reader.frames_read <= 2  # the rest stays packed
    import zstandard
    data = (tmp_path / "ids" / name).read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(plain) == 4 * sum(reader.table["n"].to_pylist())
    broken = bytearray(data)
    broken[40] ^= 0xFF
    (tmp_path / "broken.tok").write_bytes(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(str(tmp_path / "broken.tok")).ids(0)


def test_long_document_takes_several_frames(tmp_path):
    w = token_files.Writer(open(tmp_path / "x.tok", "wb"))
    ids = np.arange(1_000_000, dtype="<u4")
    w.add(1, ids[:10].tobytes())
    w.add(None, ids.tobytes())
    w.close()
    r = token_files.Reader(str(tmp_path / "x.tok"))
    assert r.n_frames >= 4 and (r.ids(1) == ids).all() and (r.ids(0) == ids[:10]).all()
    assert r.table["doc_id"].to_pylist() == [1, None]


def test_fingerprints_compose():
    for p in exact_dedup.PRIMES:
        a, b = b"some text", b" and more of it" * 9
        f = lambda x: exact_dedup.chunk_fingerprint(x, p)
        assert exact_dedup.combine(f(a), f(b), len(b), p) == f(a + b)


def check_dedup(got, docs):
    groups = defaultdict(list)
    for d, t, *_ in docs:
        groups[t or ""].append(d)
    assert len(got) == len(docs)
    want = multiset((d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for d, t, *_ in docs)
    assert multiset((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_with_colliding_fingerprints(spark, edge_dir):
    """Tiny primes and a constant scan key make different texts of one length collide."""
    docs = [(i, f"text {i % 40:02d}" * (1 + i % 3), None, None) for i in range(200)] + [(None, None, None, None), (500, "", None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").repartition(4)
    got = exact_dedup.dedup(df, primes=(3, 5), chunk=4, key=lambda t: F.lit(0).cast("long")).collect()
    check_dedup(got, docs)


def test_exact_dedup_chunks(spark):
    long = "ab" * 5000
    docs = [(1, long, None, None), (2, long, None, None), (3, long + "x", None, None), (4, "x" + long, None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    check_dedup(exact_dedup.dedup(df, chunk=64).collect(), docs)


def test_keep_first(spark, edge_dir):
    docs = queries.documents(spark, edge_dir)
    out = exact_dedup.keep_first(docs, written(exact_dedup.dedup(docs), "t"))
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r["text"] or "" for r in got) == sorted({t or "" for _, t, *_ in EDGE})
    assert {r["doc_id"] for r in got if r["text"] == "word"} == {11}
