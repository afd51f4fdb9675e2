import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i} tail{i * 7 % 1000}" for i in range(30_000))

# (doc_id, text, lang, source)
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (None, "a text without an id", "en", None),
    (None, None, None, None),
    (5, "le chat est sur la table et le chien dort", "fr", None),
    (6, LONG, "en", "c"),
    (7, LONG + " end", "en", "c"),
    (8, " \t\n\x0b ", "fr", "c"),
    (9, "12345 !!! 67", None, "c"),
    (10, "word", "en", "c"),
    (11, "word", "en", "d"),
    (12, "<|endoftext|> isn't <|ENDOFTEXT|> it<|startoftext|>s", "en", "d"),
    (13, "Ünïcødé 中文 😀 ﬁn ½ \x1c\x85 İstanbul ΑΣ é́", "de", "d"),
    (14, "le chat est sur la table et le chien dort encore une fois la nuit", "fr", "d"),
    (-15, "word", "en", "d"),
]
CLASHES = ["size", "u", "scan_key", "uid", "n_bytes", "cid", "ids", "html", "vslot", "weight", "target", "text_", "h",
           "mix_times", "dropped_id", "lang_pred", "shard", "keep_id", "digest"]

VECTORS = [
    *[(i, [1.0, 0.0, 0.5]) for i in range(0, 12)], (12, [0.0, 0.0, 0.0]), (13, None), (14, []), (15, [1.0, None, 2.0]),
    (16, [float("nan"), 1.0, 1.0]), (17, [float("inf"), 0.0, 1.0]), (None, [1.0, 2.0, 3.0]), (50, [1.0, 0.1, 0.5]),
    (50, [1.0, 0.1, 0.5]), (100, [-1.0, 2.0, 0.0]), (101, [2.0, 0.0, 1.0]), (150, [1.0, 2.0]), (151, [2.0, 1.0]),
    (200, None), (250, [0.0, 0.0, 0.0]), (300, [1e300, 0.0, 5e299]), *[(400 + i, [i * 0.1, 1.0 - i * 0.03, 0.2]) for i in range(20)],
]


# (conv_id, turn, role, text)
TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|> there"), (1, 2, "assistant", r"<\|im_start|> <\\| ok<"),
    (2, 0, "assistant", "too early"), (2, 1, "user", None), (2, 1, "user", None), (2, None, "assistant", "without a turn"),
    (3, 5, None, "no role"), (3, 7, "odd<\nrole", ""), (3, 9, "assistant", "\n\nuser\n"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "a" * 300_000), (4, 0, "user", ""),
    (5, 0, "user", "q"), (5, 1, "assistant", "call"), (5, 2, "tool", "42"), (5, 3, "assistant", "it is 42"),
]


def write_tables(folder, docs, vectors, pages, turns=()):
    ids, texts, langs, sources = zip(*docs, strict=True) if docs else ([], [], [], [])
    cols = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()),
            "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    cols |= {c: pa.array(["x"] * len(docs), pa.string()) for c in CLASHES}
    pq.write_table(pa.table(cols), f"{folder}/documents.parquet")
    ids, v = zip(*vectors, strict=True) if vectors else ([], [])
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(v, pa.list_(pa.float64())),
                             "label": pa.array([0] * len(ids), pa.int32()), "shard": pa.array(["x"] * len(ids), pa.string())}),
                   f"{folder}/embeddings.parquet")
    ids, h = zip(*pages, strict=True) if pages else ([], [])
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array([None] * len(ids), pa.string()),
                             "html": pa.array(h, pa.string()), "text": pa.array(["x"] * len(ids), pa.string())}),
                   f"{folder}/pages.parquet")
    c, t, r, x = zip(*turns, strict=True) if turns else ([], [], [], [])
    pq.write_table(pa.table({"conv_id": pa.array(c, pa.int64()), "turn": pa.array(t, pa.int64()), "role": pa.array(r, pa.string()),
                             "text": pa.array(x, pa.string()), "turns": pa.array(["x"] * len(c), pa.string()),
                             "segments": pa.array(["x"] * len(c), pa.string())}), f"{folder}/conversations.parquet")
    return str(folder)


PAGES = [(1, "<p>one<p>two"), (1, "<p>one<p>two"), (2, None), (3, ""), (None, "<div hidden>no</div>yes"),
         (4, "<script>x</script>"), (5, "<div>" * 3000 + "deep"), (6, "word " * 200_000)]


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("edge"), EDGE, VECTORS, PAGES, TURNS)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="session")
def small_docs():
    rows = pq.read_table(os.path.join(SMALL, "documents.parquet")).to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]
