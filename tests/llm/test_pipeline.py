from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from llm_brute import near_components
from llm_cases import EDGE, SMALL, edge_dir, empty_dir, small_docs  # noqa: F401
from pyspark.sql import functions as F

from tabforge.llm import queries
from tabforge.llm.common import written


@pytest.fixture(params=["edge", "small"])
def case(request, edge_dir, small_docs):  # noqa: F811
    return {"edge": (edge_dir, EDGE), "small": (SMALL, small_docs)}[request.param]


def test_stages_against_brute_force(spark, case):
    folder, want = case
    docs = queries.documents(spark, folder)
    columns = docs.columns
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        got = docs.collect()
        if name == "language":
            want = [r for r in want if any(c.isalpha() for c in r[1] or "")]
        elif name == "exact":
            last = {}
            for r in want:
                if r[1] not in last or last[r[1]][0] is None or (r[0] is not None and r[0] > last[r[1]][0]):
                    last[r[1]] = r
            want = list(last.values())
        elif name == "near":
            want = [r for r, c in zip(want, near_components(want, 5, 80), strict=True) if r[0] == c]
        elif name == "mix":
            taken = Counter(map(key, got))
            assert set(taken) <= set(want) and max(taken.values()) <= 2
            sizes, mixed = defaultdict(int), defaultdict(int)
            for r in want:
                sizes[r[3]] += len(r[1].split())
                mixed[r[3]] += len(r[1].split()) * taken[r]
            largest = max(len(r[1].split()) for r in want)
            assert abs(sum(mixed.values()) - 1.5 * sum(sizes.values())) <= largest * len(sizes)
            assert all(mixed[s] <= 2 * n for s, n in sizes.items())
            want = list(taken.elements())
        else:
            assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in want)
            assert all(len(r["ids_sha256"]) == 64 and r["n_tokens"] > 0 for r in got)
            break
        assert docs.columns == columns
        assert Counter(map(key, got)) == Counter(want), name


def test_language_keeps_texts_without_any_label(spark, edge_dir):  # noqa: F811
    docs = queries.documents(spark, edge_dir)
    got = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), edge_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in EDGE if any(c.isalpha() for c in r[1] or ""))


def test_language_drops_texts_without_a_main_language(spark):
    of = {"en": "the quick brown fox jumps over the lazy dog and then the other one", "fr": "le chat est sur la table et le chien dort encore une fois"}
    rows = [(i, f"{of[x]} {i}", x, "a") for i, x in enumerate(["en", "fr"] * 10)]
    rows += [(20, f"{of['en']}. {of['fr']}", "en", "a"), (21, f"{of['en']} {of['en']}", None, "a"), (22, "12 34", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect())
    assert got == [*range(20), 21]


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][2] == "near"


def test_empty(spark, empty_dir):  # noqa: F811
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
