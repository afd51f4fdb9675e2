"""Language identification by multilingual mixture inference.

Each language has a distribution over letter trigrams, learned from labelled
documents.  A document is a mixture: expectation-maximisation finds the
proportions of the languages that make its trigrams most likely.  The set of
its languages grows by the language with the largest remaining proportion as
long as the log-likelihood gains more than the penalty (half the logarithm of
the number of trigrams for each language added, as in the Bayesian information
criterion).

The model is fitted on at most ``max_docs`` documents a language (those with
the smallest hashes of id and text) and has at most ``max_features`` trigrams,
so it has a bounded size: each language's most frequent ones up to an equal part,
then the most frequent of the others.  More than ``max_languages`` languages are
an error.
Prediction covers every row and the whole text.

Cases with a defined result: a null text or one without a letter is ``und``
with score 0; a text with letters but without any learned trigram gets the
most frequent language with its share of the labelled documents; without
labelled rows every prediction is ``und``; ties go to the smaller language
name; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
KINDS = 128  # kinds of bytes
ROUNDS = 8  # expectation-maximisation rounds


def _byte_kinds() -> np.ndarray:
    """0 for what separates words, 1 to 26 for a to z, 32 to 63 for leading and 64 to 127 for following UTF-8 bytes."""
    b = np.arange(256)
    kinds = np.where((b >= 97) & (b <= 122), b - 96, 0)
    kinds = np.where((b >= 65) & (b <= 90), b - 64, kinds)
    kinds = np.where((b >= 128) & (b < 192), b - 64, kinds)
    return np.where(b >= 192, 32 + (b & 31), kinds).astype(np.int32)


BYTE_KINDS = _byte_kinds()


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, trigram) of every letter trigram; runs of separators count as one."""
    data = [(" " + t.lower() + " ").encode("utf-8") if t else b"" for t in texts]
    doc = np.repeat(np.arange(len(data)), [len(d) for d in data])
    kind = BYTE_KINDS[np.frombuffer(b"".join(data), np.uint8)]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0) | (doc[1:] != doc[:-1])
    kind, doc = kind[keep], doc[keep]
    if len(kind) < 3:
        return doc[:0], kind[:0]
    key = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
    # not across texts, and not around a lone separator
    use = (doc[:-2] == doc[2:]) & (kind[1:-1] != 0)
    return doc[:-2][use], key[use]


@dataclass
class Model:
    languages: list[str]  # in ascending order
    features: np.ndarray  # trigrams, ascending
    log_p: np.ndarray  # (features, languages)
    shares: np.ndarray  # of the labelled documents, by language

    def place(self) -> np.ndarray:
        """Row of each possible trigram in ``log_p``, -1 where it has none."""
        at = np.full(KINDS ** 3, -1, np.int32)
        at[self.features] = np.arange(len(self.features), dtype=np.int32)
        return at


def _count(lang_at: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column("text")):
                langs = np.array([lang_at[x] for x in b.column("lang").slice(at, len(texts)).to_pylist()], np.int64)
                at += len(texts)
                doc, key = trigrams(texts)
                both, n = np.unique(langs[doc] * KINDS ** 3 + key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((both // KINDS ** 3).astype(np.int32)),
                                                  pa.array((both % KINDS ** 3).astype(np.int32)), pa.array(n)],
                                                 names=["lang", "feature", "n"])

    return run


def held_out(id_col: Column) -> Column:
    """The fourth of the documents that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 2000,
        max_features: int = 40_000, max_languages: int = 256, smoothing: float = 0.1) -> Model:
    """Trigram distributions from the rows of ``docs`` with a text and a language."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       F.xxhash64(F.col(id_col), F.col(text_col), F.lit("fit")).alias("h")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than max_languages={max_languages} languages in column {lang_col}")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    n = {r["lang"]: r["n"] for r in sizes}
    shares = np.array([n[x] for x in languages], float) / sum(n.values())
    # the hash up to which a language's documents are used: one row per language.  Only about four times
    # max_docs hashes of a language, the smallest ones, are ranked; the first always, as equal rows share a hash
    sizes = docs.sparkSession.createDataFrame([(r["lang"], r["n"], r["first"]) for r in sizes], "lang string, n bigint, first bigint")
    small = (F.col("h") / 2.0 ** 63 < 8.0 * max_docs / F.col("n") - 1) | (F.col("h") == F.col("first"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    upto = (rows.select("lang", "h").join(F.broadcast(sizes), "lang").where(small)
            .withColumn("nth", nth).where(F.col("nth") <= max_docs).groupBy("lang").agg(F.max("h").alias("upto")))
    used = rows.join(F.broadcast(upto), "lang").where("h <= upto").select("text", "lang")
    counts = (used.mapInArrow(_count({x: i for i, x in enumerate(languages)}), "lang int, feature int, n bigint")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    # at most KINDS^3 rows a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "feature"))
    own = F.max(F.col("place") <= max(1, max_features // len(languages)))
    top = (counts.withColumn("place", place).groupBy("feature")
           .agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("all"), own.alias("own"))
           .orderBy(F.col("own").desc(), F.col("all").desc(), "feature").limit(max(max_features, len(languages))))  # the model's size
    found = sorted((r["feature"], r["by"]) for r in top.collect())
    table = np.full((len(found), len(languages)), smoothing)
    for i, (_, by) in enumerate(found):
        for x in by:
            table[i, x["lang"]] += x["n"]
    log_p = np.log(table / table.sum(axis=0)) if len(found) else table
    return Model(languages, np.array([f for f, _ in found], np.int64), log_p, shares)


def mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, allowed: np.ndarray,
            rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of several documents by expectation-maximisation.

    ``p``: probability of each (document, trigram) under each language, ``n``
    its count; a document's rows start at ``starts``; ``allowed``: the
    languages that each document may have.
    """
    rows = np.diff(np.r_[starts, len(n)])
    total = np.add.reduceat(n, starts)[:, None]
    theta = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        each = np.repeat(theta, rows, axis=0) * p
        each *= (n / each.sum(axis=1))[:, None]
        theta = np.add.reduceat(each, starts, axis=0) / total
    like = np.log((np.repeat(theta, rows, axis=0) * p).sum(axis=1))
    return theta, np.add.reduceat(n * like, starts)


def proportions(p: np.ndarray, n: np.ndarray, starts: np.ndarray, min_share: float = 0.02) -> np.ndarray:
    """Proportions of the languages in the chosen set of each document (0 for the others)."""
    docs, langs = len(starts), p.shape[1]
    stops = np.r_[starts[1:], len(n)]
    single = np.add.reduceat(np.log(p) * n[:, None], starts, axis=0)
    chosen = np.zeros((docs, langs), bool)
    chosen[np.arange(docs), single.argmax(axis=1)] = True
    best, result = single.max(axis=1), chosen.astype(float)
    if langs == 1:
        return result
    full, _ = mixture(p, n, starts, np.ones((docs, langs)))
    penalty = 0.5 * np.log(np.maximum(np.add.reduceat(n, starts), 2))
    active = np.arange(docs)
    while len(active):
        left = np.where(chosen[active], -1.0, full[active])
        more = left.argmax(axis=1)
        active, more = active[left.max(axis=1) >= min_share], more[left.max(axis=1) >= min_share]
        if not len(active):
            break
        larger = chosen[active].copy()
        larger[np.arange(len(active)), more] = True
        sizes = stops[active] - starts[active]
        own = np.repeat(starts[active] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        theta, like = mixture(p[own], n[own], np.r_[0, np.cumsum(sizes)[:-1]], larger.astype(float))
        gains = like - best[active] > penalty[active]
        active, theta, like, larger = active[gains], theta[gains], like[gains], larger[gains]
        chosen[active], best[active], result[active] = larger, like, theta
    return result


def _predict(model: Model):
    ready: list[tuple[np.ndarray, np.ndarray]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:  # once a task
            ready.append((model.place(), np.exp(model.log_p)))
        (at_of, p_of), some = ready[0], len(model.languages) > 0
        common = int(model.shares.argmax()) if some else 0
        for b in batches:
            start = 0
            for texts in slices(b.column("text")):
                rest = [b.column(c).slice(start, len(texts)) for c in b.schema.names if c != "text"]
                start += len(texts)
                theta = np.zeros((len(texts), max(1, len(model.languages))))
                if some:
                    theta[:, common] = model.shares[common]
                    doc, key = trigrams(texts)
                    at = at_of[key]
                    doc, at = doc[at >= 0], at[at >= 0]
                    if len(doc):
                        both, n = np.unique(doc * len(at_of) + at, return_counts=True)
                        doc, at = both // len(at_of), both % len(at_of)
                        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                        theta[doc[starts]] = proportions(p_of[at], n.astype(float), starts)
                known = np.array([some and bool(t) and LETTER.search(t) is not None for t in texts], bool)
                best = theta.argmax(axis=1)
                names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(theta[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
                mix = [[(model.languages[j], float(row[j])) for j in np.flatnonzero(row > 0)] if k else []
                       for row, k in zip(theta, known, strict=True)]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                mix = pa.array([[{"lang": a, "share": s} for a, s in m] for m in mix], kind)
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score), mix],
                                                 names=[*(c for c in b.schema.names if c != "text"), "lang_pred", "score", "mix"])

    return run


def predict(docs: DataFrame, model: Model, keep: dict[str, Column] | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, *keep, lang_pred, score, mix) of every row; ``mix`` lists the document's languages with their shares."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in (keep or {}).items()],
                       F.col(text_col).cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns if c != "text")
    return rows.mapInArrow(tidy(_predict(model)), f"{schema}, lang_pred string, score double, mix array<struct<lang: string, share: double>>")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` (same columns) whose language is known with at least ``min_score``.

    Where no language was learned nothing can be told of a text with a letter, so all such rows stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict_part = _predict(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                text = b.column(b.schema.names.index(text_col)).cast(pa.string())
                if not model.languages:
                    yield b.filter(pa.array([bool(t) and LETTER.search(t) is not None for t in text.to_pylist()], pa.bool_()))
                    continue
                part = pa.RecordBatch.from_arrays([text], names=["text"])
                keep = [n != UNKNOWN and s >= min_score for out in predict_part(iter([part]))
                        for n, s in zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist(), strict=True)]
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
