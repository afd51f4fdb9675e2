"""Phrase collocation mining with an FM-index per shard.

Texts are cut at punctuation and line breaks into pieces and those into words.
Each task turns its texts, language by language, into shards of at most 2^21
word ids, builds a bidirectional index of each (``fm_index``) and writes it to
the shared folder; texts are never shuffled.  A row for each shard names its
file and holds its words with their counts.

Counts are summed across shards, length by length.  A phrase that occurs
``least`` times holds only phrases that do, so a shard extends the intervals
of such phrases only, by ids that complete such phrases on the other side too:
words to the right give pairs, pairs to the left give triples, triples to the
right give phrases of four.  The counts that a shard finds go to the other
shards' by a hash bucket of the phrase, packed into one row a shard and bucket,
and the rows of phrases that reach ``least`` come back to their shards; a
bucket adds its phrases up, so no phrase needs a join, and a phrase has one
count a shard at most.  Words get ids of 31 bits by rank within one of 4096
hash buckets; two ids make a key.

A candidate is then scored by its lowest cut, and dropped where a phrase one
word longer has at least ``covered`` percent of its count (a phrase inside a
longer one occurs at least as often in between, so one word decides).

Cases with a defined result: null and empty texts have no words; a null
language is ``und``; texts of any length go through in parts that end at
piece ends (a piece of more than 2^20 words, cut there, would lose the
phrases across the cut: it is an error); repeated rows and ids count each;
empty tables give an empty result; only the text and the language column are
read, whatever else there is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, slices, tidy, written
from .fm_index import DEPTH, MOST, Index, State
from .token_files import _open

# Upper-case letters become lower-case; these bytes end a piece; words stand between blanks and tabs.
# 0xFF, which UTF-8 never uses, stands for a piece's end from here on.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PLAIN = bytes(0xFF if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))

PART = 1 << 20  # bytes of a text that are split into words at once
HELD = 2 * MOST  # ids that a task holds over all languages
BUCKETS = 4096  # of words, for their ids

SHARD = "shard long, lang string, file string, n long, words array<string>, counts array<long>"
PACKED = "bucket long, shard long, counts binary"


def _parts(text: str) -> Iterator[list[bytes]]:
    """A text's words with 0xFF for each end of a piece, in parts that end with a piece."""
    data = text.encode().translate(PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b"\xff", at + PART)
        end = len(data) if end < 0 else end + 1
        yield data[at:end].replace(b"\xff", b" \xff ").split()
        at = end


class _Builder:
    """Words of one language as ids from 1; breaks are 0."""

    def __init__(self):
        self.ids_of: dict[bytes, int] = {b"\xff": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        ids_of = self.ids_of
        for w in set(words).difference(ids_of):
            ids_of[w] = len(ids_of)
        ids = np.fromiter(map(ids_of.__getitem__, words), np.int32, len(words))
        # breaks in a row are one, and each part ends with one
        ids = np.append(ids, np.int32(0))
        ids = ids[np.r_[True, (ids[1:] != 0) | (ids[:-1] != 0)]]
        self.parts.append(ids)
        self.size += len(ids)


def _shards(docs: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, made = {}, 0
        base = TaskContext.get().partitionId() << 24

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            b = open_.pop(lang)
            ids = np.concatenate(b.parts)
            file = f"{folder}/{uuid.uuid4().hex}"
            _put(file, Index.build(ids).pack())
            counts = np.bincount(ids, minlength=len(b.ids_of))[1:]
            words = [w.decode() for w in b.ids_of if w != b"\xff"]
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([lang]), pa.array([file]), pa.array([int(counts.sum())]),
                 pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                ["shard", "lang", "file", "n", "words", "counts"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            at = 0
            for texts in slices(batch.column("text")):
                for lang, text in zip(langs[at:at + len(texts)], texts, strict=True):
                    for words in _parts(text):
                        if len(words) > MOST // 2:
                            raise ValueError(f"a piece of more than {MOST // 2} words")
                        if lang in open_ and open_[lang].size + len(words) + 1 > MOST:
                            yield close(lang)
                        open_.setdefault(lang, _Builder()).add(words)
                    if sum(b.size for b in open_.values()) > HELD:
                        yield close(max(open_, key=lambda k: open_[k].size))
                at += len(texts)
        for lang in list(open_):
            yield close(lang)

    return docs.mapInArrow(tidy(run), SHARD)


def _put(uri: str, data: bytes) -> None:
    fs, path = _open(uri)
    with fs.open_output_stream(path) as f:
        f.write(data)


def _get(uri: str) -> bytes:
    fs, path = _open(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


@dataclass(frozen=True)
class PhraseIndex:
    """Tables over all shards: ``shards`` (shard, lang, file, n, words, counts), ``words`` (shard, word's place, id;
    total, lang, word) and, by length, ``phrases[n]`` (shard, k1, k2, total)."""

    shards: DataFrame
    words: DataFrame
    phrases: dict[int, DataFrame]
    least: int


def build(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, depth: int = DEPTH) -> PhraseIndex:
    """Indexes all texts and counts the phrases of up to ``depth`` words that occur ``least`` times in their language."""
    if not 2 <= depth <= DEPTH:
        raise ValueError(f"phrases have 2 to {DEPTH} words")
    spark = docs.sparkSession
    folder = shared_path(spark, "phrase-index")
    _make_folder(folder)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    shards = written(_shards(texts, folder), "phrase-shards")
    words = written(_frequent_words(shards, least), "phrase-words")
    tasks = max(1, -(-(shards.agg(F.sum("n")).first()[0] or 0) // (MOST // 2)))
    base = shards.select("shard", F.lit(0).alias("level"), F.lit(None).cast("long").alias("k1"),
                         F.lit(None).cast("long").alias("k2"), "file").unionByName(
        words.select("shard", F.lit(1).alias("level"), F.col("place").cast("long").alias("k1"),
                     F.col("id").cast("long").alias("k2"), F.lit(None).cast("string").alias("file")))
    phrases: dict[int, DataFrame] = {}
    for n in range(2, depth + 1):
        known = base
        if n > 2:
            known = base.unionByName(phrases[n - 1].select("shard", F.lit(n - 1).alias("level"), "k1", "k2",
                                                           F.lit(None).cast("string").alias("file")))
        found = known.repartition(tasks, "shard").groupBy("shard").applyInArrow(_longer(n, tasks), PACKED)
        totals = (found.repartition(tasks, "bucket").groupBy("bucket")
                  .applyInArrow(_totals(n), "shard long, k1 long, k2 long, total long"))
        phrases[n] = written(totals.where(F.col("total") >= least), f"phrases-{n}")
    return PhraseIndex(shards, words, phrases, least)


def _make_folder(folder: str) -> None:
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)


def _frequent_words(shards: DataFrame, least: int) -> DataFrame:
    """Words with at least ``least`` occurrences in their language, a row for each shard that has them; ``id`` from 1."""
    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    local = local.select("shard", "lang", (F.col("at") + 1).alias("place"), F.col("w.words").alias("word"),
                         F.col("w.counts").alias("count"))
    local = local.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)))
    total = F.sum("count").over(Window.partitionBy("bucket", "lang", "word"))
    often = local.repartition("bucket").withColumn("total", total).where(F.col("total") >= least)
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    # ids need 31 bits, as two of them make a key; more words are an error, not a wrong key
    return (often.withColumn("id", (rank.cast("long") - 1) * BUCKETS + F.col("bucket") + 1)
            .withColumn("id", F.when(F.col("id") < 2 ** 31, F.col("id")).otherwise(
                F.raise_error(F.lit("too many words for ids of 31 bits")).cast("long")))
            .select("shard", "place", "id", "total", "lang", "word"))


def _longer(n: int, buckets: int):
    """Counts in one shard of the phrases of n words whose parts of n - 1 words are all frequent."""
    def run(table: pa.Table) -> pa.Table:
        level = table.column("level").to_numpy()
        k1, k2 = (table.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        shard = table.column("shard")[0].as_py()
        empty = np.zeros(0, np.int64)
        place, ids = k1[level == 1].astype(np.int64), k2[level == 1].astype(np.int64)
        known = _words_of(k1[level == n - 1].astype(np.int64), k2[level == n - 1].astype(np.int64), n - 1) if n > 2 else None
        if len(ids) == 0 or known is not None and len(known) == 0:
            return _packed(shard, n, empty, empty, empty, buckets)
        by_id = np.argsort(ids)
        file = next(f for f in table.column("file").to_pylist() if f is not None)
        index = Index.unpack(_get(file))
        global_ = np.zeros(len(index.starts), np.int64)
        global_[place] = ids
        state = index.words(np.sort(place))
        often = lambda which, c: global_[c] > 0
        if n == 2:
            found = index.extend(state, "right", often)
        else:
            parts = place[by_id][np.searchsorted(ids[by_id], known)]  # places of the known phrases' words
            found = _grow(index, state, parts)
        words = global_[found.words]
        key1 = (words[:, 0] << 32) | words[:, 1]
        key2 = (words[:, 2] << 32) if n > 2 else np.zeros(len(words), np.int64)
        if n > 3:
            key2 = key2 | words[:, 3]
        return _packed(shard, n, key1, key2, found.size, buckets)

    return run


def _grow(index: Index, state: State, parts: np.ndarray) -> State:
    """From words to the phrases one word longer than ``parts`` all of whose parts are in ``parts``."""
    n = parts.shape[1]
    in_pairs = _member(np.unique(parts[:, -2:], axis=0) if n == 3 else parts)
    pairs = index.extend(state, "right", lambda which, c: in_pairs(np.c_[state.words[which], c]))
    in_parts = _member(parts)
    if n == 2:  # the new left word with the pair's first
        return index.extend(pairs, "left", lambda which, c: in_parts(np.c_[c, pairs.words[which, 0]]))
    triples = index.extend(pairs, "left", lambda which, c: in_parts(np.c_[c, pairs.words[which]]))
    return index.extend(triples, "right", lambda which, c: in_parts(np.c_[triples.words[which, 1:], c]))


def _member(rows: np.ndarray):
    """Test of rows of word places against a set of rows, as sorted longs."""
    def key(r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r), np.int64)
        for i in range(r.shape[1]):
            out = out * MOST + r[:, i]
        return out

    known = np.unique(key(rows.astype(np.int64)))

    def test(r: np.ndarray) -> np.ndarray:
        k = key(r.astype(np.int64))
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        return known[at] == k

    return test


def _words_of(k1: np.ndarray, k2: np.ndarray, n: int) -> np.ndarray:
    low = (1 << 32) - 1
    return np.stack([k1 >> 32, k1 & low, k2 >> 32, k2 & low][:n], axis=1)


def _bucket(k1: np.ndarray, k2: np.ndarray, buckets: int) -> np.ndarray:
    h = k1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ k2.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _packed(shard: int, n: int, k1: np.ndarray, k2: np.ndarray, count: np.ndarray, buckets: int) -> pa.Table:
    """A shard's counts, a row a bucket: its phrases in order, first words as differences, bytes of equal rank together."""
    bucket = _bucket(k1, k2, buckets)
    order = np.lexsort((k2, k1, bucket) if n > 2 else (k1, bucket))
    bucket, words, count = bucket[order], _words_of(k1[order], k2[order], n), count[order]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
    pack, blocks = zstandard.ZstdCompressor(level=3), []
    for a, b in zip(begin, np.r_[begin[1:], len(bucket)], strict=False):
        cells = np.c_[np.diff(words[a:b, 0], prepend=0), words[a:b, 1:], count[a:b]].T.astype("<i4", order="C")
        blocks.append(pack.compress(cells.view(np.uint8).reshape(n + 1, -1, 4).transpose(0, 2, 1).tobytes()))
    return pa.table({"bucket": pa.array(bucket[begin], pa.int64()), "shard": pa.array(np.full(len(begin), shard), pa.int64()),
                     "counts": pa.array(blocks, pa.binary())})


def _unpacked(block: bytes, n: int) -> np.ndarray:
    """The words of a block's phrases and their counts, n + 1 rows."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(n + 1, 4, -1)
    cells = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i4")[:, :, 0].astype(np.int64)
    cells[0] = np.cumsum(cells[0])
    return cells


def _totals(n: int):
    """The phrases of a bucket with their counts over all shards, a row for each shard that has them."""
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(b, n) for b in table.column("counts").to_pylist()]
        shard = np.repeat(table.column("shard").to_numpy(), [p.shape[1] for p in parts])
        cells = np.concatenate(parts, axis=1)
        k1 = (cells[0] << 32) | cells[1]
        k2 = (cells[2] << 32) | (cells[3] if n > 3 else 0) if n > 2 else np.zeros(len(k1), np.int64)
        order = np.lexsort((shard, k2, k1) if n > 2 else (shard, k1))
        k1, k2, shard, count = k1[order], k2[order], shard[order], cells[n][order]
        first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        total = np.repeat(np.add.reduceat(count, first), np.diff(np.r_[first, len(k1)]))
        return pa.table({c: pa.array(v, pa.int64())
                         for c, v in (("shard", shard), ("k1", k1), ("k2", k2), ("total", total))})

    return run


def extensions(index: PhraseIndex, phrase: str, lang: str = "und") -> DataFrame:
    """The words beside a phrase of up to ``DEPTH - 1`` words: side, word, count over all shards, rare words too."""
    wanted = [w.encode().translate(PLAIN).decode() for w in phrase.split()]
    if not 1 <= len(wanted) < DEPTH:
        raise ValueError(f"a phrase of 1 to {DEPTH - 1} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = {w: i + 1 for i, w in enumerate(row["words"])}
                ids = [place.get(w) for w in wanted]
                if None in ids:
                    continue
                ix = Index.unpack(_get(row["file"]))
                state = ix.words(np.array(ids[:1]))
                for c in ids[1:]:
                    state = ix.extend(state, "right", lambda _, found, c=c: found == c)
                for side in ("left", "right"):
                    out = ix.extend(state, side)
                    beside = out.words[:, 0 if side == "left" else -1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([side] * len(beside), pa.string()),
                         pa.array([row["words"][i - 1] for i in beside], pa.string()), pa.array(out.size, pa.int64())],
                        ["side", "word", "count"])

    full = index.shards.where(F.col("lang") == lang).select("file", "words")
    found = full.mapInArrow(run, "side string, word string, count long")
    return found.groupBy("side", "word").agg(F.sum("count").alias("count"))


def _all_phrases(index: PhraseIndex) -> DataFrame:
    """Every frequent phrase once: n, k1, k2, total, from the rows of its shards."""
    out = None
    for n, t in index.phrases.items():
        part = t.groupBy("k1", "k2").agg(F.first("total").alias("total")).withColumn("n", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def _key(words: list[Column]) -> tuple[Column, Column]:
    zero = F.lit(0).cast("long")
    w = [*words, zero, zero, zero, zero][:4]
    pair = lambda a, b: F.shiftleft(a, 32).bitwiseOR(b)
    return pair(w[0], w[1]), pair(w[2], w[3])


def collocations(index: PhraseIndex, top: int = 2000, covered: int = 80) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    low = F.lit((1 << 32) - 1)
    words = index.words.groupBy("id").agg(F.first("total").alias("total"), F.first("lang").alias("lang"),
                                          F.first("word").alias("word"))
    words = written(words, "phrase-vocabulary")
    phrases = _all_phrases(index).withColumn("w", F.array(
        F.shiftright("k1", 32), F.col("k1").bitwiseAND(low), F.shiftright("k2", 32), F.col("k2").bitwiseAND(low)))
    phrases = written(phrases.withColumn("w", F.slice("w", 1, F.col("n"))), "phrase-candidates")
    w = [F.get("w", F.lit(i)) for i in range(4)]

    def part(length: int, begin: int) -> Column:
        k1, k2 = _key(w[begin:begin + length])
        return F.struct(k1.alias("k1"), k2.alias("k2"))

    # a phrase of n words covers its first and its last n - 1 words
    inside = F.when(F.col("n") == 3, F.array(part(2, 0), part(2, 1))).when(F.col("n") == 4, F.array(part(3, 0), part(3, 1)))
    longest = (phrases.where("n > 2").select("total", F.explode(inside).alias("p"))
               .groupBy(F.col("p.k1").alias("k1"), F.col("p.k2").alias("k2")).agg(F.max("total").alias("around")))
    left = phrases.join(longest, ["k1", "k2"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < covered * F.col("total")))
    cuts = F.when(F.col("n") == 2, F.array(_cut(part, 2, 1))).when(
        F.col("n") == 3, F.array(_cut(part, 3, 1), _cut(part, 3, 2))).otherwise(
        F.array(_cut(part, 4, 1), _cut(part, 4, 2), _cut(part, 4, 3)))
    cut = left.select("k1", "k2", "w", F.col("total").alias("a"), F.explode(cuts).alias("c"))
    parts = phrases.select("k1", "k2", "total").unionByName(
        words.select(F.shiftleft("id", 32).alias("k1"), F.lit(0).cast("long").alias("k2"), "total"))
    side = lambda s, name: parts.select(F.struct("k1", "k2").alias(f"{s}_key"), F.col("total").alias(name))
    scored = (cut.select("k1", "k2", "w", "a", "c.k", F.col("c.left").alias("left_key"), F.col("c.right").alias("right_key"))
              .join(side("left", "l"), "left_key").join(side("right", "r"), "right_key"))
    exact = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + r)")
    best = (scored.withColumn("score", exact).groupBy("k1", "k2")
            .agg(F.first("w").alias("w"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b")))
    # all words of a phrase are of one language
    one = best.join(words.select(F.col("id").alias("first"), "lang"), F.get("w", F.lit(0)) == F.col("first"))
    near = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"))
    kept = written(one.withColumn("near", F.rank().over(near)).where(F.col("near") <= top), "phrase-top")
    spelled = (kept.select("k1", "k2", F.posexplode("w").alias("at", "id")).join(words.select("id", "word"), "id")
               .groupBy("k1", "k2").agg(F.array_join(F.transform(
                   F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    sizes = index.shards.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    return (kept.join(spelled, ["k1", "k2"]).join(sizes, "lang")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"),
                    F.col("b.r").alias("r"), "n", F.col("b.score").alias("score")))


def _cut(part, n: int, k: int) -> Column:
    return F.struct(F.lit(k).alias("k"), part(k, 0).alias("left"), part(n - k, k).alias("right"))
