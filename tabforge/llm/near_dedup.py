"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

A document's set holds its distinct word shingles.  Its sketch has ``T`` bins.
Rounds of hashed bin placement fill them: in round i < T every shingle goes to
one hashed bin with value (i, hash) and each bin keeps its smallest value; the
rounds stop once all bins are filled.  A set that is too small for that gets
rounds T..2T-1, in which round T + b offers every shingle to bin b, so each
coordinate is filled for certain.  Two sets agree in a coordinate with
probability equal to their similarity, with the concentration bounds of fully
random minwise hashing, at O(T log T + n) instead of O(T n) steps.

Bands of ``ROWS`` coordinates give ``BANDS`` keys a document.  A pair at
similarity 0.8 shares no key with probability (1 - 0.8^5)^40, about 1e-7;
at 0.85 it is 6e-11.

Documents with equal sets are collapsed to one class first (128-bit digest of
the sorted set).  Classes that are connected by shared keys form a candidate
group.  A group within the bounds of a block goes to one task, each of its
full sets once, and is compared there as a whole.  In a larger group each
class is compared with one leader of its buckets, which joins most groups of
near copies at one comparison a class; buckets that still hold several
components are compared in full, by blocks of bounded size in which only the
classes outside the largest component meet all others.  Both ways give back a
spanning forest of links.  So no step emits the pairs of a group, and no link
between classes that share a key is lost.  Links are confirmed on the full
sets.

Cases with a defined result: null texts and texts without words have the empty
set and are linked with nothing; texts shorter than a shingle are one shingle;
component ids are the smallest non-null ids; empty tables give empty results;
any further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact_dedup
from .common import slices, tidy, written

BANDS, ROWS = 40, 5
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1 << 20  # bounds of a block; larger groups and buckets take several

# Odd 64-bit constants of the hash mixer (any would do).
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while a task runs (emptied when large)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes | None], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts as (offsets, hashes): text i has hashes[offsets[i]:offsets[i + 1]], sorted."""
    words: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            # bytes.lower and bytes.split know ASCII letters and ASCII white space only
            own = text.lower().split()
            counts[i] = len(own)
            words.extend(map(hashes.__getitem__, own))
    h = np.array(words, np.uint64)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(ends, counts) - np.arange(len(h))  # words from here to the text's end
    whole = counts < size
    s = np.zeros(len(h), np.uint64)
    for j in range(size):
        n = len(h) - j
        inside = left[:n] > j
        s[:n] = np.where(inside, s[:n] * MIX_A + h[j:], s[:n])
    s = mix(s + np.minimum(left, size).astype(np.uint64))
    starts = np.arange(len(h)) == np.repeat(ends - counts, counts)
    use = np.where(whole[doc], starts, left >= size)
    s, doc = s[use], doc[use]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    if len(s):
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[first], doc[first]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=len(texts)), out=offsets[1:])
    return offsets, s


def sketch(offsets: np.ndarray, s: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``bins`` values per set; empty sets keep the largest value."""
    n_sets = len(offsets) - 1
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n_sets, bins), unset, np.uint64)
    doc = np.repeat(np.arange(n_sets), np.diff(offsets))
    flat = out.reshape(-1)
    low = np.uint64((1 << 48) - 1)
    with np.errstate(over="ignore"):
        for i in range(bins):
            x = mix(s + np.uint64(i + 1) * MIX_A)
            slot = doc * bins + ((x >> np.uint64(48)) % np.uint64(bins)).astype(np.int64)
            np.minimum.at(flat, slot, (np.uint64(i) << np.uint64(48)) | (x & low))
            open_ = (out == unset).any(axis=1)[doc]
            if not open_.all():
                s, doc = s[open_], doc[open_]
            if not len(s):
                return out
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        who = doc[starts]
        for b in range(bins):
            lack = out[who, b] == unset
            if lack.any():
                x = mix(s + np.uint64(bins + b + 1) * MIX_A) & low
                least = np.minimum.reduceat(x, starts) | (np.uint64(bins + b) << np.uint64(48))
                out[who[lack], b] = least[lack]
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    v = values.reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX_C, (len(values), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * MIX_A + v[:, :, r])
    return key.astype(np.int64)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _profile(size: int, bands: int, rows: int, sets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: set size, digest, and either its band keys or the set itself (each set once a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        with np.errstate(over="ignore"):
            for batch in batches:
                at, ids = 0, batch.column("doc_id")
                rest = [batch.column(c) for c in ("uid", "scan_key")]
                for texts in slices(batch.column("text")):
                    offsets, s = shingle_sets(texts, size, hashes)
                    digests = [xxhash.xxh3_128_digest(s[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    own, more = ids.slice(at, len(texts)), [c.slice(at, len(texts)) for c in rest]
                    at += len(texts)
                    arrays = [own, pa.array(np.diff(offsets)), pa.array(digests, pa.binary())]
                    if sets:
                        keys = list(zip(own.to_pylist(), digests, strict=True))
                        fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                        arrays.append(_lists(offsets, s))
                        yield pa.RecordBatch.from_arrays([a.take(pa.array(fresh, pa.int64())) for a in arrays],
                                                         names=["doc_id", "n_shingles", "digest", "shingles"])
                    else:
                        keys = band_keys(sketch(offsets, s, bands * rows), bands, rows)
                        arrays += [_lists(np.arange(len(texts) + 1) * bands, keys.reshape(-1)), *more]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "digest", "bands", "uid", "scan_key"])

    return run


def _bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       F.monotonically_increasing_id().alias("uid"),
                       exact_dedup.scan_key(F.coalesce(F.col(text_col), F.lit(""))).alias("scan_key"))


def sketches(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, bands, uid, scan_key) of every row."""
    return _bytes(docs, id_col, text_col).mapInArrow(
        tidy(_profile(size, bands, rows, False)), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, uid bigint, scan_key bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ids of ``edges`` (a, b): ``comp`` is the smallest id that is connected.

    Alternates large-star and small-star steps on the edge table until it no
    longer changes; every step is two joins with per-id minima.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(
                edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", "a", "b")
        edges = written(small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
                                                       F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
                        .select("e.a", "e.b").where("a <> b").distinct(), "edges")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` % similarity."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb").cast("long") - both
    return pairs.join(right, "b").join(left, "a").where(both * 100 >= union * percent).select("a", "b")


def _compare(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links across components among the classes of a block, as a forest."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        cid, comp = block.column("cid").to_numpy(), block.column("comp").to_numpy()
        lists = block.column("shingles").chunk(0) if block.num_rows else pa.array([], pa.list_(pa.int64()))
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy()[offsets[0]:offsets[-1]]
        starts, sizes = (offsets - offsets[0])[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        words, at = np.unique(values, return_inverse=True)
        names, group, members = np.unique(comp, return_inverse=True, return_counts=True)
        mark = np.zeros(len(words), np.int32)
        a, b = [], []
        # what is connected with the pivot by now is skipped: all that is not meets it
        pivot = np.flatnonzero(group == members.argmax())[0] if len(group) else 0
        outside = np.flatnonzero(group != members.argmax()) if len(group) else []
        for x in [pivot, *outside] if len(names) > 1 and members.max() == 1 else outside:
            if x != pivot and group[x] == group[pivot]:
                continue
            own = at[starts[x]:starts[x] + sizes[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[at], starts)
            mark[own] = 0
            near = np.flatnonzero((both * 100 >= (sizes[x] + sizes - both) * percent) & (group != group[x]))
            for y in near:
                if group[x] != group[y]:
                    a.append(cid[x])
                    b.append(cid[y])
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _size_fits(n1: str, n2: str, percent: int) -> F.Column:
    """No pair beyond this ratio of sizes can be similar enough."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def full_sets(names: DataFrame, used: DataFrame, size: int) -> DataFrame:
    """The rows of ``used`` (digest, first_id, ...) with their shingles, from a scan of the texts."""
    ids = used.select(F.col("first_id").alias("wanted")).distinct()
    return (names.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
            .mapInArrow(tidy(_profile(size, 1, 1, True)),
                        "doc_id bigint, n_shingles bigint, digest binary, shingles array<bigint>").alias("s")
            .join(used.alias("u"), (F.col("s.digest") == F.col("u.digest")) & F.col("s.doc_id").eqNullSafe(F.col("u.first_id")))
            .select("u.*", "shingles"))


def _large_groups(names: DataFrame, keys: DataFrame, used: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b), as a forest, of the classes ``used`` with the buckets of each (cid, leader, keys): groups beyond
    one block, and groups whose documents repeat an id and a text.  ``leader`` is the smallest leader of a class's
    buckets other than itself; what is known of a class joins it once, and its keys unfold after that."""
    sets = written(full_sets(names, used, size).groupBy("cid").agg(F.first("shingles").alias("shingles")), "sets")

    # each class with one leader: joins groups of near copies at one comparison a class
    pairs = keys.where("leader is not null").select(F.col("leader").alias("a"), F.col("cid").alias("b"))
    size_of = used.select("cid", "n")
    pairs = (pairs.join(size_of.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a")
             .join(size_of.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b")
             .where(_size_fits("na", "nb", percent)).select("a", "b"))
    links = written(verify(pairs, sets, percent), "links")
    comps = written(components(links), "components")

    # pairs across components, once for each set of classes that some bucket holds
    known = (size_of.join(comps.withColumnRenamed("id", "cid"), "cid", "left")
             .select("cid", "n", F.coalesce("comp", "cid").alias("comp")))
    state = written(keys.select("cid", "keys").join(known, "cid").select(F.explode("keys").alias("key"), "cid", "n", "comp"),
                    "state")
    mixed = (state.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("all"),
                                      F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("cid")).alias("h1"),
                                      F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("h2"))
             .where("low <> high").groupBy("members", "h1", "h2").agg(F.min("key").alias("key"), F.min("all").alias("all")))
    mixed = mixed.select("key", F.ceil(F.greatest(F.col("members") / BLOCK_CLASSES, F.col("all") / BLOCK_SHINGLES)).alias("blocks"))
    mixed = written(state.join(mixed, "key")
                    .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
                    .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                    .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "comp"),
                    "mixed")
    found = written(mixed.join(sets, "cid").groupBy("key", "i", "j").applyInArrow(_compare(percent), "a bigint, b bigint"),
                    "links")
    return comps.select(F.col("comp").alias("a"), F.col("id").alias("b")).unionByName(found)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, comp, uid, scan_key) of every row of ``docs``.

    ``size`` words a shingle; documents are linked at ``percent`` % similarity.
    ``component_id`` is the smallest id that links lead to; ``comp`` numbers
    the components (null: a document without words).
    """
    all_rows = written(sketches(docs, size, bands, rows, id_col, text_col), "sketches")
    classes = written(all_rows.where("n_shingles > 0").groupBy("digest")
                      .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
                      .withColumn("cid", F.monotonically_increasing_id()), "classes")

    # buckets with more than one class
    keyed = classes.select("cid", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("cid").alias("leader")).where("members > 1")
    buckets = written(keyed.join(heads, "key").select("key", "cid", "leader"), "buckets")

    # candidate groups: classes connected by shared keys
    groups = written(components(buckets.select(F.col("leader").alias("a"), F.col("cid").alias("b"))), "groups")
    again = (all_rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
             .select(F.col("digest").alias("again"), F.col("doc_id").alias("again_id")))
    used = classes.select("cid", "n", "digest", "first_id").join(groups.select(F.col("id").alias("cid"), F.col("comp").alias("g")), "cid")
    used = written(used.join(again, (F.col("digest") == F.col("again")) & F.col("first_id").eqNullSafe(F.col("again_id")), "left")
                   .select("cid", "n", "digest", "first_id", "g", F.col("again").isNotNull().alias("again")), "used")
    bounds = used.groupBy("g").agg((F.max("again") | (F.count(F.lit(1)) > BLOCK_CLASSES) | (F.sum("n") > BLOCK_SHINGLES)).alias("large"))
    used = written(used.join(bounds, "g").drop("again"), "used")

    # a group that fits into a block is compared at once
    names = _bytes(docs, id_col, text_col)
    fits = full_sets(names, used.where("not large"), size).select("g", "cid", F.col("cid").alias("comp"), "shingles")
    comps = written(fits.groupBy("g").applyInArrow(_compare(percent), "a bigint, b bigint"), "links")

    large = used.where("large")
    if not large.isEmpty():
        keys = (buckets.groupBy("cid").agg(F.min(F.when(F.col("leader") != F.col("cid"), F.col("leader"))).alias("leader"),
                                           F.collect_list("key").alias("keys")))
        keys = written(keys.join(large.select("cid"), "cid", "left_semi"), "keys")
        comps = comps.unionByName(_large_groups(names, keys, large, size, percent))
    comps = written(components(comps), "components")

    first = classes.select("cid", "first_id", "digest").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
    first = first.withColumn("comp", F.coalesce("comp", "cid"))
    least = first.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = first.join(least, "comp").select("digest", "component_id", "comp")
    out = ["doc_id", "n_shingles", "component_id", "comp", "uid", "scan_key"]
    empty = (all_rows.where("n_shingles = 0")
             .withColumns({"component_id": F.col("doc_id"), "comp": F.lit(None).cast("bigint")}).select(*out))
    return all_rows.where("n_shingles > 0").join(named, "digest").select(*out).unionByName(empty)


def keep_one(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``decided`` (from ``near_duplicates``, written), with all its
    columns: the one with the smallest id, ids before null.  Documents without words all stay."""
    stays = decided.where("comp is not null").groupBy("comp").agg(
        F.coalesce(F.min_by("uid", "doc_id"), F.min("uid")).alias("keep_uid"))
    rows = written(decided.join(stays, "comp", "left").select(
        "doc_id", "scan_key", F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept")), "near-kept")
    return exact_dedup.keep_first(docs, rows, id_col, text_col)
