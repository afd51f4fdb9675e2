"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks.  A chunk's fingerprint is its bytes
read as a number in base 256, modulo a prime; the fingerprint of a whole text
is ``sum(chunk_i * 256^(bytes after chunk i)) mod p``.  So chunks are hashed
independently of each other and a plain partial ``sum`` combines them, however
long the document is.  Rows with equal length, scan key and fingerprints (two
primes) form a group; the chunks of all groups with more than one row are then
compared byte for byte by grouping on the chunk's content, and a group that
turns out to hold different texts is split by whole text.

Only narrow rows are shuffled, except the texts that occur more than once.  A
hot text shrinks to one row per task before each shuffle.

Cases with a defined result: a null text counts as empty, so null and empty
texts are equal; of equal texts the row with the largest id stays, ids before
null; of rows that also share that id exactly one stays; empty tables give
empty results; any further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, tidy, written

CHUNK = 1 << 16
# Primes below 2^47: 2^16 residues (a text of 4 GiB) sum up within a long.
PRIMES = (140737488355213, 140737488355201)

CLASS = ["scan_key", "n_bytes", "f1", "f2"]


def chunk_fingerprint(chunk: bytes, prime: int) -> int:
    return int.from_bytes(chunk, "big") % prime


def combine(left: int, right: int, right_len: int, prime: int) -> int:
    """Fingerprint of two texts one after the other."""
    return (left * pow(256, right_len, prime) + right) % prime


def chunks_of(data: Column, size: int = CHUNK) -> Column:
    """Array of (chunk_no, chunk) of a binary column; an empty text is one empty chunk."""
    last = F.floor(F.greatest(F.octet_length(data) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("chunk_no"), F.substring(data, i * size + 1, F.lit(size)).alias("chunk")))


def _hash_chunks(primes: tuple[int, int], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    both = primes[0] * primes[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f1, f2 = [], []
            for chunk, no, n in zip(b.column("chunk"), b.column("chunk_no").to_pylist(), b.column("n_bytes").to_pylist(),
                                    strict=True):
                h = int.from_bytes(chunk.as_buffer(), "big") % both
                after = max(0, n - (no + 1) * size)
                f1.append(combine(h, 0, after, primes[0]))
                f2.append(combine(h, 0, after, primes[1]))
            keep = [n for n in b.schema.names if n not in ("chunk", "chunk_no")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())],
                                             names=[*keep, "s1", "s2"])

    return run


def scan_key(text: Column) -> Column:
    """A cheap native hash; finds the texts of a group again on the second scan."""
    return F.xxhash64(text)


def _rows(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key(text).alias("scan_key"),
                       F.octet_length(text).cast("long").alias("n_bytes"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None,
                 primes: tuple[int, int] = PRIMES, chunk: int = CHUNK,
                 key: Callable[[Column], Column] = scan_key) -> DataFrame:
    """(uid, doc_id, *extra, scan_key, n_bytes, f1, f2): one row per row of ``docs``.

    ``extra`` adds columns made from ``text`` (null made empty) in the same scan.
    """
    extra = extra or {}
    rows = _rows(docs, id_col, text_col, key)
    keys = ["uid", "doc_id", *extra, "scan_key", "n_bytes"]
    pieces = (rows.withColumns({"uid": F.monotonically_increasing_id()} | extra)
              .select(*keys, F.explode(chunks_of(F.col("text").cast("binary"), chunk)).alias("c"))
              .select(*keys, "c.chunk_no", "c.chunk"))
    kinds = dict(pieces.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "s1 bigint", "s2 bigint"])
    hashed = pieces.mapInArrow(tidy(_hash_chunks(primes, chunk)), schema)
    return hashed.groupBy(*keys).agg((F.sum("s1") % primes[0]).alias("f1"), (F.sum("s2") % primes[1]).alias("f2"))


def differing(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, chunk: int,
              key: Callable[[Column], Column]) -> DataFrame:
    """(scan_key, n_bytes) under which the texts of some repeated fingerprint are not all the same.

    Chunks are grouped by content: a group of copies has one content for each
    chunk number.
    """
    # a table of its own: Spark knows its size, and broadcasts it or not
    repeated = written(groups.where("group_size > 1").select("scan_key", "n_bytes").distinct(), "repeated")
    found = _rows(docs, id_col, text_col, key).join(repeated, ["scan_key", "n_bytes"], "left_semi")
    contents = (found.select("scan_key", "n_bytes", F.explode(chunks_of(F.col("text").cast("binary"), chunk)).alias("c"))
                .select("scan_key", "n_bytes", "c.chunk_no", "c.chunk").distinct())
    return (contents.groupBy("scan_key", "n_bytes", "chunk_no").agg(F.count(F.lit(1)).alias("contents"))
            .where("contents > 1").select("scan_key", "n_bytes").distinct())


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per class: its size, the id that stays and the row that stays."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"),
                                 F.coalesce(F.max_by("uid", "doc_id"), F.max("uid")).alias("keep_uid"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None,
          primes: tuple[int, int] = PRIMES, chunk: int = CHUNK, key: Callable[[Column], Column] = scan_key) -> DataFrame:
    """(doc_id, *extra, scan_key, n_bytes, keep_id, group_size, kept), one row per row of ``docs``."""
    names = ["doc_id", *(extra or {}), "scan_key", "n_bytes"]
    rows = written(fingerprints(docs, id_col, text_col, extra, primes, chunk, key), "fingerprints")
    groups = written(_groups(rows, CLASS), "groups")
    split = written(differing(docs, groups, id_col, text_col, chunk, key), "differing")
    result = [*names, "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept")]
    if split.isEmpty():
        return rows.join(groups, CLASS).select(*result)
    same = ["scan_key", "n_bytes"]
    sure = rows.join(split, same, "left_anti").join(groups, CLASS).select(*result)
    # texts that share length, scan key and fingerprints without being equal: classes by whole text
    odd = (_rows(docs, id_col, text_col, key).join(split, same, "left_semi")
           .withColumns({"uid": F.monotonically_increasing_id()} | (extra or {})))
    odd = written(odd, "differing-texts")
    return sure.unionByName(odd.join(_groups(odd, ["text"]), "text").select(*result))


def keep_first(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               key: Callable[[Column], Column] = scan_key) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (from ``dedup``, written) keeps, with all their columns.

    Rows are found again by id and scan key; where rows agree in both, one of them stays.
    """
    k = free_name(docs.columns, "scan_key")
    rows = docs.withColumn(k, key(F.coalesce(F.col(text_col), F.lit(""))))
    per = decided.groupBy("doc_id", "scan_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    per = written(per.where(~F.col("kept") | (F.col("n") > 1)), "dropped")
    match = lambda p: rows[id_col].eqNullSafe(p["doc_id"]) & (rows[k] == p["scan_key"])
    out = rows.join(per, match(per), "left_anti")
    again = per.where("kept")
    if not again.isEmpty():
        out = out.unionByName(rows.join(again, match(again), "left_semi").dropDuplicates([id_col, k]))
    return out.drop(k)
