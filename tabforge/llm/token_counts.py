"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens): the digest of a
normalised content and the digest of the tokenizer's version lead to the
count.  A run joins the distinct digests of its documents to the cache,
encodes one text of each digest that is missing, appends the counts, and reads
all counts from the cache.  Copies of a text are dropped before texts are
shuffled, and Spark moves the join below that step where the missing digests
are few enough to broadcast.

Cases with a defined result: a null text counts as empty; an empty text has
the count that the library gives; rows that share an id or a text are counted
each; empty tables give empty results; digests that two runs appended at the
same time are read once; any further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, tidy, written

CACHE = "digest binary, tokenizer string, n_tokens bigint"


@lru_cache(maxsize=2)
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def version(path: str) -> str:
    """Digest of the tokenizer file and the library that reads it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def no_change(text: Column) -> Column:
    return text


def _digest(text: Column, normalise: Callable[[Column], Column]) -> Column:
    return F.unhex(F.sha2(normalise(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def open_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache table at ``cache``, made if it isn't there."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _processor(path).encode
        for b in batches:
            n = [len(ids) for texts in slices(b.column("text")) for ids in encode(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] = no_change) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``path`` names a sentencepiece model.

    ``normalise`` must not change a text's count; the counts of this
    sentencepiece model depend on every character, so by default only null
    becomes empty.
    """
    spark, tokenizer = docs.sparkSession, version(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                               _digest(F.col(text_col), normalise).alias("digest")), "digests")
    known = open_cache(spark, cache).where(F.col("tokenizer") == tokenizer)
    missing = written(rows.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
    texts = (docs.select(_digest(F.col(text_col), normalise).alias("digest"), normalise(text).alias("text"))
             .groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi"))
    (texts.mapInArrow(tidy(_count(path)), "digest binary, n_tokens bigint")
     .select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache))
    # a table of its own, so that Spark can split the hot digests of the join
    counts = written(spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
                     .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
