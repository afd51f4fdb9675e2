"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import checkpoint_dir

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage, so that later passes read a narrow table instead of the
    texts again, and survives the loss of executors.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words in a text; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unit_hash(seed: int, doc_id: Column, text: Column) -> Column:
    """A seeded hash of a record as a long in [0, 2^60).

    Made from md5, so that any SQL engine can repeat it.  The text takes part:
    rows that share an id still differ, only wholly equal rows tie.
    """
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")),
                      F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores appended until no column has that name."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's Arrow batches; gives the memory of dead batches and objects back to the system when the
    task ends, as the Python worker lives on between tasks."""
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        give_back()

    return whole


def give_back() -> None:
    """Returns the C heap's free pages to the system, where its library can (glibc)."""
    import ctypes
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(column, most_bytes: int = 1 << 20, most_rows: int = 512) -> Iterator[list]:
    """Values of an Arrow column as lists of bounded size (a long text is a list of its own)."""
    part, size = [], 0
    for start in range(0, len(column), most_rows):
        for v in column.slice(start, most_rows).to_pylist():
            n = len(v) if v is not None else 0
            if part and (size + n > most_bytes or len(part) >= most_rows):
                yield part
                part, size = [], 0
            part.append(v)
            size += n
    if part:
        yield part
