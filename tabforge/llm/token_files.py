"""Token-id files of independent zstandard frames.

A file holds the ids of its documents, one after the other, as little-endian
unsigned 32-bit integers.  They are cut into frames that decompress on their
own; a frame ends with the document that makes it large enough, and a very
long document takes several frames.  After them come two skippable frames, so
that plain zstandard readers see the ids only: the table of documents (id,
first id's place, number of ids; an Arrow stream) and, last, the seek table in
zstandard's seekable format: compressed size, size and checksum of each frame,
with a footer of fixed size.  A reader fetches the footer, the tables and the
frames that it needs, and checks each frame it decompresses.

Tasks write files below a shared folder under names of their own; the index
table that Spark commits names the files that count, so what a lost task left
is never read.  Paths are opened through pyarrow's file systems (local or
mounted folders, hdfs, s3, gs).

Cases with a defined result: null and empty texts have no ids but the end id;
null ids come first; rows that share an id are kept each, next to each other;
empty tables give an empty index; only the id and the text column are read.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy, written
from .wordsplit import PLAIN, PartIds, splitter

FRAME = 1 << 17  # bytes of ids after which a frame ends
LONGEST = 1 << 20  # bytes of ids that no frame exceeds

# Magic numbers of zstandard's skippable frames and of its seekable format.
TABLE_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def checksum(data: bytes) -> int:
    """Lower half of the 64-bit hash that the seekable format names."""
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file: ``add`` documents in order, then ``close``."""

    def __init__(self, out, level: int = 3):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.held, self.size, self.total = [], 0, 0
        self.ids, self.starts, self.counts = [], [], []

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.total)
        self.counts.append(len(data) // 4)
        self.total += len(data) // 4
        for at in range(0, len(data), LONGEST):
            self.held.append(data[at:at + LONGEST])
            self.size += len(self.held[-1])
            if self.size >= FRAME:
                self._flush()

    def _flush(self) -> None:
        data = b"".join(self.held)
        self.held, self.size = [], 0
        for at in range(0, len(data), LONGEST):
            part = data[at:at + LONGEST]
            packed = self.pack.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), checksum(part)))

    def close(self) -> None:
        self._flush()
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "start": pa.array(self.starts, pa.int64()),
                          "n": pa.array(self.counts, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        packed = self.pack.compress(sink.getvalue())
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(packed)) + packed)
        entries = [*self.frames, (len(packed) + 8, 0, checksum(b""))]
        body = b"".join(struct.pack("<III", *e) for e in entries)
        footer = struct.pack("<IBI", len(entries), HAS_CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body) + len(footer)) + body + footer)
        self.out.close()


class Reader:
    """Reads one file by its tables; decompresses only the frames that it is asked for."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError(f"no seek table with checksums in {uri}")
        entries = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.places = np.r_[0, np.cumsum(entries[:, 0])]
        self.bounds = np.r_[0, np.cumsum(entries[:, 1])][:n]  # the last entry is the table of documents
        self.sums, self.n_frames, self.unpack = entries[:, 2], n - 1, zstandard.ZstdDecompressor()
        packed = self._at(int(self.places[n - 1]) + 8, int(entries[n - 1, 0]) - 8)
        self.table = pa.ipc.open_stream(self.unpack.decompress(packed)).read_all()
        self.frames_read, self.kept = 0, (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            data = self.unpack.decompress(self._at(int(self.places[k]), int(self.places[k + 1] - self.places[k])),
                                          max_output_size=int(self.bounds[k + 1] - self.bounds[k]))
            if checksum(data) != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.kept = k, data
            self.frames_read += 1
        return self.kept[1]

    def pieces(self, row: int) -> Iterator[bytes]:
        """The bytes of a document's ids, frame by frame."""
        start = 4 * self.table["start"][row].as_py()
        stop = start + 4 * self.table["n"][row].as_py()
        k = int(np.searchsorted(self.bounds, start, "right")) - 1
        while start < stop:
            data, base = self.frame(k), int(self.bounds[k])
            yield data[start - base:stop - base]
            start = base + len(data)
            k += 1

    def ids(self, row: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(row)), "<u4")

    def rows(self, wanted: set[int]) -> list[int]:
        """Places of the documents with these ids."""
        return [i for i, x in enumerate(self.table["doc_id"].to_pylist()) if x in wanted]

    def close(self) -> None:
        self.file.close()


@lru_cache(maxsize=2)
def library_ids(path: str) -> PartIds:
    """Ids by the tokenizers library; each distinct word of a run of texts is encoded once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    split = splitter(path)
    encode = split.whole.encode_batch_fast

    def words(new: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(new), 500):
            some = new[at:at + 500]
            if all(map(PLAIN.fullmatch, some)):  # one text; the library says which word a token is of
                e = split.whole.encode(" ".join(some), add_special_tokens=False)
                ends = 4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some)), side="right")
                data = np.array(e.ids, "<u4").tobytes()
                out += [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                out += [np.array(e.ids, "<u4").tobytes() for e in encode(some, add_special_tokens=False)]
        return out

    return PartIds(split, words, 1_200_000)


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_ids(path), end_id.to_bytes(4, "little")
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        no = TaskContext.get().partitionId()
        name, writer = f"{no:06d}-{uuid.uuid4().hex}.tok", None
        for b in batches:
            ids, at = b.column("doc_id").to_pylist(), 0
            for texts in slices(b.column("text"), 4 << 20, 4096):
                if writer is None:
                    writer = Writer(fs.open_output_stream(f"{base}/{name}"))
                offsets, tokens = encode(texts)
                data, offsets = tokens.tobytes(), (4 * offsets).tolist()
                for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
                    writer.add(ids[at], data[start:stop] + end)
                    at += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([name]), pa.array([len(writer.ids)]),
                                              pa.array([writer.total])], names=["file_no", "file", "docs", "ids"])

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows' ids in ascending id order; returns the committed index (file_no, file, docs, ids, start).

    ``start``: number of ids in the files before.  Rows go to files by ranges
    of (id, hash of the text, place), so that no id, however frequent, has to
    lie in one file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    files = (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
             .mapInArrow(tidy(_write(folder, path, end_id)), "file_no bigint, file string, docs bigint, ids bigint"))
    files = written(files, "token-files")
    # one row per file
    return files.withColumn("start", F.sum("ids").over(Window.orderBy("file_no")) - F.col("ids"))


def _read(folder: str, per_document: Callable[[Reader, int], list], names: list[str], wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                reader = Reader(f"{folder}/{f['file']}")
                rows = reader.rows(set(f["wanted"])) if wanted else range(len(reader.table))
                ids, starts, counts = (reader.table[c].to_pylist() for c in ("doc_id", "start", "n"))
                out: list[list] = [[] for _ in names]
                for r in rows:
                    for column, v in zip(out, [ids[r], f["start"] + starts[r], counts[r], per_document(reader, r)], strict=True):
                        column.append(v)
                    if len(out[0]) >= (256 if wanted else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
                        out = [[] for _ in names]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
                reader.close()

    return run


def _crc(reader: Reader, row: int) -> int:
    crc = 0
    for piece in reader.pieces(row):
        crc = zlib.crc32(piece, crc)
    return crc


def check(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; one task per file."""
    files = index.select("file", "start")
    return (files.repartition(max(1, files.count()))
            .mapInArrow(_read(folder, _crc, ["doc_id", "start", "n_tokens", "ids_crc32"], False),
                        "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def read(index: DataFrame, folder: str, wanted: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents with the ids ``wanted``; other frames are left alone."""
    files = index.select("file", "start", F.array(*[F.lit(int(w)) for w in wanted]).alias("wanted"))
    ids = lambda reader, row: reader.ids(row).astype(np.int64).tolist()
    return (files.repartition(max(1, files.count()))
            .mapInArrow(_read(folder, ids, ["doc_id", "start", "n_tokens", "ids"], True),
                        "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>"))
