"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word's prefix is determined by its last token: it is the
encoding of the prefix without that token, plus the token.  A token that ends
at a position is the last one there if it is compatible with the last token of
the prefix before it, i.e. if merging the two side by side leaves them as they
are; exactly one token is.  The distinct words of a run of documents form a
trie.  Visiting it depth first (the words in sorted order) keeps the states of
the current path on a stack, so a prefix that many words share is worked out
once.

Cases with a defined result: null and empty texts have no ids and decode to an
empty text; strings of added tokens in a text become those tokens; ids that the
vocabulary lacks are left out when decoding, as the library does; empty tables
give empty results; only the id and the text column are read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy
from .wordsplit import PartIds, byte_letters, splitter

END = 0x8000  # added to a letter's code: the letter that ends a word


class TrieEncoder:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix = model["end_of_word_suffix"]
        self.letters = byte_letters()
        own = lambda t: t[:-len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + END) if t.endswith(suffix) and t != suffix else t
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        n = max(self.ids.values()) + 1
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.pair_rank: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = own(a), own(b)
            i = self.ids[a + b]
            self.rank[i], self.left[i], self.right[i] = r, self.ids[a], self.ids[b]
            self.pair_rank[self.ids[a] << 20 | self.ids[b]] = r
        self.fits: dict[int, bool] = {}
        # tokens that merging never yields can't be a last token
        for t in [t for t, i in self.ids.items() if len(t) > 1 and not self._reachable(i)]:
            del self.ids[t]
        self.starts = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[str, tuple[str, tuple]] = {}

    def _step(self, key: str) -> tuple[str, tuple]:
        """After ``key`` (a state and a letter): the next state, i.e. the longest ending that a token starts
        with, and the tokens that end here as (length, id), longest first."""
        if len(self.steps) > 100_000:
            self._forget()
        at = key
        while at and at not in self.starts:
            at = at[1:]
        ends = tuple((len(at) - i, self.ids[at[i:]]) for i in range(len(at)) if at[i:] in self.ids)
        self.steps[key] = at, ends
        return at, ends

    def _reachable(self, i: int) -> bool:
        return self.rank[i] >= 0 and self._ends_with_merge(self.left[i], self.right[i], self.rank[i])

    def _ends_with_merge(self, a: int, b: int, limit: int) -> bool:
        """Whether merging a and b side by side reaches their own merge first of all across the seam."""
        # Undo the last merge inside a or b, again and again: no merge across the seam may come before it.
        while True:
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.right[a]
            else:
                before, b = rb + 1, self.left[b]
            across = self.pair_rank.get(a << 20 | b)
            if across is not None and across < min(before, limit):
                return False

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay as they are."""
        key = a << 20 | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 100_000:
                self.fits.clear()
            ok = self.fits[key] = key not in self.pair_rank and self._ends_with_merge(a, b, len(self.pair_rank))
        return ok

    def __call__(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as little-endian 32-bit integers."""
        letters, fits, compatible, step = self.letters, self.fits, self.compatible, self._step
        spelled = []
        for i, w in enumerate(words):
            s = w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode("utf-8")])
            spelled.append((s[:-1] + chr(ord(s[-1]) + END), i))
        spelled.sort()
        out: list[bytes] = [b""] * len(words)
        path = ""
        last, length, seen = [-1], [0], [""]  # at each depth: the last token, its length, the state
        for s, at in spelled:
            depth, most = 0, min(len(path), len(s))
            while depth < most and path[depth] == s[depth]:
                depth += 1
            del last[depth + 1:], length[depth + 1:], seen[depth + 1:]
            state = seen[depth]
            steps = self.steps
            for end in range(depth + 1, len(s) + 1):
                key = state + s[end - 1]
                state, ends = steps.get(key) or step(key)
                for n, token in ends:
                    if n == end:
                        break
                    pair = last[end - n] << 20 | token
                    ok = fits.get(pair)
                    if ok or ok is None and compatible(pair >> 20, token):
                        break
                last.append(token)
                length.append(n)
                seen.append(state)
            path, end, found = s, len(s), []
            while end:
                found.append(last[end])
                end -= length[end]
            found.reverse()
            out[at] = array("I", found).tobytes()
        return out


# Fixed value: parts of texts whose ids a task remembers.
KNOWN_PARTS = 400_000


@lru_cache(maxsize=2)
def _part_ids(path: str, most: int = KNOWN_PARTS) -> PartIds:
    return PartIds(splitter(path), TrieEncoder(path), most)


def _encode(path: str, most: int = KNOWN_PARTS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _part_ids(path, most)
        for b in batches:
            at = 0
            for texts in slices(b.column("text"), 2 << 20, 2048):
                offsets, ids = encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), ids], names=["doc_id", "ids"])
                at += len(texts)
        encode.trim()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the whole text's token ids, without added begin or end tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidy(_encode(path)), f"doc_id {kind}, ids array<int>")


@lru_cache(maxsize=2)
def _tokens(path: str) -> pa.Array:
    """Each id's token; null where the vocabulary has none."""
    spec = json.load(open(path, encoding="utf-8"))
    of = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([of.get(i) for i in range(max(of) + 1)], pa.string())


def decoded_texts(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids: this tokenizer file has no decoder, so tokens are joined by spaces."""
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    values = values[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    known = (values >= 0) & (values < len(tokens))
    known[known] = tokens.is_valid().to_numpy(zero_copy_only=False)[values[known]]
    if not known.all():
        offsets = np.r_[0, np.cumsum(known)][offsets]
        values = values[known]
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens.take(pa.array(values, pa.int64())))
    return pc.binary_join(lists, " ")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                texts = decoded_texts(_tokens(path), part.column("ids"))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*b.schema.names, "decoded"])

    return run


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = KNOWN_PARTS) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ``encode`` and ``decode`` in one pass of the texts; a task remembers the ids
    of about ``most`` parts of texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    both = lambda batches: _decode(path)(_encode(path, most)(batches))
    return rows.mapInArrow(tidy(both), f"doc_id {kind}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) plus ``decoded``, the text of the ids, special tokens included."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidy(_decode(path)), f"doc_id {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, decoded)."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
