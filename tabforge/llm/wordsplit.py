"""Splitting texts into the words that a tokenizer with word ends encodes one by one.

Texts made of common Latin characters take a short way through ``str.lower``
and one regular expression; all other texts go through the tokenizer file's
own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# Fixed value: the tokenizer file's split pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Characters that neither composition nor Unicode versions nor notions of white space treat differently.
PLAIN = re.compile(r"[\t\n\r -~¡-įı-ɏ]*")

# Marks of parts that the plain way can't yield.
OTHER, ADDED = "\0", "\1"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Splitter:
    """Words of a text by the rules of the tokenizer file at ``path``."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.at_special = re.compile(f"({found})") if found else None
        self.path = path
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        pre = spec["pre_tokenizer"]["pretokenizers"][0]
        self.short = pre["pattern"].get("Regex") == WORDS.pattern and [
            n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]

    @cached_property
    def whole(self) -> Tokenizer:
        """The library's tokenizer, read once it is needed."""
        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bool:
        """Whether the text's parts are its runs between white space, in lower case."""
        return self.short and "<|" not in text and PLAIN.fullmatch(text) is not None

    def parts(self, text: str) -> list[str]:
        """The parts of any other text: words marked by OTHER, and strings of added tokens marked by ADDED."""
        cut = self.at_special.split(text) if self.at_special else [text]
        return [w for i, part in enumerate(cut) for w in ([ADDED + part] if i % 2 else self._words(part))]

    def _words(self, text: str) -> list[str]:
        pieces = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text)) if text else []
        return [OTHER + bytes(map(self.byte_of.__getitem__, p)).decode("utf-8") for p, _ in pieces]

    def words(self, part: str) -> list[str]:
        """The words of a part; no word goes across white space."""
        return [part[1:]] if part[0] == OTHER else WORDS.findall(part)


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class PartIds:
    """Ids of texts; the ids of parts are remembered (up to a number of them) as little-endian 32-bit integers.

    ``encode`` gets a list of distinct words and returns the ids of each as bytes.
    """

    def __init__(self, split: Splitter, encode: Callable[[list[str]], list[bytes]], most: int = 400_000):
        self.split, self.encode, self.most = split, encode, most
        self.known: dict[str, bytes] = {}
        self.last: list[str] = []
        self.added = {ADDED + t: i.to_bytes(4, "little") for t, i in split.special.items()} | {"": b""}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]."""
        collects = gc.isenabled()
        gc.disable()  # millions of live strings and no cycles: collections would only walk through them
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        is_plain = [not t or self.split.plain(t) for t in texts]
        lower = pa.array([(t or "").lower() for t, p in zip(texts, is_plain, strict=True) if p], pa.string())
        lists = pc.ascii_split_whitespace(lower)
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        places, bounds = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes = np.diff(bounds).astype(np.int64)
        if not all(is_plain):  # put the others' parts in between
            at: dict[str, int] = {}
            own = iter(np.split(places, bounds[1:-1]))
            each = [next(own) if p else np.array([at.setdefault(w, len(names) + len(at)) for w in self.split.parts(t)], np.int64)
                    for t, p in zip(texts, is_plain, strict=True)]
            names += at
            places, sizes = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        if len(self.known) > self.most:
            self.trim()
        self.known |= self.added
        data = list(map(self.known.get, names))
        if new := [p for p, d in zip(names, data, strict=True) if d is None]:
            fresh = iter(self._learn(new))
            data = [next(fresh) if d is None else d for d in data]
        self.last = names
        ids = np.frombuffer(b"".join(data), "<u4")
        counts = np.fromiter(map(len, data), np.int64, len(data)) // 4
        # the ids of each part in turn
        n = counts[places]
        ends = np.cumsum(n)
        first = (np.cumsum(counts) - counts)[places]
        ids = ids[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return np.r_[0, ends][np.r_[0, np.cumsum(sizes)]], ids

    def trim(self) -> None:
        """Forget what the last texts did not use: a worker that waits for its next task holds little."""
        self.known = {p: self.known[p] for p in self.last if p in self.known}

    def _learn(self, new: list[str]) -> list[bytes]:
        # a run of ASCII letters is one word by the pattern
        split = [[p] if p.isascii() and p.isalpha() else self.split.words(p) for p in new]
        words = list(set().union(*split))
        of = dict(zip(words, self.encode(words), strict=True))
        data = [of[w[0]] if len(w) == 1 else b"".join([of[x] for x in w]) for w in split]
        # a long run without breaks is not worth keeping
        self.known.update((p, d) for p, d in zip(new, data, strict=True) if len(p) <= 256)
        return data
