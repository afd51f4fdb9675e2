"""Depth-limited bidirectional FM-index over word ids.

A text is a sequence of ids from 1 with 0 for a break, which no phrase
crosses.  Its rotations are sorted by their first ``DEPTH`` ids, forwards and
backwards; the index keeps the id before each rotation (the two transforms).
Sorting that far is enough for phrases of up to ``DEPTH`` ids: the rotations
that start with a phrase are an interval, and a step to the left,
``C[c] + rank_c(i)``, is one binary search in the sorted pairs (id, place).

A state holds, for many phrases at once, the interval's begin in both
transforms and its size, which they share.  ``extend`` lists all ids on one
side of each interval with their counts, and moves both begins: the searched
side by a step, the other by the number of smaller ids in the interval.

An index has at most ``MOST`` ids, so that three of them fit into a long and
the rotations are sorted as plain integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

DEPTH = 4
BITS = 21
MOST = 1 << BITS


@dataclass
class State:
    """Phrases of equal length with their intervals."""

    words: np.ndarray  # one row a phrase
    left: np.ndarray  # begin among the rotations of the text
    right: np.ndarray  # begin among the rotations of the reversed text
    size: np.ndarray

    def take(self, which: np.ndarray) -> State:
        return State(self.words[which], self.left[which], self.right[which], self.size[which])


def transform(ids: np.ndarray) -> np.ndarray:
    """The id before each rotation, rotations sorted by their first ``DEPTH`` ids."""
    n = len(ids)
    if n > MOST:
        raise ValueError(f"{n} ids; an index has at most {MOST}")
    places = np.arange(n, dtype=np.int64)
    rank = ids.astype(np.int64)
    for step in (1, 2):  # ranks of pairs, then of pairs of pairs
        keys = (rank << 2 * BITS) | (np.roll(rank, -step) << BITS) | places
        keys.sort()
        order = keys & (MOST - 1)
        keys >>= BITS
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        rank = new
    return ids[order - 1].astype(np.int32)


class Index:
    """Both transforms of a text; ``sides`` are built when they are first searched."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bwt = {"left": left, "right": right}
        self.starts = np.r_[0, np.cumsum(np.bincount(left))].astype(np.int64)
        self._pairs: dict[str, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> Index:
        return cls(transform(ids), transform(ids[::-1]))

    def pack(self) -> bytes:
        both = np.concatenate([self.bwt["left"], self.bwt["right"]]).astype("<i4")
        # the four bytes of the ids apart: the upper ones are nearly constant
        return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        both = np.ascontiguousarray(flat.reshape(4, -1).T).view("<i4").ravel()
        return cls(both[:len(both) // 2], both[len(both) // 2:])

    def words(self, ids: np.ndarray) -> State:
        """The phrases of one word each."""
        begin = self.starts[ids]
        return State(ids[:, None], begin, begin.copy(), self.starts[ids + 1] - begin)

    def _step(self, side: str, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """C[c] + rank_c(place) for each pair."""
        if side not in self._pairs:
            bwt = self.bwt[side]
            pairs = (bwt.astype(np.int64) << BITS) | np.arange(len(bwt))
            pairs.sort()
            self._pairs[side] = pairs
        return np.searchsorted(self._pairs[side], (ids << BITS) | places)

    def extend(self, state: State, side: str, wanted=None) -> State:
        """Each phrase with each id that stands beside it on one side, breaks left out.

        ``wanted(phrase numbers, ids)`` says which of them to keep; it is asked about distinct pairs.
        """
        own, other = (state.left, state.right) if side == "left" else (state.right, state.left)
        places = np.repeat(own - np.r_[0, np.cumsum(state.size)[:-1]], state.size) + np.arange(state.size.sum())
        keys = np.repeat(np.arange(len(own), dtype=np.int64), state.size) << BITS | self.bwt[side][places]
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(keys)])
        which, ids = keys[first] >> BITS, keys[first] & (MOST - 1)
        keep = ids > 0
        if wanted is not None:
            keep[keep] = wanted(which[keep], ids[keep])
        smaller = first - np.r_[0, np.cumsum(state.size)][which]  # ids below this one in its interval
        which, ids, size, smaller = which[keep], ids[keep], size[keep], smaller[keep]
        moved = self._step(side, ids, own[which])
        shifted = other[which] + smaller
        words = state.words[which]
        if side == "left":
            return State(np.c_[ids, words], moved, shifted, size)
        return State(np.c_[words, ids], shifted, moved, size)
