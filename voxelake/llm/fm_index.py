"""A bidirectional FM-index of word ids for patterns of at most four words.

The text is a sequence of ids with 0 between pieces.  Suffixes are ordered by their first DEPTH words (equal ones by position),
which is as deep as backward search has to be right for patterns of DEPTH words.  Of both the sequence and its mirror image the
index keeps the Burrows-Wheeler transform and the map LF(i) = C[bwt[i]] + Occ(bwt[i], i); a pattern is an interval in each.
A step to the left takes the symbols of the transform in the interval, counts them, finds the new interval by LF, and the
mirrored one by how many smaller symbols were there; a step to the right is the same with both exchanged.  Steps are made for
all intervals at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import ranges

DEPTH = 4


@dataclass
class Phrases:
    """Patterns (a row of ids each) with their intervals in the index and in its mirror image; sizes are their counts."""

    words: np.ndarray
    low: np.ndarray
    mirrored: np.ndarray
    size: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.low[keep], self.mirrored[keep], self.size[keep])


def _order(seq: np.ndarray) -> np.ndarray:
    """Positions by their first four symbols, round the end."""
    key = seq * (seq.max() + 1) + np.roll(seq, -1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    key[1:] = np.cumsum(key[1:] != key[:-1])
    key[0] = 0
    rank = np.empty(len(seq), np.int64)
    rank[order] = key
    del order, key
    return np.argsort(rank * (rank.max() + 1) + np.roll(rank, -2), kind="stable")


class _Side:
    def __init__(self, seq: np.ndarray):
        self.bwt = seq[_order(seq) - 1].astype(np.int32)
        self.lf = np.empty(len(seq), np.int32)
        self.lf[np.argsort(self.bwt, kind="stable")] = np.arange(len(seq), dtype=np.int32)


class Index:
    """seq: ids from 1, 0 at both ends and between pieces."""

    def __init__(self, seq: np.ndarray):
        seq = seq.astype(np.int64)
        self.sigma = int(seq.max()) + 1
        self.counts = np.bincount(seq, minlength=self.sigma)
        self.forward, self.backward = _Side(seq), _Side(seq[::-1])

    def single(self) -> Phrases:
        before = np.cumsum(self.counts) - self.counts
        ids = np.arange(1, self.sigma)
        return Phrases(ids[:, None], before[1:], before[1:], self.counts[1:])

    def _step(self, side: _Side, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        """Of every interval and each symbol (but 0) beside it: interval, symbol, new interval, new one on the other side, count."""
        at = ranges(low, size)
        owner = np.repeat(np.arange(len(low)), size)
        key = owner * self.sigma + side.bwt[at]
        del owner
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(key)))
        own, symbol = np.divmod(key[edge], self.sigma)
        smaller = edge - (np.cumsum(size) - size)[own]
        new = side.lf[at[order[edge]]].astype(np.int64)
        kept = symbol > 0
        return own[kept], symbol[kept], new[kept], (other[own] + smaller)[kept], count[kept]

    def left(self, p: Phrases) -> Phrases:
        """Every word before each phrase, as longer phrases."""
        own, word, low, mirrored, size = self._step(self.forward, p.low, p.mirrored, p.size)
        return Phrases(np.column_stack([word, p.words[own]]), low, mirrored, size)

    def right(self, p: Phrases) -> Phrases:
        own, word, mirrored, low, size = self._step(self.backward, p.mirrored, p.low, p.size)
        return Phrases(np.column_stack([p.words[own], word]), low, mirrored, size)
