"""Distinct words of a piece of texts and their hashed character n-grams, vectorised over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import LOWER, byte_prefix, mix, ranges, spans, token_spans


#: Bytes whose words are hashed at once.
PIECE = 1 << 20


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters from U+00C0 to U+00DE."""
    out = LOWER[data]
    if len(out) > 1:
        second = out[1:]
        up = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        second[up] += 32
    return out


@dataclass
class Words:
    """`kind` of each word (an index into the distinct words), its text; distinct words framed by < and >."""

    kind: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    framed: np.ndarray
    off: np.ndarray

    @property
    def n_kinds(self) -> int:
        return len(self.hashes)


def words_of(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> Words:
    """Words are runs of bytes for which `inside` is true.  More than PIECE bytes are read in pieces of whole texts, so that the hashing
    needs little memory besides the words."""
    if len(data) > PIECE and len(off) > 2:
        return _joined(data, off, inside)
    start, end, text = token_spans(data, off, inside)
    low = fold(data)
    hashes, first, kind = np.unique(spans(byte_prefix(low), start, end), return_index=True, return_inverse=True)
    s, size = start[first], end[first] - start[first]
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size + 2, out=at[1:])
    framed = np.full(at[-1], ord("<"), np.uint8)
    framed[ranges(at[:-1] + 1, size)] = low[ranges(s, size)]
    framed[at[1:] - 1] = ord(">")
    return Words(kind.ravel(), text, hashes, framed, at)


def _joined(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> Words:
    parts, lo = [], 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, "right")) - 1)
        w = words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], inside)
        parts.append(Words(w.kind.astype(np.int32), (w.text + lo).astype(np.int32), w.hashes, w.framed, w.off))
        lo = hi
    hashes, first, kind = np.unique(np.concatenate([w.hashes for w in parts]), return_index=True, return_inverse=True)
    kind = kind.ravel()
    before = np.cumsum([0, *(len(w.hashes) for w in parts)])
    sizes = np.concatenate([np.diff(w.off) for w in parts])[first]
    starts = np.concatenate([w.off[:-1] + b for w, b in zip(parts, np.cumsum([0, *(len(w.framed) for w in parts)]))])[first]
    at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    framed = np.concatenate([w.framed for w in parts])[ranges(starts, sizes)]
    kinds = np.concatenate([kind[b + w.kind] for w, b in zip(parts, before)])
    return Words(kinds.astype(np.int32), np.concatenate([w.text for w in parts]), hashes, framed, at)


def features(w: Words, grams: tuple[int, ...], buckets: int, affixes: tuple[int, ...] = (), whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, bucket) pairs in no particular order, as 32-bit integers."""
    prefix = byte_prefix(w.framed)
    size = w.off[1:] - w.off[:-1]
    n = w.n_kinds
    of, bucket = [], []

    def put(word, start, length, salt):
        of.append(word.astype(np.int32))
        key = spans(prefix, start, start + length) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        bucket.append((mix(key) % np.uint64(buckets)).astype(np.int32))

    everyone = np.arange(n)
    if whole:
        put(everyone, w.off[:-1], size, 1)
    for g in grams:
        count = np.maximum(size - g + 1, 0)
        put(np.repeat(everyone, count), ranges(w.off[:-1], count), g, 2)
    for a in affixes:
        long = np.flatnonzero(size > a)
        put(long, w.off[:-1][long], a, 3)
        put(long, w.off[1:][long] - a, a, 4)
    return np.concatenate(of), np.concatenate(bucket)
