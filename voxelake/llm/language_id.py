"""Language identification of code-switched text by a linear-chain conditional random field.

Words are labelled with languages: a word's potentials are the summed weights of its affixes, character
n-grams and, if learned, its lexicon entry; learned transitions tie neighbours; forward-backward gives each
word's marginals.  The words of a text are one chain, however long it is: chains are cut into blocks of BLOCK words that
run side by side, and a block's messages from the left and from the right are carried over by products of
transition matrices, so the result is that of the whole chain and memory stays bounded by the piece.  A text's language
is the one with the highest mean marginal over its words (its score); runs of words with one label are returned as well.

The fit uses at most TRAIN_ROWS texts with a known lang, about as many of each (of the MOST_LANGS most frequent),
with at most TRAIN_BYTES in all for each lang, never a held-out one; every word gets its text's lang, the fit reads windows of BLOCK words,
and windows spliced from two texts teach the transitions switching.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is every text if no lang
could be learned; ties go to the first lang in order; repeated rows are each labelled; of an id with several texts one is
learned from; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RESULT, byte_table, held_out, map_texts, per_text, training_texts, utf8
from .subwords import Words, features, words_of

TRAIN_ROWS = 2000
TRAIN_BYTES = 3 << 18
MOST_LANGS = 64
BLOCK = 32
GRAMS = (2, 3)
AFFIXES = (2, 3, 4)
BUCKETS = 1 << 16
EPOCHS = 30
LEXICON_LEAST, LEXICON_SHARE = 3, 0.9
LETTERS = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_ASCII_LETTERS = byte_table((0x41, 0x5A), (0x61, 0x7A))
_letter = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (buckets, langs)
    lexicon: np.ndarray  # sorted hashes of words
    entries: np.ndarray  # (len(lexicon) + 1, langs); the last row is of no word
    transition: np.ndarray
    start: np.ndarray


def potentials(w: Words, m: Model) -> np.ndarray:
    """(distinct words, langs)"""
    of, bucket = features(w, GRAMS, BUCKETS, AFFIXES, whole=False)
    n = np.maximum(np.bincount(of, minlength=w.n_kinds), 1)
    out = np.stack([np.bincount(of, m.weight[bucket, k], w.n_kinds) for k in range(len(m.langs))], 1) / np.sqrt(n)[:, None]
    return out + m.entries[lexicon_at(w.hashes, m.lexicon)]


def lexicon_at(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, len(lexicon))


def blocks_of(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each block of a text's chain."""
    n = np.bincount(text, minlength=n_texts)
    first = np.cumsum(n) - n
    count = -(-n // BLOCK)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(first, count) + nth * BLOCK
    return start, np.minimum(BLOCK, np.repeat(first + n, count) - start)


def forward_backward(score: np.ndarray, length: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False, left: np.ndarray | None = None, right: np.ndarray | None = None):
    """score: (chains, T, langs) log potentials.  Marginals, and the summed marginals of neighbouring pairs.  left: what
    stands for `start` of each chain, right: the message to its last word; both not as logarithms."""
    n, t_max, k = score.shape
    e = np.exp(score - score.max(2, keepdims=True))
    a_exp = np.exp(transition - transition.max())
    alpha = np.empty_like(e)
    alpha[:, 0] = (np.exp(start - start.max()) if left is None else left) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, t_max):
        x = (alpha[:, t - 1] @ a_exp) * e[:, t]
        x /= x.sum(1, keepdims=True)
        alpha[:, t] = np.where((t < length)[:, None], x, alpha[:, t - 1])
    marginal = np.empty_like(e)
    beta = np.full((n, k), 1.0 / k, e.dtype) if right is None else right.copy()
    expected = np.zeros((k, k))
    for t in range(t_max - 1, -1, -1):
        x = alpha[:, t] * beta
        marginal[:, t] = x / x.sum(1, keepdims=True)
        if t:
            live = t < length
            onward = e[:, t] * beta
            if pairs:
                joint = alpha[live, t - 1][:, :, None] * a_exp * onward[live][:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            x = onward @ a_exp.T
            beta = np.where(live[:, None], x / x.sum(1, keepdims=True), beta)
    return marginal, expected


def messages(score: np.ndarray, length: np.ndarray, text: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks (text: of each, in order), what comes in from the left and from the right, by the product of each
    block's transitions and potentials.  One step for each place of a block in its text, all texts side by side."""
    n, t_max, k = score.shape
    e = np.exp(score - score.max(2, keepdims=True))
    a_exp = np.exp(transition - transition.max())
    left = np.empty((n, k), e.dtype)
    right = np.full((n, k), 1.0 / k, e.dtype)
    head = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    count = np.diff(np.append(head, n))
    left[head] = np.exp(start - start.max())
    many = head[count > 1]
    if not len(many):
        return left, right
    across = np.repeat(count > 1, count)
    own = np.flatnonzero(across)
    product = np.zeros((len(own), k, k), e.dtype)
    product[:, np.arange(k), np.arange(k)] = e[own, 0]
    for t in range(1, t_max):
        x = (product @ a_exp) * e[own, t][:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        product = np.where((t < length[own])[:, None, None], x, product)
    at = np.zeros(n, np.int64)
    at[own] = np.arange(len(own))
    left_of = np.sort(count[count > 1])[::-1]
    order = many[np.argsort(-count[count > 1], kind="stable")]  # most blocks first, so that who goes on is a prefix
    for step in range(1, int(left_of[0])):
        now = order[: np.searchsorted(-left_of, -step)]
        x = np.einsum("ij,ijl->il", left[now + step - 1], product[at[now + step - 1]]) @ a_exp
        left[now + step] = x / x.sum(1, keepdims=True)
    last = order + left_of - 1
    for step in range(1, int(left_of[0])):
        now = last[: np.searchsorted(-left_of, -step)]
        x = np.einsum("ijl,il->ij", product[at[now - step + 1]], right[now - step + 1]) @ a_exp.T
        right[now - step] = x / x.sum(1, keepdims=True)
    return left, right


def padded(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t_max = int(length.max(initial=1))
    at = start[:, None] + np.arange(t_max)
    inside = np.arange(t_max) < length[:, None]
    return np.where(inside, at, 0), inside


def fit(data: np.ndarray, off: np.ndarray, lang: list[str], epochs: int = EPOCHS, seed: int = 9) -> Model | None:
    langs = sorted(set(lang))
    if not langs:
        return None
    k = len(langs)
    label = np.searchsorted(np.array(langs), np.array(lang))
    w = words_of(data, off, LETTERS)
    y = label[w.text]
    seen = np.stack([np.bincount(w.kind[y == j], minlength=w.n_kinds) for j in range(k)], 1) if len(y) else np.zeros((0, k))
    total = seen.sum(1)
    known = (total >= LEXICON_LEAST) & (seen.max(1, initial=0) >= LEXICON_SHARE * total)
    lexicon = w.hashes[known]
    m = Model(langs, np.zeros((BUCKETS, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)), np.zeros(k))
    start, length = blocks_of(w.text, len(lang))
    if k == 1 or not len(start):
        return m
    at, inside = padded(w.kind, start, length)
    kind, truth = w.kind[at], y[at]
    # every fifth chain takes its second half from another chain
    rng = np.random.default_rng(seed)
    mixed = np.arange(0, len(start), 5)
    other = rng.integers(0, len(start), len(mixed))
    half = at.shape[1] // 2
    kind[mixed, half:], truth[mixed, half:], inside[mixed, half:] = kind[other, half:], truth[other, half:], inside[other, half:]
    inside[mixed, :half] |= (inside[mixed, half:].any(1))[:, None]
    length = inside.sum(1)
    of, bucket = features(w, GRAMS, BUCKETS, AFFIXES, whole=False)
    norm = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=w.n_kinds), 1))
    entry = lexicon_at(w.hashes, lexicon)
    # rare langs count as much as frequent ones
    share = np.bincount(truth[inside], minlength=k) / inside.sum()
    word_weight = np.where(inside, (1 / np.maximum(share, 1e-9) / k)[truth], 0) / inside.sum()
    one_hot = np.eye(k)[truth]
    params = [m.weight, m.entries, m.transition, m.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    pair_ok = inside[:, 1:]
    observed = np.bincount((truth[:, :-1] * k + truth[:, 1:])[pair_ok], minlength=k * k).reshape(k, k)
    for epoch in range(1, epochs + 1):
        scores = potentials(w, m)[kind]
        marginal, expected = forward_backward(scores, length, m.transition, m.start, pairs=True)
        d = (one_hot - marginal) * word_weight[:, :, None]
        d_kind = np.stack([np.bincount(kind.ravel(), d[:, :, j].ravel(), w.n_kinds) for j in range(k)], 1)
        spread = d_kind * norm[:, None]
        grads = [
            np.stack([np.bincount(bucket, spread[of, j], BUCKETS) for j in range(k)], 1) - 1e-7 * m.weight,
            np.stack([np.bincount(entry, d_kind[:, j], len(lexicon) + 1) for j in range(k)], 1) - 1e-7 * m.entries,
            (observed - expected) / inside.sum(),
            d[:, 0].sum(0),
        ]
        grads[1][-1] = 0
        for p, g, (m1, m2) in zip(params, grads, moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p += 0.1 * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.999**epoch)) + 1e-9)
    return m


def label_words(w: Words, n_texts: int, m: Model) -> np.ndarray:
    """(words, langs): each word's marginals in its text's chain."""
    first, length = blocks_of(w.text, n_texts)
    if not len(first):
        return np.zeros((0, len(m.langs)), np.float32)
    at, inside = padded(w.kind, first, length)
    scores = potentials(w, m).astype(np.float32)[w.kind[at]]
    transition, start = m.transition.astype(np.float32), m.start.astype(np.float32)
    left, right = messages(scores, length, w.text[first], transition, start)
    marginal, _ = forward_backward(scores, length, transition, start, left=left, right=right)
    return marginal[inside]


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("label")).where(F.col("label").isNotNull() & ~held_out())
    ids = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    # the k-th least of a lang's hashes is about k / n, so hash times n takes about as many ids of each
    share = ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LANGS)
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 11).cast("double") * F.col("n")
    ids = ids.join(F.broadcast(share), "label").orderBy(order, "doc_id").limit(rows).select("doc_id")
    # at most `rows` ids: a proven bound
    table = training_texts(known.join(F.broadcast(ids), "doc_id"), TRAIN_BYTES)
    data, off = utf8(table["text"])
    return fit(data, off, table["label"].to_pylist())


FIELDS = "lang_pred: string, score: double, run_ends: array<int>, run_langs: array<string>"


def annotate(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and a struct RESULT: lang_pred, score, and the runs of words with one label (the word behind
    each run's last, and its lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        langs = None if m is None else pa.array(m.langs, pa.string())

        def work(data, off):
            n_texts = len(off) - 1
            some = per_text(_ASCII_LETTERS[data], off) > 0
            for i in np.flatnonzero(~some & (per_text(data >= 0x80, off) > 0)):
                some[i] = bool(_letter.search(data[off[i] : off[i + 1]].tobytes().decode()))
            if m is None:
                none = np.zeros(n_texts + 1, np.int32)
                return [pa.array([UNKNOWN] * n_texts, pa.string()), np.zeros(n_texts), pa.ListArray.from_arrays(pa.array(none), pa.array([], pa.int32())), pa.ListArray.from_arrays(pa.array(none), pa.array([], pa.string()))]
            w = words_of(data, off, LETTERS)
            marginal = label_words(w, n_texts, m)
            count = np.bincount(w.text, minlength=n_texts)
            n = np.maximum(count, 1)
            mean = np.stack([np.bincount(w.text, marginal[:, j], n_texts) for j in range(len(m.langs))], 1) / n[:, None]
            best = mean.argmax(1)
            names = [m.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
            label = marginal.argmax(1)
            head = np.ones(len(label), bool)
            head[1:] = (label[1:] != label[:-1]) | (w.text[1:] != w.text[:-1])
            run = np.flatnonzero(head)
            ends = np.append(run[1:], len(label))[: len(run)] - (np.cumsum(count) - count)[w.text[run]]
            edges = np.zeros(n_texts + 1, np.int32)
            np.cumsum(np.bincount(w.text[run], minlength=n_texts), out=edges[1:])
            runs = [pa.ListArray.from_arrays(pa.array(edges), x) for x in (pa.array(ends.astype(np.int32)), langs.take(pa.array(label[run])))]
            return [pa.array(names, pa.string()), np.where(some, np.clip(mean[np.arange(n_texts), best], 0, 1), 0.0), *runs]

        return work

    return map_texts(docs, FIELDS, make, keep)


def report(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return annotate(d, train(d)).select("doc_id", held_out().alias("held_out"), f"{RESULT}.lang_pred", f"{RESULT}.score")
