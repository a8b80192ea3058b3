"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of the word and of its character n-grams, so an unseen
misspelling shares most of its vector with the word it comes from.  A window is WINDOW consecutive words;
its averaged vector goes through a linear softmax, and a text's score is its most toxic window's (every
window of the whole text is looked at: one sentence in a long text counts).  Embeddings and softmax are
trained jointly in numpy by Adam, first with all windows of a toxic text as positive, then with the one
that scores highest.  The fit uses at most TRAIN_ROWS labelled texts of each label, chosen by a hash, with at most TRAIN_BYTES
in all for each label, long texts among them, and never a held-out one; of an id with several texts it takes one; ids, lang and source are no inputs.

Edge cases: null and empty texts are one empty window (the prior of the softmax, never predicted toxic);
null, conflicting or other labels are not learned from; without both labels every score is 0; repeated
rows are each scored; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RESULT, held_out, labelled_sample, map_texts, named, training_texts, utf8
from .decontaminate import WORD_BYTES
from .subwords import Words, features, words_of

TRAIN_ROWS = 1500
TRAIN_BYTES = 4 << 20
WINDOW = 3
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 8
EPOCHS = 80


@dataclass
class Model:
    """What scoring needs: the embeddings times the softmax's weights, and the bias."""

    weight: np.ndarray
    bias: float


def word_scores(w: Words, model: Model) -> np.ndarray:
    of, bucket = features(w, GRAMS, BUCKETS)
    n = np.bincount(of, minlength=w.n_kinds)
    return np.bincount(of, model.weight[bucket], w.n_kinds) / np.maximum(n, 1)


def text_margins(w: Words, n_texts: int, model: Model) -> np.ndarray:
    """Of each text, the highest margin of its windows."""
    total = np.zeros(len(w.kind) + 1)
    if len(w.kind):
        np.cumsum(word_scores(w, model)[w.kind], out=total[1:])
    n = np.bincount(w.text, minlength=n_texts)
    first = np.cumsum(n) - n
    out = np.zeros(n_texts)
    short = (n > 0) & (n <= WINDOW)
    out[short] = (total[first + n] - total[first])[short] / n[short]
    long = np.flatnonzero(n > WINDOW)
    if len(long):
        sums = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
        # windows that reach into the next text are left out by where each text's slice ends
        edges = np.stack((first[long], first[long] + n[long] - WINDOW + 1), 1).ravel()
        out[long] = np.maximum.reduceat(np.append(sums, -np.inf), edges)[::2]
    return out + model.bias


def fit(data: np.ndarray, off: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> Model | None:
    if len(toxic) < 2 or toxic.min() == toxic.max():
        return None
    w = words_of(data, off, WORD_BYTES)
    of, bucket = features(w, GRAMS, BUCKETS)
    n_sub = np.maximum(np.bincount(of, minlength=w.n_kinds), 1)
    # windows of half a window's step, so that each toxic word is whole in one
    n = np.bincount(w.text, minlength=len(toxic))
    first = np.cumsum(n) - n
    step = WINDOW // 2
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // step) + 1)
    text = np.repeat(np.arange(len(toxic), dtype=np.int32), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    a = (first[text] + np.minimum(nth * step, np.maximum(n[text] - WINDOW, 0))).astype(np.int32)
    b = np.minimum(a + WINDOW, first[text] + n[text]).astype(np.int32)
    size = np.maximum(b - a, 1).astype(np.float32)
    y = toxic[text].astype(np.float32)
    del nth
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out = rng.normal(0, 0.3, WIDTH)
    bias = 0.0
    moments = [[np.zeros_like(emb), np.zeros(BUCKETS), 0], [np.zeros(WIDTH), np.zeros(WIDTH)], [0.0, 0.0]]
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))
    for epoch in range(1, epochs + 1):
        score = np.bincount(of, (emb @ out)[bucket], w.n_kinds) / n_sub
        total = np.concatenate(([0.0], np.cumsum(score[w.kind])))
        z = (total[b] - total[a]).astype(np.float32) / size + np.float32(bias)
        use = np.ones(len(z), np.float32)
        if epoch > epochs // 4:  # of a toxic text, only the highest window
            top = np.maximum.reduceat(z, starts)
            use[(y == 1) & (z < top[text])] = 0
            hard = (y == 0) & (z >= top[text])  # the highest windows of the others count half of their weight
        else:
            hard = y == 0
        weight = np.where(y == 1, use / max(1.0, use[y == 1].sum()), 0.5 / max(1, (y == 0).sum()) + 0.5 * hard / max(1, hard.sum()))
        d = (y - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) * weight
        per_word = np.bincount(a, d / size, len(w.kind) + 1) - np.bincount(b, d / size, len(w.kind) + 1)
        per_kind = np.bincount(w.kind, np.cumsum(per_word)[:-1], w.n_kinds) / n_sub
        c = np.bincount(bucket, per_kind[of], BUCKETS)  # the gradient of a bucket is c times `out`
        g_emb, g_out, g_bias = np.outer(c, out) - 1e-7 * emb, emb.T @ c, d.sum()
        fix1, fix2 = 1 - 0.9**epoch, 1 - 0.999**epoch
        m = moments[0]
        m[0] = 0.9 * m[0] + 0.1 * g_emb
        m[1] = 0.999 * m[1] + 0.001 * (g_emb**2).mean(1)
        emb += 0.1 * (m[0] / fix1) / (np.sqrt(m[1] / fix2)[:, None] + 1e-8)
        m = moments[1]
        m[0], m[1] = 0.9 * m[0] + 0.1 * g_out, 0.999 * m[1] + 0.001 * g_out**2
        out += 0.1 * (m[0] / fix1) / (np.sqrt(m[1] / fix2) + 1e-8)
        m = moments[2]
        m[0], m[1] = 0.9 * m[0] + 0.1 * g_bias, 0.999 * m[1] + 0.001 * g_bias**2
        bias += 0.1 * (m[0] / fix1) / (np.sqrt(m[1] / fix2) + 1e-8)
    model = Model(emb @ out, float(bias))
    # the threshold that parts the learned texts best, in the middle of the gap, becomes the margin 0
    z = text_margins(w, len(toxic), model)
    order = np.argsort(z)
    wrong = np.concatenate(([0], np.cumsum(toxic[order] == 1))) / max(1, (toxic == 1).sum()) + ((toxic == 0).sum() - np.concatenate(([0], np.cumsum(toxic[order] == 0)))) / max(1, (toxic == 0).sum())
    best = np.flatnonzero(wrong == wrong.min())
    low, high = best[0], best[-1]
    cut = (z[order[max(low - 1, 0)]] + z[order[min(high, len(z) - 1)]]) / 2
    return Model(model.weight, float(min(model.bias - cut, -1e-3)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    learned = labels.where(~held_out())
    sample = labelled_sample(docs, learned, "toxic", rows, 4, per_value=True)
    # at most 2 * rows ids and labels: a proven bound
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    table = training_texts(picked, TRAIN_BYTES)
    data, off = utf8(table["text"])
    return fit(data, off, table["label"].to_numpy().astype(int))


FIELDS = "score: double, predicted: int"


def annotate(docs: DataFrame, model: Model | None, keep: list[str] | None = None, raw: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(data, off):
            if m is None:
                score = np.zeros(len(off) - 1)
            else:
                score = 1 / (1 + np.exp(-np.clip(text_margins(words_of(data, off, WORD_BYTES), len(off) - 1, m), -700, 700)))
            return [score, (score >= 0.5).astype(np.int32)]

        return work

    return map_texts(docs, FIELDS, make, keep, raw=raw)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return annotate(d, train(docs, labels)).select("doc_id", held_out().alias("held_out"), f"{RESULT}.score", f"{RESULT}.predicted")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that aren't predicted toxic."""
    return named(annotate(docs, train(docs, labels), docs.columns, raw=True).where(F.col(f"{RESULT}.predicted") == 0), docs.columns)
