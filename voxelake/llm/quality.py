"""Quality rules: document statistics, fixed base rules and gradient-boosted trees.

The statistics are vectorised over the bytes of a piece of whole documents.  The trees are fitted on at
most TRAIN_ROWS labelled documents (`labels.quality`), with the score constrained to fall with the share of
symbols, repeated words and duplicate lines; flat node arrays score every row.  They are fitted whenever both
labels are there; a leaf has 20 documents at least, or an eighth of fewer than 160.

Edge cases: null and empty texts have no words and fail the base rules; labels that are null, conflicting
or not 0/1 are not learned from; without both labels only the base rules decide; repeated rows are each judged;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import RESULT, byte_prefix, byte_table, labelled_sample, map_texts, mix, per_text, prefix_sums, spans, token_spans

TRAIN_ROWS = 20_000
REPEAT_WINDOW = 8
LEAST_WORDS = 20
SPACES = byte_table((0x20, 0x20), (0x09, 0x0D))
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: (feature, monotonic constraint)
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", 0),
    ("digit_share", 0), ("punct_share", 0), ("bang_share", 0), ("distinct_share", 0), ("words_per_line", 0), ("non_ascii_share", 0), ("symbol_word_share", -1),
)
_UPPER, _DIGIT = byte_table((0x41, 0x5A)), byte_table((0x30, 0x39))
_PUNCT = byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _again(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, whether its (group, key) occurs more than once, and whether it isn't the first such."""
    order = np.argsort(keys ^ mix(groups.astype(np.uint64) + np.uint64(1)), kind="stable")
    k, g = keys[order], groups[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The BASE counts, and the FEATURES matrix, of each text."""
    n = len(off) - 1
    inside = ~SPACES
    start, end, text = token_spans(data, off, inside)
    n_words = np.bincount(text, minlength=n)
    here = inside[data]
    points = per_text(here & ((data & 0xC0) != 0x80), off)
    symbols = SYMBOLS[data]
    n_symbols = per_text(symbols, off)
    prefix = byte_prefix(data)
    cuts = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate((off[:-1], cuts + 1)))
    le = np.sort(np.concatenate((cuts, off[1:])))
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(here, out=filled[1:])
    spoken = filled[le] > filled[ls]
    ls, le = ls[spoken], le[spoken]
    of = np.searchsorted(off, ls, "right") - 1
    n_lines = np.bincount(of, minlength=n)
    _, later = _again(spans(prefix, ls, le), of)
    n_dup = np.bincount(of[later], minlength=n)
    words = spans(prefix, start, end)
    _, seen = _again(words, text)
    distinct = n_words - np.bincount(text[seen], minlength=n)
    w = REPEAT_WINDOW
    at = np.flatnonzero(text[w - 1 :] == text[: len(text) - w + 1]) if len(text) >= w else np.zeros(0, np.int64)
    twice, _ = _again(spans(prefix_sums(words), at, at + w), text[at])
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + w, -1)
    covered = np.cumsum(cover)[:-1] > 0
    n_repeat = np.bincount(text[covered], minlength=n)
    marked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbols, out=marked[1:])
    with_symbol = np.bincount(text[marked[end] > marked[start]], minlength=n)
    size, some = np.maximum(off[1:] - off[:-1], 1), np.maximum(n_words, 1)
    x = np.stack(
        [
            np.log1p(n_words), points / some, n_symbols / size, n_dup / np.maximum(n_lines, 1), n_repeat / some, per_text(_UPPER[data], off) / size,
            per_text(_DIGIT[data], off) / size, per_text(_PUNCT[data], off) / size, per_text(data == 33, off) / size, distinct / some,
            n_words / np.maximum(n_lines, 1), per_text(data >= 0x80, off) / size, with_symbol / some,
        ],
        1,
    )
    return [n_words, points, n_symbols, n_dup, n_repeat], x


def _features():
    names = [f for f, _ in FEATURES]

    def work(data, off):
        _, x = statistics(data, off)
        return [x[:, i] for i in range(len(names))]

    return work


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> trees.Forest | None:
    sample = labelled_sample(docs, labels, "quality", rows, 8)
    # at most `rows` ids and labels: a proven bound
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    # of an id with several texts one, found before the shuffle already
    picked = picked.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("m")).select("doc_id", "m.label", "m.text")
    fields = ", ".join(f"{f}: double" for f, _ in FEATURES)
    found = map_texts(picked, fields, _features, ["doc_id", "label"]).select("doc_id", "label", f"{RESULT}.*").toPandas().sort_values("doc_id", kind="stable")
    y = found["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    x = found[[f for f, _ in FEATURES]].to_numpy(float)
    return trees.fit(x, y, np.array([m for _, m in FEATURES]), least=max(1, min(20, len(y) // 8)))


FIELDS = ", ".join(f"{b}: bigint" for b in BASE) + ", base_failed: boolean, kept: boolean, score: double"


def annotate(docs: DataFrame, forest: trees.Forest | None, keep: list[str] | None = None) -> DataFrame:
    def make():
        def work(data, off):
            base, x = statistics(data, off)
            n_words, n_repeat = base[0], base[4]
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > 30 * n_words)
            score = forest.probability(x) if forest is not None else np.ones(len(x))
            return [*base, failed, ~failed & (score >= 0.5), score]

        return work

    return map_texts(docs, FIELDS, make, keep)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [*BASE, "base_failed", "kept", "score"]
    return annotate(d, train(docs, labels)).select("doc_id", *[F.col(f"{RESULT}.{c}").alias(c) for c in names])
