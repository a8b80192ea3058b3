"""Frequent phrases of two to four words in each language, with how much more often their words meet than stand apart.

Texts are lower-cased (A-Z), cut at `[.,;:!?` and line ends`]` into pieces, these at blanks and tabs into words.  Tasks gather
texts of one language into shards of SHARD_BYTES, each an FM-index over word ids (`fm_index`), whose intervals are
extended by words on the left and on the right down to four words.  Counts are summed over shards.

A phrase can only be frequent where its words and its pairs of neighbours are.  So words are summed first and rare ones
become gaps between pieces; pairs are summed under 64-bit hashes, and longer phrases are extended only through frequent pairs.
Frequent words and pairs go to all tasks as a table of bits, two for each hash, which is never longer than HELD_ROWS * KEY_BITS
bits, however many they are.  Bits of others, or equal hashes, keep a word or pair that could have gone and lose none; what is
counted in the end are phrases by their text.

score: the cut after k words with the least floor(SCALE * a / (l + r)), l and r being the counts of both parts, in decimals of
38 digits.  A phrase goes if one with one word more on the left or right, itself frequent, is there COVERED percent as often;
longer ones than by one word needn't be looked at, as what they hold between is at least as frequent.

Edge cases: null and empty texts have no words; a null lang is `und`, together with rows that say so; repeated rows count each
time; ties of scores go by count, then by the phrase's bytes; an empty table has no rows; other columns are
ignored, whatever their names; a text of any length is in one shard as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_prefix, byte_table, mix, persisted, small_batches, spans, token_spans, utf8
from .fm_index import DEPTH, Index

SHARD_BYTES = 2 << 20
#: Texts that wait in a task for their shards to fill, over all languages.
WAITING_BYTES = 4 * SHARD_BYTES
#: The table of frequent words or pairs that goes to every task has so many bits for each, up to so many of them (16 MB); with
#: more it stays as long, and more that are rare go on to be counted (one in ten at 25 million).
KEY_BITS, HELD_ROWS = 32, 1 << 22
#: Rows that go back to Spark at once.
OUT_ROWS = 1 << 14
LEAST, COVERED, SCALE, TOP = 30, 80, 2_000_000, 2000
_BREAK = byte_table((10, 13), *[(ord(c), ord(c)) for c in ".,;:!?"])
_INSIDE = ~(_BREAK | byte_table((32, 32), (9, 9)))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PART = 4096  # bytes of a bitmap that Spark makes
_SHARD = "lang string, words array<string>, counts array<bigint>, tokens binary"
#: Shards are rows of megabytes: the writer has to look at its memory often.
_WRITE = {"compression": "zstd", "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.block.size": 16 << 20}


def _id_type(words: int) -> type:
    """Of the places in a shard's vocabulary, as they are stored."""
    return np.uint16 if words < 1 << 16 else np.int32


def tokens(col) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as a dictionary, and their places in it from 1 on, with 0 at both ends and between pieces."""
    data, off = utf8(col)
    low = LOWER[data]
    start, end, text = token_spans(low, off, _INSIDE)
    if not len(start):
        return pa.array([], pa.string()), np.zeros(1, np.int32)
    breaks = np.cumsum(_BREAK[low], dtype=np.int32)[start]
    new = np.ones(len(start), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(low[_INSIDE[low]])).dictionary_encode()
    seq = np.zeros(len(start) + int(new.sum()) + 1, np.int32)
    seq[np.arange(len(start)) + np.cumsum(new)] = words.indices.to_numpy() + 1
    return words.dictionary.cast(pa.string()), seq


def shards(docs: DataFrame) -> DataFrame:
    """lang, words, counts (of each word), tokens: texts of one language, put together in the task that reads them."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")).where(F.octet_length("text") > 0)

    def made(lang, parts):
        vocabulary, seq = tokens(pa.chunked_array(parts))
        if not len(vocabulary):
            return
        counts = np.bincount(seq, minlength=len(vocabulary) + 1)[1:]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), v) for v in (vocabulary, pa.array(counts.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays([pa.array([lang]), *lists, pa.array([seq.astype(_id_type(len(vocabulary))).tobytes()], pa.binary())], ["lang", "words", "counts", "tokens"])

    def run(batches):
        waiting: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                waiting.setdefault(lang, []).append(texts)
                size[lang] = size.get(lang, 0) + int(pc.sum(pc.binary_length(texts)).as_py())
            while size and (max(size.values()) >= SHARD_BYTES or sum(size.values()) >= WAITING_BYTES):
                lang = max(size, key=size.get)
                yield from made(lang, waiting.pop(lang))
                size.pop(lang)
        for lang, parts in waiting.items():
            yield from made(lang, parts)

    return persisted(rows.mapInArrow(run, _SHARD), "shards", **_WRITE)


def _hashes(words: pa.Array) -> np.ndarray:
    data, off = utf8(words)
    return spans(byte_prefix(data), off[:-1], off[1:])


def _word_keys(lang: str, hashed: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word of a language."""
    return mix(hashed * _ODD + _hashes(pa.array([lang]))[0]).view(np.int64)


def _pair_keys(lang: str, hashed: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair of words in a language."""
    return mix((hashed[pairs[:, 0]] * _ODD + hashed[pairs[:, 1]]) * _ODD + _hashes(pa.array([lang]))[0]).view(np.int64)


class Held:
    """A table of bits for the keys of a frame, sent to every task."""

    def __init__(self, keys: DataFrame):
        self.bits = KEY_BITS * (1 << (max(1, min(keys.count(), HELD_ROWS)) - 1).bit_length())
        places = keys.select(F.explode(F.array(*[F.expr(f"({k} & {self.bits - 1}L) + 1") for k in ("key", "shiftrightunsigned(key, 32)")])).alias("place"))
        # dealt before they are put together, as a part of each task's own would be nearly as long as the whole
        dealt = places.select(F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").alias("bit")).repartition("part")
        table = np.zeros(max(self.bits // 8, _PART), np.uint8)
        for part, made in dealt.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
            table[(part - 1) * _PART : part * _PART] = np.frombuffer(made, np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(table)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the frame, and for few others."""
        table, keys, found = self.sent.value, keys.view(np.uint64), True
        for place in (keys, keys >> np.uint64(32)):
            place = (place & np.uint64(self.bits - 1)).astype(np.int64)
            found = found & (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _keys_of_words(words: DataFrame) -> DataFrame:
    """key of each (lang, word)."""

    def run(batches):
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.column(1).filter(pc.equal(batch.column(0), lang))
                yield pa.RecordBatch.from_arrays([pa.array(_word_keys(lang, _hashes(own)))], ["key"])

    return words.select("lang", "word").mapInArrow(run, "key long")


def _index(vocabulary: pa.Array, seq: np.ndarray, keep: np.ndarray) -> tuple[pa.Array, Index | None]:
    """The kept words of a shard and the index of its text, where others are gaps."""
    new = np.zeros(len(vocabulary) + 1, np.int32)
    new[1:][keep] = np.arange(1, int(keep.sum()) + 1)
    seq = new[seq]
    gap = (seq == 0) & (np.roll(seq, 1) == 0)  # of several gaps one stays
    gap[0] = False
    seq = seq[~gap]
    return vocabulary.filter(pa.array(keep)), Index(seq) if keep.any() else None


def _each(pieces: DataFrame, schema: str, words: Held, make) -> DataFrame:
    """make(lang, words, their hashes from 1 on, index) -> record batches, of every shard."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, own = batch.column(0)[i].as_py(), batch.column(1)[i].values
                hashed = _hashes(own)
                keep = words.has(_word_keys(lang, hashed))
                seq = np.frombuffer(batch.column(2)[i].as_buffer(), _id_type(len(own)))
                vocabulary, index = _index(own, seq, keep)
                if index is not None:
                    for made in make(lang, vocabulary, np.concatenate([np.zeros(1, np.uint64), hashed[keep]]), index):
                        for lo in range(0, made.num_rows, OUT_ROWS):
                            yield made.slice(lo, OUT_ROWS)
                del index
                pa.default_memory_pool().release_unused()

    return pieces.select("lang", "words", "tokens").mapInArrow(run, schema)


def _pairs(pieces: DataFrame, words: Held) -> DataFrame:
    """key, n of the pairs of neighbours in each shard."""

    def make(lang, vocabulary, hashed, index):
        p = index.left(index.single())
        yield pa.RecordBatch.from_arrays([pa.array(_pair_keys(lang, hashed, p.words)), pa.array(p.size)], ["key", "n"])

    return _each(pieces, "key long, n long", words, make)


def _longer(pieces: DataFrame, words: Held, pairs: Held) -> DataFrame:
    """lang, phrase, n of phrases of two words and more whose pairs are all held, in each shard."""

    def known(code, table):
        if not len(table):
            return np.zeros(len(code), bool)
        return table[np.minimum(np.searchsorted(table, code), len(table) - 1)] == code

    def make(lang, vocabulary, hashed, index):
        now = index.left(index.single())
        now = now.where(pairs.has(_pair_keys(lang, hashed, now.words)))
        good = np.sort(now.words[:, 0] * index.sigma + now.words[:, 1])
        while len(now.size):
            texts = pc.binary_join_element_wise(*[vocabulary.take(pa.array(now.words[:, k] - 1)) for k in range(now.words.shape[1])], " ")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(now.size), pa.string()), texts, pa.array(now.size)], ["lang", "phrase", "n"])
            n = now.words.shape[1]
            if n == DEPTH:
                return
            # to both sides by turns
            now = index.right(now) if n % 2 == 0 else index.left(now)
            met = now.words[:, -2:] if n % 2 == 0 else now.words[:, :2]
            now = now.where(known(met[:, 0] * index.sigma + met[:, 1], good))

    return _each(pieces, "lang string, phrase string, n long", words, make)


def counted(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, a) of the phrases of two words and more that occur `least` times."""
    pieces = shards(docs)
    own_words = pieces.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("w")).select("lang", "w.word", "w.n")
    words = persisted(own_words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    frequent = Held(_keys_of_words(words.where(F.col("n") >= least)))
    pairs = Held(persisted(_pairs(pieces, frequent).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), "pairs"))
    phrases = _longer(pieces, frequent, pairs).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return words, persisted(phrases, "phrases")


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, k, score, left_most, right_most of all phrases: the cut with the least score, and how often the most
    frequent phrase with one word more on that side occurs (null: none that is frequent)."""
    split = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice("ws", first, n), " ")
    wide = phrases.withColumn("ws", split)
    cuts = wide.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"), "ws")
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("part")))).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    met = sides.join(known, ["lang", "part"]).repartition("lang", "phrase").groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr(f"(cast(a as decimal(31,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)").cast("long")
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    more = wide.where(F.size("ws") > 2)
    sub = more.select("lang", F.explode(F.array(F.struct(part(F.lit(2), F.size("ws")).alias("phrase"), F.col("a").alias("left_most"), F.lit(None).cast("long").alias("right_most")), F.struct(part(F.lit(1), F.size("ws") - 1).alias("phrase"), F.lit(None).cast("long").alias("left_most"), F.col("a").alias("right_most")))).alias("e")).select("lang", "e.*")
    longest = sub.groupBy("lang", "phrase").agg(F.max("left_most").alias("left_most"), F.max("right_most").alias("right_most"))
    return best.join(longest, ["lang", "phrase"], "left")


def report(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first phrases by score."""
    words, phrases = counted(docs, least)
    covered = F.coalesce(F.greatest("left_most", "right_most").cast("decimal(31,0)") * 100 >= F.col("a").cast("decimal(31,0)") * COVERED, F.lit(False))
    left = scored(words, phrases).where(~covered)
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _sql_grams() -> str:
    return " UNION ALL ".join(f"SELECT lang, {k} AS m, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})".replace("- -1", "+ 1") for k in range(1, DEPTH + 1))


ORACLE_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-
]')) AS piece FROM d)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM ({_sql_grams()}) GROUP BY ALL HAVING m = 1 OR count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, (2000000::HUGEINT * k.a // (x.a + y.a))::BIGINT AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = p1 JOIN f y ON y.lang = k.lang AND y.phrase = p2),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, array_to_string(ws[i:j], ' ') AS sub FROM (SELECT *, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM c WHERE m > 2)) WHERE j - i < m - 1) GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN e ON e.lang = b.lang AND e.sub = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < {COVERED}::HUGEINT * a),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q) JOIN n USING (lang) WHERE rank <= {TOP}"""
