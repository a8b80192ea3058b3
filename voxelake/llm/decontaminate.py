"""Benchmark decontamination with word-level suffix arrays of the training texts.

Each task sorts the word suffixes of a bounded shard of whole documents (DEPTH words deep) into a suffix
array and binary-searches the benchmark's window starts in it, as deep as the window is long: the interval's
entries are the locations, from which matches are extended word by word.  A window is 10 consecutive words of an item (a shorter item is one window); document words inside any occurrence of a
window are hit, and documents with a hit word are removed.  `longest_matches` searches every suffix of every item, the last words
too, and gives each one's longest verbatim match in the documents, whatever its length, with the places.

The benchmark travels to the tasks only in slices of about SLICE_BYTES of distinct items (one longer item is a slice of its
own).  The driver holds one slice at a time: it is broadcast, matched with all documents and freed before the next one is
read; each slice adds to the hits of the rows so far, which a table in the shared folder keeps between slices.
Documents are never shuffled.

Edge cases: A-Z are lower-cased; null and empty texts have no words and no hit; items without words
have no window; words of an item with a null id are hit, but it is not among the items that are listed and
counted (the SQL counts all of them as one); equal items all count; repeated documents are each judged; with an empty
benchmark nothing is hit; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TABLE, LOWER, RESULT, byte_prefix, byte_table, chunks, map_texts, named, persisted, ranges, small_batches, spans, token_spans, utf8

WINDOW = 10
DEPTH = 12
SLICE_BYTES = 16 << 20
SHARD_BYTES = 3 << 20
WORD_BYTES = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FIELDS = "n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, longest: bigint, runs: array<int>, items: array<string>"
_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd hashes of the lower-cased words and the text each is in."""
    start, end, text = token_spans(data, off, WORD_BYTES)
    return spans(byte_prefix(data, _TABLE[LOWER]), start, end) | np.uint64(1), text


class SuffixArray:
    """Suffixes of a word sequence, ordered by their first `depth` words (by rank of the word's hash)."""

    def __init__(self, words: np.ndarray, depth: int = DEPTH):
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        n = len(words)
        self.rank = np.zeros(n + depth + 64, np.int64)
        self.rank[:n] = rank
        bits = max(1, int(len(self.vocabulary)).bit_length())
        m = max(1, min(63 // bits, depth))
        key = self.rank[: n + depth].copy()
        for j in range(1, m):
            key = (key << bits) | self.rank[j : n + depth + j]
        sa = np.argsort(key[:n])
        ordered = key[:n][sa]
        same = np.zeros(n, bool)  # equal to the next so far
        same[:-1] = ordered[1:] == ordered[:-1]
        done = m
        while done < depth:
            tied = same.copy()
            tied[1:] |= same[:-1]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            fresh = np.ones(len(at), bool)
            fresh[1:] = ~same[at[1:] - 1]
            group = np.cumsum(fresh)
            more = key[np.minimum(sa[at] + done, n + depth - 1)]
            order = np.lexsort((more, group))
            sa[at] = sa[at][order]
            more = more[order]
            same[at[:-1]] = (group[1:] == group[:-1]) & (more[1:] == more[:-1])
            same[at[-1]] = False
            done += m
        self.sa = sa
        self.first = np.zeros(len(self.vocabulary) + 1, np.int64)
        np.cumsum(np.bincount(rank, minlength=len(self.vocabulary)), out=self.first[1:])

    def _bound(self, lo, hi, word, depth, upper):
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            seen = self.rank[self.sa[mid] + depth]
            right = seen <= word[live] if upper else seen < word[live]
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
            live = live[lo[live] < hi[live]]
        return lo

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Interval [lo, hi) of the suffixes that begin with words[start : start + length], and how many of
        those words (the first up to `length`) occur verbatim."""
        if not len(self.vocabulary):
            z = np.zeros(len(start), np.int64)
            return z, z.copy(), z.copy()
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        rank = np.where(self.vocabulary[at] == words, at, -1)
        w = rank[start]
        lo, hi = np.where(w >= 0, self.first[w], 0), np.where(w >= 0, self.first[w + 1], 0)
        longest = (hi > lo).astype(np.int64)
        for depth in range(1, int(length.max(initial=1))):
            live = np.flatnonzero((length > depth) & (hi > lo))
            if not len(live):
                break
            w = rank[start[live] + depth]
            a = self._bound(lo[live], hi[live], w, depth, False)
            b = self._bound(a, hi[live], w, depth, True)
            lo[live], hi[live] = a, b
            longest[live] += b > a
        return lo, hi, longest


class Windows:
    """The benchmark's words and the suffixes to search: window starts with their lengths and items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.ids = [None if i is None else str(i) for i, _ in items]
        col = pa.array([t or "" for _, t in items], pa.string())
        data, off = utf8(col)
        self.words, item = word_hashes(data, off)
        n = np.bincount(item, minlength=len(items)) if len(item) else np.zeros(len(items), np.int64)
        first = np.cumsum(n) - n
        count = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
        self.start = ranges(first, count)
        self.item = np.repeat(np.arange(len(items)), count)
        self.length = np.minimum(window, n[self.item]) if len(items) else np.zeros(0, np.int64)


def _matcher(shared):
    """shared: a broadcast of Windows."""

    def make():
        test = shared.value

        def work(data, off):
            n_texts = len(off) - 1
            hashes, text = word_hashes(data, off)
            n_words = np.bincount(text, minlength=n_texts)
            # a 0 after each text keeps matches inside texts
            place = np.arange(len(hashes)) + text
            words = np.zeros(len(hashes) + n_texts, np.uint64)
            words[place] = hashes
            owner = np.repeat(np.arange(n_texts), n_words + 1)
            first = np.cumsum(n_words + 1) - (n_words + 1)
            hit = np.zeros(len(words) + 1, np.int64)
            pairs = np.zeros(0, np.int64)
            longest = np.zeros(n_texts, np.int64)
            if len(test.start) and len(hashes):
                array = SuffixArray(words, max(DEPTH, int(test.length.max())))
                lo, hi, _ = array.search(test.words, test.start, test.length)
                count = hi - lo
                where = array.sa[ranges(lo, count)]
                which = np.repeat(np.arange(len(lo)), count)
                size = test.length[which]
                hit += np.bincount(where, minlength=len(hit)) - np.bincount(where + size, minlength=len(hit))
                pairs = np.unique(owner[where] * len(test.ids) + test.item[which])
                if len(where):
                    np.maximum.at(longest, owner[where], extend(words, where, test, which))
            inside = np.cumsum(hit)[:-1] > 0
            total = np.zeros(len(words) + 1, np.int64)
            np.cumsum(inside, out=total[1:])
            n_hit = total[first + n_words] - total[first]
            items: list[list[str]] = [[] for _ in range(n_texts)]
            for p in pairs:
                if (name := test.ids[p % len(test.ids)]) is not None:
                    items[p // len(test.ids)].append(name)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
            runs: list[list[int]] = [[] for _ in range(n_texts)]
            for a, b in zip(edges[::2], edges[1::2]):
                runs[owner[a]] += [int(a - first[owner[a]]), int(b - first[owner[a]])]
            items = [sorted(set(x)) for x in items]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else _NO_ITEMS for x in items]
            return [n_words, n_hit, np.array([len(x) for x in items], np.int64), pa.array(digest, pa.string()), n_hit > 0, longest, pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

        return work

    return make


def extend(words: np.ndarray, where: np.ndarray, test: Windows, which: np.ndarray) -> np.ndarray:
    """Length in words of the verbatim match that starts at each location and goes on as far as the item does."""
    size = test.length[which].copy()
    end = np.append(test.start[1:], 0)
    last = np.zeros(len(test.ids), np.int64)
    np.maximum.at(last, test.item, test.start + test.length)
    left = last[test.item[which]]
    live = np.arange(len(where))
    while len(live):
        a, b = where[live] + size[live], test.start[which[live]] + size[live]
        ok = (a < len(words)) & (b < left[live])
        live, a, b = live[ok], a[ok], b[ok]
        ok = words[a] == test.words[b]
        live = live[ok]
        size[live] += 1
    return size


def _longest(words: np.ndarray, array: SuffixArray, test: Windows, start: np.ndarray, end: np.ndarray, order: np.ndarray):
    """Of each suffix (start to end of test.words): its longest match in `words`, how many places have it, and the least `order` of
    these places."""
    depth = np.minimum(end - start, DEPTH)
    lo, hi, length = array.search(test.words, start, depth)
    # the search narrows to nothing where a word more doesn't follow: back to the depth that did
    short = np.flatnonzero((length > 0) & (hi <= lo))
    if len(short):
        lo[short], hi[short], _ = array.search(test.words, start[short], length[short])
    count = np.where(length > 0, hi - lo, 0)
    which, where = np.repeat(np.arange(len(start)), count), array.sa[ranges(lo, count)]
    size = length[which]
    live = np.flatnonzero((size == DEPTH) & (start[which] + size < end[which]))
    while len(live):
        a, b = where[live] + size[live], start[which[live]] + size[live]
        live = live[words[np.minimum(a, len(words) - 1)] == test.words[b]]
        size[live] += 1
        live = live[start[which[live]] + size[live] < end[which[live]]]
    best = np.zeros(len(start), np.int64)
    np.maximum.at(best, which, size)
    top = size == best[which]
    n = np.bincount(which[top], minlength=len(start))
    first = np.full(len(start), np.iinfo(np.int64).max)
    np.minimum.at(first, which[top], order[where[top]])
    return best, n, first


def longest_matches(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE_BYTES) -> DataFrame:
    """item_id, at (the suffix's first word in its item, from 0), n_words (of the suffix), longest (in words; 0: its first word
    is nowhere), n_places, doc_id and place (the first of those with the longest match by doc_id, null first, and word).  Each
    shard of documents searches all suffixes; shards' findings are reduced by suffix, so places are counted, never gathered.
    Equal items are one; an item of several texts has suffixes of each; null doc_ids count as one document."""
    items, n = benchmark_slices(benchmark, limit)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") > 0)
    schema = "item_id string, at long, n_words long, item long, longest long, n_places long, doc_id long, place long"
    parts = []
    for i in range(n):
        own = items.where(F.col("slice") == i).select("item_id", "text", "h")
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()])

        def search(batches, shared=shared):
            held = sorted(shared.value, key=str)
            test = Windows([r[:2] for r in held])
            _, item = word_hashes(*utf8(pa.array([r[1] or "" for r in held], pa.string())))
            size = np.bincount(item, minlength=len(held)) if len(item) else np.zeros(len(held), np.int64)
            first = np.cumsum(size) - size
            start, end = np.arange(len(item)), (first + size)[item] if len(item) else np.zeros(0, np.int64)
            names = pa.array([r[0] for r in held], pa.string())
            keys = np.array([r[2] for r in held], np.int64)
            for batch in batches:
                for a, b, data, off in chunks(batch.column(1), SHARD_BYTES):
                    hashes, text = word_hashes(data, off)
                    if not len(hashes) or not len(start):
                        continue
                    words = np.zeros(len(hashes) + len(off) - 1, np.uint64)
                    words[np.arange(len(hashes)) + text] = hashes
                    n_words = np.bincount(text, minlength=len(off) - 1)
                    ids = batch.column(0).slice(a, b - a)
                    known = pc.unique(ids).sort(null_placement="at_start")
                    rank = pc.index_in(ids, known).to_numpy().astype(np.int64)
                    width = int(n_words.max()) + 1
                    order = np.repeat(rank * width, n_words + 1) + ranges(np.zeros(len(n_words), np.int64), n_words + 1)
                    best, places, at = _longest(words, SuffixArray(words, DEPTH), test, start, end, order)
                    got = np.flatnonzero(best)
                    columns = [names.take(pa.array(item[got])), pa.array(start[got] - first[item[got]]), pa.array((end - start)[got]), pa.array(keys[item[got]]), pa.array(best[got]), pa.array(places[got]), known.take(pa.array(at[got] // width)), pa.array(at[got] % width)]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

        found = rows.mapInArrow(search, schema)
        key = ["item", "item_id", "at", "n_words"]
        # the longest of each shard first, then how many places have the longest of all
        lengths = found.groupBy(*key, "longest").agg(F.sum("n_places").alias("n_places"), F.min(F.struct("doc_id", "place")).alias("p"))
        best = lengths.groupBy(*key).agg(F.max(F.struct("longest", "n_places", "p")).alias("b"))
        parts.append(persisted(best.select(*key, "b.longest", "b.n_places", "b.p.doc_id", "b.p.place"), "longest"))
        shared.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    words = items.select(F.col("h").alias("item"), "item_id", F.regexp_count("text", F.lit(WORD)).alias("n"))
    every = words.where("n > 0").select("item", "item_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"), "n").select("item", "item_id", F.col("at").cast("long").alias("at"), (F.col("n") - F.col("at")).cast("long").alias("n_words"))
    met = every.join(out.drop("item_id", "n_words"), ["item", "at"], "left")
    return met.select("item_id", "at", "n_words", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("longest", "n_places")], "doc_id", "place")


def benchmark_slices(benchmark: DataFrame, limit: int = SLICE_BYTES) -> tuple[DataFrame, int]:
    """Distinct items (item_id, text, slice) and the number of slices."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = persisted(items.withColumn("h", F.xxhash64("item_id", "text")), "items")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // limit))
    return items.withColumn("slice", F.pmod("h", F.lit(n))), n


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, limit: int = SLICE_BYTES, raw: bool = False) -> DataFrame:
    """The kept columns and a struct RESULT: n_words, n_hit, n_items, items_sha256, contaminated, longest
    (longest verbatim match of a whole window or more, in words; 0 without one), runs of hit words (start, end, ...), items."""
    keep = ["doc_id"] if keep is None else keep
    items, n = benchmark_slices(benchmark, limit)

    def sent(i):
        return docs.sparkSession.sparkContext.broadcast(Windows([(r.item_id, r.text) for r in items.where(F.col("slice") == i).select("item_id", "text").toLocalIterator()]))

    if n == 1:
        return map_texts(docs, FIELDS, _matcher(sent(0)), keep, SHARD_BYTES, raw)
    names = [f"k{i}" for i in range(len(keep))]
    now = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.col("text"), F.lit(None).cast(f"struct<{_ddl()}>").alias("so_far"))
    for i in range(n):
        test = sent(i)
        step = map_texts(now, FIELDS, _matcher(test), [*names, "text", "so_far"], SHARD_BYTES)
        now = persisted(step.select(*names, "text", merged("so_far", RESULT).alias("so_far")), "matched")
        test.destroy()
    return now.select(*[F.col(n).alias(n if raw else k) for n, k in zip(names, keep)], F.col("so_far").alias(RESULT))


def _ddl() -> str:
    return FIELDS


def merged(a: str, b: str):
    """Both slices' findings together; runs of hit words are counted as one union."""
    ends = F.sort_array(F.flatten(F.transform(F.array(F.col(f"{a}.runs"), F.col(f"{b}.runs")), lambda r: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(r), 1) - 1), lambda i: F.struct(F.get(r, 2 * i).alias("s"), F.get(r, 2 * i + 1).alias("e"))))))
    both = F.filter(ends, lambda x: x["s"].isNotNull())
    joined = F.aggregate(
        both,
        F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= x["s"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["e"])))).otherwise(F.concat(acc, F.array(x["s"], x["e"]))),
    )
    n_hit = F.aggregate(F.transform(joined, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    items = F.array_sort(F.array_union(F.col(f"{a}.items"), F.col(f"{b}.items")))
    new = F.struct(
        F.col(f"{b}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.greatest(F.col(f"{a}.longest"), F.col(f"{b}.longest")).alias("longest"), joined.alias("runs"), items.alias("items"),
    )
    return F.when(F.col(a).isNull(), F.col(b)).otherwise(new)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that hold no benchmark window."""
    return named(annotate(docs, benchmark, docs.columns, raw=True).where(~F.col(f"{RESULT}.contaminated")), docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return annotate(d, benchmark).select("doc_id", *[f"{RESULT}.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (SELECT doc_id, item_id, dw.i, dw.n FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
