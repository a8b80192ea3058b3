"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts earlier.

Texts are UTF-8 bytes; earlier is a smaller doc_id (null last; of one id, a smaller text hash), or an earlier
start in the same document; matches never cross documents.  All LENGTH-byte windows of all documents are judged, without shuffling them:

1.  Each window is assigned to its anchor, the leftmost ANCHOR-byte string in it of the least hash, so
    equal windows have equal anchors at equal places.  The windows of one occurrence of an anchor are a run;
    its context is all bytes of its windows.  Copies of a context within a piece of the scan are combined at
    once (all but the first repeat as a whole); what is left, about one row for 40 bytes, is dealt out and sorted.
    An anchor sends one row of a piece to its own task, further contexts of it in the piece go by their context,
    so no anchor gathers more than one row of each piece.
2.  Sorted rows are read with one row of memory.  An occurrence whose context stood earlier repeats as a whole;
    the first ones of anchors with several contexts go on.
3.  Of these, each context gives at most BLOCKS rows: any window of it holds the anchor and BLOCKS - 1 blocks of
    BLOCK bytes beside it, its core.  Rows are dealt by core, a core with many rows by a salt as well, and never
    more than about GROUP_ROWS of them are compared at once.  A row is written as the bytes before the core, one
    symbol for the core, and the bytes behind it; a suffix array of these, by linear grouping (suffix_group), brings equal
    windows together, and all but the first repeat.  Firsts of a salted core meet once more, one row for each
    window and salt.
4.  The runs of repeated windows of each document are joined with its text.

Every step treats all anchors, contexts and cores alike; salts split a core by its size and lose no window.

Hashes (of anchors, contexts and cores) have 64 bits.  Edge cases: a null or empty text has nothing to remove; rows with equal doc_id and text
are one document and get equal results; rows with one doc_id and different texts are documents of their own;
null doc_ids sort last, and each such row is a document of its own: of equal texts the row whose other columns
have the least hash is first, the others repeat it; an empty table gives an empty result; other columns are
kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RESULT, byte_prefix, chunks, mix, persisted, prefix_sums, ranges, small_batches, spans, utf8
from .suffix_group import suffix_array

LENGTH = 100
ANCHOR = 32
REACH = LENGTH - ANCHOR + 1
BLOCK = 17
BLOCKS = 4
CORE = LENGTH - BLOCK
#: Rows of one core that are compared at once; a core with more is split by salts.
GROUP_ROWS = 4096
SCAN_BYTES = 1 << 19
#: Symbols of one suffix array.
ARRAY_SYMBOLS = 1 << 17
#: Cores with salts that are broadcast; more are joined by key.
SALTED_LIST = 100_000
SPAN, LONE, SEVERAL = 0, 1, 2
_LAST = (1 << 63) - 1


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over x[i : i + w] for every i with a whole window."""
    out, s = x, 1
    while s * 2 <= w:
        out = best(out[:-s], out[s:])
        s *= 2
    return best(out[: len(out) - (w - s)], out[w - s :]) if w > s else out


def _minima(data: np.ndarray, off: np.ndarray):
    """Prefix sums, anchor hashes, window minima (0 where no window starts) and which places are anchors."""
    n = len(data)
    prefix = byte_prefix(data)
    at = np.arange(n - ANCHOR + 1)
    hashes = spans(prefix, at, at + ANCHOR) | np.uint64(1)
    low = _slide(hashes, REACH, np.minimum)
    starts = np.zeros(len(low) + 1, np.int32)
    size = off[1:] - off[:-1]
    long = np.flatnonzero(size >= LENGTH)
    starts[off[:-1][long]] += 1
    starts[off[1:][long] - LENGTH + 1] -= 1
    valid = np.cumsum(starts[:-1]) > 0
    low = np.where(valid, low, np.uint64(0))
    padded = np.zeros(len(hashes) + REACH - 1, np.uint64)
    padded[REACH - 1 : REACH - 1 + len(low)] = low
    anchor = _slide(padded, REACH, np.maximum) == hashes
    return prefix, hashes, low, valid, anchor


def occurrences(data: np.ndarray, off: np.ndarray):
    """Of every anchor occurrence: hash, context hash, text number, first window, place, last window."""
    if len(data) < LENGTH or (off[1:] - off[:-1]).max() < LENGTH:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e, e, e
    prefix, hashes, low, valid, anchor = _minima(data, off)
    places = np.flatnonzero(anchor)
    count = np.zeros(len(anchor) + 1, np.int64)
    np.cumsum(anchor, out=count[1:])
    window = np.flatnonzero(valid)
    own = count[window]  # the first anchor at or after the window's start
    want = low[window]
    value = hashes[places]
    wrong = np.flatnonzero(value[own] != want)
    while len(wrong):
        own[wrong] += 1
        wrong = wrong[value[own[wrong]] != want[wrong]]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    head = np.flatnonzero(fresh)
    first, last = window[head], window[np.append(head[1:], len(window)) - 1]
    place = places[own[head]]
    text = np.searchsorted(off, first, "right") - 1
    context = mix(spans(prefix, first, last + LENGTH) ^ ((place - first) * REACH + last - first).astype(np.uint64))
    return value[own[head]], context, text, first, place, last


def _documents(docs: DataFrame) -> DataFrame:
    """doc (null: last), text_hash, text (null: empty); doc and text_hash name a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each entry equals the one before in all columns."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _leads(again: np.ndarray) -> np.ndarray:
    """For each entry, where its run of entries that equal the one before begins."""
    return np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))


def combined(h: np.ndarray, c: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, pack: np.ndarray):
    """Of one piece's occurrences: those to send, what each is dealt by, whether its anchor has several contexts
    here, and those that repeat as a whole."""
    key = mix(c ^ mix(h))
    order = np.lexsort((pack, text_hash, doc, key))
    again = _same(key[order])
    lead = order[_leads(again)]
    # repeated rows are one document
    twin = (doc[order] == doc[lead]) & (text_hash[order] == text_hash[lead]) & (pack[order] == pack[lead])
    sent = order[~again]
    sent = sent[np.argsort(h[sent], kind="stable")]
    tied = _same(h[sent])
    several = tied.copy()
    several[:-1] |= tied[1:]
    return sent, np.where(tied, key[sent], h[sent]), several, order[again & ~twin]


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the union of ranges [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return a[head], b[np.append(head[1:], len(a)) - 1]


def _span_of(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a context."""
    first = (pack >> 30) - ((pack >> 23) & 127)
    return first, first + ((pack >> 16) & 127) + LENGTH


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names)


SENT = ["kind", "key", "h", "c", "doc", "text_hash", "pack"]


def _scan(docs: DataFrame) -> DataFrame:
    """SENT rows of every anchor occurrence, copies of a context in a piece combined.  pack: place, windows before
    and after.  Of kind SPAN: h and c are the ends of bytes that repeat."""

    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, data, off in chunks(batch.column(2), SCAN_BYTES):
                h, c, text, first, place, last = occurrences(data, off)
                doc, text_hash = ids[lo + text], hashes[lo + text]
                pack = ((place - off[text]) << 30) | ((place - first) << 23) | ((last - first) << 16)
                sent, key, several, repeats = combined(h, c, doc, text_hash, pack)
                yield _batch(SENT, np.where(several, SEVERAL, LONE).astype(np.int32), key, h[sent], c[sent], doc[sent], text_hash[sent], pack[sent])
                if len(repeats):
                    # texts lie one behind another in the piece, with a gap their spans don't touch
                    a, b = _span_of(pack[repeats])
                    shift = off[text[repeats]] + text[repeats]
                    a, b = union(a + shift, b + shift)
                    at = np.searchsorted(off[:-1] + np.arange(len(off) - 1), a, "right") - 1
                    shift = off[at] + at
                    a, b, doc, text_hash = a - shift, b - shift, ids[lo + at], hashes[lo + at]
                    key = mix((a ^ doc ^ text_hash).view(np.uint64))
                    yield _batch(SENT, np.full(len(a), SPAN, np.int32), key, a, b, doc, text_hash, np.zeros(len(a), np.int64))

    return docs.mapInArrow(run, "kind int, key long, h long, c long, doc long, text_hash long, pack long")


FOUND = ["kind", "doc", "text_hash", "x", "y"]


def _judge(batches):
    """Rows sorted by (h, c, doc, text_hash, pack) become FOUND rows: kind SPAN with bytes that repeat from x to y, and
    kind LONE with pack x, the first of each context of anchors with several.  Holds one batch and one row."""
    held = None  # the last context's first row; is its anchor known to have several contexts; was it put out
    for batch in batches:
        kind, _, h, c, doc, text_hash, pack = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        span = kind == SPAN
        if span.any():
            yield _batch(FOUND, kind[span], doc[span], text_hash[span], h[span], c[span])
            kind, h, c, doc, text_hash, pack = (x[~span] for x in (kind, h, c, doc, text_hash, pack))
        if not len(h):
            continue
        known, out = False, False
        if held is not None:
            row, known, out = held
            kind, h, c, doc, text_hash, pack = (np.concatenate(([v], x)) for v, x in zip(row, (kind, h, c, doc, text_hash, pack)))
        same_h = _same(h)
        same_c = _same(h, c)
        lead = _leads(same_c)
        twin = (doc == doc[lead]) & (text_hash == text_hash[lead]) & (pack == pack[lead])
        again = same_c & ~twin
        again[1:] &= ~_same(h, c, doc, text_hash, pack)[1:]
        group = np.cumsum(~same_h) - 1
        several = (np.bincount(group, ~same_c) > 1) | (np.bincount(group, kind == SEVERAL) > 0)
        several[0] |= known
        goes = ~same_c & several[group]
        goes[0] &= not out
        last = int(lead[-1])
        held = ((kind[last], h[last], c[last], doc[last], text_hash[last], pack[last]), bool(several[-1]), bool(several[-1]))
        a, b = _span_of(pack[again])
        yield _batch(FOUND, np.full(len(a), SPAN, np.int32), doc[again], text_hash[again], a, b)
        yield _batch(FOUND, np.full(int(goes.sum()), LONE, np.int32), doc[goes], text_hash[goes], pack[goes], pack[goes])


CORES = ["core", "doc", "text_hash", "at", "left", "right"]


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[ranges(start, size)]))])


def _cores(source: DataFrame, needs: DataFrame) -> DataFrame:
    """CORES rows of the contexts that `needs` (doc, text_hash, pack) names: hash and start of each core, and the bytes
    on both sides that its windows reach.  `needs` has one row for each document, so a document that is repeated many
    times can be split over tasks."""
    lists = needs.groupBy("doc", "text_hash").agg(F.collect_set("pack").alias("packs"))  # of one document
    both = source.join(lists.hint("shuffle_hash"), ["doc", "text_hash"]).select("doc", "text_hash", "text", "packs")

    def run(batches):
        seen: set[tuple[int, int]] = set()  # of equal rows one is enough
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [x not in seen and not seen.add(x) for x in names]
            if not any(fresh):
                continue
            batch = batch if all(fresh) else batch.filter(pa.array(fresh))
            for lo, hi, data, off in chunks(batch.column(2), SCAN_BYTES):
                lists = batch.column(3).slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                pack = lists.flatten().to_numpy(zero_copy_only=False)
                ids, hashes = (batch.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
                most = (pack >> 23) & 127  # bytes of a window before the anchor
                least = most - ((pack >> 16) & 127)
                prefix = byte_prefix(data)
                for q in range(BLOCKS):
                    low = np.maximum(least, BLOCK * q) - BLOCK * q
                    high = np.minimum(most, BLOCK * (q + 1) - (q < BLOCKS - 1)) - BLOCK * q
                    some = np.flatnonzero(low <= high)
                    at = (pack[some] >> 30) - BLOCK * q
                    start = off[row[some]] + at
                    core = mix(spans(prefix, start, start + CORE) ^ np.uint64(q + 1))
                    left, right = high[some], BLOCK - low[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core.view(np.int64)), pa.array(ids[some]), pa.array(hashes[some]), pa.array(at), _binary(data, start - left, left), _binary(data, start + CORE, right)], CORES
                    )

    return both.mapInArrow(run, "core long, doc long, text_hash long, at long, left binary, right binary")


def repeated_windows(core: np.ndarray, salted: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, at: np.ndarray, left, right):
    """Rows of whole cores (core, salt), left and right as (bytes, offsets).  Windows that an earlier one of the rows
    equals: row, start; and of salted rows those that none does: row, start, hash."""
    n_left, n_right = (np.diff(x[1]) for x in (left, right))
    size = n_left + n_right + 2
    off = np.cumsum(size) - size
    middle = off + n_left
    kind = np.unique(core, return_inverse=True)[1].ravel()
    text = np.zeros(int(size.sum()) + BLOCK + 1, np.int64)
    text[ranges(off, n_left)] = left[0].astype(np.int64) + 1
    text[middle] = 257 + kind
    text[ranges(middle + 1, n_right)] = right[0].astype(np.int64) + 1
    value = mix(text.astype(np.uint64) + np.uint64(1))
    value[middle] = mix(core.view(np.uint64))
    row = np.repeat(np.arange(len(core)), size)
    sa = suffix_array(text[: len(row)])
    before = middle[row[sa]] - sa
    # a window is BLOCK bytes and the core's symbol
    sa = sa[(before >= 0) & (before >= BLOCK - n_right[row[sa]])]
    same = np.zeros(len(sa), bool)
    same[1:] = True
    for d in range(BLOCK + 1):
        same[1:] &= text[sa[1:] + d] == text[sa[:-1] + d]
    who = row[sa]
    start = at[who] - (middle[who] - sa)
    group = np.cumsum(~same) - 1
    lone = np.bincount(group, minlength=1)[group] == 1
    matter = np.flatnonzero(~lone | salted[who])
    sa, who, start, group = sa[matter], who[matter], start[matter], group[matter]
    order = np.lexsort((start, text_hash[who], doc[who], group))
    sa, who, start, group = sa[order], who[order], start[order], group[order]
    again = _same(group)
    lead = _leads(again)
    twin = (doc[who] == doc[who[lead]]) & (text_hash[who] == text_hash[who[lead]]) & (start == start[lead])
    later = again & ~twin
    first = np.flatnonzero(~again & salted[who])
    prefix = prefix_sums(value)
    return who[later], start[later], who[first], start[first], spans(prefix, sa[first], sa[first] + BLOCK + 1)


def _joined(who: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of each row: row, first, last."""
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (start[1:] - start[:-1] > 1)
    head = np.flatnonzero(fresh)
    return who[head], start[head], start[np.append(head[1:], len(who)) - 1] if len(head) else start


JUDGED = ["doc", "text_hash", "a", "b", "w"]


def _compare(batches):
    """Rows sorted by (core, salt) become JUDGED rows: bytes that repeat (w null), and firsts of salted cores with their hash."""
    kept: list[pa.RecordBatch] = []
    held = 0

    def judged(parts):
        table = pa.Table.from_batches(parts)
        core, salt, doc, text_hash, at = (table[i].to_numpy() for i in range(5))
        # a core alone in its group has nothing to compare, unless others of it have other salts
        alone = ~_same(core, salt)
        alone[:-1] &= alone[1:]
        stay = np.flatnonzero(~alone | (salt >= 0))
        if not len(stay):
            return
        table = table.take(pa.array(stay))
        core, salt, doc, text_hash, at = (x[stay] for x in (core, salt, doc, text_hash, at))
        who, start, first, begin, w = repeated_windows(core, salt >= 0, doc, text_hash, at, utf8(table[5]), utf8(table[6]))
        who, a, b = _joined(who, start)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (doc[who], text_hash[who], a, b + LENGTH)), pa.nulls(len(who), pa.int64())], JUDGED)
        if len(first):
            yield _batch(JUDGED, doc[first], text_hash[first], begin, begin + LENGTH, w)

    for batch in batches:
        if not batch.num_rows:
            continue
        core, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.flatnonzero(~_same(core, salt))[1:]
        if kept and (kept[-1].column(0)[-1].as_py(), kept[-1].column(1)[-1].as_py()) != (core[0], salt[0]):
            new = np.concatenate(([0], new))
        done = 0
        for cut in new:  # whole groups, as many as fill an array
            if held + (cut - done) * (BLOCK + 8) >= ARRAY_SYMBOLS:
                parts = [*kept, batch.slice(done, cut - done)]
                kept, held, done = [], 0, int(cut)
                yield from judged(parts)
        kept.append(batch.slice(done))
        held += (batch.num_rows - done) * (BLOCK + 8)
    if kept:
        yield from judged(kept)


def _later(batches):
    """JUDGED rows sorted by (w, doc, text_hash, a): all but the first of each w repeat.  Holds one batch and one row."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if held is not None:
            rows = [np.concatenate(([v], x)) for v, x in zip(held, rows)]
        doc, text_hash, a, b, w = rows
        lead = _leads(_same(w))
        later = (doc != doc[lead]) | (text_hash != text_hash[lead]) | (a != a[lead])
        held = [x[lead[-1]] for x in rows]
        yield _batch(JUDGED[:4], doc[later], text_hash[later], a[later], b[later])


def repeated_spans(source: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc, text_hash, a, b: byte ranges of `_documents` rows that repeat, overlapping ones too."""
    spark = source.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc", "text_hash", "a", "b"]
    rows = _scan(source).repartition(n, "key").sortWithinPartitions("h", "c", "doc", "text_hash", "pack")
    found = persisted(rows.mapInArrow(_judge, "kind int, doc long, text_hash long, x long, y long"), "passages")
    whole = found.where(F.col("kind") == SPAN).select("doc", "text_hash", F.col("x").alias("a"), F.col("y").alias("b"))
    cores = persisted(_cores(source, found.where(F.col("kind") == LONE).select("doc", "text_hash", F.col("x").alias("pack"))), "cores")
    sizes = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    sizes = persisted(sizes.select("core", F.ceil(F.col("n") / group_rows).alias("salts")), "salts")
    many = sizes.count()
    salt = F.lit(-1)
    if many:
        cores = cores.join(F.broadcast(sizes) if many <= SALTED_LIST else sizes, "core", "left")
        salt = F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc", "text_hash", "at"), F.col("salts")).cast("int"))
    dealt = cores.select("core", salt.alias("salt"), "doc", "text_hash", "at", "left", "right").repartition(n, "core", "salt").sortWithinPartitions("core", "salt")
    judged = dealt.mapInArrow(_compare, "doc long, text_hash long, a long, b long, w long")
    if not many:
        return whole.unionByName(judged.select(*names))
    judged = persisted(judged, "windows")
    again = judged.where("w is not null").repartition(n, "w").sortWithinPartitions("w", "doc", "text_hash", "a").mapInArrow(_later, "doc long, text_hash long, a long, b long")
    return whole.unionByName(judged.where("w is null").select(*names)).unionByName(again)


FIELDS = "n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string, spans: array<int>"


def annotate(docs: DataFrame, keep: list[str] | None = None, group_rows: int = GROUP_ROWS, as_text: bool = False, raw: bool = False) -> DataFrame:
    """The kept columns and a struct RESULT of FIELDS (spans: start, end, ... in bytes).  as_text: instead,
    column KEPT_TEXT has the text without the removed bytes, of a character all or none."""
    keep = ["doc_id"] if keep is None else keep
    kept = [f"k{i}" for i in range(len(keep))]
    found = repeated_spans(_documents(docs), group_rows)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)])
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    named = rows.where(F.col("doc") != _LAST).select("doc", "text_hash", "text", *kept, F.lit(None).cast("long").alias("own"), F.lit(1).alias("nth"))
    # rows without an id: one of those with equal texts is the first, by a hash of what else is kept; rows equal in that too are
    # counted and spelled out again, so that exactly one of them has nth 1 wherever it is
    own = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("z"), *kept)))
    lone = rows.where(F.col("doc") == _LAST).withColumn("own", own)
    lone = lone.groupBy("doc", "text_hash", "own").agg(F.first("text").alias("text"), *[F.first(k).alias(k) for k in kept], F.count(F.lit(1)).alias("times"))
    equal = lone.groupBy("doc", "text_hash").agg(F.min("own").alias("lead"), F.sum("times").alias("n")).where("n > 1")
    lone = lone.select("doc", "text_hash", "text", *kept, "own", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    none = F.lit(None).cast("long")
    found = found.select("doc", "text_hash", "a", "b", none.alias("lead")).unionByName(equal.select("doc", "text_hash", none.alias("a"), none.alias("b"), "lead"))
    lists = found.groupBy("doc", "text_hash").agg(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("ranges"), F.max("lead").alias("lead"))
    both = named.unionByName(lone).join(lists.hint("shuffle_hash"), ["doc", "text_hash"], "left")
    whole = F.col("lead").isNotNull() & ~((F.col("own") == F.col("lead")) & (F.col("nth") == 1))
    both = both.select("text", F.col("ranges.a").alias("a"), F.col("ranges.b").alias("b"), F.coalesce(whole, F.lit(False)).alias("whole"), *kept)
    kinds = ", ".join(f"k{i} {both.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    made = f"{RESULT} string" if as_text else f"{RESULT} struct<{FIELDS}>"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, a_all, b_all, whole = batch.column(0), batch.column(1), batch.column(2), batch.column(3).to_pylist()
            out = []
            for lo, hi, data, off in chunks(texts):
                for i in range(lo, hi):
                    raw = data[off[i - lo] : off[i - lo + 1]]
                    a, b = _values(a_all, i), _values(b_all, i)
                    if whole[i] and len(raw) >= LENGTH:
                        a, b = np.array([0]), np.array([len(raw)])
                    if len(a):
                        a, b = union(a, b)
                    if as_text:
                        out.append(cut(raw, a, b))
                        continue
                    stay = np.ones(len(raw) + 1, np.int8)
                    stay[-1] = 0
                    if len(a):
                        stay[ranges(a, b - a)] = 0
                    left = raw[stay[:-1] > 0].tobytes() if len(a) else raw.tobytes()
                    out.append((len(raw), len(raw) - len(left), len(a), hashlib.sha256(left).hexdigest(), np.stack((a, b), 1).ravel().astype(np.int32)))
            if as_text:
                column = pa.array(out, pa.string())
            else:
                n_bytes, n_removed, n_spans, digest, where = zip(*out)
                column = pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(where, pa.list_(pa.int32()))], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            yield pa.RecordBatch.from_arrays([*[batch.column(4 + i) for i in range(len(keep))], column], [*(f"k{i}" for i in range(len(keep))), RESULT])

    out = both.mapInArrow(run, f"{kinds}, {made}")
    return out if raw else out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], RESULT)


def _values(column, i: int) -> np.ndarray:
    x = column[i].values
    return np.zeros(0, np.int64) if x is None else x.to_numpy(zero_copy_only=False)


def cut(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> str:
    """The text without the ranges; characters that a range cuts into stay."""
    inner = np.append((raw & 0xC0) == 0x80, False)
    a, b = a.copy(), b.copy()
    for _ in range(3):
        a += inner[a]
        b -= inner[b]
    stay = np.ones(len(raw), bool)
    size = np.maximum(b - a, 0)
    stay[ranges(a, size)] = False
    return raw[stay].tobytes().decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All documents (all columns; n_chars follows the text) without their repeated passages."""
    others = [c for c in docs.columns if c != "text"]
    made = annotate(docs, others, as_text=True, raw=True)
    values = {c: F.col(f"k{i}") for i, c in enumerate(others)} | {"text": F.col(RESULT)}
    if "n_chars" in values:
        values["n_chars"] = F.length(RESULT).cast(docs.schema["n_chars"].dataType)
    return made.select(*[values[c].alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return annotate(d).select("doc_id", *[f"{RESULT}.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
