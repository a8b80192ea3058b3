"""Near-duplicate join on the Jaccard similarity of word n-grams by a MinHash LSH forest.

1.  A document's shingles are its WORDS-word sequences (A-Z lower-cased; a shorter document is one shingle).
    Documents with equal shingle sets are collapsed into one set with a multiplicity.  Each set has TREES signatures of
    DEPTH MinHash values.
2.  The matched prefix is shortened from DEPTH values on, in all tries at once, until the target recall is met: by the
    formula for a pair at the threshold, and by measurement.  For the latter a bounded sample of documents is compared
    exactly with every set while signatures are made, and for each link so found the longest prefix shared in any
    trie is counted (`prefix_length`).
3.  Each trie is the sorted order of its signatures, range-partitioned, so that no prefix is too frequent for a task.
    Sets with a common prefix of the found length stand together; each run gives edges from its sets to its first, never
    all pairs.  Runs that go on in the next partition are joined by the partitions' ends.
4.  Connected components of these edges hold all candidates.  They are verified exactly: counts of common
    shingles of all sets of a component, in blocks of at most about BLOCK sets and BLOCK_SHINGLES shingles, each pair
    of blocks a group of its own.
5.  The links found, counted with multiplicities, give each document's number of links, and components of
    a spanning forest of them the classes.

Nothing is capped: a large component makes more blocks.  The recall at the threshold itself is the target
(more above it); verification is exact up to 64-bit hashes.

Edge cases: a document without words (null, empty) is a class of its own without links; repeated rows count
as copies; class_id is the least doc_id of the class, null ids last; classes that share it (null or repeated
ids) are told apart by class_key, a hash of one set of the class (null without words); an empty table gives
an empty result; other columns are ignored or, in `keep_one`, kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, RESULT, map_texts, mix, named, persisted, prefix_sums, ranges, small_batches, spans, training_texts, utf8
from .components import components
from .decontaminate import word_hashes

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 10
RECALL = 0.9999
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: The sample that recall is measured on: at most so many documents, of at most so many bytes in all.
SAMPLE, SAMPLE_BYTES = 256, 1 << 20
#: Bits of a MinHash value that a trie keeps, and values in one long.
BITS, PER_LONG = 12, 5
#: Shingles of fewer sets of a group are counted by their pairs, those of more by a matrix product.
RARE = 24
_LAST = (1 << 63) - 1
_FACTORS = np.random.default_rng(5).integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(depths: dict[int, int] | None = None, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix with the target recall: that of a pair at the threshold, which shares one in some trie, and
    that measured (depths: longest shared prefix -> links of the sample)."""
    depths = depths or {}
    links = sum(depths.values())
    k = DEPTH
    while k > 1 and (1 - (1 - threshold**k) ** trees < recall or sum(n for d, n in depths.items() if d >= k) < recall * links):
        k -= 1
    return k


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order of (text, hash): hashes, texts."""
    h, text = word_hashes(data, off)
    if not len(h):
        return h, text
    n = np.bincount(text, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    start = ranges(first, count)
    of = np.repeat(np.arange(len(n)), count)
    found = spans(prefix_sums(h), start, start + np.minimum(words, n[of]))
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[fresh], of[fresh]


def signatures(found: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n texts with these distinct shingles: sizes, hashes of the sets, and the tries' entries: (n, TREES) longs with the
    first PER_LONG values and with the others, each value less significant than the one before."""
    size = np.bincount(of, minlength=n)
    some = np.flatnonzero(size)
    whole = np.zeros(n, np.uint64)
    packed = np.zeros((2, n, TREES), np.uint64)
    if len(some):
        starts = (np.cumsum(size) - size)[some]
        mixed = mix(found)
        whole[some] = mix(np.add.reduceat(mixed, starts) ^ size[some].astype(np.uint64))
        for tree in range(TREES):
            for d in range(DEPTH):
                low = np.minimum.reduceat(mixed * _FACTORS[tree * DEPTH + d], starts)
                half = packed[d // PER_LONG]
                half[some, tree] = (half[some, tree] << np.uint64(BITS)) | (mix(low) >> np.uint64(64 - BITS))
    return size, whole, packed[0], packed[1]


def common_prefix(high: np.ndarray, low: np.ndarray, other_high: np.ndarray, other_low: np.ndarray) -> np.ndarray:
    """How many leading values two entries of a trie share."""
    shifts = [np.uint64(BITS * (PER_LONG - k)) for k in range(1, PER_LONG + 1)]
    a, b = (high ^ other_high).astype(np.uint64), (low ^ other_low).astype(np.uint64)
    out = sum((a >> s == 0).astype(np.int64) for s in shifts)
    return out + np.where(a == 0, sum((b >> s == 0).astype(np.int64) for s in shifts), 0)


class Sample:
    """Shingle sets of a bounded sample, to be compared exactly with all others."""

    def __init__(self, texts: pa.Array, words: int):
        data, off = utf8(texts)
        found, of = shingles(data, off, words)
        self.size, self.whole, self.high, self.low = signatures(found, of, len(off) - 1)
        order = np.argsort(found, kind="stable")
        self.shingles, first = np.unique(found[order], return_index=True)
        self.owner, self.first = of[order], np.append(first, len(found))

    def depths(self, found: np.ndarray, of: np.ndarray, made: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Links between texts (with what `signatures` made of them) and different sets of the sample: text, longest prefix shared."""
        size, whole, high, low = made
        if not len(self.shingles) or not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        hit = np.flatnonzero(self.shingles[at] == found)
        count = self.first[at[hit] + 1] - self.first[at[hit]]
        pair, n = np.unique(np.repeat(of[hit], count) * len(self.size) + self.owner[ranges(self.first[at[hit]], count)], return_counts=True)
        text, mine = pair // len(self.size), pair % len(self.size)
        near = (n * (1 + threshold) >= threshold * (size[text] + self.size[mine]) - 1e-9) & (whole[text] != self.whole[mine])
        text, mine = text[near], mine[near]
        return text, common_prefix(high[text], low[text], self.high[mine], self.low[mine]).max(1, initial=0)


def _signatures(words: int, sample, threshold: float):
    def make():
        known = sample.value

        def work(data, off):
            n = len(off) - 1
            found, of = shingles(data, off, words)
            made = size, whole, high, low = signatures(found, of, n)
            text, depth = known.depths(found, of, made, threshold)
            ends = pa.array(np.arange(0, (n + 1) * TREES, TREES, dtype=np.int32))
            edges = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(text, minlength=n), out=edges[1:])
            tries = [pa.ListArray.from_arrays(ends, pa.array(x.ravel().view(np.int64))) for x in (high, low)]
            return [size, whole.view(np.int64), *tries, pa.ListArray.from_arrays(pa.array(edges), pa.array(depth.astype(np.int32)))]

        return work

    return make


ENTRIES = ["src", "dst", "tree", "high", "low", "part"]


def _trie(k: int):
    """Entries sorted by (tree, high, low, set): edges from each set to the first of those that share k values with it.  The
    partition's first and last entry come out as well (dst null)."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last = head = None

        def end(row):
            return pa.RecordBatch.from_arrays([pa.array([row[3]], pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.int64()) for x in (*row[:3], part))], ENTRIES)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, high, low, name = (batch.column(i).to_numpy() for i in range(4))
            if last is None:
                yield end((tree[0], high[0], low[0], name[0]))
                head = name[0]
                tree, high, low, name = (np.concatenate((x[:1], x)) for x in (tree, high, low, name))
            else:
                tree, high, low, name = (np.concatenate(([v], x)) for v, x in zip(last, (tree, high, low, name)))
            joined = (tree[1:] == tree[:-1]) & (common_prefix(high[1:], low[1:], high[:-1], low[:-1]) >= k)
            first = np.concatenate(([0], np.where(joined, 0, np.arange(1, len(name)))))
            of = np.maximum.accumulate(first)
            heads = np.where(of == 0, head, name[of])
            edge = np.flatnonzero(heads[1:] != name[1:]) + 1
            edge = edge[joined[edge - 1]]
            last, head = (tree[-1], high[-1], low[-1], name[-1]), heads[-1]
            none = pa.nulls(len(edge), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(name[edge]), pa.array(heads[edge]), none, none, none, none], ENTRIES)
        if last is not None:
            yield end(last)

    return run


def forest_edges(sets: DataFrame, k: int) -> DataFrame:
    """(src, dst) sets that share k leading values of a trie, by way of the runs in the tries' sorted order.  sets: set, high, low."""
    spark = sets.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = sets.select("set", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "v")).select(F.col("tree").cast("long").alias("tree"), "v.high", "v.low", "set")
    ordered = entries.repartitionByRange(n, "tree", "high", "low", "set").sortWithinPartitions("tree", "high", "low", "set")
    found = persisted(ordered.mapInArrow(_trie(k), ", ".join(f"{c} long" for c in ENTRIES)), "trie")
    # two rows of each partition
    ends = sorted(found.where("dst is null").toArrow().to_pylist(), key=lambda r: (r["part"], r["tree"], r["high"], r["low"], r["src"]))
    across = []
    for a, b in zip(ends, ends[1:]):
        if a["part"] != b["part"] and a["tree"] == b["tree"] and a["src"] != b["src"]:
            ah, al, bh, bl = (np.array([x]) for x in (a["high"], a["low"], b["high"], b["low"]))
            if common_prefix(ah, al, bh, bl)[0] >= k:
                across.append((b["src"], a["src"]))
    edges = found.where("dst is not null").select("src", "dst")
    if across:
        edges = edges.unionByName(spark.createDataFrame(across, "src long, dst long"))
    return edges.distinct()


def recall_sample(d: DataFrame, words: int) -> Sample:
    """At most SAMPLE documents with ids divisible by 50, by a hash."""
    ids = d.where(F.col("doc_id") % 50 == 0).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(SAMPLE)
    return Sample(training_texts(d.select("doc_id", "text", F.lit(0).alias("label")).join(F.broadcast(ids), "doc_id"), SAMPLE_BYTES)["text"], words)


def _sets(words: int):
    def make():
        def work(data, off):
            found, of = shingles(data, off, words)
            ends = np.zeros(len(off), np.int32)
            np.cumsum(np.bincount(of, minlength=len(off) - 1), out=ends[1:])
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))]

        return work

    return make


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of common shingles of sets a[i] and b[j]."""
    size = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    column = column.ravel()
    row = np.repeat(np.arange(len(sets)), size)
    df = np.bincount(column)
    out = np.zeros((len(a), len(b)))
    spot_a, spot_b = np.full(len(sets), -1), np.full(len(sets), -1)
    spot_a[a], spot_b[b] = np.arange(len(a)), np.arange(len(b))
    many = df > RARE
    # rare shingles: the pairs of sets that have them
    pick = np.flatnonzero((df[column] > 1) & ~many[column])
    order = pick[np.argsort(column[pick], kind="stable")]
    c, r = column[order], row[order]
    n = df[c]
    first = np.repeat(np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))), n[np.concatenate(([True], c[1:] != c[:-1]))]) if len(c) else c
    step = max(1, (1 << 22) // RARE)
    for lo in range(0, len(c), step):
        x, y = r[lo : lo + step], n[lo : lo + step]
        left = spot_a[np.repeat(x, y)]
        right = spot_b[r[ranges(first[lo : lo + step], y)]]
        ok = (left >= 0) & (right >= 0)
        out += np.bincount(left[ok] * len(b) + right[ok], minlength=out.size).reshape(out.shape)
    # frequent ones: 0-1 matrices
    wide = np.cumsum(many) - 1
    pick = np.flatnonzero(many[column])
    r, c = row[pick], wide[column[pick]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    total = int(many.sum())
    for lo in range(0, total, 2048):
        i, j = np.searchsorted(c, (lo, lo + 2048))
        x = np.zeros((len(sets), min(2048, total - lo)), np.float32)
        x[r[i:j], c[i:j] - lo] = 1
        out += x[a] @ x[b].T
    return np.rint(out)


def verify(rep: np.ndarray, copies: np.ndarray, block: np.ndarray, pair: tuple[int, int], sets: list[np.ndarray], threshold: float = THRESHOLD):
    """Links within one block, or between two: per set the documents it is linked to, and edges of a spanning forest."""
    i, j = pair
    a = np.flatnonzero(block == i)
    b = a if i == j else np.flatnonzero(block == j)
    links = np.zeros(len(rep), np.int64)
    if len(a) == 0 or len(b) == 0 or len(rep) < 2:
        return links, np.zeros((0, 2), np.int64)
    size = np.array([len(s) for s in sets])
    count = common_counts(sets, a, b)
    near = count * (1 + threshold) >= threshold * (size[a][:, None] + size[b]) - 1e-9
    if i == j:
        np.fill_diagonal(near, False)
    links[a] += near @ copies[b]
    if i != j:
        links[b] += near.T @ copies[a]
    # a spanning forest, breadth first over the matrix
    edges = []
    whole = np.zeros((len(rep), len(rep)), bool)
    whole[np.ix_(a, b)] = near
    whole |= whole.T
    fresh = whole.any(1)
    while fresh.any():
        root = int(np.flatnonzero(fresh)[0])
        reached = np.zeros(len(rep), bool)
        front = np.array([root])
        reached[root] = True
        while len(front):
            new = whole[front].any(0) & ~reached
            reached |= new
            front = np.flatnonzero(new)
        low = rep[reached].min()
        edges += [(int(r), int(low)) for r in rep[reached] if r != low]
        fresh &= ~reached
    return links, np.array(edges, np.int64).reshape(-1, 2)


def _verifier(threshold: float):
    def run(batches):
        kept: list[pa.RecordBatch] = []

        def judged():
            table = pa.Table.from_batches(kept)
            rep, copies, block = (table[k].to_numpy() for k in ("rep", "copies", "block"))
            flat = table["shingles"].combine_chunks()
            sizes, values = flat.value_lengths().to_numpy(), flat.flatten().to_numpy()
            sets = np.split(values, np.cumsum(sizes)[:-1])
            links, edges = verify(rep, copies, block, (table["i"][0].as_py(), table["j"][0].as_py()), sets, threshold)
            some = np.flatnonzero(links)
            n = len(some) + len(edges)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((rep[some], edges[:, 0]))), pa.array(np.concatenate((links[some], np.zeros(len(edges), np.int64)))), pa.array(np.concatenate((rep[some], edges[:, 1])))],
                ["rep", "links", "other"],
            ) if n else None

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                key = tuple(keys[lo])
                if kept and key != last:
                    if (out := judged()) is not None:
                        yield out
                    kept.clear()
                kept.append(batch.slice(lo, hi - lo))
                last = key
        if kept and (out := judged()) is not None:
            yield out

    return run


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, text_hash, set (hash of its shingles), size, class_id, class_key, n_links."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("text_hash", F.xxhash64("text"))
    sample = docs.sparkSession.sparkContext.broadcast(recall_sample(d, words))
    fields = "size: bigint, set: bigint, high: array<bigint>, low: array<bigint>, depths: array<int>"
    signed = map_texts(d, fields, _signatures(words, sample, threshold), ["doc_id", "text_hash"], CHUNK_BYTES)
    signed = persisted(signed.select("doc_id", "text_hash", f"{RESULT}.*"), "signatures")
    depths = signed.where(F.size("depths") > 0).select(F.explode("depths").alias("depth")).groupBy("depth").count().collect()  # at most DEPTH + 1 rows
    k = prefix_length({r["depth"]: r["count"] for r in depths}, threshold, recall)
    whole = signed.where("size > 0")
    # collapse equal sets; any document of a set has its signatures.  An id alone doesn't name a text
    groups = whole.groupBy("set").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
    groups = persisted(groups.select("set", F.col("m.doc_id").alias("rep"), F.col("m.text_hash").alias("text_hash"), "copies", "size"), "sets")
    keyed = whole.join(groups.select("set", F.col("rep").alias("doc_id"), "text_hash"), ["set", "doc_id", "text_hash"]).select("set", "high", "low").dropDuplicates(["set"])
    # a set's name is its hash: two sets may share a document id
    edges = persisted(forest_edges(persisted(keyed, "forest"), k), "edges")
    outcome = signed.sparkSession.createDataFrame([], "set long, links long, class long")
    if not edges.isEmpty():
        part = components(edges).select(F.col("node").alias("set"), "component")
        part = persisted(part, "parts")
        total = part.join(groups.select("set", "size"), "set").groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        member = part.join(total, "component").join(groups, "set").select("set", F.col("rep").alias("doc_id"), "text_hash", "copies", "component", "blocks")
        # the texts of the members
        texts = map_texts(d.join(member.select("doc_id", "text_hash", F.col("set").alias("want"), "copies", "component", "blocks"), ["doc_id", "text_hash"]), "shingles: array<bigint>", _sets(words), ["want", "copies", "component", "blocks"], CHUNK_BYTES)
        hashed = texts.select("want", "copies", "component", "blocks", F.col(f"{RESULT}.shingles").alias("shingles"))
        if not signed.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():  # repeated rows
            hashed = hashed.dropDuplicates(["want"])
        own = F.pmod(F.xxhash64("want"), F.col("blocks")).cast("int")
        dealt = hashed.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("component", F.least("block", "with").cast("int").alias("i"), F.greatest("block", "with").cast("int").alias("j"), F.col("want").alias("rep"), "copies", "block", "shingles")
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = dealt.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_verifier(threshold), "rep long, links long, other long")
        found = persisted(found, "links")
        links = found.groupBy(F.col("rep").alias("set")).agg(F.sum("links").alias("links"))
        spanning = found.where(F.col("rep") != F.col("other")).select(F.col("rep").alias("src"), F.col("other").alias("dst"))
        if not spanning.isEmpty():
            outcome = links.join(components(spanning).select(F.col("node").alias("set"), F.col("component").alias("class")), "set", "left")
    named = groups.join(outcome, "set", "left").select("set", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "set").alias("class"))
    least_id = named.groupBy("class").agg(F.min("rep").alias("class_id"))
    final = named.join(least_id, "class").select("set", "class_id", F.col("class").alias("class_key"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    ids = signed.select("doc_id", "text_hash", "set", "size")
    out = ids.where("size > 0").join(final, "set").select("doc_id", "text_hash", "set", "size", "class_id", "class_key", "n_links")
    return out.unionByName(ids.where("size = 0").select("doc_id", "text_hash", "set", "size", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("class_key"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) without the others of each class: the one with the least doc_id stays (of
    rows with one id, that of the least shingle and text hashes; of equal rows, one).  Rows are found again by id
    and text hash, so whole texts don't go through Python a second time."""
    found = persisted(classes(docs, threshold), "classes")
    best = found.where("size > 0 and doc_id = class_id").groupBy("class_key").agg(F.min(F.struct("doc_id", "set", "text_hash")).alias("m"))
    stays = best.select(F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash"), F.lit(True).alias("once"))
    stays = stays.unionByName(found.where("size = 0").select("doc_id", "text_hash", F.lit(False).alias("once")).distinct())
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    kept = rows.join(stays, ["doc_id", "text_hash"])
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():  # repeated rows
        nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(*[f"k{i}" for i in range(len(names))])))
        kept = kept.withColumn("nth", nth).where("nth = 1 or not once")
    return named(kept, names)


def report(docs: DataFrame) -> DataFrame:
    found = classes(docs)
    none = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return found.select(none("doc_id").alias("doc_id"), none("class_id").alias("class_id"), "class_key", "n_links")
