"""Nearest neighbours by cosine, found through a forest of random-projection trees.

Fit: TREES perfect trees over a sample of at most SAMPLE vectors (those whose ids' hashes are least).  Each node has a random
direction and the sample's median along it.  There are as many leaves as put LEAF_ROWS rows into one, up to MOST_LEAVES, so
the forest that goes to all tasks is bounded whatever the table's size; beyond that leaves grow.

Search: one priority queue for all trees of a query.  It holds nodes under the largest distance to a plane that was crossed
on the way to them; the nearest is taken first, until the budget of leaves is used up.  The budget is what
finds a share of RECALL of the sample's own neighbours for PROBES of its vectors; in the whole table neighbours are nearer, so
more are found.  Every row is in one leaf of each tree.  A leaf's rows are dealt into blocks of BLOCK rows, and its queries into
blocks as well, so no task holds a whole leaf; inside a task one matrix product ranks all pairs, and those that may be
among the first are scored exactly, in double precision on the vectors as they are.

Equal vectors: only the first k + 1 ids of each can be in a result, so only these are indexed, found before any shuffle of the
rest; equal queries are searched once.  So a vector that a third of all rows have is no hot leaf.

Edge cases: vectors that are null, empty, all zero, or have null, NaN or infinite components take no part, neither as queries nor as
candidates; nor do those of another length than most (of equally many the shorter).  Rows without an id take no part.  A repeated id is a
candidate once for each different vector, and only other ids are candidates for it; a repeated query row gives its results once.
Ties go to the smaller id.  An empty table has no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted, small_batches

TREES, LEAF_ROWS, MOST_LEAVES = 4, 512, 4096
SAMPLE, PROBES, RECALL = 16384, 256, 0.97
BLOCK = 4096
NEAREST, EVERY = 5, 50


@dataclass
class Forest:
    """Perfect trees: directions (tree, node, dimension) and borders (tree, node), nodes in level order; budget of leaves a query visits."""

    directions: np.ndarray
    borders: np.ndarray
    budget: int = 1

    @property
    def leaves(self) -> int:
        return self.borders.shape[1] + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through all trees."""
        out = np.empty((len(x), len(self.borders)), np.int64)
        for t, (w, b) in enumerate(zip(self.directions, self.borders)):
            node = np.zeros(len(x), np.int64)
            while self.leaves > 1 and len(x) and node[0] < len(b):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, w[node]) > b[node])
            out[:, t] = node - len(b) + t * self.leaves
        return out

    def visits(self, x: np.ndarray, budget: int | None = None) -> list[list[int]]:
        """The leaves of each query in the order of the shared queue."""
        budget, inner = self.budget if budget is None else budget, self.leaves - 1
        far = np.stack([x @ w.T - b for w, b in zip(self.directions, self.borders)], axis=1) if inner else np.zeros((len(x), len(self.borders), 0))
        return [self._walk(f, budget, inner) for f in far.tolist()]

    def _walk(self, far: list[list[float]], budget: int, inner: int) -> list[int]:
        queue = [(0.0, t, 0) for t in range(len(far))]
        found: list[int] = []
        while queue and len(found) < budget:
            crossed, t, node = heapq.heappop(queue)
            while node < inner:  # down on the own side; the other one waits
                side = far[t][node]
                right = side > 0
                heapq.heappush(queue, (max(crossed, abs(side)), t, 2 * node + 2 - right))
                node = 2 * node + 1 + right
            found.append(node - inner + t * (inner + 1))
        return found


def unit(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x  # exact, and no square overflows
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row with the row beside it, the same for equal rows wherever they are."""
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) if len(v) else v for v in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def fit(x: np.ndarray, leaves: int, trees: int = TREES, recall: float = RECALL, seed: int = 7) -> Forest:
    """x: unit vectors of the sample; leaves: a power of two."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((trees, leaves - 1, x.shape[1]))
    w /= np.linalg.norm(w, axis=2, keepdims=True)
    b = np.zeros((trees, leaves - 1))
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for first in [2**k - 1 for k in range(leaves.bit_length() - 1)]:
            along = np.einsum("ij,ij->i", x, w[t][node])
            order = np.lexsort((along, node))
            edges = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
            for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                if hi > lo:
                    b[t][first + i] = along[order[(lo + hi - 1) // 2]]
            node = 2 * node + 1 + (along > b[t][node])
    forest = Forest(w, b)
    if leaves > 1:
        forest.budget = _budget(forest, x, recall)
    return forest


def _budget(forest: Forest, x: np.ndarray, recall: float) -> int:
    """How many leaves it takes until that share of the sample's neighbours is met."""
    probes = x[:PROBES]
    near = probes @ x.T
    near[np.arange(len(probes)), np.arange(len(probes))] = -2
    k = min(NEAREST, len(x) - 1)
    if k < 1:
        return 1
    wanted = np.argpartition(-near, k - 1, axis=1)[:, :k]
    home = forest.place(x)
    turns = []
    for q, order in enumerate(forest.visits(probes, forest.leaves * len(forest.borders))):
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order))
        turns.append(turn[home[wanted[q]]].min(axis=1))
    turns = np.sort(np.concatenate(turns))
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))]) + 1


def _matrix(col) -> np.ndarray:
    """Rows of a list column of one length as float64."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, h (a hash of v) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    real = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & real & F.exists("v", lambda c: c != 0))
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(1).select("length")
    return rows.where(F.size("v") == lengths.scalar()).withColumn("h", F.xxhash64("v"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries (vec_id, v, h, as `usable` gives them) the k nearest of vectors that the
    forest finds."""
    spark = vectors.sparkSession
    small_batches(spark)
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    distinct = vectors.dropDuplicates(["h", "v", "vec_id"]).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    indexed = persisted(distinct, "vectors")
    n = indexed.count()
    sample = _matrix(indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"])
    leaves = 1
    while leaves < MOST_LEAVES and leaves * LEAF_ROWS < n:
        leaves *= 2
    forest = spark.sparkContext.broadcast(fit(unit(sample), leaves if len(sample) else 1))

    def place(batches):
        for batch in batches:
            home = forest.value.place(unit(_matrix(batch.column(1))))
            at = np.repeat(np.arange(batch.num_rows), home.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(home.reshape(-1)), *[c.take(pa.array(at)) for c in batch.columns]], ["leaf", "vec_id", "v"])

    def search(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.value.visits(unit(_matrix(part.column(1)))), pa.list_(pa.int64()))], ["key", "v", "leaves"])

    kind = dict(indexed.dtypes)["v"]
    asked = queries.select("vec_id", "v", "h").distinct()
    keys = asked.groupBy("h", "v").agg(F.min("vec_id").alias("key"))
    walks = persisted(keys.select("key", "v").mapInArrow(search, f"key long, v {kind}, leaves array<bigint>"), "walks")
    placed = indexed.mapInArrow(place, f"leaf long, vec_id long, v {kind}")
    steps = walks.select("key", "v", F.explode("leaves").alias("leaf"))
    # a row for each leaf of the forest at most
    blocks = lambda rows, name: rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    shape = F.broadcast(persisted(blocks(placed.select("leaf"), "row_blocks").join(blocks(steps.select("leaf"), "query_blocks"), "leaf"), "leaves"))
    salt = lambda c, count: F.pmod(F.xxhash64(c), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    held = placed.join(shape, "leaf").select("leaf", salt("vec_id", "row_blocks").alias("rows"), every("query_blocks").alias("asks"), "vec_id", "v")
    asks = steps.join(shape, "leaf").select("leaf", every("row_blocks").alias("rows"), salt("key", "query_blocks").alias("asks"), "key", "v")

    def rank(_, own, asking):
        if not own.num_rows or not asking.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = _matrix(own["v"]), _matrix(asking["v"])
        ids, ask = own["vec_id"].to_numpy(), asking["key"].to_numpy()
        ux, out = unit(x).T, []
        for lo in range(0, len(q), 512):
            near = unit(q[lo : lo + 512]) @ ux
            least = -np.partition(-near, k, axis=1)[:, k] if near.shape[1] > k + 1 else np.full(len(near), -2.0)
            i, j = np.nonzero(near >= least[:, None] - 1e-9)
            score = cosines(q[lo + i], x[j])
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            start = np.searchsorted(i, i)
            top = np.arange(len(i)) - start <= k
            out.append((ask[lo + i[top]], ids[j[top]], score[top]))
        return pa.table(dict(zip(("key", "vec_id", "score"), (pa.array(np.concatenate(c)) for c in zip(*out)))))

    group = ["leaf", "rows", "asks"]
    found = asks.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(lambda g, a, b: rank(g, b, a), "key long, vec_id long, score double")
    # an id may have several vectors: its best counts
    once = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = once.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    named = asked.join(keys, ["h", "v"]).select("vec_id", "key").join(lists, "key")
    others = F.slice(F.filter("found", lambda c: c["vec_id"] != F.col("vec_id")), 1, k)
    return named.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "c")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "c.vec_id", "c.score")


def report(vectors: DataFrame) -> DataFrame:
    """The nearest of every EVERY-th id among all rows."""
    rows = usable(vectors)
    return neighbours(rows, rows.where(F.col("vec_id") % EVERY == 0))
