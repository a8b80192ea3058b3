"""Octrees as one binary file: the nodes with their surfels, depth-first or level by level.

The first byte says whether the layout is depth-first.  A node is a byte (leaf or not), the number of its surfels (4 bytes) and
nine floats each: centre, u and v; then the number of its children (4 bytes; level by level only where the node is
no leaf), all little-endian.  The file has no codes: a node is known by its place and its parent's.

`spark.dataSource.register(OctreeFile)` once, then `spark.read.format("octree_file").load(path)`: nth, parent (null: the root),
level, is_leaf, n_children, contents.  The file is read by many tasks (option `bytes_per_split`).  An index of nodes cuts it: one pass
that jumps from node to node and reads 13 bytes of each, never the surfels, and keeps 25 bytes a node on the driver.

`write` gives every node's record to the task that has the row; parts are in order, and the driver puts them behind the first
byte.  Files are opened through pyarrow's filesystems, as PLY files are.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelake.functions import morton
from voxelake.sources.ply import _filesystem
from voxelake.sources.shared import stored

SURFEL = ("cx", "cy", "cz", "ux", "uy", "uz", "vx", "vy", "vz")
CONTENTS = f"array<struct<{', '.join(f'{c}: float' for c in SURFEL)}>>"
ROWS = f"nth long, parent long, level int, is_leaf boolean, n_children long, contents {CONTENTS}"
_POINT = 4 * len(SURFEL)
_BATCH_BYTES = 4 << 20


@dataclass
class Index:
    """Of each node in the order of the file: where it begins, its surfels and children, its parent's place (-1: none) and level."""

    depth_first: bool
    at: np.ndarray
    points: np.ndarray
    kids: np.ndarray
    leaf: np.ndarray
    parent: np.ndarray
    level: np.ndarray


def index_of(path: str) -> Index:
    fs, p = _filesystem(path)
    at, points, kids, leaf = [], [], [], []
    with fs.open_input_file(p) as f:
        size = f.size()
        depth_first = f.read(1) == b"\x01"
        pos = 1
        head = f.read(5)
        while pos < size:
            if len(head) < 5:
                raise ValueError(f"{path} ends inside a node")
            is_leaf, n = struct.unpack("<?I", head)
            at.append(pos)
            points.append(n)
            leaf.append(is_leaf)
            pos += 5 + n * _POINT
            f.seek(pos)
            if depth_first or not is_leaf:
                raw = f.read(9)  # the children, and the next node's first bytes
                if len(raw) < 4:
                    raise ValueError(f"{path} ends inside a node")
                kids.append(struct.unpack("<I", raw[:4])[0])
                head, pos = raw[4:], pos + 4
            else:
                kids.append(0)
                head = f.read(5)
    made = [np.array(x, t) for x, t in ((at, np.int64), (points, np.int64), (kids, np.int64), (leaf, bool))]
    return Index(depth_first, *made, *(_deep if depth_first else _broad)(made[2]))


def _broad(kids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level by level children follow in the order of their parents."""
    parent = np.concatenate([[-1], np.repeat(np.arange(len(kids)), kids)])[: len(kids)]
    level = np.zeros(len(kids), np.int32)
    first, end = 0, 1
    while end < len(kids):
        more = int(kids[first:end].sum())
        level[end : end + more] = level[first] + 1
        first, end = end, end + more
        if not more:
            raise ValueError("nodes without a parent")
    return parent, level


def _deep(kids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parent, level = np.full(len(kids), -1), np.zeros(len(kids), np.int32)
    open_: list[list[int]] = []  # nodes whose children aren't all there, and how many are missing
    for i, n in enumerate(kids.tolist()):
        if open_:
            parent[i], level[i] = open_[-1][0], len(open_)
            open_[-1][1] -= 1
        if n:
            open_.append([i, n])
        while open_ and not open_[-1][1]:
            open_.pop()
    return parent, level


@dataclass
class Split(InputPartition):
    path: str
    first: int
    at: np.ndarray
    points: np.ndarray
    kids: np.ndarray
    leaf: np.ndarray
    parent: np.ndarray
    level: np.ndarray


class OctreeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.bytes = int(options.get("bytes_per_split", 64 << 20))

    def partitions(self):
        i = index_of(self.path)
        edges = np.flatnonzero(np.diff((i.at - 1) // self.bytes, prepend=-1))
        return [Split(self.path, int(lo), *(x[lo:hi] for x in (i.at, i.points, i.kids, i.leaf, i.parent, i.level))) for lo, hi in zip(edges, [*edges[1:], len(i.at)])] or [Split("", 0, *[np.zeros(0, np.int64)] * 6)]

    def read(self, split):
        lo, n = 0, len(split.at)
        fs, p = _filesystem(split.path)
        while lo < n:
            ahead = np.cumsum(split.points[lo:] * _POINT)
            hi = lo + max(1, int(np.searchsorted(ahead, _BATCH_BYTES, "right")))
            with fs.open_input_file(p) as f:
                parts = []
                for at, count in zip(split.at[lo:hi].tolist(), split.points[lo:hi].tolist()):
                    f.seek(at + 5)
                    parts.append(f.read(count * _POINT))
            flat = np.frombuffer(b"".join(parts), "<f4").reshape(-1, len(SURFEL))
            ends = np.concatenate([[0], np.cumsum(split.points[lo:hi])])
            surfels = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(SURFEL))], SURFEL)
            up = split.parent[lo:hi]
            columns = [pa.array(np.arange(split.first + lo, split.first + hi)), pa.array(up, mask=up < 0), pa.array(split.level[lo:hi].astype(np.int32)), pa.array(split.leaf[lo:hi].astype(bool)), pa.array(split.kids[lo:hi]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), surfels)]
            yield pa.RecordBatch.from_arrays(columns, ["nth", "parent", "level", "is_leaf", "n_children", "contents"])
            lo = hi


class OctreeFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "octree_file"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return OctreeReader(self.options)


def read(spark: SparkSession, path: str, bytes_per_split: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(OctreeFile)
    return spark.read.format("octree_file").option("bytes_per_split", bytes_per_split).load(path)


def coded(nodes: DataFrame, slots: DataFrame) -> DataFrame:
    """Nodes of a file with `morton`: slots (nth, slot) has the octant of each in its parent.  A join for each level."""
    known = nodes.join(slots, "nth", "left")
    now = known.where("level = 0").withColumn("morton", F.lit(1).cast("long"))
    out, deepest = now, nodes.agg(F.max("level")).first()[0] or 0
    for lv in range(1, deepest + 1):
        up = now.select(F.col("nth").alias("parent"), F.shiftleft("morton", 3).alias("above"))
        now = known.where(F.col("level") == lv).join(up, "parent").withColumn("morton", F.col("above").bitwiseOR(F.col("slot"))).drop("above")
        out = out.unionByName(now.select(out.columns))
    return out.drop("slot")


def write(nodes: DataFrame, path: str, depth_first: bool, deepest: int) -> None:
    """nodes: morton, level, is_leaf, n_children, contents (CONTENTS) of a whole tree."""
    if depth_first:
        order = dict(zip(("first__", "second__"), morton.preorder(F.col("morton"), deepest)))
    else:
        order = {"first__": F.col("level"), "second__": F.col("morton")}
    rows = nodes.select(*[c.alias(k) for k, c in order.items()], "is_leaf", F.col("n_children").cast("long").alias("n_children"), "contents")

    def records(batches):
        for batch in batches:
            first, second, leaf, kids, lists = batch.columns
            surfels = lists.flatten()
            flat = np.stack([surfels.field(k).to_numpy(zero_copy_only=False).astype("<f4") for k in range(len(SURFEL))], 1) if len(surfels) else np.zeros((0, len(SURFEL)), "<f4")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            made = []
            for is_leaf, n_kids, n, e in zip(leaf.to_pylist(), kids.to_pylist(), sizes.tolist(), ends.tolist()):
                tail = struct.pack("<I", 0 if is_leaf else n_kids) if depth_first or not is_leaf else b""
                made.append(struct.pack("<?I", is_leaf, n) + flat[e - n : e].tobytes() + tail)
            yield pa.RecordBatch.from_arrays([first, second, pa.array(made, pa.binary())], ["first__", "second__", "record"])

    kinds = {k: t for k, t in rows.dtypes}
    packed = stored(rows.mapInArrow(records, f"first__ {kinds['first__']}, second__ {kinds['second__']}, record binary"), "records")
    fs, p = _filesystem(path)
    with fs.open_output_stream(p) as out:
        out.write(b"\x01" if depth_first else b"\x00")
        # partitions come one after another, never the whole file at once
        for r in packed.orderBy("first__", "second__").select("record").toLocalIterator():
            out.write(bytes(r["record"]))
