"""Octrees on disk: a Parquet table clustered by level and code, its metadata as JSON, and progressive reading."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import points as point_ops
from voxelake.sources import ply
from voxelake.sources.shared import Folder, work_dir


@dataclass
class Meta:
    points: str
    nodes: str
    size: tuple[float, float, float]
    origin: tuple[float, float, float]
    depth: int
    database: str = ""


def write_meta(meta: Meta, path: str) -> None:
    axes = lambda v: dict(zip("xyz", v))
    fs, p = ply._filesystem(path)
    with fs.open_output_stream(p) as out:
        out.write(json.dumps({"points": meta.points, "database": meta.database, "nodes": meta.nodes, "size": axes(meta.size), "origin": axes(meta.origin), "depth": meta.depth}).encode())


def read_meta(path: str) -> Meta:
    """A missing origin reads as 0."""
    fs, p = ply._filesystem(path)
    with fs.open_input_file(p) as f:
        d = json.loads(f.read())
    axes = lambda k: tuple(float(d.get(k, {}).get(a, 0)) for a in "xyz")
    return Meta(d.get("points", ""), d.get("nodes", ""), axes("size"), axes("origin"), int(d["depth"]), d.get("database", ""))


def write_breadth(nodes: DataFrame, path: str, files: int | None = None) -> None:
    """Level by level (one folder each), sorted by code inside a level, with the zones of its files; then a mark for each level,
    for progressive readers.  files: how many to spread the nodes over (default: as many as a shuffle has partitions)."""
    dealt = nodes.repartitionByRange("level", "morton") if files is None else nodes.repartitionByRange(files, "level", "morton")
    dealt.sortWithinPartitions("level", "morton").write.mode("overwrite").partitionBy("level").parquet(path)
    zones(nodes.sparkSession.read.parquet(path)).coalesce(1).write.mode("overwrite").parquet(_zones(path))
    levels = sorted(int(n.removeprefix("level=")) for n in Folder(nodes.sparkSession, path).names("") if n.startswith("level="))
    for lv in levels:
        _mark(nodes.sparkSession, path, lv, lv == levels[-1])


def write_level(nodes: DataFrame, path: str, level: int, last: bool) -> None:
    """One level more of a table that is being written, for readers that wait for it."""
    nodes.drop("level").repartitionByRange("morton").sortWithinPartitions("morton").write.mode("overwrite").parquet(f"{path.rstrip('/')}/level={level}")
    _mark(nodes.sparkSession, path, level, last)


def _mark(spark: SparkSession, path: str, level: int, last: bool) -> None:
    Folder(spark, _marks(path)).publish(f"{level:02d}.json", {"level": level, "last": last})


def zones(nodes: DataFrame) -> DataFrame:
    """file, level, first, last, n: the codes that each file of a level-by-level table begins and ends with; reads codes only."""
    return nodes.groupBy(F.col("_metadata.file_name").alias("file"), F.col("level").cast("int").alias("level")).agg(F.min("morton").alias("first"), F.max("morton").alias("last"), F.count(F.lit(1)).alias("n"))


def _zones(path: str) -> str:
    return f"{path.rstrip('/')}-zones"


class Stored:
    """A level-by-level table with its zones (a row for each file, on the driver like the list of files itself): gives scans of
    the files that can hold codes of given intervals, and of no others."""

    FEW = 10_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        here = Folder(spark, self.path)
        known = spark.read.parquet(_zones(path)) if here.names("") and here._fs.exists(here._path(_zones(path))) else zones(spark.read.parquet(path))
        rows = sorted(known.collect(), key=lambda r: (r["level"], r["first"], r["last"]))
        self.files = {lv: [r for r in rows if r["level"] == lv] for lv in {r["level"] for r in rows}}
        self.deepest = max(self.files, default=-1)
        self.schema = spark.read.parquet(self.path).schema

    def read(self, levels, under: DataFrame | None = None) -> DataFrame | None:
        """Rows of some levels, of the files that hold something below the codes of `under` (morton, level); None if there is none."""
        if under is None:
            return self._scan([(lv, i) for lv in levels for i in range(len(self.files.get(lv, ())))])
        down = [F.struct(F.lit(lv).alias("level"), (F.lit(lv) - F.col("level")).alias("down")) for lv in levels]
        rows = under.select("morton", F.explode(F.array(*down)).alias("d")).where("d.down > 0")
        first = lambda c: F.call_function("shiftleft", c, F.col("d.down") * 3)
        return self.within(rows.select("d.level", first(F.col("morton")).alias("a"), (first(F.col("morton") + 1) - 1).alias("b")))

    def children(self, of: DataFrame) -> DataFrame | None:
        """Rows of the files that hold children of nodes (morton, level)."""
        iv = morton.child_interval(F.col("morton"))
        return self.within(of.select((F.col("level") + 1).alias("level"), iv["a"].alias("a"), iv["b"].alias("b")))

    def within(self, intervals: DataFrame) -> DataFrame | None:
        """Rows of the files that meet closed intervals (level, a, b) of codes.  Up to FEW intervals are looked up by the driver; more
        stay distributed, and what comes back is the distinct files."""
        firsts = {lv: np.array([f["first"] for f in fs]) for lv, fs in self.files.items()}
        lasts = {lv: np.maximum.accumulate([f["last"] for f in fs]) for lv, fs in self.files.items()}

        def files(level, a, b):
            for lv in np.unique(level):
                if lv in firsts:
                    lo = np.searchsorted(lasts[lv], a[level == lv], "left")
                    hi = np.searchsorted(firsts[lv], b[level == lv], "right")
                    edge = np.zeros(len(firsts[lv]) + 1, np.int64)
                    np.add.at(edge, lo[hi > lo], 1)
                    np.add.at(edge, hi[hi > lo], -1)
                    yield int(lv), np.flatnonzero(np.cumsum(edge[:-1]) > 0)

        def met(batches):
            for batch in batches:
                for lv, at in files(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lv, np.int32)), pa.array(at.astype(np.int32))], ["level", "file"])

        asked = intervals.select(F.col("level").cast("int"), "a", "b")
        few = asked.limit(self.FEW + 1).collect()
        if len(few) <= self.FEW:
            columns = [np.array([r[k] for r in few], np.int64) for k in ("level", "a", "b")]
            return self._scan([(lv, int(i)) for lv, at in files(*columns) for i in at])
        found = asked.mapInArrow(met, "level int, file int").distinct().collect()
        return self._scan([(r["level"], r["file"]) for r in found])

    def _scan(self, found: list[tuple[int, int]]) -> DataFrame | None:
        if not found:
            return None
        names = [f"{self.path}/level={lv}/{self.files[lv][i]['file']}" for lv, i in sorted(found)]
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*names)


def _marks(path: str) -> str:
    return f"{path.rstrip('/')}-levels"


def write_depth(nodes: DataFrame, path: str, deepest: int) -> None:
    """In depth-first order."""
    lifted, lv = morton.preorder(F.col("morton"), deepest)
    nodes.withColumns({"pre": lifted, "pre_level": lv}).repartitionByRange("pre", "pre_level").sortWithinPartitions("pre", "pre_level").drop("pre", "pre_level").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_progressively(spark: SparkSession, path: str, on_level: Callable[[int, DataFrame], None], seconds: float | None = None) -> int:
    """Publishes levels from the root on, as soon as each is there as a whole: a stream of the levels' marks, which waits for
    a writer that isn't done; queries are gated by level <= the last one published.  Returns the last level.  Needs
    the level-by-level layout.  seconds: how long to wait for the rest (an error beyond that)."""
    marks = Folder(spark, _marks(path))
    if Folder(spark, path).names("") and not marks.names(""):
        raise ValueError("only a level-by-level table can be read progressively")
    marks._fs.mkdirs(marks.at(""))
    kind = spark.createDataFrame([], "level int, last boolean").schema
    here: dict[int, bool] = {}
    state = {"next": 0}
    done = threading.Event()

    def each(batch: DataFrame, batch_id: int) -> None:
        here.update({r["level"]: r["last"] for r in batch.collect()})  # at most 21 in all
        while (lv := state["next"]) in here and not done.is_set():
            on_level(lv, spark.read.parquet(f"{path.rstrip('/')}/level={lv}").withColumn("level", F.lit(lv)))
            state["next"] = lv + 1
            if here[lv]:
                done.set()

    stream = spark.readStream.schema(kind).json(_marks(path)).writeStream.foreachBatch(each)
    q = stream.option("checkpointLocation", work_dir(spark, "levels")).trigger(processingTime="100 milliseconds").start()
    left = seconds
    try:
        while not done.wait(0.1):
            if not q.isActive:
                raise q.exception() or RuntimeError("the stream of levels ended")
            if left is not None and (left := left - 0.1) <= 0:
                raise TimeoutError(f"level {state['next']} of {path} isn't there")
    finally:
        q.stop()
    return state["next"] - 1


def sort_to_file(cloud: DataFrame, level: int, ply_path: str, oct_path: str, *tie: str) -> Meta:
    """A point table (x, y, z, nx, ny, nz) as one PLY file in Z-order (ties by the named columns), with its metadata beside it."""
    grid = point_ops.bounds(cloud)
    # the file keeps the points as they are; only their order is that of the normalised ones
    codes = point_ops.with_morton(cloud.withColumns({f"raw_{a}": F.col(a) for a in "xyz"}), level, grid)
    rows = codes.select("morton", *tie, *[F.col(f"raw_{a}").alias(a) for a in "xyz"], "nx", "ny", "nz")
    ply.write(rows, ply_path, index=["morton", *tie])
    b = grid.first()
    meta = Meta(ply_path, "", (b.sx, b.sy, b.sz), (b.ox, b.oy, b.oz), level)
    write_meta(meta, oct_path)
    return meta


def open_cloud(spark: SparkSession, path: str) -> tuple[str, DataFrame, Meta | None]:
    """By the file's ending: ("octree", nodes, meta) of an .oct file, ("points", points, None) of a .ply or .gp."""
    if path.endswith(".oct"):
        meta = read_meta(path)
        return "octree", read(spark, meta.nodes), meta
    if path.endswith(".ply"):
        return "points", ply.read(spark, path), None
    if path.endswith(".gp"):
        return "points", ply.read_group(spark, path), None
    raise ValueError(f"don't know how to open {path}")


def write_report(stats: DataFrame, path: str) -> None:
    """A statistics table as JSON lines."""
    stats.write.mode("overwrite").json(path)
