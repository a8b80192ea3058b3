"""Fronts that go on from frame to frame, and a front over a tree that is still being built: placeholders, what substitutes
them, and which groups may be pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import front
from voxelake.sources.octree_store import Stored
from voxelake.sources.shared import Folder, work_dir
from voxelake.streaming.build import IncrementalTree, file_stream


class Tracker:
    """The fronts of all cameras, carried over frames: a table of (camera, node) rows for each frame, made from that of the frame
    before.

    A frame is one set-based step for all cameras (`front.track`).  Its result is written under (batch, frame), so a batch that
    runs again after a failure starts from what the batch before it left and replaces its own frames.  The state is spread over
    the cluster by (camera, parent); a keyed stateful operator would hold a camera's whole front in one task, and can't look
    children up in the node table.  A camera starts at the root with its first view and keeps its front in frames without
    one.  Of several views of a camera in one frame the one with the least matrix counts."""

    def __init__(self, spark: SparkSession, path: str, tree: Stored, grid: Column):
        self.spark, self.tree, self.grid = spark, tree, grid
        self.folder = Folder(spark, path)

    def _name(self, batch_id: int, nth: int) -> str:
        return f"{batch_id:09d}-{nth:06d}"

    def _before(self, batch_id: int) -> DataFrame | None:
        names = [n for n in self.folder.names("") if int(n[:9]) < batch_id]
        return self._read(names[-1]) if names else None

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.schema(f"frame long, {front.FRONT}, is_culled boolean").parquet(*[f"{self.folder.path}/{n}" for n in names])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of views (frame and front.VIEWS), whose frames are taken in order."""
        now = self._before(batch_id)
        for nth, frame in enumerate(sorted(r["frame"] for r in batch.select("frame").distinct().collect())):
            views = batch.where(F.col("frame") == frame).groupBy("camera").agg(F.min(F.struct("m", "threshold", "max_depth")).alias("v")).select("camera", "v.*")
            fronts = front.start(views, self.tree) if now is None else self._joined(now, views)
            seen = front.track(fronts, self.tree, self.grid, views).withColumn("frame", F.lit(frame).cast("long"))
            seen.write.mode("overwrite").parquet(f"{self.folder.path}/{self._name(batch_id, nth)}")
            now = self._read(self._name(batch_id, nth))

    def _joined(self, now: DataFrame, views: DataFrame) -> DataFrame:
        """The fronts so far, and those of cameras that are new."""
        kept = now.drop("frame", "is_culled")
        new = views.join(kept.select("camera").distinct(), "camera", "left_anti")
        return kept.unionByName(front.start(new, self.tree))

    def frames(self) -> DataFrame:
        """frame and FRONT columns after each frame, with is_culled: in the front, but outside the view."""
        names = self.folder.names("")
        return self._read(*names) if names else self.spark.createDataFrame([], f"frame long, {front.FRONT}, is_culled boolean")


def tracked(spark: SparkSession, views: str, tree: Stored, grid: Column) -> DataFrame:
    """All frames of a stream of views (files of frame and front.VIEWS), to its end."""
    folder = work_dir(spark, "front")
    tracker = Tracker(spark, f"{folder}/frames", tree, grid)
    q = file_stream(spark, views, 1).writeStream.foreachBatch(tracker.add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return tracker.frames()


class Placeholders:
    """A placeholder for each leaf code, from the first batch that meets it: a stream that drops repeated codes in the state
    store, so a batch looks at its own rows and the state of their keys only, and a restart goes on from the checkpoint.  The
    sink's log makes each code stay single, whatever runs again."""

    def __init__(self, spark: SparkSession, path: str, leaf_level: int):
        self.spark, self.leaf_level = spark, leaf_level
        self.folder = Folder(spark, path)

    def follow(self, cells: DataFrame, level: int, trigger: dict | None = None) -> None:
        """Notes the leaves of a stream of rows with morton of `level`, to the end of what is there."""
        leaves = cells.select(morton.ancestor(F.col("morton"), level, self.leaf_level).alias("morton")).dropDuplicates(["morton"])
        q = leaves.writeStream.format("parquet").option("path", f"{self.folder.path}/codes").option("checkpointLocation", f"{self.folder.path}/state").trigger(**(trigger or {"availableNow": True})).start()
        q.awaitTermination()

    def all(self) -> DataFrame:
        """morton of every placeholder."""
        if not self.folder.names("codes"):
            return self.spark.createDataFrame([], "morton long")
        return self.spark.read.schema("morton long").parquet(f"{self.folder.path}/codes")

    def substituted(self, loaded: DataFrame) -> DataFrame:
        """placeholder, substitute: its deepest loaded ancestor, or itself (null: none yet)."""
        return front.substitute(self.all(), loaded, self.leaf_level)

    def pending(self, loaded: DataFrame) -> DataFrame:
        """level, n: placeholders that aren't loaded themselves, by the level of what stands for them now (null: nothing)."""
        rows = self.substituted(loaded).where(F.col("substitute").isNull() | (F.col("substitute") != F.col("placeholder")))
        return rows.groupBy(F.when(F.col("substitute").isNotNull(), morton.level_of(F.col("substitute"))).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def prunable(cut: DataFrame, nodes: DataFrame, tree: IncrementalTree) -> DataFrame:
    """complete_groups with `prunable`: all children of the parent are in the front, and no more can come.  Until the input
    has ended, groups that the last batch touched are held back, as the next one may go on with them."""
    groups = front.complete_groups(cut, nodes)
    last = tree.last_batch()
    if tree.complete() or last is None:
        return groups.withColumn("prunable", F.col("complete"))
    held = tree.touched(last).select(F.col("morton").alias("parent"), F.lit(True).alias("held")).distinct()
    return groups.join(held, "parent", "left").withColumn("prunable", F.col("complete") & F.col("held").isNull()).drop("held")
