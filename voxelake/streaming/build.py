"""Incremental construction and running statistics with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import hierarchy, keyed, points
from voxelake.sources.shared import Folder, work_dir


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 64, bytes_per_trigger: int | None = None) -> DataFrame:
    """The files of a parquet table (a file or a folder) as a stream; a batch is admitted by number of files, or by bytes where
    these are given."""
    schema = spark.read.parquet(path).schema
    admitted = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    reader = spark.readStream.schema(schema).option(*admitted)
    if _is_file(spark, path):
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = Folder(spark, path)
    return at._fs.getFileStatus(at.at("")).isFile()


class IncrementalTree:
    """Node counts of every level, as signed changes batch by batch.  A micro-batch writes the counts of its own points (those taken
    away are negative) as a run and reads nothing.  FOLD runs of one size are summed into one of the next (`fold`), so a
    change is written anew a logarithmic number of times, and totals sum a logarithmic number of runs.  A run is named by its size
    and its batches, so a batch or a fold that runs again replaces itself.  A mark at the end of the input makes the tree complete."""

    FOLD = 4
    NODES = "level int, morton long, n_points long"

    def __init__(self, spark: SparkSession, path: str, level: int):
        self.spark, self.level = spark, level
        self.folder = Folder(spark, path)
        self.path = self.folder.path

    def _name(self, size: int, first: int, last: int) -> str:
        return f"{size:02d}-{first:09d}-{last:09d}"

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.schema(self.NODES).parquet(*[f"{self.path}/runs/{n}" for n in names])

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.NODES)
        return self._read(*names).groupBy("level", "morton").agg(F.sum("n_points").alias("n_points")).where("n_points <> 0")

    def add(self, batch: DataFrame, batch_id: int, taken: DataFrame | None = None) -> None:
        """batch: points with morton of `level` that come; taken: such that go."""
        cells = hierarchy.cells(batch)
        if taken is not None:
            cells = cells.unionByName(hierarchy.cells(taken).withColumn("n", -F.col("n")))
        hierarchy.pyramid(cells, self.level).write.mode("overwrite").parquet(f"{self.path}/runs/{self._name(0, batch_id, batch_id)}")

    def fold(self, batch_id: int) -> None:
        """What is due after a batch: FOLD runs of each size that it completes become one of the next size."""
        size, width = 1, self.FOLD
        while (batch_id + 1) % width == 0:
            first = batch_id + 1 - width
            step = width // self.FOLD
            parts = [self._name(size - 1, first + i * step, first + (i + 1) * step - 1) for i in range(self.FOLD)]
            self._sum(parts).write.mode("overwrite").parquet(f"{self.path}/runs/{self._name(size, first, batch_id)}")
            size, width = size + 1, width * self.FOLD

    def cover(self, before: int | None = None) -> list[str]:
        """The fewest runs that hold all batches, or those before one."""
        known: dict[int, tuple[int, str]] = {}
        for name in self.folder.names("runs"):
            _, first, last = map(int, name.split("-"))
            if (before is None or last < before) and last >= known.get(first, (-1, ""))[0]:
                known[first] = (last, name)
        out, at = [], 0
        while at in known:
            at, name = known[at][0] + 1, known[at][1]
            out.append(name)
        return out

    def nodes(self, before: int | None = None) -> DataFrame:
        """level, morton, n_points of all nodes (cells included), or as they were before a batch."""
        return self._sum(self.cover(before))

    def touched(self, batch_id: int) -> DataFrame:
        """The nodes that a batch changed."""
        return self._read(self._name(0, batch_id, batch_id)).select("level", "morton")

    def last_batch(self) -> int | None:
        names = [n for n in self.folder.names("runs") if n.startswith("00-")]
        return int(names[-1][-9:]) if names else None

    def clean(self) -> None:
        """Deletes runs that a larger one holds, when nobody reads them any more; the last batch's own stays."""
        kept = {*self.cover(), self._name(0, self.last_batch() or 0, self.last_batch() or 0)}
        for name in self.folder.names("runs"):
            if name not in kept:
                self.folder.drop(f"runs/{name}")

    def pyramid(self) -> DataFrame:
        return self.nodes().where(F.col("level") < self.level)

    def finish(self) -> None:
        """The end of the input."""
        self.folder.publish("complete", {"last": self.last_batch()})

    def complete(self) -> bool:
        return self.folder.read("complete") is not None


def followed(spark: SparkSession, path: str, level: int, to_points: Callable[[DataFrame], DataFrame], whole: DataFrame, each: Callable[[IncrementalTree, int], None] | None = None, files_per_trigger: int = 64, bytes_per_trigger: int | None = None) -> IncrementalTree:
    """Builds a tree from the files of a table as a stream, to its end; `whole` gives the bounds (a first pass), `each` is called
    after every batch."""
    folder = work_dir(spark, "stream-build")
    tree = IncrementalTree(spark, f"{folder}/tree", level)
    grid = points.bounds(whole).first()
    fixed = spark.createDataFrame([tuple(grid)[:7]], "ox double, oy double, oz double, sx double, sy double, sz double, scale double")

    def add(batch: DataFrame, batch_id: int) -> None:
        tree.add(points.with_morton(to_points(batch), level, fixed), batch_id)
        tree.fold(batch_id)
        if each is not None:
            each(tree, batch_id)

    q = file_stream(spark, path, files_per_trigger, bytes_per_trigger).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    tree.finish()
    return tree


def build_from_stream(spark: SparkSession, path: str, level: int, to_points: Callable[[DataFrame], DataFrame], whole: DataFrame) -> DataFrame:
    """Node counts of every level, built batch by batch."""
    return followed(spark, path, level, to_points, whole).pyramid()


def answered(spark: SparkSession, asked: str, nodes: DataFrame, level: int) -> DataFrame:
    """A stream of requests (files of intervals a, b, the children of a node) answered batch by batch from a node table: each
    interval once, whichever batches it is in; a batch that runs again writes the same."""
    folder = work_dir(spark, "requests")
    seen = Folder(spark, f"{folder}/seen")

    def each(batch: DataFrame, batch_id: int) -> None:
        new = keyed.requests(batch)
        earlier = [n for n in seen.names("") if int(n) < batch_id]
        if earlier:
            new = new.join(spark.read.schema("a long, b long").parquet(*[f"{seen.path}/{n}" for n in earlier]), ["a", "b"], "left_anti")
        new.write.mode("overwrite").parquet(f"{seen.path}/{batch_id:09d}")
        now = spark.read.schema("a long, b long").parquet(f"{seen.path}/{batch_id:09d}")
        keyed.answer(now, nodes, level).write.mode("overwrite").parquet(f"{folder}/out/{batch_id:09d}")

    q = file_stream(spark, asked, 1).writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    shape = keyed.answer(spark.createDataFrame([], "a long, b long"), nodes, level).schema
    return spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def running_stats(spark: SparkSession, path: str) -> DataFrame:
    """Count, average (of cents, cut after six digits) and maximum by event type, kept by a stateful aggregation and upserted by key."""
    folder = work_dir(spark, "stream-stats")
    stats = file_stream(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("value").alias("max_value"))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("seq", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = stats.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.groupBy("event_type").agg(F.max(F.struct("seq", "n", "cents", "max_value")).alias("r"))
    return last.select("event_type", "r.n", (F.expr("(r.cents * 10000) div r.n") / F.lit(1000000.0)).alias("avg_value"), "r.max_value")
