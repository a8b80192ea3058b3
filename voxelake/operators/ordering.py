"""Z-order sorts, top-k, segments and scans that need no single-task window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many chunks have a partition each; more are put side by side into partitions of so many rows.
OWN_PARTITIONS, PARTITION_ROWS = 256, 1 << 16
#: Rows of a block, and blocks of a group of blocks, of the scans.
BLOCK_BITS, GROUP_BITS = 14, 14


def zorder(points: DataFrame, *tie: str) -> DataFrame:
    """Total order by (morton, tie): a range exchange and a sort that spills."""
    return points.orderBy("morton", *tie)


def zorder_layout(points: DataFrame, partitions: int, *tie: str) -> DataFrame:
    """Range-partitioned and sorted inside partitions: what a clustered table is written from."""
    return points.repartitionByRange(partitions, "morton").sortWithinPartitions("morton", *tie)


def first_rows(points: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k first rows in Z-order without sorting the rest."""
    return points.orderBy("morton", *tie).limit(k)


def _running(totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds `before`, the exclusive running sum of value in the order of keys[-1] within keys[:-1]."""
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def block_offsets(rows: DataFrame, index: Column, value: Column) -> DataFrame:
    """blk, base: the sum of value in all earlier blocks of 2^BLOCK_BITS indices.  Blocks are summed first, then
    groups of blocks; only the groups (one in 2^28 indices) meet in one task."""
    blocks = rows.groupBy(F.shiftright(index, BLOCK_BITS).alias("blk")).agg(F.sum(value).alias("total"))
    blocks = blocks.withColumn("grp", F.shiftright("blk", GROUP_BITS))
    inner = _running(blocks, ["grp", "blk"], "total")
    groups = blocks.groupBy("grp").agg(F.sum("total").alias("total"))
    outer = _running(groups.withColumn("all", F.lit(0)), ["all", "grp"], "total").select("grp", F.col("before").alias("group_base"))
    return inner.join(outer, "grp").select("blk", (F.col("before") + F.col("group_base")).alias("base"))


def prefix_scan(rows: DataFrame, index: str, value: Column, name: str = "prefix", inclusive: bool = False) -> DataFrame:
    """Adds the sum of value over all rows before (inclusive: and with) each one, in the order of an integer
    index column."""
    blk = F.shiftright(F.col(index).cast("long"), BLOCK_BITS)
    base = block_offsets(rows, F.col(index).cast("long"), value)
    w = Window.partitionBy("blk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = rows.withColumn("blk", blk).withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inside.join(base, "blk").withColumn(name, F.col(name) + F.col("base")).drop("blk", "base")


def compact(rows: DataFrame, index: str, flag: Column) -> DataFrame:
    """The flagged rows and their dense position in the order of index."""
    kept = rows.where(flag)
    return prefix_scan(kept, index, F.lit(1).cast("long"), "pos")


def cell_ranks(cells: DataFrame, level: int, super_level: int) -> DataFrame:
    """morton, n -> adds `before`, the number of points in all earlier cells: inside ancestors of super_level,
    then over these (at most 8^super_level rows meet in one task)."""
    up = F.shiftrightunsigned("morton", 3 * (level - super_level))
    inner = _running(cells.withColumn("sup", up), ["sup", "morton"], "n")
    supers = cells.groupBy(up.alias("sup")).agg(F.sum("n").alias("total"))
    outer = _running(supers.withColumn("all", F.lit(0)), ["all", "sup"], "total").select("sup", F.col("before").alias("base"))
    return inner.join(outer, "sup").select("morton", "n", (F.col("before") + F.col("base")).alias("before"))


def segments(points: DataFrame, level: int, count: int = 10, super_level: int = 3) -> DataFrame:
    """morton, segment, n: how many points of each cell fall into each of `count` equal segments of the Z-order
    (the first segments take the rest of the division, like ntile)."""
    cells = points.groupBy("morton").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    ranked = cell_ranks(cells, level, super_level).withColumn("total", total)
    small, rest = F.floor(F.col("total") / count), F.col("total") % count
    start = lambda s: s * small + F.least(s, rest)  # noqa: E731  first rank of segment s
    ids = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))
    parts = ranked.withColumn("s", F.explode(F.filter(ids, lambda s: (start(s) < F.col("before") + F.col("n")) & (start(s + 1) > F.col("before")))))
    taken = F.least(start(F.col("s") + 1), F.col("before") + F.col("n")) - F.greatest(start(F.col("s")), F.col("before"))
    return parts.select("morton", (F.col("s") + 1).cast("int").alias("segment"), taken.cast("long").alias("n"))


def ranked(points: DataFrame, level: int, super_level: int = 3, bits: int = 16) -> DataFrame:
    """Adds `rank`, the place of each row (morton, pid and others) in the order of (morton, pid): rows of one cell and 2^bits ids
    are numbered together, so a cell with a third of all rows is shared out, and the rest are sums of counts."""
    rows = points.withColumn("part__", F.shiftright("pid", bits))
    counts = rows.groupBy("morton", "part__").agg(F.count(F.lit(1)).alias("n"))
    inner = _running(counts, ["morton", "part__"], "n").withColumnRenamed("before", "inside__")
    ahead = cell_ranks(counts.groupBy("morton").agg(F.sum("n").alias("n")), level, super_level).select("morton", "before")
    base = inner.join(ahead, "morton").select("morton", "part__", (F.col("before") + F.col("inside__")).alias("base__"))
    nth = F.row_number().over(Window.partitionBy("morton", "part__").orderBy("pid")) - 1
    return rows.withColumn("nth__", nth).join(base, ["morton", "part__"]).withColumn("rank", (F.col("nth__") + F.col("base__")).cast("long")).drop("part__", "nth__", "base__")


def chunks(points: DataFrame, level: int, quota: int, super_level: int = 3) -> DataFrame:
    """Points with `chunk`, of `quota` rows each in the order of (morton, pid) whatever the skew, every chunk whole and sorted in one
    partition: rows are placed there directly, without sampling for borders.  A chunk has a partition of its own while there are
    few; many small ones lie one after another in partitions of some PARTITION_ROWS rows, as a task for each would cost more than its
    rows, and its report to the driver as well."""
    placed = ranked(points, level, super_level).withColumn("chunk", F.floor(F.col("rank") / quota).cast("int"))
    n = points.count()
    made = max(1, -(-n // quota))
    side = max(1, min(-(-made // OWN_PARTITIONS), PARTITION_ROWS // quota))
    return placed.repartitionById(-(-made // side), F.floor(F.col("chunk") / side).cast("int")).sortWithinPartitions("rank")


def write_run(cells: DataFrame, table: str, buckets: int) -> None:
    """A presorted run: counted cells (morton, n) as a table of the session's catalog in buckets of codes, one sorted file each."""
    _bucketed(cells.repartition(buckets, "morton"), table, buckets)


def _bucketed(cells: DataFrame, table: str, buckets: int) -> None:
    cells.write.mode("overwrite").bucketBy(buckets, "morton").sortBy("morton").saveAsTable(table)


def merged(spark: SparkSession, run: str, other: str) -> DataFrame:
    """morton, n of two runs of the same number of buckets: each bucket is merged by itself, without an exchange."""
    more = spark.table(other).select("morton", F.col("n").alias("more"))
    return spark.table(run).select("morton", "n").hint("merge").join(more, "morton", "full_outer").select("morton", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))


def merge_runs(spark: SparkSession, tables: list[str], into: str, buckets: int) -> DataFrame:
    """Runs put together one after another, each result a run again (rows are in their buckets already, so writing exchanges
    nothing either); to append a run is one more such step.  (A union of bucketed tables claims to keep their buckets in Spark
    4.1.2, but sums over it come out by table, so it isn't used here.)"""
    now = tables[0]
    for i, name in enumerate(tables[1:]):
        made = into if i == len(tables) - 2 else f"{into}_{i}"
        _bucketed(merged(spark, now, name), made, buckets)
        if i:
            spark.sql(f"DROP TABLE {now}")
        now = made
    return spark.table(now)


def level_to_substitute(pending: DataFrame) -> DataFrame:
    """level, n -> the level with most pending insertions, of equals the deepest; no row if all are empty."""
    return pending.where("n > 0").orderBy(F.desc("n"), F.desc("level")).limit(1)
