"""Registered queries on files, runs and chunks of points, budgets, and the deepest level."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import hierarchy, ordering, points
from voxelake.plans.catalog import EVENTS_SQL, LEAF, LEVEL, LINE_CELLS, NODES_SQL, SAMPLED_SQL, event_points, grid_sql, line_points, line_sampled, query, stored_nodes, table
from voxelake.sources import octree_file
from voxelake.sources.shared import root, work_dir


def _with_contents(nodes):
    """LINE's nodes with one surfel each, made of what the node has."""
    values = {"cx": F.col("n_points"), "cy": F.col("level"), "cz": F.col("n_children"), "ux": F.col("morton") % 1000, "uy": F.lit(1), "uz": F.lit(0), "vx": F.lit(0), "vy": F.lit(0), "vz": F.lit(1)}
    surfel = F.struct(*[v.cast("float").alias(k) for k, v in values.items()])
    return nodes.select("morton", "level", "is_leaf", "n_children", F.array_repeat(surfel, (F.col("n_points") % 3).cast("int")).alias("contents"))


_ROUND_TRIP_SQL = f"{NODES_SQL} SELECT morton, level, is_leaf, n_children, n_points % 3 AS n_surfels, CASE WHEN n_points % 3 > 0 THEN n_points END::DOUBLE AS cx, CASE WHEN n_points % 3 > 0 THEN morton % 1000 END::DOUBLE AS ux FROM nodes"


def _round_trip(spark, sf_dir, depth_first: bool):
    """Codes come back by the octants, which the file doesn't have; they are given by place."""
    nodes = stored_nodes(spark, sf_dir)
    path = f"{root(spark)}/{work_dir(spark, 'tree').rpartition('/')[2]}.boc"
    octree_file.write(_with_contents(nodes), path, depth_first, LEAF)
    read = octree_file.read(spark, path, 1 << 18)
    order = list(morton.preorder(F.col("morton"), LEAF)) if depth_first else [F.col("level"), F.col("morton")]
    placed = nodes.select(F.struct(*order).alias("o"), (F.col("morton") % 8).alias("slot"))
    lifted = placed.withColumn("key", (F.col("o.col1").cast("long") * 32 + F.col("o.col2").cast("long")) if depth_first else F.col("o.morton"))
    slots = ordering.prefix_scan(lifted.select("key", "slot"), "key", F.lit(1).cast("long"), "nth").select("nth", "slot")
    found = octree_file.coded(read, slots)
    first = F.get("contents", F.lit(0))
    return found.select("morton", "level", "is_leaf", "n_children", F.size("contents").cast("long").alias("n_surfels"), first["cx"].cast("double").alias("cx"), first["ux"].cast("double").alias("ux"))


@query("octree_file_breadth", _ROUND_TRIP_SQL)
def octree_file_breadth(spark, sf_dir):
    """LINE's nodes as a binary file level by level, read back by many tasks."""
    return _round_trip(spark, sf_dir, False)


@query("octree_file_depth", _ROUND_TRIP_SQL)
def octree_file_depth(spark, sf_dir):
    return _round_trip(spark, sf_dir, True)


RUNS = 16


@query("merged_runs", f"{LINE_CELLS} SELECT morton, n FROM c")
def merged_runs(spark, sf_dir):
    """Three presorted runs of LINE's cells, merged bucket by bucket."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), F.pmod("l_orderkey", F.lit(3)).alias("run"))
    cells = points.with_morton(t, LEVEL, points.bounds(line_points(spark, sf_dir))).groupBy("run", "morton").agg(F.count(F.lit(1)).alias("n"))
    name = work_dir(spark, "run").rpartition("/")[2].replace("-", "_")
    tables = [f"{name}_{i}" for i in range(3)]
    for i, made in enumerate(tables):
        ordering.write_run(cells.where(F.col("run") == i).select("morton", "n"), made, RUNS)
    out = ordering.merge_runs(spark, tables, f"{name}_all", RUNS)
    for made in tables:
        spark.sql(f"DROP TABLE {made}")
    return out


CHUNK = 150


@query(
    "equal_chunks",
    f"WITH {grid_sql(EVENTS_SQL, 6)}, r AS (SELECT morton, pid, row_number() OVER (ORDER BY morton, pid) - 1 AS rank FROM m) "
    f"SELECT (rank // {CHUNK})::INTEGER AS chunk, count(*) AS n, min(morton) AS first_morton, max(morton) AS last_morton, arg_min(pid, rank) AS first_pid, arg_max(pid, rank) AS last_pid, 1::BIGINT AS n_partitions FROM r GROUP BY 1",
)
def equal_chunks(spark, sf_dir):
    """Chunks of as many points each, and that each is whole in one partition."""
    placed = ordering.chunks(points.with_morton(event_points(spark, sf_dir), 6).select("morton", "pid"), 6, CHUNK)
    here = placed.withColumn("at", F.spark_partition_id())
    return here.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("morton").alias("first_morton"), F.max("morton").alias("last_morton"), F.min_by("pid", "rank").alias("first_pid"), F.max_by("pid", "rank").alias("last_pid"), F.count_distinct("at").alias("n_partitions"))


@query(
    "memory_budget",
    f"""{LINE_CELLS}, {SAMPLED_SQL}, b AS (SELECT (36 * sum(n_contents)) // 2 AS most FROM sn), gs AS (SELECT level, morton >> 3 AS grp, 36 * sum(n_contents) AS bytes FROM sn GROUP BY sn.level, sn.morton >> 3),
u AS (SELECT level, grp, sum(bytes) OVER (ORDER BY level, grp) AS upto FROM gs)
SELECT sn.level, morton, n_contents, upto > most AS released FROM sn JOIN u ON u.level = sn.level AND u.grp = morton >> 3, b""",
)
def memory_budget(spark, sf_dir):
    """What a budget of half of all bytes releases of the sampled nodes."""
    s = line_sampled(spark, sf_dir)
    most = s.select(F.floor(F.sum("n_contents") * hierarchy.SURFEL_BYTES / 2).alias("b")).scalar()
    return hierarchy.within_budget(s, most).select("level", "morton", "n_contents", "released")


_DEEP = [f"CASE WHEN s{a} * scale * {2.0**-21!r} > 0 THEN floor({a} / (s{a} * scale * {2.0**-21!r})) ELSE 0 END::BIGINT" for a in "xyz"]
_DEEP_SQL = f"WITH {grid_sql(EVENTS_SQL, 1)}, e AS MATERIALIZED (SELECT pid, {morton.sql_encode_deep(*_DEEP)} AS code FROM n)"
_SIGNED = "CASE WHEN {c} >= 9223372036854775808::HUGEINT THEN {c} - 18446744073709551616::HUGEINT ELSE {c} END::BIGINT"


@query("deepest_pyramid", f"{_DEEP_SQL}, l AS (SELECT lv::INTEGER AS level, code // (8::HUGEINT ** (21 - lv))::HUGEINT AS c FROM e, (SELECT unnest(range(0, 22)) AS lv)) SELECT level, {_SIGNED.format(c='c')} AS morton, count(*) AS n_points FROM l GROUP BY 1, 2".replace("(8::HUGEINT ** (21 - lv))::HUGEINT", "(1::HUGEINT << (3 * (21 - lv))::INTEGER)"))
def deepest_pyramid(spark, sf_dir):
    """All levels down to 21, whose codes have the sign bit."""
    return hierarchy.pyramid(hierarchy.cells(points.with_morton(event_points(spark, sf_dir), 21)), 21)


@query("deepest_order", f"{_DEEP_SQL} SELECT {_SIGNED.format(c='code')} AS morton, pid FROM e ORDER BY code, pid LIMIT 500")
def deepest_order(spark, sf_dir):
    """The first points in the order of codes of level 21."""
    p = points.with_morton(event_points(spark, sf_dir), 21)
    return p.select("morton", "pid").orderBy(morton.sort_key(F.col("morton")), "pid").limit(500)
