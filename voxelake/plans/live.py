"""Registered queries that run a stream to the end of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import ordering, points
from voxelake.plans.catalog import LEAF, LEVEL, NODES_SQL, ORACLE, built, line_points, query, stored_nodes, table
from voxelake.sources import octree_store
from voxelake.sources.shared import work_dir
from voxelake.streaming import build
from voxelake.streaming import front as live_front


def _to_points(d):
    return d.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def _files(spark, sf_dir) -> str:
    """LINE as a table of several files."""
    files = work_dir(spark, "line")
    table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount").repartition(6).write.parquet(files)
    return files


def _places(spark, sf_dir, files: str) -> live_front.Placeholders:
    """The placeholders of LINE's leaves, two files a batch."""
    places = live_front.Placeholders(spark, work_dir(spark, "placeholders"), LEAF)
    meta = octree_store.read_meta(built(spark, sf_dir).oct)
    most = max(meta.size)
    grid = spark.createDataFrame([(*meta.origin, *meta.size, 1.0 / most if most > 0 else 1.0)], "ox double, oy double, oz double, sx double, sy double, sz double, scale double")
    places.follow(points.with_morton(_to_points(build.file_stream(spark, files, 2)), LEVEL, grid), LEVEL)
    return places


@query("stream_placeholders", ORACLE["placeholder_substitution"])
def stream_placeholders(spark, sf_dir):
    """Placeholders that batches left behind, with what stands for them at the end."""
    places = _places(spark, sf_dir, _files(spark, sf_dir))
    return places.substituted(stored_nodes(spark, sf_dir).where("n_points >= 40"))


@query(
    "stream_pending",
    f"{NODES_SQL}, u AS MATERIALIZED (SELECT p.morton AS placeholder, max(ld.morton) AS substitute FROM (SELECT morton, morton >> (3 * k) AS code FROM nodes, (SELECT unnest(range(0, {LEAF + 1})) AS k) WHERE is_leaf) p LEFT JOIN (SELECT morton FROM nodes WHERE n_points >= 40) ld ON p.code = ld.morton GROUP BY 1) "
    f"SELECT {morton.sql_level('substitute')} AS level, count(*) AS n FROM u WHERE substitute <> placeholder GROUP BY 1",
)
def stream_pending(spark, sf_dir):
    """Pending insertions by the level that stands for them."""
    places = _places(spark, sf_dir, _files(spark, sf_dir))
    return places.pending(stored_nodes(spark, sf_dir).where("n_points >= 40"))


@query("stream_prunable", f"{NODES_SQL} SELECT parent_morton AS parent, count(*) AS n_here, count(*) AS n_children, true AS complete, true AS prunable FROM nodes WHERE is_leaf GROUP BY 1")
def stream_prunable(spark, sf_dir):
    """After the end mark every complete group of leaves may be pruned."""
    files = _files(spark, sf_dir)
    tree = build.followed(spark, files, LEVEL, _to_points, line_points(spark, sf_dir), files_per_trigger=2)
    return live_front.prunable(_places(spark, sf_dir, files).all(), stored_nodes(spark, sf_dir), tree)


@query("stream_requests", ORACLE["interval_requests"])
def stream_requests(spark, sf_dir):
    """Requests that arrive in files, some of them more than once, answered from the node table."""
    n = stored_nodes(spark, sf_dir)
    iv = morton.child_interval(F.shiftrightunsigned("parent_morton", 3))
    asked = n.where("level = 6 and n_points >= 4").select(iv["a"].alias("a"), iv["b"].alias("b"))
    folder = work_dir(spark, "asked")
    asked.repartition(3).write.parquet(folder)
    return build.answered(spark, folder, n.where("level = 5").select("morton", "n_points"), 5)


@query("completion_steps", "SELECT step, min(event_id) AS event_id FROM (SELECT event_id, ((row_number() OVER (ORDER BY event_id)) * 10 // count(*) OVER () * 10)::INTEGER AS step FROM events) GROUP BY 1")
def completion_steps(spark, sf_dir):
    """The first event at which each tenth of all events is complete."""
    e = table(spark, sf_dir, "events").select("event_id")
    placed = ordering.compact(e, "event_id", F.lit(True)).withColumn("n", e.agg(F.count(F.lit(1)).alias("n")).scalar())
    step = (F.floor((F.col("pos") + 1) * 10 / F.col("n")) * 10).cast("int")
    return placed.groupBy(step.alias("step")).agg(F.min("event_id").alias("event_id"))
