"""Registered queries over the driver's tables, and the DuckDB SQL that must give the same rows.

Point sets: LINE has l_quantity, l_extendedprice and l_discount as x, y, z and no id; EVENTS has user_id,
value and event_id as x, y, z and event_id as its id; EMBEDDED has the first three dimensions as position,
the next three as normal and vec_id as its id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import geometry, morton
from voxelake.operators import bvh, front, hierarchy, keyed, ordering, points
from voxelake.sources import octree_store
from voxelake.sources.key_table import KeyTable
from voxelake.sources.shared import Folder, work_dir

QUERIES: dict = {}
ORACLE: dict = {}

#: Level of the cells; leaves are one above.
LEVEL = 7
LEAF = LEVEL - 1
SAMPLE_LEVEL = 4
SPLIT_MOST = 100
#: A camera in front of normalised space that looks along -z.
_PROJECTION = ((2.0, 0.0, 0.0, 0.0), (0.0, 2.0, 0.0, 0.0), (0.0, 0.0, -1.22, -2.22), (0.0, 0.0, -1.0, 0.0))
_CAMERA = ((1.0, 0.0, 0.0, -0.25), (0.0, 1.0, 0.0, -0.25), (0.0, 0.0, 1.0, -1.75), (0.0, 0.0, 0.0, 1.0))
VIEW = front.View(tuple(map(tuple, geometry.product(_PROJECTION, _CAMERA))), 0.02, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, as it is now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(F.col("event_id").alias("pid"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), F.col("event_id").cast("double").alias("z"))


def embedded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("pid"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "nx", "ny", "nz"))])


LINE_SQL = "SELECT l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem"
EVENTS_SQL = "SELECT event_id AS pid, user_id::DOUBLE AS x, value AS y, event_id::DOUBLE AS z FROM events"
EMBEDDED_SQL = "SELECT vec_id AS pid, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {n}" for i, n in enumerate(("x", "y", "z", "nx", "ny", "nz"))) + " FROM embeddings"


def grid_sql(source: str, level: int) -> str:
    """CTEs p, g (bounds) and m (normalised points with their cells)."""
    index = [f"CASE WHEN s{a} * scale * {2.0**-level!r} > 0 THEN floor({a} / (s{a} * scale * {2.0**-level!r})) ELSE 0 END::BIGINT" for a in "xyz"]
    index = [f"({i})" for i in index]
    return f"""p AS ({source}),
g0 AS (SELECT CASE WHEN min(x) = 0 THEN 0.0 ELSE min(x) END AS ox, CASE WHEN min(y) = 0 THEN 0.0 ELSE min(y) END AS oy, CASE WHEN min(z) = 0 THEN 0.0 ELSE min(z) END AS oz, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz, count(*) AS n_points FROM p),
g AS (SELECT *, CASE WHEN greatest(sx, sy, sz) > 0 THEN 1.0 / greatest(sx, sy, sz) ELSE 1.0 END AS scale FROM g0),
n AS (SELECT p.* REPLACE ((x - ox) * scale AS x, (y - oy) * scale AS y, (z - oz) * scale AS z), sx, sy, sz, scale FROM p, g),
i AS (SELECT *, {index[0]} AS ix, {index[1]} AS iy, {index[2]} AS iz FROM n),
m AS (SELECT * EXCLUDE (ix, iy, iz), {morton.sql_encode('ix', 'iy', 'iz', level)} AS morton FROM i)"""


LINE_CELLS = f"WITH {grid_sql(LINE_SQL, LEVEL)},\nc AS MATERIALIZED (SELECT morton, count(*) AS n FROM m GROUP BY 1)"
PYRAMID_SQL = "l AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {lv} AS level, morton >> {3 * (LEVEL - lv)} AS morton, sum(n)::BIGINT AS n_points FROM c GROUP BY 2" for lv in range(LEVEL + 1)) + ")"
NODES_SQL = f"""{LINE_CELLS}, {PYRAMID_SQL},
k AS MATERIALIZED (SELECT morton >> 3 AS up, count(*) AS n_children FROM l WHERE level BETWEEN 1 AND {LEAF} GROUP BY 1),
nodes AS MATERIALIZED (SELECT morton, level, CASE WHEN morton <> 1 THEN morton >> 3 END AS parent_morton, level = {LEAF} AS is_leaf, n_points, coalesce(n_children, 0) AS n_children
  FROM l LEFT JOIN k ON morton = up WHERE level <= {LEAF})"""
#: The same levels with the children of each node, one aggregate for each level and no join.
LEVELS_SQL = f"{LINE_CELLS}, lv AS (" + " UNION ALL ".join(f"SELECT {lv} AS level, morton >> {3 * (LEVEL - lv)} AS morton, sum(n)::BIGINT AS n_points, {f'count(DISTINCT morton >> {3 * (LEVEL - lv - 1)})' if lv < LEVEL else '0'} AS n_children FROM c GROUP BY 2" for lv in range(LEVEL + 1)) + ")"
SIZE_SQL = [f"(SELECT s{a} * scale FROM g)" for a in "xyz"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cells(points.with_morton(line_points(spark, sf_dir), LEVEL))


def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nodes(line_cells(spark, sf_dir), LEAF, LEVEL)


@dataclass
class Built:
    """An octree on disk: its metadata file, and cells beside the nodes that it names."""

    oct: str
    cells: str


_built: dict[tuple, Built] = {}


def built(spark: SparkSession, sf_dir: str) -> Built:
    """LINE's octree, written once for the files that the table has now: cells and nodes clustered by code.  Queries on nodes
    read it; after the table is written anew the next one builds another."""
    key = (spark.sparkContext.applicationId, Folder(spark, f"{sf_dir}/lineitem.parquet").identity())
    if key not in _built:
        folder = work_dir(spark, "octree")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordering.zorder_layout(hierarchy.cells(points.with_morton(line_points(spark, sf_dir), LEVEL)), parts).write.parquet(f"{folder}/cells")
        counted = spark.read.schema("morton long, n long").parquet(f"{folder}/cells")
        octree_store.write_breadth(hierarchy.nodes(counted, LEAF, LEVEL), f"{folder}/nodes")
        b = points.bounds(line_points(spark, sf_dir)).first()
        octree_store.write_meta(octree_store.Meta(f"{sf_dir}/lineitem.parquet", f"{folder}/nodes", (b.sx, b.sy, b.sz), (b.ox, b.oy, b.oz), LEVEL), f"{folder}/line.oct")
        _built[key] = Built(f"{folder}/line.oct", f"{folder}/cells")
    return _built[key]


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("morton long, n long").parquet(built(spark, sf_dir).cells)


def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table as it lies on disk; `level` is its partition column."""
    _, nodes, _ = octree_store.open_cloud(spark, built(spark, sf_dir).oct)
    return nodes.select("morton", "level", "parent_morton", "is_leaf", "n_points", "n_children")


def line_grid(spark: SparkSession, sf_dir: str) -> Column:
    """The grid that the octree's metadata has."""
    meta = octree_store.read_meta(built(spark, sf_dir).oct)
    most = max(meta.size)
    values = dict(zip(("ox", "oy", "oz", "sx", "sy", "sz", "scale"), (*meta.origin, *meta.size, 1.0 / most if most > 0 else 1.0)))
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()])


def with_line_grid(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.withColumn("grid", line_grid(spark, sf_dir))


def stored_tree(spark: SparkSession, sf_dir: str) -> octree_store.Stored:
    return octree_store.Stored(spark, octree_store.read_meta(built(spark, sf_dir).oct).nodes)


# bounds, normalisation, codes


@query("bounds", f"WITH {grid_sql(LINE_SQL, 1)} SELECT ox, oy, oz, sx, sy, sz, scale, n_points FROM g")
def bounds(spark, sf_dir):
    return points.bounds(line_points(spark, sf_dir))


@query("normalize", f"WITH {grid_sql(EVENTS_SQL, 1)} SELECT pid, x, y, z FROM n")
def normalize(spark, sf_dir):
    return points.normalize(event_points(spark, sf_dir)).select("pid", "x", "y", "z")


@query("morton_encode", f"WITH {grid_sql(EVENTS_SQL, 10)} SELECT pid, morton FROM m")
def morton_encode(spark, sf_dir):
    return points.with_morton(event_points(spark, sf_dir), 10).select("pid", "morton")


@query("morton_decode", f"{LINE_CELLS} SELECT morton, " + ", ".join(f"{morton.sql_decode('morton', k, LEVEL)}::BIGINT AS {a}" for k, a in enumerate("xyz")) + " FROM c")
def morton_decode(spark, sf_dir):
    return line_cells(spark, sf_dir).select("morton", morton.decode(F.col("morton")).alias("d")).select("morton", "d.x", "d.y", "d.z")


@query("morton_level_parent", f"{LINE_CELLS}, {PYRAMID_SQL} SELECT morton, {morton.sql_level('morton')} AS level, CASE WHEN morton <> 1 THEN morton >> 3 END AS parent, (morton & 7)::INTEGER AS child_index FROM l")
def morton_level_parent(spark, sf_dir):
    p = hierarchy.pyramid(line_cells(spark, sf_dir), LEVEL)
    c = F.col("morton")
    return p.select(c, morton.level_of(c).alias("level"), morton.parent(c).alias("parent"), morton.child_index(c).alias("child_index"))


@query("ancestors", f"{LINE_CELLS} SELECT morton, lv AS level, morton >> (3 * ({LEVEL} - lv)) AS ancestor FROM c, (SELECT unnest(range(0, {LEVEL + 1}))::INTEGER AS lv)")
def ancestors(spark, sf_dir):
    return line_cells(spark, sf_dir).select("morton", F.posexplode(morton.ancestors(F.col("morton"), LEVEL)).alias("level", "ancestor"))


@query("children_explode", f"{LINE_CELLS}, {PYRAMID_SQL} SELECT morton, (morton << 3) | k AS child FROM l, (SELECT unnest(range(0, 8)) AS k) WHERE level = 3")
def children_explode(spark, sf_dir):
    return hierarchy.pyramid(line_cells(spark, sf_dir), LEVEL, 3).where("level = 3").select("morton", F.explode(morton.children(F.col("morton"))).alias("child"))


@query("child_interval", f"{LINE_CELLS} SELECT morton, morton << 3 AS first_child, (morton << 3) | 7 AS last_child, morton << 6 AS first_down2, ((morton + 1) << 6) - 1 AS last_down2, morton - 1 AS previous, morton + 1 AS following FROM c")
def child_interval(spark, sf_dir):
    c = F.col("morton")
    iv = morton.child_interval(c)
    return line_cells(spark, sf_dir).select(c, iv["a"].alias("first_child"), iv["b"].alias("last_child"), morton.first_descendant(c, 2).alias("first_down2"), morton.last_descendant(c, 2).alias("last_down2"), morton.previous(c).alias("previous"), morton.following(c).alias("following"))


@query("descendant_check", f"{LINE_CELLS}, {PYRAMID_SQL} SELECT morton, level >= 2 AND (morton >> greatest(3 * (level - 2), 0)) = 64 AS in_first, (morton >> 3) = 64 AS child_of_first, level = 0 OR (level <= 2 AND (64 >> greatest(3 * (2 - level), 0)) = morton) AS holds_first FROM l")
def descendant_check(spark, sf_dir):
    c, first = F.col("morton"), F.lit(morton.level_first(2)).cast("long")
    p = hierarchy.pyramid(line_cells(spark, sf_dir), LEVEL)
    return p.select(c, morton.is_descendant_of(c, first).alias("in_first"), morton.is_child_of(c, first).alias("child_of_first"), morton.is_descendant_of(first, c).alias("holds_first"))


@query("path_to_root", f"{LINE_CELLS} SELECT morton, array_to_string(['0x' || lower(to_hex(morton >> (3 * k))) for k in range(0, {LEVEL + 1})], '->') AS path FROM c")
def path_to_root(spark, sf_dir):
    return line_cells(spark, sf_dir).select("morton", morton.path_to_root(F.col("morton")).alias("path"))


@query("preorder", f"{LINE_CELLS}, {PYRAMID_SQL} SELECT morton, level, row_number() OVER (PARTITION BY morton >> greatest(3 * (level - 2), 0) ORDER BY morton << (3 * ({LEVEL} - level)), level)::INTEGER AS nth FROM l WHERE level >= 2")
def preorder(spark, sf_dir):
    """Depth-first positions inside each subtree of level 2."""
    from pyspark.sql import Window

    c = F.col("morton")
    lifted, lv = morton.preorder(c, LEVEL)
    p = hierarchy.pyramid(line_cells(spark, sf_dir), LEVEL, 2)
    w = Window.partitionBy(morton.ancestor(c, F.col("level"), 2)).orderBy(lifted, lv)
    return p.select(c, "level", F.row_number().over(w).alias("nth"))


# orders and scans


@query("zorder_topk", f"WITH {grid_sql(EVENTS_SQL, 10)} SELECT morton, pid FROM m ORDER BY morton, pid LIMIT 1000")
def zorder_topk(spark, sf_dir):
    return ordering.first_rows(points.with_morton(event_points(spark, sf_dir), 10), 1000, "pid").select("morton", "pid")


@query("zorder_sort", f"WITH {grid_sql(EVENTS_SQL, 10)} SELECT morton, pid FROM m")
def zorder_sort(spark, sf_dir):
    return ordering.zorder(points.with_morton(event_points(spark, sf_dir), 10), "pid").select("morton", "pid")


@query("partial_sort_segments", f"WITH {grid_sql(LINE_SQL, LEVEL)}, s AS (SELECT morton, ntile(10) OVER (ORDER BY morton)::INTEGER AS segment FROM m) SELECT morton, segment, count(*) AS n FROM s GROUP BY 1, 2")
def partial_sort_segments(spark, sf_dir):
    return ordering.segments(points.with_morton(line_points(spark, sf_dir), LEVEL), LEVEL)


@query("run_boundaries", f"{LINE_CELLS}, d AS (SELECT morton, morton >> 3 AS parent, lag(morton >> 3) OVER (PARTITION BY morton >> 9 ORDER BY morton) AS before FROM c) SELECT morton, parent, before IS NULL OR before <> parent AS starts_run FROM d")
def run_boundaries(spark, sf_dir):
    from pyspark.sql import Window

    c = F.col("morton")
    up = F.shiftrightunsigned("morton", 3)
    before = F.lag(up).over(Window.partitionBy(F.shiftrightunsigned("morton", 9)).orderBy("morton"))
    return line_cells(spark, sf_dir).select(c, up.alias("parent"), (before.isNull() | (before != up)).alias("starts_run"))


@query("new_levels", f"{NODES_SQL} SELECT level, min(morton) AS first_morton, max(morton) AS last_morton, count(*) AS n_nodes FROM nodes GROUP BY 1")
def new_levels(spark, sf_dir):
    return hierarchy.new_levels(line_nodes(spark, sf_dir), LEAF)


@query("prefix_scan", "SELECT event_id, coalesce(sum(value::DECIMAL(18, 2)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS prefix FROM events")
def prefix_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("decimal(18,2)").alias("v"))
    return ordering.prefix_scan(e, "event_id", F.col("v")).select("event_id", F.col("prefix").cast("double").alias("prefix"))


@query("compaction", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_type = 'click'")
def compaction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ordering.compact(e, "event_id", F.col("event_type") == "click").select("event_id", F.col("pos").cast("long").alias("pos"))


_CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(
    "running_avg_stats",
    f"SELECT event_id, (sum({_CENTS}) OVER w * 10000 // count(*) OVER w)::BIGINT / 1000000.0::DOUBLE AS running_avg, "
    f"((sum({_CENTS}) FILTER (value > 10) OVER w) * 10000 // nullif((count(*) FILTER (value > 10) OVER w), 0))::BIGINT / 1000000.0::DOUBLE AS running_avg_over_10 "
    "FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def running_avg_stats(spark, sf_dir):
    """Averages so far, of all values and of those over 10, cut (not rounded) after six digits."""
    e = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("v"), (F.col("value") > 10).alias("over"))
    zero = F.lit(0).cast("long")
    out = e
    for name, value in (("s", F.col("v")), ("n", F.lit(1).cast("long")), ("so", F.when(F.col("over"), F.col("v")).otherwise(zero)), ("no", F.col("over").cast("long"))):
        out = ordering.prefix_scan(out, "event_id", value, name, inclusive=True)
    avg = lambda s, n: F.expr(f"(`{s}` * 10000) div nullif(`{n}`, 0)") / F.lit(1000000.0)
    return out.select("event_id", avg("s", "n").alias("running_avg"), avg("so", "no").alias("running_avg_over_10"))


# the hierarchy


@query("leaf_nodes", f"{LINE_CELLS} SELECT morton >> 3 AS morton, min(morton) AS first, sum(n)::BIGINT AS n_points FROM c GROUP BY c.morton >> 3")
def leaf_nodes(spark, sf_dir):
    return hierarchy.leaves(line_cells(spark, sf_dir))


@query("level_pyramid", f"{LINE_CELLS}, {PYRAMID_SQL} SELECT level, morton, n_points FROM l")
def level_pyramid(spark, sf_dir):
    return hierarchy.pyramid(line_cells(spark, sf_dir), LEVEL)


@query("nodes", f"{NODES_SQL} SELECT * FROM nodes")
def nodes(spark, sf_dir):
    return line_nodes(spark, sf_dir)


def _sampled_sql() -> str:
    parts = [f"s{LEAF} AS (SELECT morton >> 3 AS morton, sum(n)::BIGINT AS n_contents FROM c GROUP BY c.morton >> 3)"]
    for lv in range(LEAF - 1, -1, -1):
        parts.append(f"s{lv} AS (SELECT morton >> 3 AS morton, floor(greatest(1.0, sum(n_contents)::DOUBLE * 0.2::DOUBLE))::BIGINT AS n_contents FROM s{lv + 1} GROUP BY s{lv + 1}.morton >> 3)")
    return ", ".join(parts) + ", sn AS (" + " UNION ALL ".join(f"SELECT {lv} AS level, morton, n_contents FROM s{lv}" for lv in range(LEAF + 1)) + ")"


SAMPLED_SQL = _sampled_sql()


def line_sampled(spark, sf_dir):
    return hierarchy.sampled_pyramid(stored_cells(spark, sf_dir), LEVEL)


@query("sampled_nodes", f"{LINE_CELLS}, {SAMPLED_SQL} SELECT * FROM sn")
def sampled_nodes(spark, sf_dir):
    return hierarchy.sampled_pyramid(line_cells(spark, sf_dir), LEVEL)


@query("node_stats", f"{LINE_CELLS}, {SAMPLED_SQL} SELECT level, count(*) AS n_nodes, sum(n_contents)::BIGINT AS n_contents, (36 * sum(n_contents))::BIGINT AS n_bytes FROM sn GROUP BY 1")
def node_stats(spark, sf_dir):
    s = line_sampled(spark, sf_dir)
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_contents").alias("n_contents"), (F.sum("n_contents") * hierarchy.SURFEL_BYTES).alias("n_bytes"))


@query("subtree_stats", f"{LINE_CELLS}, {SAMPLED_SQL} SELECT morton >> (3 * k) AS morton, count(*) AS n_nodes, sum(n_contents)::BIGINT AS n_contents FROM sn, (SELECT unnest(range(0, {LEAF + 1})) AS k) WHERE k <= level GROUP BY sn.morton >> (3 * k)")
def subtree_stats(spark, sf_dir):
    return hierarchy.subtrees(line_sampled(spark, sf_dir), LEAF)


@query("sibling_prefix", f"{LINE_CELLS}, {SAMPLED_SQL} SELECT level, morton, n_contents, coalesce(sum(n_contents) OVER (PARTITION BY morton >> 3 ORDER BY morton ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM sn")
def sibling_prefix(spark, sf_dir):
    return hierarchy.sibling_offsets(line_sampled(spark, sf_dir)).select("level", "morton", "n_contents", "offset")


@query("left_right_sibling", f"{NODES_SQL} SELECT morton, lag(morton) OVER (PARTITION BY morton >> 3 ORDER BY morton) AS left_sibling, lead(morton) OVER (PARTITION BY morton >> 3 ORDER BY morton) AS right_sibling FROM nodes")
def left_right_sibling(spark, sf_dir):
    return hierarchy.siblings(stored_nodes(spark, sf_dir))


@query("parent_child_join", f"{LEVELS_SQL} SELECT morton >> 3 AS parent, morton AS child, n_points AS child_points, (sum(n_points) OVER (PARTITION BY level, morton >> 3))::BIGINT AS parent_points FROM lv WHERE level BETWEEN 1 AND {LEAF}")
def parent_child_join(spark, sf_dir):
    n = stored_nodes(spark, sf_dir)
    a = n.select(F.col("morton").alias("parent"), F.col("n_points").alias("parent_points"))
    return a.join(n.select(F.col("parent_morton").alias("parent"), F.col("morton").alias("child"), F.col("n_points").alias("child_points")), "parent")


def _stirred_sql(v: str) -> str:
    for shift, factor in ((15, 739982445), (12, 695872825), (15, 1)):
        v = f"({v}) % 2147483648"
        v = f"xor({v}, (({v}) >> {shift})) * {factor}"
    return f"({v})"


def _draws_sql() -> str:
    leaf = SAMPLE_LEVEL - 1
    parts = [f"c{leaf} AS (SELECT morton >> 3 AS node, row_number() OVER (PARTITION BY morton >> 3 ORDER BY morton, pid) - 1 AS ord, pid FROM m)"]
    for lv in range(leaf - 1, -1, -1):
        below = f"c{lv + 1}"
        parts.append(f"q{lv} AS (SELECT node >> 3 AS node, row_number() OVER (PARTITION BY node >> 3 ORDER BY node, ord) - 1 AS pos, pid FROM {below})")
        parts.append(f"t{lv} AS (SELECT node, count(*) AS n FROM q{lv} GROUP BY 1)")
        parts.append(f"i{lv} AS (SELECT node, n, unnest(range(0, floor(greatest(1.0, n::DOUBLE * 0.2::DOUBLE))::BIGINT)) AS i FROM t{lv})")
        parts.append(f"h{lv} AS (SELECT *, {_stirred_sql('(node % 2147483648) * 1103515245 + (i % 2147483648) * 1540483477')} AS h FROM i{lv})")
        parts.append(f"d{lv} AS (SELECT node, i AS ord, (h * 2147483648 + {_stirred_sql('(i % 2147483648) * 1181783497 + h')}) % n AS pos FROM h{lv})")
        parts.append(f"c{lv} AS (SELECT node, ord, pid FROM d{lv} JOIN q{lv} USING (node, pos))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {lv} AS level, node, ord, pid FROM c{lv}" for lv in range(leaf + 1))


@query("lod_sample", f"WITH {grid_sql(EVENTS_SQL, SAMPLE_LEVEL)}, {_draws_sql()}")
def lod_sample(spark, sf_dir):
    p = points.with_morton(event_points(spark, sf_dir), SAMPLE_LEVEL).select("morton", "pid")
    return hierarchy.sample_levels(hierarchy.ordered_contents(p), SAMPLE_LEVEL - 1)


@query(
    "collapse_leaves",
    f"""{LINE_CELLS}, {SAMPLED_SQL},
a AS (SELECT morton >> 3 AS morton, min(morton) AS lone, sum(n_contents) AS n FROM sn WHERE level = {LEAF} GROUP BY sn.morton >> 3 HAVING count(*) = 1)
SELECT morton, level, n_contents, level = {LEAF} AS is_leaf FROM sn WHERE morton NOT IN (SELECT lone FROM a) AND morton NOT IN (SELECT morton FROM a)
UNION ALL SELECT morton, {LEAF - 1}, floor(greatest(1.0, n::DOUBLE * 0.2::DOUBLE))::BIGINT, true FROM a""",
)
def collapse_leaves(spark, sf_dir):
    return hierarchy.collapsed(line_sampled(spark, sf_dir), LEAF)


@query(
    "topdown_split",
    f"""{LEVELS_SQL} SELECT level, morton, n_points, n_points > {SPLIT_MOST} AND level < {LEVEL} AS is_inner, CASE WHEN n_points > {SPLIT_MOST} AND level < {LEVEL} THEN {SPLIT_MOST} ELSE n_points END::BIGINT AS n_contents
FROM (SELECT *, sum(n_points) OVER (PARTITION BY level, morton >> 3) AS up_points FROM lv) WHERE level = 0 OR up_points > {SPLIT_MOST}""",
)
def topdown_split(spark, sf_dir):
    return hierarchy.top_down(hierarchy.pyramid(stored_cells(spark, sf_dir), LEVEL), SPLIT_MOST, LEVEL)


KEPT = 40


@query(
    "topdown_contents",
    f"""WITH {grid_sql(EVENTS_SQL, SAMPLE_LEVEL)},
a AS MATERIALIZED (SELECT lv AS level, morton >> (3 * ({SAMPLE_LEVEL} - lv)) AS node, pid FROM m, (SELECT unnest(range(0, {SAMPLE_LEVEL + 1}))::INTEGER AS lv)),
k AS MATERIALIZED (SELECT node, count(*) AS n FROM a GROUP BY 1),
w AS (SELECT a.*, k.n, row_number() OVER (PARTITION BY node ORDER BY (pid * 1103515245 + 12345) % 2147483648, pid) AS nth FROM a JOIN k USING (node) LEFT JOIN (SELECT node AS um, n AS un FROM k) u ON um = node >> 3 WHERE node = 1 OR un > {KEPT})
SELECT level, node AS morton, pid FROM w WHERE n <= {KEPT} OR level = {SAMPLE_LEVEL} OR nth <= {KEPT}""",
)
def topdown_contents(spark, sf_dir):
    return hierarchy.kept_points(points.with_morton(event_points(spark, sf_dir), SAMPLE_LEVEL), SAMPLE_LEVEL, KEPT)


@query(
    "release_children",
    f"""{LEVELS_SQL}, a AS (SELECT *, CASE WHEN level >= 3 THEN sum(n_points) OVER (PARTITION BY level, morton >> (3 * greatest(level - 3, 0))) END AS third FROM lv WHERE level <= {LEAF})
SELECT morton, level, level = {LEAF} OR (level = 3 AND n_points < 60) AS is_leaf, CASE WHEN level = {LEAF} OR (level = 3 AND n_points < 60) THEN 0 ELSE n_children END::BIGINT AS n_children FROM a WHERE level <= 3 OR third >= 60""",
)
def release_children(spark, sf_dir):
    n = stored_nodes(spark, sf_dir)
    return hierarchy.release_children(n, n.where("level = 3 and n_points < 60"), LEAF).select("morton", "level", "is_leaf", "n_children")


@query("append_points", f"WITH {grid_sql(EVENTS_SQL, 4)} SELECT morton >> 3 AS parent, string_agg(pid, ',' ORDER BY morton, pid) AS contents, count(DISTINCT morton) AS n_children, count(DISTINCT morton) AS n_leaves FROM m GROUP BY 1")
def append_points(spark, sf_dir):
    """A parent's whole contents, those of its children one after another.  Ids are sorted and spelled out in parts; only the texts of
    a parent's parts meet, in the row that is asked for."""
    p = points.with_morton(event_points(spark, sf_dir), 4).withColumn("part", F.shiftright("pid", hierarchy.ID_BITS))
    kids = p.groupBy("morton", "part").agg(F.array_join(F.sort_array(F.collect_list("pid")), ",").alias("contents")).select("morton", "part", "contents", F.shiftrightunsigned("morton", 3).alias("parent"), F.lit(True).alias("is_leaf"))
    return hierarchy.joined_parts(hierarchy.append_points(kids))


# surfels, boxes, views


_U = """d AS (SELECT *, nx * x + ny * y + nz * z AS d FROM n0),
a AS (SELECT *, CASE WHEN abs(nx) > 1e-10 THEN 0 WHEN abs(ny) > 1e-10 THEN 1 WHEN abs(nz) > 1e-10 THEN 2 END AS ax FROM d),
t AS (SELECT *, CASE WHEN ax = 0 THEN d / nx WHEN ax IS NOT NULL THEN 0.0 END - x AS tx, CASE WHEN ax = 1 THEN d / ny WHEN ax IS NOT NULL THEN 0.0 END - y AS ty, CASE WHEN ax = 2 THEN d / nz WHEN ax IS NOT NULL THEN 0.0 END - z AS tz FROM a),
w AS (SELECT *, nullif(sqrt(tx * tx + ty * ty + tz * tz), 0) AS len FROM t),
u AS (SELECT *, tx / len AS ux, ty / len AS uy, tz / len AS uz FROM w)"""


@query("surfel_frame", f"WITH n0 AS ({EMBEDDED_SQL}), {_U} SELECT pid, len IS NOT NULL AS framed, round(ux, 9) AS ux, round(uy, 9) AS uy, round(uz, 9) AS uz, round(ny * uz - nz * uy, 9) AS vx, round(nz * ux - nx * uz, 9) AS vy, round(nx * uy - ny * ux, 9) AS vz FROM u")
def surfel_frame(spark, sf_dir):
    e = embedded_points(spark, sf_dir)
    framed, u, v = geometry.surfel([F.col(c) for c in "xyz"], [F.col(c) for c in ("nx", "ny", "nz")])
    return e.select("pid", framed.alias("framed"), *[F.round(c, 9).alias(f"u{a}") for c, a in zip(u, "xyz")], *[F.round(c, 9).alias(f"v{a}") for c, a in zip(v, "xyz")])


def _multiplier_sql(i: int) -> str:
    table = geometry.multipliers("david", 0.2)
    return "CASE level " + " ".join(f"WHEN {lv} THEN {table[lv][i]}::DOUBLE" for lv in sorted(table)) + " ELSE 1.0::DOUBLE END"


@query("tangent_multipliers", f"{LINE_CELLS}, {PYRAMID_SQL} SELECT morton, level, {_multiplier_sql(0)} AS mu, {_multiplier_sql(1)} AS mv FROM l")
def tangent_multipliers(spark, sf_dir):
    p = hierarchy.pyramid(line_cells(spark, sf_dir), LEVEL)
    mu, mv = geometry.multiplier(F.col("level"), "david", 0.2)
    return p.select("morton", "level", mu.alias("mu"), mv.alias("mv"))


def _box_sql(code: str, level: int) -> tuple[list[str], list[str]]:
    part = repr(2.0**-level)
    low = [f"{morton.sql_decode(code, k, level) if level else '0'}::DOUBLE * (s{a} * {part}::DOUBLE)" for k, a in enumerate("xyz")]
    return [f"({v})" for v in low], [f"({v} + s{a} * {part}::DOUBLE)" for v, a in zip(low, "xyz")]


def _boxed_sql(level: int, source: str = "nodes") -> str:
    low, high = _box_sql("morton", level)
    sizes = ", ".join(f"{s} AS s{a}" for s, a in zip(SIZE_SQL, "xyz"))
    corners = ", ".join([f"{v} AS l{a}" for v, a in zip(low, "xyz")] + [f"{v} AS h{a}" for v, a in zip(high, "xyz")])
    return f"SELECT *, {corners} FROM (SELECT *, {sizes} FROM {source} WHERE level = {level})"


BOXES_SQL = f"{NODES_SQL}, x AS (" + " UNION ALL ".join(_boxed_sql(lv) for lv in range(LEAF + 1)) + ")"


def _cull_sql(low: list[str], high: list[str]) -> str:
    tests = []
    for a, b, c, d in geometry.planes(VIEW.view_proj):
        reach = [f"({float(n)!r}::DOUBLE * {high[i] if n > 0 else low[i]})" for i, n in enumerate((a, b, c))]
        tests.append(f"(({reach[0]} + {reach[1]}) + {reach[2]}) + ({float(d)!r}::DOUBLE) < 0")
    return "(" + " OR ".join(f"({t})" for t in tests) + ")"


def _flags_sql() -> str:
    """CTE v: x with diagonal, cull and fine, by way of the projected corners."""
    m = VIEW.view_proj
    corners = {"a": ("lx", "ly", "z0"), "b": ("hx", "hy", "z1"), "c": ("lx", "hy", "z1"), "d": ("hx", "ly", "z0")}

    def row(i, p):
        return f"((({float(m[i][0])!r}::DOUBLE * {p[0]}) + ({float(m[i][1])!r}::DOUBLE * {p[1]})) + ({float(m[i][2])!r}::DOUBLE * {p[2]}) + ({float(m[i][3])!r}::DOUBLE))"

    flat = ", ".join(f"{row(i, p)} / nullif({row(3, p)}, 0) AS {n}{k}" for n, p in corners.items() for i, k in enumerate("uv"))
    length = [f"(({q}u - {p}u) * ({q}u - {p}u) + ({q}v - {p}v) * ({q}v - {p}v))" for p, q in (("a", "b"), ("c", "d"))]
    return f"""v0 AS (SELECT *, CASE WHEN abs(lz) < 1e-6 THEN hz ELSE lz END AS z0, CASE WHEN abs(hz) < 1e-6 THEN lz ELSE hz END AS z1 FROM x),
v1 AS (SELECT *, {flat} FROM v0), v2 AS (SELECT *, greatest({length[0]}, {length[1]}) AS diagonal FROM v1),
v AS MATERIALIZED (SELECT morton, level, is_leaf, n_points, diagonal, {_cull_sql(_L, _H)} AS cull, coalesce(diagonal < {VIEW.threshold}, false) AS fine FROM v2)"""


_L, _H = [f"l{a}" for a in "xyz"], [f"h{a}" for a in "xyz"]


def boxed(spark, sf_dir):
    """Nodes with the corners of their cells."""
    n = with_line_grid(stored_nodes(spark, sf_dir), spark, sf_dir)
    low, high = geometry.cell_box(F.col("morton"), F.col("level"), points.grid_size())
    return n.withColumns({f"l{a}": v for v, a in zip(low, "xyz")} | {f"h{a}": v for v, a in zip(high, "xyz")})


@query("cell_boxes", f"{BOXES_SQL} SELECT morton, lx, ly, lz, hx, hy, hz, ((hx - lx) * ((hy - ly) + (hz - lz)) + (hy - ly) * (hz - lz)) AS half_area FROM x")
def cell_boxes(spark, sf_dir):
    b = boxed(spark, sf_dir)
    area = geometry.half_area([F.col(f"h{a}") - F.col(f"l{a}") for a in "xyz"])
    return b.select("morton", *_L, *_H, area.alias("half_area"))


@query("frustum_cull", f"{BOXES_SQL} SELECT morton, {_cull_sql(_L, _H)} AS cullable FROM x")
def frustum_cull(spark, sf_dir):
    c = geometry.is_cullable([F.col(v) for v in _L], [F.col(v) for v in _H], VIEW.view_proj)
    return boxed(spark, sf_dir).select("morton", c.alias("cullable"))


@query("projection_test", f"{BOXES_SQL}, {_flags_sql()} SELECT morton, round(diagonal, 9) AS diagonal, fine AS renderable FROM v")
def projection_test(spark, sf_dir):
    p = front.judged(with_line_grid(stored_nodes(spark, sf_dir), spark, sf_dir), VIEW)
    return p.select("morton", F.round("diagonal", 9).alias("diagonal"), F.col("is_fine").alias("renderable"))


def _cut_sql() -> str:
    """The cut by its definition: a frontier that goes down level by level."""
    parts = [_flags_sql(), f"r AS MATERIALIZED (SELECT *, NOT is_leaf AND level < {VIEW.max_depth} AND NOT cull AND NOT fine AS opens FROM v)"]
    parts.append("f0 AS (SELECT * FROM r WHERE morton = 1)")
    for lv in range(1, LEAF + 1):
        parts.append(f"f{lv} AS MATERIALIZED (SELECT r.* FROM r JOIN f{lv - 1} up ON r.morton >> 3 = up.morton WHERE r.level = {lv} AND up.opens)")
    return ", ".join(parts) + ", cut AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM f{lv} WHERE NOT opens" for lv in range(LEAF + 1)) + ")"


CUT_SQL = f"{BOXES_SQL}, {_cut_sql()}"


def line_cut(spark, sf_dir):
    return front.descend(stored_tree(spark, sf_dir), line_grid(spark, sf_dir), VIEW)


@query("lod_cut", f"{CUT_SQL} SELECT morton, level, n_points, cull AS is_culled, NOT cull AS is_emitted FROM cut")
def lod_cut(spark, sf_dir):
    return line_cut(spark, sf_dir).select("morton", "level", "n_points", "is_culled", (~F.col("is_culled")).alias("is_emitted"))


QUOTA = 400_000


@query(
    "lod_cut_quota",
    f"{CUT_SQL}, w AS (SELECT morton, level, n_points, sum(36 * n_points) OVER (ORDER BY level, morton ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, sum(36 * n_points) OVER (PARTITION BY level) AS level_used FROM cut WHERE NOT cull) "
    f"SELECT morton, level, n_points FROM w WHERE used <= {QUOTA}",
)
def lod_cut_quota(spark, sf_dir):
    cut = line_cut(spark, sf_dir).where(~F.col("is_culled")).select("morton", "level", "n_points")
    return front.within_quota(cut, QUOTA).select("morton", "level", "n_points")


@query("complete_groups", f"{CUT_SQL}, h AS (SELECT morton >> 3 AS parent, count(*) AS n_here FROM cut WHERE morton <> 1 GROUP BY cut.morton >> 3) SELECT parent, n_here, n_children, n_here = n_children AS complete FROM h JOIN nodes ON parent = morton")
def complete_groups(spark, sf_dir):
    return front.complete_groups(line_cut(spark, sf_dir), stored_nodes(spark, sf_dir))


@query("front_segments", f"{CUT_SQL} SELECT morton, ntile(5) OVER (ORDER BY morton << (3 * ({LEAF} - level)))::INTEGER AS segment FROM cut")
def front_segments(spark, sf_dir):
    return front.segments(line_cut(spark, sf_dir), LEAF, 5)


@query("front_members", f"{CUT_SQL} SELECT morton FROM nodes WHERE n_points % 2 = 0 AND morton IN (SELECT morton FROM cut)")
def front_members(spark, sf_dir):
    return front.contains(line_cut(spark, sf_dir), stored_nodes(spark, sf_dir).where("n_points % 2 = 0").select("morton"))


@query("front_changes", f"{CUT_SQL} SELECT morton FROM cut WHERE NOT cull UNION SELECT morton >> 3 FROM cut WHERE cull AND morton <> 1")
def front_changes(spark, sf_dir):
    cut = line_cut(spark, sf_dir).select("morton", "is_culled")
    culled = cut.where("is_culled and morton <> 1").select("morton")
    return front.apply_changes(cut.where("not is_culled or morton <> 1"), culled.select(F.shiftrightunsigned("morton", 3).alias("morton")), culled)


@query(
    "placeholder_substitution",
    f"{NODES_SQL}, up AS (SELECT morton AS placeholder, morton >> (3 * k) AS code FROM nodes, (SELECT unnest(range(0, {LEAF + 1})) AS k) WHERE is_leaf), ld AS (SELECT morton FROM nodes WHERE n_points >= 40) "
    "SELECT placeholder, max(ld.morton) AS substitute FROM up LEFT JOIN ld ON up.code = ld.morton GROUP BY 1",
)
def placeholder_substitution(spark, sf_dir):
    n = stored_nodes(spark, sf_dir)
    return front.substitute(n.where("is_leaf"), n.where("n_points >= 40"), LEAF)


@query("pending_level_pick", f"{NODES_SQL}, q AS (SELECT level, count(*) AS n FROM nodes WHERE n_points < 40 GROUP BY 1) SELECT level, n FROM q WHERE n > 0 ORDER BY n DESC, level DESC LIMIT 1")
def pending_level_pick(spark, sf_dir):
    return ordering.level_to_substitute(stored_nodes(spark, sf_dir).where("n_points < 40").groupBy("level").agg(F.count(F.lit(1)).alias("n")))


# keys and ranges

_A, _B = morton.level_first(LEVEL) + (3 << 12), morton.level_first(LEVEL) + (90 << 12)


@query("range_scan", f"{LINE_CELLS} SELECT morton, n FROM c WHERE morton BETWEEN {_A} AND {_B}")
def range_scan(spark, sf_dir):
    return keyed.range_scan(stored_cells(spark, sf_dir), _A, _B)


_KEYS = (1, 8, 9, 64, 65, 512, 513, 1 << 60)


@query("key_lookup", f"{NODES_SQL} SELECT k AS morton, n_points, n.morton IS NOT NULL AS found FROM (SELECT unnest([{', '.join(map(str, _KEYS))}]::BIGINT[]) AS k) LEFT JOIN nodes n ON n.morton = k")
def key_lookup(spark, sf_dir):
    return keyed.lookup(stored_nodes(spark, sf_dir).select("morton", "n_points"), _KEYS)


@query("upsert_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    return keyed.latest(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "value")


@query("key_table_changes", f"{LINE_CELLS} SELECT morton, CASE WHEN n > 2 THEN n + 1000 ELSE n END AS n FROM c WHERE NOT morton BETWEEN {_A} AND {_B} UNION ALL SELECT {_A}, 7")
def key_table_changes(spark, sf_dir):
    """Insert, replace, delete by range and insert again, in place, the last two as one version."""
    cells = stored_cells(spark, sf_dir)
    table = KeyTable.create(spark, work_dir(spark, "keys"), "morton long, n long", bucket_bits=17)
    table.upsert(cells)
    table.upsert(cells.where("n > 2").withColumn("n", F.col("n") + 1000))
    with table.transaction():
        table.delete_range(_A, _B)
        table.upsert(spark.createDataFrame([(_A, 7)], "morton long, n long"))
    return table.read()


@query("range_delete", f"{LINE_CELLS} SELECT morton, n FROM c WHERE NOT morton BETWEEN {_A} AND {_B}")
def range_delete(spark, sf_dir):
    return keyed.delete_range(stored_cells(spark, sf_dir), _A, _B)


@query("interval_requests", f"{NODES_SQL} SELECT (parent_morton << 3) AS a, (parent_morton << 3) | 7 AS b, morton, n_points FROM nodes WHERE level = 5 AND parent_morton IN (SELECT parent_morton >> 3 FROM nodes WHERE level = 6 AND n_points >= 4)")
def interval_requests(spark, sf_dir):
    n = stored_nodes(spark, sf_dir)
    iv = morton.child_interval(F.shiftrightunsigned("parent_morton", 3))
    asked = n.where("level = 6 and n_points >= 4").select(iv["a"].alias("a"), iv["b"].alias("b"))
    return keyed.answer(asked, n.where("level = 5").select("morton", "n_points"), 5)


@query(
    "merge_offsets",
    "WITH f AS (SELECT event_type AS file_ord, count(*) AS n FROM events GROUP BY 1), o AS (SELECT file_ord, n, coalesce(sum(n) OVER (ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM f) "
    "SELECT event_id AS face_id, file_ord, event_id % n + o AS v0, (event_id + 1) % n + o AS v1, (event_id + 2) % n + o AS v2 FROM events JOIN o ON event_type = file_ord",
)
def merge_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("face_id"), F.col("event_type").alias("file_ord"))
    off = keyed.file_offsets(e.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n")))
    faces = e.join(off.select("file_ord", "n"), "file_ord").select("face_id", "file_ord", F.array(*[(F.col("face_id") + k) % F.col("n") for k in range(3)]).alias("vertex_indices"))
    v = F.col("vertex_indices")
    return keyed.merge_faces(faces, off).select("face_id", "file_ord", *[F.get(v, F.lit(k)).alias(f"v{k}") for k in range(3)])


@query("union_files", f"WITH p AS ({LINE_SQL} UNION ALL SELECT user_id::DOUBLE, value, 0.0::DOUBLE FROM events) SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p")
def union_files(spark, sf_dir):
    both = line_points(spark, sf_dir).unionByName(event_points(spark, sf_dir).select("x", "y", F.lit(0.0).alias("z")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


# bounding volumes: insertion is sequential by nature, so SQL states single trees as values, and what must hold for all


BVH_LEVEL, BVH_POINTS = 4, 64
#: Three points each, with the trees that insertion gives.
_BVH_POINTS = {1: ((-1, -1, -1), (1, 1, 1), (2, 2, 2)), 2: ((-1, -1, -1), (1, 1, 1), (2, 2, 0.5)), 3: ((-1, -1, 0), (2, 2, -1), (0, 0, 1))}
_BVH_TREES = (
    "(1, 1, -1, -1, -1, 3, 3, 3, false, 0, 2), (1, 2, -1, -1, -1, 0, 0, 0, true, 1, 0), (1, 2, 1, 1, 1, 1, 1, 1, false, 0, 2), (1, 3, 1, 1, 1, 0, 0, 0, true, 1, 0), (1, 3, 2, 2, 2, 0, 0, 0, true, 1, 0), "
    "(2, 1, -1, -1, -1, 3, 3, 2, false, 0, 2), (2, 2, -1, -1, -1, 0, 0, 0, true, 1, 0), (2, 2, 1, 1, 0.5, 1, 1, 0.5, false, 0, 2), (2, 3, 1, 1, 1, 0, 0, 0, true, 1, 0), (2, 3, 2, 2, 0.5, 0, 0, 0, true, 1, 0), "
    "(3, 1, -1, -1, -1, 3, 3, 2, false, 0, 2), (3, 2, 2, 2, -1, 0, 0, 0, true, 1, 0), (3, 2, -1, -1, 0, 1, 1, 1, false, 0, 2), (3, 3, -1, -1, 0, 0, 0, 0, true, 1, 0), (3, 3, 0, 0, 1, 0, 0, 0, true, 1, 0)"
)
_BOX = [f"{k}{a}" for k in "oe" for a in "xyz"]


@query("bvh_small_trees", f"SELECT tree::BIGINT AS tree, depth::INTEGER AS depth, {', '.join(f'{c}::DOUBLE AS {c}' for c in _BOX)}, is_leaf, n_points::BIGINT AS n_points, n_children::BIGINT AS n_children FROM (VALUES {_BVH_TREES}) AS t(tree, depth, {', '.join(_BOX)}, is_leaf, n_points, n_children)")
def bvh_small_trees(spark, sf_dir):
    rows = [(t, 0, i, *map(float, p)) for t, ps in _BVH_POINTS.items() for i, p in enumerate(ps)]
    p = spark.createDataFrame(rows, "tree long, part long, pid long, x double, y double, z double")
    return bvh.build_partitioned(p).select("tree", "depth", *_BOX, "is_leaf", "n_points", "n_children")


def bvh_trees(spark, sf_dir):
    """The trees of all groups, with the high corner of each node."""
    return bvh.build_partitioned(bvh.spatial_groups(points.with_morton(embedded_points(spark, sf_dir), BVH_LEVEL), BVH_LEVEL, BVH_POINTS))


@query("bvh_nodes")
def bvh_nodes(spark, sf_dir):
    return bvh_trees(spark, sf_dir).drop("hx", "hy", "hz")


@query("bvh_stats")
def bvh_stats(spark, sf_dir):
    return bvh.statistics(bvh_nodes(spark, sf_dir))


_BVH_GROUPS_SQL = f"""WITH {grid_sql(EMBEDDED_SQL, BVH_LEVEL)},
b AS MATERIALIZED (SELECT lv, morton >> (3 * ({BVH_LEVEL} - lv)) AS tree, count(*) AS n FROM m, (SELECT unnest(range(0, {BVH_LEVEL + 1})) AS lv) GROUP BY ALL),
f AS (SELECT b.lv, b.tree FROM b LEFT JOIN b u ON u.tree = b.tree >> 3 WHERE (b.tree = 1 OR u.n > {BVH_POINTS}) AND (b.n <= {BVH_POINTS} OR b.lv = {BVH_LEVEL}))"""


@query(
    "bvh_roots",
    f"{_BVH_GROUPS_SQL} SELECT tree, count(*) AS n_points, count(*) AS n_leaves, " + ", ".join([f"min({a}) AS o{a}" for a in "xyz"] + [f"max({a}) - min({a}) AS e{a}" for a in "xyz"]) + f" FROM m JOIN f ON m.morton >> (3 * ({BVH_LEVEL} - lv)) = tree GROUP BY 1",
)
def bvh_roots(spark, sf_dir):
    """A row for each cell that has a tree of its own; a deepest cell of too many points has several trees, its parts, which count as one."""
    r = bvh.roots(bvh_trees(spark, sf_dir), "tree")
    return r.select("tree", "n_points", "n_leaves", *[F.col(f"l{a}").alias(f"o{a}") for a in "xyz"], *[(F.col(f"h{a}") - F.col(f"l{a}")).alias(f"e{a}") for a in "xyz"])


@query("bvh_violations", "SELECT 0::BIGINT AS tree, 0::BIGINT AS part, 0::BIGINT AS node_id, 0::BIGINT AS parent_id, false AS not_smaller, false AS sticks_out WHERE false")
def bvh_violations(spark, sf_dir):
    return bvh.violations(bvh_nodes(spark, sf_dir))


# streams, run to the end of the table


@query("stream_build", f"{LINE_CELLS}, {PYRAMID_SQL} SELECT level, morton, n_points FROM l WHERE level <= {LEAF}")
def stream_build(spark, sf_dir):
    from voxelake.streaming import build

    return build.build_from_stream(spark, f"{sf_dir}/lineitem.parquet", LEVEL, lambda d: d.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z")), line_points(spark, sf_dir))


@query("stream_running_stats", "SELECT event_type, count(*) AS n, (sum(CAST(round(value * 100) AS BIGINT)) * 10000 // count(*))::BIGINT / 1000000.0::DOUBLE AS avg_value, max(value) AS max_value FROM events GROUP BY 1")
def stream_running_stats(spark, sf_dir):
    from voxelake.streaming import build

    return build.running_stats(spark, f"{sf_dir}/events.parquet")


# further modules register their queries here

from voxelake.plans import files, layouts, live, shapes, tracking, volumes  # noqa: E402, F401
