"""Registered queries over files: the driver's tables are written as PLY or octree files in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelake.operators import hierarchy, points
from voxelake.plans.catalog import EVENTS_SQL, LEAF, LEVEL, LINE_CELLS, LINE_SQL, NODES_SQL, SAMPLED_SQL, event_points, grid_sql, line_points, line_sampled, query, stored_nodes, table
from voxelake.sources import octree_store, ply
from voxelake.sources.shared import Folder, work_dir

_AXES = ("x", "y", "z", "nx", "ny", "nz")


def _vertices(spark, sf_dir):
    """EVENTS as vertices with a normal, in the order of pid."""
    e = event_points(spark, sf_dir)
    return e.select("pid", "x", "y", "z", (F.col("pid") % 3).cast("double").alias("nx"), F.lit(0.5).alias("ny"), F.lit(0.0).alias("nz"))


def _faces(spark, sf_dir):
    """A triangle for each event, over neighbours in the order of event_id."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"))
    first = F.greatest(F.col("pid") - 2, F.lit(0))
    return e.select("pid", F.array(F.col("pid"), first, F.col("pid") % 7).alias("vertex_indices"))


def _as_doubles(df):
    return df.select(*[F.col(c).cast("double").alias(c) for c in _AXES])


_VERTEX_SQL = f"SELECT x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, (pid % 3)::DOUBLE AS nx, 0.5::DOUBLE AS ny, 0.0::DOUBLE AS nz FROM ({EVENTS_SQL})"
_FACE_SQL = "SELECT event_id AS v0, greatest(event_id - 2, 0) AS v1, event_id % 7 AS v2 FROM events"


@query("ply_vertices", _VERTEX_SQL)
def ply_vertices(spark, sf_dir):
    folder = work_dir(spark, "vertices")
    ply.write_parts(_vertices(spark, sf_dir), folder)
    return _as_doubles(ply.read(spark, folder, rows_per_split=1 << 12))


@query("ply_faces", _FACE_SQL)
def ply_faces(spark, sf_dir):
    """Vertices and faces in one file."""
    folder = work_dir(spark, "mesh")
    Folder(spark, folder).publish("made", {})
    ply.write(_vertices(spark, sf_dir), f"{folder}/mesh.ply", _faces(spark, sf_dir), "pid", "pid")
    v = F.col("vertex_indices")
    return ply.read(spark, f"{folder}/mesh.ply", "face", rows_per_split=1 << 12).select(*[F.get(v, F.lit(k)).alias(f"v{k}") for k in range(3)])


@query("ply_polygons", "SELECT event_id AS v0, event_id % 5 + 3 AS n, (event_id % 5 + 3) * event_id + 3 * (event_id % 5 + 3) * (event_id % 5 + 2) // 2 AS total FROM events")
def ply_polygons(spark, sf_dir):
    """Faces of three to seven corners, in files that several tasks read."""
    folder = work_dir(spark, "polygons")
    pid = F.col("event_id")
    corners = F.transform(F.sequence(F.lit(0), (pid % 5 + 2).cast("int")), lambda k: pid + k * 3)
    ply.write_parts(table(spark, sf_dir, "events").select(corners.alias("vertex_indices")), folder, "face")
    v = F.col("vertex_indices")
    read = ply.read(spark, folder, "face", bytes_per_split=1 << 13)
    return read.select(F.get(v, F.lit(0)).alias("v0"), F.size(v).cast("long").alias("n"), F.aggregate(v, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


def _group(spark, sf_dir):
    """A group of two meshes: EVENTS, and its first hundred."""
    folder = work_dir(spark, "group")
    at = Folder(spark, folder)
    at.publish("made", {})
    v, f = _vertices(spark, sf_dir), _faces(spark, sf_dir)
    ply.write(v, f"{folder}/a.ply", f, "pid", "pid")
    ply.write(v.where("pid < 100"), f"{folder}/b.ply", f.where("pid < 100"), "pid", "pid")
    fs, p = ply._filesystem(f"{folder}/both.gp")
    with fs.open_output_stream(p) as out:
        out.write(f"{folder}/a.ply\n{folder}/b.ply\n".encode())
    return f"{folder}/both.gp"


@query("ply_group", f"WITH p AS ({EVENTS_SQL}), q AS (SELECT 0 AS file_ord, * FROM p UNION ALL SELECT 1, * FROM p WHERE pid < 100) SELECT file_ord, count(*) AS n, min(x::FLOAT::DOUBLE) AS low, max(y::FLOAT::DOUBLE) AS high FROM q GROUP BY 1")
def ply_group(spark, sf_dir):
    g = ply.read_group(spark, _group(spark, sf_dir))
    return g.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n"), F.min("x").cast("double").alias("low"), F.max("y").cast("double").alias("high"))


@query("ply_merge", f"{_FACE_SQL} UNION ALL SELECT event_id + n, greatest(event_id - 2, 0) + n, event_id % 7 + n FROM events, (SELECT count(*) AS n FROM events) WHERE event_id < 100")
def ply_merge(spark, sf_dir):
    """The group's files as one, whose faces name the vertices of both."""
    group = _group(spark, sf_dir)
    made = group.replace("both.gp", "merged.ply")
    ply.merge(group, spark, made)
    v = F.col("vertex_indices")
    return ply.read(spark, made, "face").select(*[F.get(v, F.lit(k)).alias(f"v{k}") for k in range(3)])


@query("sort_to_file", f"WITH {grid_sql(LINE_SQL, LEVEL)} SELECT n_points, ox, oy, oz, sx, sy, sz, {LEVEL} AS depth FROM g")
def sort_to_file(spark, sf_dir):
    """A sorted PLY file and its metadata, both read back."""
    folder = work_dir(spark, "sorted")
    Folder(spark, folder).publish("made", {})
    cloud = line_points(spark, sf_dir).withColumns({"nx": F.lit(1.0), "ny": F.lit(0.0), "nz": F.lit(0.0)})
    octree_store.sort_to_file(cloud, LEVEL, f"{folder}/line.ply", f"{folder}/line.oct")
    m = octree_store.read_meta(f"{folder}/line.oct")
    kind, read, _ = octree_store.open_cloud(spark, m.points)
    named = dict(zip(("ox", "oy", "oz", "sx", "sy", "sz"), (*m.origin, *m.size)))
    return read.agg(F.count(F.lit(1)).alias("n_points")).select("n_points", *[F.lit(v).alias(k) for k, v in named.items()], F.lit(m.depth).alias("depth"))


@query("octree_breadth", f"{NODES_SQL} SELECT * FROM nodes")
def octree_breadth(spark, sf_dir):
    """The node table that queries share: written level by level, opened by its metadata."""
    return stored_nodes(spark, sf_dir)


@query("octree_depth", f"{NODES_SQL} SELECT * FROM nodes")
def octree_depth(spark, sf_dir):
    folder = work_dir(spark, "deep")
    octree_store.write_depth(stored_nodes(spark, sf_dir), folder, LEAF)
    return octree_store.read(spark, folder)


@query("octree_levels", f"{NODES_SQL} SELECT level, count(*) AS n_nodes, sum(n_points)::BIGINT AS n_points, sum(count(*)) OVER (ORDER BY level)::BIGINT AS n_ready FROM nodes GROUP BY 1")
def octree_levels(spark, sf_dir):
    """Progressive reading: what is ready when each level is published."""
    from voxelake.plans.catalog import built

    nodes = octree_store.read_meta(built(spark, sf_dir).oct).nodes
    seen = []

    def each(level, rows):
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_points").alias("p")).first()
        seen.append((level, r.n, r.p, r.n + sum(x[1] for x in seen)))

    octree_store.read_progressively(spark, nodes, each, 600)
    return spark.createDataFrame(seen, "level int, n_nodes long, n_points long, n_ready long")


@query("stats_report", f"{LINE_CELLS}, {SAMPLED_SQL} SELECT level::BIGINT AS level, count(*) AS n_nodes, sum(n_contents)::BIGINT AS n_contents FROM sn GROUP BY 1")
def stats_report(spark, sf_dir):
    """A statistics report as JSON lines, read back."""
    folder = work_dir(spark, "report")
    stats = line_sampled(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_contents").alias("n_contents"))
    octree_store.write_report(stats, folder)
    return spark.read.schema("level long, n_nodes long, n_contents long").json(folder)


@query("points_from_ply", f"WITH {grid_sql(EVENTS_SQL.replace('user_id::DOUBLE', 'user_id::FLOAT::DOUBLE').replace('value AS y', 'value::FLOAT::DOUBLE AS y').replace('event_id::DOUBLE', 'event_id::FLOAT::DOUBLE'), 4)} SELECT morton, count(*) AS n FROM m GROUP BY 1")
def points_from_ply(spark, sf_dir):
    """A .ply file is opened and built from."""
    folder = work_dir(spark, "open")
    Folder(spark, folder).publish("made", {})
    ply.write(_vertices(spark, sf_dir), f"{folder}/cloud.ply")
    _, cloud, _ = octree_store.open_cloud(spark, f"{folder}/cloud.ply")
    return hierarchy.cells(points.with_morton(_as_doubles(cloud), 4))


@query("contents_round_trip", f"WITH {grid_sql(EVENTS_SQL, 4)} SELECT morton, pid, x, y, z FROM m")
def contents_round_trip(spark, sf_dir):
    """Cells with their points as nested arrays, written, read back and spelled out again.  Cells go in parts of ids, so no row
    holds more than a part."""
    p = points.with_morton(event_points(spark, sf_dir), 4)
    folder = work_dir(spark, "contents")
    packed = p.groupBy("morton", F.shiftright("pid", hierarchy.ID_BITS).alias("part")).agg(F.sort_array(F.collect_list(F.struct("pid", "x", "y", "z"))).alias("contents"))
    packed.write.parquet(folder)
    return spark.read.parquet(folder).select("morton", F.explode("contents").alias("c")).select("morton", "c.*")
