"""A front tracked over frames: two cameras on paths of ten views each."""

from __future__ import annotations

import math

from voxelake.functions import geometry
from voxelake.plans.catalog import _H, _L, _PROJECTION, BOXES_SQL, line_grid, query, stored_tree
from voxelake.sources.shared import work_dir
from voxelake.streaming import front as live_front

FRAMES, THRESHOLD, DEPTH = 10, 0.02, 5


def path(camera: int) -> list[geometry.Matrix]:
    """Views of a camera: 0 goes in and comes back out, 1 passes along x and turns."""
    out = []
    for i in range(FRAMES):
        t = i / (FRAMES - 1)
        near = 1 - abs(2 * t - 1)
        turn = 0.0 if camera == 0 else 0.7 * (t - 0.5)
        x, z = (0.25, 2.6 - 1.6 * near) if camera == 0 else (0.9 * t - 0.2, 1.4)
        c, s = math.cos(turn), math.sin(turn)
        turned = ((c, 0.0, s, 0.0), (0.0, 1.0, 0.0, 0.0), (-s, 0.0, c, 0.0), (0.0, 0.0, 0.0, 1.0))
        moved = ((1.0, 0.0, 0.0, -x), (0.0, 1.0, 0.0, -0.25), (0.0, 0.0, 1.0, -z), (0.0, 0.0, 0.0, 1.0))
        out.append(geometry.product(_PROJECTION, geometry.product(turned, moved)))
    return out


VIEWS = [(i, camera, [float(v) for row in m for v in row], THRESHOLD, DEPTH) for camera in (0, 1) for i, m in enumerate(path(camera))]


def _track_sql() -> str:
    """Frame by frame: flags of all nodes for all views, then each frame's front from the one before."""
    values = ", ".join(f"({frame}, {camera}, {', '.join(f'{v!r}::DOUBLE' for v in m)})" for frame, camera, m, _, _ in VIEWS)
    names = [f"m{i}{k}" for i in range(4) for k in range(4)]
    corners = {"a": ("lx", "ly", "z0"), "b": ("hx", "hy", "z1"), "c": ("lx", "hy", "z1"), "d": ("hx", "ly", "z0")}
    row = lambda i, p: f"(((m{i}0 * {p[0]}) + (m{i}1 * {p[1]})) + (m{i}2 * {p[2]}) + m{i}3)"
    flat = ", ".join(f"{row(i, p)} / nullif({row(3, p)}, 0) AS {n}{k}" for n, p in corners.items() for i, k in enumerate("uv"))
    length = [f"(({q}u - {p}u) * ({q}u - {p}u) + ({q}v - {p}v) * ({q}v - {p}v))" for p, q in (("a", "b"), ("c", "d"))]
    planes = [[f"(m3{k} {s} m{i}{k})" for k in range(4)] for i in range(3) for s in "+-"]
    outside = ["(" + " + ".join(f"greatest({n[k]} * {_L[k]}, {n[k]} * {_H[k]})" for k in range(3)) + f" + {n[3]} < 0)" for n in planes]
    parts = [
        f"views AS (SELECT * FROM (VALUES {values}) AS t(frame, camera, {', '.join(names)}))",
        "x0 AS (SELECT *, CASE WHEN abs(lz) < 1e-6 THEN hz ELSE lz END AS z0, CASE WHEN abs(hz) < 1e-6 THEN lz ELSE hz END AS z1 FROM x)",
        f"x1 AS (SELECT *, {flat} FROM x0, views)",
        f"j AS MATERIALIZED (SELECT frame, camera, morton, level, n_children, {' OR '.join(outside)} AS cull, coalesce(greatest({length[0]}, {length[1]}) < {THRESHOLD}, false) AS fine, is_leaf FROM x1)",
        f"j2 AS MATERIALIZED (SELECT *, NOT is_leaf AND level < {DEPTH} AND NOT cull AND NOT fine AS opens FROM j)",
        "front0 AS (SELECT 0::BIGINT AS camera, 1::BIGINT AS morton UNION ALL SELECT 1, 1)",
    ]
    for f in range(FRAMES):
        parts += [
            f"gone{f} AS MATERIALIZED (SELECT s.camera, s.morton >> 3 AS parent FROM front{f} s JOIN j2 p ON p.frame = {f} AND p.camera = s.camera AND p.morton = s.morton >> 3 WHERE p.cull OR p.fine GROUP BY s.camera, s.morton >> 3, p.n_children HAVING count(*) = p.n_children)",
            f"rest{f} AS MATERIALIZED (SELECT s.camera, s.morton, j2.opens FROM front{f} s JOIN j2 ON j2.frame = {f} AND j2.camera = s.camera AND j2.morton = s.morton WHERE NOT EXISTS (SELECT 1 FROM gone{f} g WHERE g.camera = s.camera AND g.parent = s.morton >> 3))",
            f"front{f + 1} AS MATERIALIZED (SELECT camera, parent AS morton FROM gone{f} UNION ALL SELECT camera, morton FROM rest{f} WHERE NOT opens UNION ALL SELECT r.camera, n.morton FROM rest{f} r JOIN nodes n ON n.parent_morton = r.morton WHERE r.opens)",
        ]
    out = " UNION ALL ".join(f"SELECT {f} AS frame, s.camera, s.morton, j2.level, NOT j2.cull AS is_rendered FROM front{f + 1} s JOIN j2 ON j2.frame = {f} AND j2.camera = s.camera AND j2.morton = s.morton" for f in range(FRAMES))
    return f"{BOXES_SQL}, {', '.join(parts)} {out}"


@query("front_track", _track_sql())
def front_track(spark, sf_dir):
    """The front of two cameras after each of their frames, from a stream of views."""
    views = work_dir(spark, "views")
    for first in range(0, FRAMES, 5):  # files in the order of frames
        spark.createDataFrame([v for v in VIEWS if first <= v[0] < first + 5], "frame long, camera long, m array<double>, threshold double, max_depth int").coalesce(1).write.mode("append").parquet(views)
    frames = live_front.tracked(spark, views, stored_tree(spark, sf_dir), line_grid(spark, sf_dir))
    return frames.select("frame", "camera", "morton", "level", (~frames.is_culled).alias("is_rendered"))
