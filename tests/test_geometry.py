import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.functions import geometry as G
from voxelake.operators import bvh, points

P = ((2, 0, 0, 0), (0, 2, 0, 0), (0, 0, -1.22, -2.22), (0, 0, -1, 0))
FLIP = ((-1, 0, 0, 0), (0, 1, 0, 0), (0, 0, -1, 0), (0, 0, 0, 1))
S = math.sqrt(0.5)
TURN = [list(r) for r in G.product(((S, 0, S, 0), (0, 1, 0, 0), (-S, 0, S, 0), (0, 0, 0, 1)), FLIP)]
for _i, _v in enumerate((0, 0, 10)):
    TURN[_i][3] = _v


def flag(spark, f, low, high, *args):
    return spark.range(1).select(f([F.lit(float(v)) for v in low], [F.lit(float(v)) for v in high], *args).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "view, low, high, cull",
    [
        (P, (0.6, -0.1, -0.45), (3, 0.2, -0.2), True), (P, (-3, 0, -5), (0, 0.25, 0), False), (P, (0.3, 0.1, -9.5), (0.4, 0.4, -8), False),
        (G.product(P, FLIP), (-3, -0.1, 0.2), (-0.6, 0.2, 0.45), True), (G.product(P, FLIP), (0, 0, 0), (3, 0.25, 5), False), (G.product(P, FLIP), (-0.4, 0.1, 8), (-0.3, 0.4, 9.5), False),
        (G.product(P, TURN), (1, -0.1, -9.25754), (2, 0.2, -7.73726), True), (G.product(P, TURN), (-15, -3, 5), (-13.5, 0, 15), False), (G.product(P, TURN), (-15, -1, 14), (-14, 0, 15), False),
    ],
)
def test_frustum(spark, view, low, high, cull):
    assert flag(spark, G.is_cullable, low, high, view) is cull


def test_renderable_and_window(spark):
    low, high = (0.0, 0.0, -5.0), (0.1, 0.1, -4.9)
    assert flag(spark, G.is_renderable, low, high, P, 0.05) and not flag(spark, G.is_renderable, low, high, P, 1e-6)
    assert flag(spark, G.is_renderable_window, low, high, P, 2000.0, 1000, 1000)
    assert flag(spark, G.is_renderable, (0, 0, 0), (0.1, 0.1, 0), P, 0.05) is False  # no homogeneous projection


def test_surfel(spark):
    def frame(p, n):
        ok, u, v = G.surfel([F.lit(float(c)) for c in p], [F.lit(float(c)) for c in n])
        r = spark.range(1).select(ok.alias("ok"), F.array(*u).alias("u"), F.array(*v).alias("v")).first()
        return r.ok, r.u, r.v

    ok, u, v = frame((1, 2, 3), (0, 0, 1))
    assert ok and abs(sum(a * a for a in u) - 1) < 1e-12 and abs(u[2]) < 1e-12 and abs(sum(a * b for a, b in zip(u, v))) < 1e-12
    assert frame((1, 2, 3), (0, 0, 0))[0] is False
    assert frame((5, 0, 0), (1, 0, 0))[0] is False


def test_multipliers(spark):
    assert G.multipliers("duomo", 0.1) == G.multipliers("duomo", 0.2)
    lv = lambda x: F.lit(x).cast("int")
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(*G.accumulated_multiplier(lv(5), lv(7), "david", 0.2)) == pytest.approx((4.7 * 3.0 * 2.0, 4.7 * 2.5 * 2.0))
    assert one(*G.accumulated_multiplier(lv(0), lv(2), "david", 0.2)) == one(*G.accumulated_multiplier(lv(3), lv(2), "david", 0.2)) == (1.0, 1.0)
    step = lambda ms: one(G.adapt_threshold(F.lit(0.5), F.lit(ms), 20, 2))[0]
    assert step(30) == pytest.approx(0.51) and step(21) == 0.5 and step(10_000) == 1.0 and step(-10_000) == 2 / 1024


def test_window_pixels(spark):
    """Pixels are cut towards zero; the second edge reaches behind the box."""
    def diagonal(low, high):
        return spark.range(1).select(G.window_diagonal([F.lit(float(v)) for v in low], [F.lit(float(v)) for v in high], P, 100, 100)).first()[0]

    def pixel(p):
        clip = [sum(P[i][k] * p[k] for k in range(3)) + P[i][3] for i in (0, 1, 3)]
        return [int((c / clip[2] + 1) * 50) for c in clip[:2]]

    low, high = (-3.0, -0.7, -5.0), (0.4, 0.9, -3.0)
    ends = [(low, high), ((high[0], high[1], low[2]), (high[0], high[1], 2 * high[2] - low[2]))]
    assert diagonal(low, high) == max(sum((a - b) ** 2 for a, b in zip(pixel(p), pixel(q))) for p, q in ends)


SIMPLE = [(1, 15, 2), (3, -31, 4), (-14, 5, 6), (46, 7, 8), (9, 10, 24), (11, 12, -51), (13, -12, 9), (-5, -8, 1), (14, 11, -4), (7, 3, -12), (12, 5, 0)]
CODES = [0x53602200, 0x5361A68A, 0x61904024, 0x61928928, 0x676742F4, 0x70B01305, 0x714DE1C8, 0x73A3DA0B, 0x73E512D5, 0x76010822, 0x760A0586]
FIRST_NORMALS = [0.13, 0.16, 0.01, 0.04, 0.19, 0.22, 0.28, 0.31, 0.25, 0.07, 0.10]


def test_golden_order(spark):
    rows = [(float(x), float(y), float(z), round(0.01 + 0.03 * i, 2)) for i, (x, y, z) in enumerate(SIMPLE)]
    df = spark.createDataFrame(rows, "x double, y double, z double, nx double")
    b = points.bounds(df).first()
    assert (b.ox, b.oy, b.oz, b.sx, b.sy, b.sz, b.scale) == (-14, -31, -51, 60, 46, 75, 1 / 75)
    out = points.with_morton(df, 10).orderBy("morton").collect()
    assert [r.morton for r in out] == CODES
    assert [r.nx for r in out] == FIRST_NORMALS
    tripled = points.with_morton(df.union(df).union(df), 10).orderBy("morton").collect()
    assert [r.morton for r in tripled] == [c for c in CODES for _ in range(3)]


def test_degenerate_clouds(spark):
    one = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert points.with_morton(one, 5).first().morton == 1 << 15
    assert points.with_morton(one.limit(0), 5).count() == 0


@pytest.mark.parametrize(
    "at, kids",
    [
        ([(-1, -1, -1), (1, 1, 1), (2, 2, 2)], [((-1, -1, -1), (0, 0, 0)), ((1, 1, 1), (1, 1, 1))]),
        ([(-1, -1, -1), (1, 1, 1), (2, 2, 0.5)], [((-1, -1, -1), (0, 0, 0)), ((1, 1, 0.5), (1, 1, 0.5))]),
        ([(-1, -1, 0), (2, 2, -1), (0, 0, 1)], [((-1, -1, 0), (1, 1, 1)), ((2, 2, -1), (0, 0, 0))]),
    ],
)
def test_bvh(at, kids):
    t = bvh.build(at)
    rows = list(t.rows())
    assert [(r[3:6], r[6:9]) for r in rows if r[2] == 2] == kids


def test_bvh_tables(spark):
    r = np.random.default_rng(1)
    at = r.normal(size=(120, 3))
    df = spark.createDataFrame([(i // 60, 0, i, *map(float, p)) for i, p in enumerate(at)], "tree long, part long, pid long, x double, y double, z double")
    nodes = bvh.build_partitioned(df).cache()
    assert bvh.violations(nodes).count() == 0
    # the tables hold what one tree in memory does, and the statistics what a plain count of them does
    for tree in (0, 1):
        want = [x[:10] for x in bvh.build(at[tree * 60 : tree * 60 + 60]).rows()]
        rows = nodes.where(f"tree = {tree}").orderBy("node_id").collect()
        assert [tuple(x)[2:12] for x in rows] == want
        leaf, inner = [x for x in rows if x.is_leaf], [x for x in rows if not x.is_leaf]
        s = bvh.statistics(nodes).where(f"tree = {tree}").first()
        assert (s.n_nodes, s.n_leaves, s.n_points, s.max_depth) == (len(rows), len(leaf), 60, max(x.depth for x in rows))
        assert (s.avg_points_per_leaf, s.avg_children_per_inner) == (60 // len(leaf), sum(x.n_children for x in inner) // len(inner))
        assert (s.min_points_per_leaf, s.max_points_per_leaf) == (min(x.n_points for x in leaf), max(x.n_points for x in leaf))
    assert bvh.statistics(bvh.build_partitioned(df.limit(1))).first().avg_children_per_inner is None


def test_bvh_groups_are_bounded(spark):
    """A crowded cell is split by level, and equal points, which no level splits, by parts."""
    rows = [(i, 0.5, 0.5, 0.5) for i in range(300)] + [(300 + i, i / 100, (i * 7 % 100) / 100, (i * 3 % 100) / 100) for i in range(100)]
    p = points.with_morton(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 3)
    grouped = bvh.spatial_groups(p, 3, 50).cache()
    assert grouped.count() == 400 and grouped.select("pid").distinct().count() == 400
    sizes = grouped.groupBy("tree", "part").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 90
    assert bvh.violations(bvh.build_partitioned(grouped)).count() == 0


@pytest.mark.parametrize("equal", [0, 150])
def test_one_tree_over_all_groups(spark, equal):
    """One root; each node's box holds those below; groups join in the order of the least surface; parts of a cell of equal points too."""
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.random((300, 3)))] + [(1000 + i, 0.5, 0.5, 0.5) for i in range(equal)]
    cells = points.with_morton(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 3)
    parts = bvh.build_partitioned(bvh.spatial_groups(cells, 3, 12)).cache()
    nodes, by_cell = bvh.one_tree(parts, 3)
    got = {(r.tree, r.part, r.node_id): r for r in nodes.collect()}
    assert len(got) == nodes.count()
    roots = {(r.tree, r.part, r.node_id) for r in parts.where("depth = 1").collect()}
    top = [k for k, r in got.items() if r.up_tree is None]
    assert len(top) == 1 and got[top[0]].n_points == len(rows)
    assert {k for k in got if k[1] >= 0} == roots and len(got) == 2 * len(roots) - 1
    below = {}
    for k, r in got.items():
        if r.up_tree is not None:
            below.setdefault((r.up_tree, r.up_part, r.up_node), []).append(r)
    assert set(below) == {k for k in got if k[1] < 0}
    for k, kids in below.items():
        r = got[k]
        assert len(kids) == 2 and r.n_points == sum(c.n_points for c in kids)
        assert all(r[f"l{a}"] == min(c[f"l{a}"] for c in kids) and r[f"h{a}"] == max(c[f"h{a}"] for c in kids) for a in "xyz")
    if equal:
        assert max(r.part for r in parts.collect()) >= 8
    held = {r.cell: r.n_points for r in by_cell.collect()}
    assert held[1] == len(rows) and all(held[m >> 3] >= n for m, n in held.items() if m > 1)


def test_trees_are_dealt_to_tasks_and_keep_exact_corners(spark):
    """Few bytes, much work: not all groups in one task; a box's high corner is the points' own, to the last bit."""
    at = np.random.default_rng(2).normal(size=(400, 3))
    df = spark.createDataFrame([(i // 20, 0, i, *map(float, p)) for i, p in enumerate(at)], "tree long, part long, pid long, x double, y double, z double")
    nodes = bvh.build_partitioned(df)
    assert nodes.select(F.spark_partition_id()).distinct().count() > 1
    tops = nodes.where("depth = 1").collect()
    assert any(r.ox + r.ex != r.hx for r in tops)
    for r in tops:
        assert (r.hx, r.hy, r.hz) == tuple(at[r.tree * 20 : r.tree * 20 + 20].max(0))


def test_pairs_of_least_surface():
    boxes = np.array([[0, 0, 0, 1, 1, 1], [10, 0, 0, 11, 1, 1], [0, 0, 2, 1, 1, 3], [10, 5, 0, 11, 6, 1]], float)
    assert bvh._pair_up(boxes) == [(0, 2), (1, 3), (4, 5)]
    assert bvh._pair_up(boxes[:1]) == []
