"""Views: what is read of a stored tree, and fronts from frame to frame."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from voxelake.functions import geometry
from voxelake.operators import front, hierarchy
from voxelake.plans import catalog, tracking
from voxelake.sources import octree_store
from voxelake.streaming.front import Tracker


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """LINE's nodes over many files."""
    path = str(tmp_path_factory.mktemp("tree") / "nodes")
    octree_store.write_breadth(catalog.stored_nodes(spark, SF), path, 60)
    return octree_store.Stored(spark, path)


def names(df):
    return {re.sub(r".*/(level=\d+/.*)", r"\1", f) for f in df.inputFiles()}


def test_descent_opens_no_file_below_closed_nodes(spark, tree, monkeypatch):
    grid = catalog.line_grid(spark, SF)
    corner = ((1.0, 0.0, 0.0, -0.02), (0.0, 1.0, 0.0, -0.02), (0.0, 0.0, 1.0, -1.2), (0.0, 0.0, 0.0, 1.0))
    view = front.View(geometry.product(((8.0, 0, 0, 0), (0, 8.0, 0, 0), (0, 0, -1.22, -2.22), (0, 0, -1.0, 0)), corner), 0.01, 5)
    read, seen = octree_store.Stored.read, []

    def noted(self, levels, under=None):
        df = read(self, levels, under)
        seen.append(df)
        return df

    monkeypatch.setattr(octree_store.Stored, "read", noted)
    cut = front.descend(tree, grid, view)
    whole = front.lod_cut(catalog.with_line_grid(catalog.stored_nodes(spark, SF), spark, SF), view, catalog.LEAF)
    assert sorted(map(tuple, cut.select("morton", "level", "n_points", "is_culled").collect())) == sorted(map(tuple, whole.select("morton", "level", "n_points", "is_culled").collect()))
    opened = set().union(*[names(df) for df in seen])
    assert not any(f.startswith("level=6/") for f in opened)  # below the view's depth
    # exactly the files that hold something below a node of level 2 that branches
    codes = {r.morton for r in cut.collect()}
    branching = {c >> (3 * k) for c in codes for k in range(1, 6)} - {0}
    second = [m for m in branching if 64 <= m < 128]
    for lv in (3, 4, 5):
        down = 3 * (lv - 2)
        want = {f"level={lv}/{z['file']}" for z in tree.files[lv] if any(z["first"] <= ((m + 1) << down) - 1 and z["last"] >= m << down for m in second)}
        assert want == {f for f in opened if f.startswith(f"level={lv}/")}
    assert len({f for f in opened if f.startswith("level=5/")}) < len(tree.files[5])


@pytest.mark.parametrize("few", [10_000, 0])
def test_zones_find_the_files_of_intervals(spark, tree, few, monkeypatch):
    monkeypatch.setattr(octree_store.Stored, "FEW", few)
    zones = tree.files[5]
    one = zones[len(zones) // 2]
    asked = spark.createDataFrame([(5, one["first"], one["first"]), (5, one["last"], one["last"]), (9, 1, 2)], "level int, a long, b long")
    assert names(tree.within(asked)) == {f"level=5/{one['file']}"}
    assert tree.within(asked.where("level = 9")) is None and tree.within(asked.where("a < 0")) is None
    everything = spark.createDataFrame([(5, 0, 1 << 62)], "level int, a long, b long")
    assert len(tree.within(everything).inputFiles()) == len(zones)
    gap = spark.createDataFrame([(5, zones[-1]["last"] + 1, 1 << 62)], "level int, a long, b long")
    assert tree.within(gap) is None


def brute_frame(now, nodes, flags, depth):
    """One pass in Python."""
    groups = {}
    for m in now:
        groups.setdefault(m >> 3, []).append(m)
    out = set()
    for parent, kids in groups.items():
        if parent and len(kids) == nodes[parent].n_children and any(flags[parent]):
            out.add(parent)
            continue
        for m in kids:
            n = nodes[m]
            if not n.is_leaf and n.level < depth and not any(flags[m]):
                out |= {k for k in range(m << 3, (m << 3) + 8) if k in nodes}
            else:
                out.add(m)
    return out


def test_tracking_against_one_pass_in_python(spark, tree, tmp_path):
    grid = catalog.line_grid(spark, SF)
    nodes = {r.morton: r for r in catalog.stored_nodes(spark, SF).collect()}
    tracker = Tracker(spark, str(tmp_path / "frames"), tree, grid)
    kind = "frame long, camera long, m array<double>, threshold double, max_depth int"
    chosen = [v for v in tracking.VIEWS if v[0] in (0, 3, 5, 9)]
    late = [v for v in chosen if v[1] == 0 or v[0] > 3]  # a camera that comes later
    tracker.add(spark.createDataFrame([v for v in late if v[0] <= 3], kind), 0)
    second = spark.createDataFrame([v for v in late if v[0] > 3] + [v for v in late if v[0] == 9], kind)
    tracker.add(second, 1)
    tracker.add(second, 1)  # runs again
    got = {}
    for r in tracker.frames().collect():
        assert (r.frame, r.camera, r.morton) not in got
        got[r.frame, r.camera, r.morton] = r
        assert len(r.up) == r.level and all(n == nodes[r.morton >> (3 * (r.level - i))].n_children for i, n in enumerate(r.up))
    all_nodes = catalog.stored_nodes(spark, SF).withColumn("grid", grid)
    want = {0: {1}, 1: {1}}
    for frame in (0, 3, 5, 9):
        for camera in (0, 1):
            view = [v for v in late if v[:2] == (frame, camera)]
            if view:
                m = view[0][2]
                flags = {r.morton: (r.is_culled, r.is_fine) for r in front.judged(all_nodes, front.View(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), view[0][3], 5)).select("morton", "is_culled", "is_fine").collect()}
                want[camera] = brute_frame(want[camera], nodes, flags, 5)
                mine = {k[2]: r for k, r in got.items() if k[:2] == (frame, camera)}
                assert set(mine) == want[camera]
                assert all(r.is_culled == flags[k][0] for k, r in mine.items())


def test_a_front_of_no_tree(spark, tmp_path):
    octree_store.write_breadth(hierarchy.nodes(spark.createDataFrame([(8, 1)], "morton long, n long"), 0, 1), str(tmp_path / "one"))
    one = octree_store.Stored(spark, str(tmp_path / "one"))
    grid = catalog.line_grid(spark, SF)
    assert [r.morton for r in front.descend(one, grid, catalog.VIEW).collect()] == [1]
    views = spark.createDataFrame([v[1:] for v in tracking.VIEWS[:1]], front.VIEWS)
    now = front.start(views, one)
    assert [r.morton for r in front.track(now, one, grid, views).collect()] == [1]
    # a camera without a view keeps its front
    assert [r.camera for r in front.track(now, one, grid, views.where("camera < 0")).collect()] == [0]


def test_draws_differ(spark):
    for n in (1500, 15000):
        d = hierarchy.drawn(spark.range(n // 5).select(F.lit(77).cast("long").alias("node"), F.col("id").alias("ord"), F.lit(n).cast("long").alias("n")))
        expected = n * (1 - (1 - 1 / n) ** (n // 5))
        assert abs(d.select("pos").distinct().count() - expected) < 0.03 * expected
        assert d.agg(F.min("pos"), F.max("pos")).first()[0] >= 0 and d.where(f"pos >= {n}").count() == 0


def test_lookup_filters_the_scan(spark):
    from voxelake.operators import keyed

    plan = keyed.lookup(catalog.stored_nodes(spark, SF), (1, 8, 1 << 60))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(morton, [" in plan and "(1,8,1152921504606846976)" in plan


def test_quota_in_blocks(spark):
    rows = [(8 + i, 1, 10 * (i % 3 + 1)) for i in range(8)] + [((1 << 18) + 977 * i, 6, i % 7 + 1) for i in range(200)]
    got = {r.morton for r in front.within_quota(spark.createDataFrame(rows, "morton long, level int, n_points long"), 15_000).collect()}
    used, want = 0, set()
    for m, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        used += 36 * n
        if used <= 15_000:
            want.add(m)
    assert got == want and 8 < len(want) < len(rows)
