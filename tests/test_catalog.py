import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import front, hierarchy, keyed, ordering, points
from voxelake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        same_rows(df, duck, catalog.ORACLE[name])
    else:  # trees of insertion: their roots, boxes and single trees have SQL, tests/test_geometry.py holds them against one tree in memory
        assert name in ("bvh_nodes", "bvh_stats")
        n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
        points = df.agg(F.sum("n_points")).first()[0]
        assert points == n


def test_parents_have_whole_contents(spark, tmp_path):
    """One row for each parent, whatever ranges of ids its children's points are in."""
    ids = [i * 40_000 + i % 3 for i in range(60)]
    e = spark.createDataFrame([(i, i % 7, float(i % 11)) for i in ids], "event_id long, user_id long, value double")
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    placed = points.with_morton(catalog.event_points(spark, str(tmp_path)), 4).collect()
    want = {}
    for r in sorted(placed, key=lambda r: (r.morton, r.pid)):
        want.setdefault(r.morton >> 3, []).append(r)
    got = catalog.append_points(spark, str(tmp_path)).collect()
    kids = {k: len({r.morton for r in v}) for k, v in want.items()}
    assert sorted(map(tuple, got)) == sorted((k, ",".join(str(r.pid) for r in v), kids[k], kids[k]) for k, v in want.items())


def test_scan_closed_form(spark):
    rows = spark.range(3000)
    out = ordering.prefix_scan(rows, "id", rows.id, "p").orderBy("id").collect()
    assert [r.p for r in out] == [i * (i - 1) // 2 for i in range(3000)]
    assert out[-1].p + 2999 == 4_498_500


def test_compaction_closed_form(spark):
    out = ordering.compact(spark.range(3000), "id", F.col("id") % 2 == 1).orderBy("id").collect()
    assert [(r.id, r.pos) for r in out] == [(2 * i + 1, i) for i in range(1500)]


def test_invariants(spark):
    n = catalog.line_nodes(spark, SF).collect()
    by = {r.morton: r for r in n}
    assert sum(r.n_points for r in n if r.is_leaf) == by[1].n_points
    for r in n:
        if r.morton != 1:
            p = by[r.parent_morton]
            assert p.morton << 3 <= r.morton <= (p.morton << 3 | 7)
    s = {r.morton: r.n_contents for r in catalog.line_sampled(spark, SF).collect()}
    for m, k in s.items():
        kids = [s[c] for c in range(m << 3, (m << 3) + 8) if c in s]
        if kids:
            assert k == max(1, int(sum(kids) * 0.2))


def test_front_steps_reach_the_cut(spark):
    nodes = catalog.with_line_grid(catalog.line_nodes(spark, SF), spark, SF).cache()
    cut = sorted(r.morton for r in front.lod_cut(nodes, catalog.VIEW, catalog.LEAF).collect())
    now = [1]
    for _ in range(catalog.LEAF + 1):
        d = spark.createDataFrame([(m,) for m in now], "morton long")
        now = sorted(r.morton for r in front.step(d, nodes, catalog.VIEW).collect())
    assert now == cut


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "morton long, n long")
    assert hierarchy.pyramid(cells, 5).count() == 0
    assert hierarchy.nodes(cells, 4, 5).count() == 0
    assert hierarchy.sampled_pyramid(cells, 5).count() == 0
    assert ordering.segments(spark.createDataFrame([], "morton long"), 5).count() == 0
    assert keyed.latest(spark.createDataFrame([], "k long, t long, v string"), "k", ["t"], "v").count() == 0


def test_delete_keeps_null_keys(spark):
    t = spark.createDataFrame([(1,), (5,), (None,)], "morton long")
    assert sorted(str(r.morton) for r in keyed.delete_range(t, 4, 9).collect()) == ["1", "None"]
    assert morton.level_first(0) == 1


def test_ranges_of_the_stored_tree_skip_row_groups(spark, tmp_path):
    """Codes are clustered, so the statistics of row groups rule most of them out, and the filter reaches the scan."""
    import pyarrow.parquet as pq

    cells = ordering.zorder_layout(catalog.line_cells(spark, SF), 4)
    cells.write.option("parquet.block.size", 2048).option("parquet.page.size", 512).option("parquet.block.size.row.check.min", 10).parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    a, b = catalog._A, catalog._A + (4 << 12)
    found = keyed.range_scan(stored, a, b)
    assert f"GreaterThanOrEqual(morton,{a})" in found._jdf.queryExecution().executedPlan().toString()
    groups = []
    for f in (tmp_path / "cells").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
    met = [s for s in groups if s.max >= a and s.min <= b]
    assert found.count() > 0 and 0 < len(met) <= len(groups) / 2


def test_deep_pyramid_in_steps(spark):
    cells = spark.range(400).select((F.pmod(F.xxhash64("id"), F.lit(1 << 36)) + (1 << 36)).alias("morton"), (F.col("id") % 5 + 1).alias("n"))
    want = sorted(map(tuple, hierarchy.pyramid(cells, 12, step=13).collect()))
    assert len(want) > 400 and sorted(map(tuple, hierarchy.pyramid(cells, 12, step=3).collect())) == want
    assert sorted(map(tuple, hierarchy.pyramid(cells, 12, first=4, step=5).collect())) == [r for r in want if r[0] >= 4]
    codes = {r[1] for r in want}
    for r in hierarchy.nodes(cells, 11, 12).collect():
        assert r.n_children == (0 if r.is_leaf else sum(r.morton << 3 | k in codes for k in range(8)))
