"""Binary octree files, presorted runs, chunks, budgets and level 21."""

import struct

import pytest
from conftest import SF
from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import hierarchy, ordering
from voxelake.plans import catalog
from voxelake.sources import octree_file

KIND = f"morton long, level int, is_leaf boolean, n_children long, contents {octree_file.CONTENTS}"


def surfels(*firsts):
    return [tuple(f + k / 8 for k in range(9)) for f in firsts]


def small(spark):
    """A root with one surfel, a child with two, and its leaf with two."""
    return spark.createDataFrame([(1, 0, False, 1, surfels(0.0)), (8, 1, False, 1, surfels(1.0, 1.5)), (64, 2, True, 0, surfels(2.0, 2.5))], KIND)


@pytest.mark.parametrize("deep", [True, False])
def test_the_bytes_of_a_small_tree(spark, tmp_path, deep):
    octree_file.write(small(spark), str(tmp_path / "t.boc"), deep, 2)
    body = lambda *f: struct.pack("<I", len(f)) + b"".join(struct.pack("<9f", *s) for s in surfels(*f))
    one = struct.pack("<I", 1)
    end = struct.pack("<I", 0) if deep else b""
    want = bytes([deep]) + b"\0" + body(0.0) + one + b"\0" + body(1.0, 1.5) + one + b"\1" + body(2.0, 2.5) + end
    assert (tmp_path / "t.boc").read_bytes() == want
    got = sorted(octree_file.read(spark, str(tmp_path / "t.boc"), 60).collect())
    assert [(r.nth, r.parent, r.level, r.is_leaf, r.n_children) for r in got] == [(0, None, 0, False, 1), (1, 0, 1, False, 1), (2, 1, 2, True, 0)]
    assert [[tuple(s) for s in r.contents] for r in got] == [surfels(0.0), surfels(1.0, 1.5), surfels(2.0, 2.5)]


@pytest.mark.parametrize("deep", [True, False])
def test_parents_and_levels_of_a_wide_tree(spark, tmp_path, deep):
    nodes = catalog.stored_nodes(spark, SF).where("level <= 4").withColumn("is_leaf", F.col("level") == 4)
    rows = nodes.select("morton", "level", "is_leaf", F.when(F.col("is_leaf"), 0).otherwise(F.col("n_children")).alias("n_children"), F.array().cast(octree_file.CONTENTS).alias("contents"))
    octree_file.write(rows, str(tmp_path / "t.boc"), deep, 4)
    reader = octree_file.OctreeReader({"path": str(tmp_path / "t.boc"), "bytes_per_split": "500"})
    assert len(reader.partitions()) > 5
    codes = sorted(r.morton for r in rows.collect())
    if deep:
        lift = {m: (m << (12 - 3 * ((m.bit_length() - 1) // 3)), m) for m in codes}
        codes.sort(key=lift.get)
    got = sorted(octree_file.read(spark, str(tmp_path / "t.boc"), 500).collect())
    assert len(got) == len(codes)
    for r, m in zip(got, codes):
        assert r.level == (m.bit_length() - 1) // 3 and (codes[r.parent] == m >> 3 if m > 1 else r.parent is None)


def test_a_file_that_ends_early(spark, tmp_path):
    octree_file.write(small(spark), str(tmp_path / "t.boc"), True, 2)
    raw = (tmp_path / "t.boc").read_bytes()
    (tmp_path / "cut.boc").write_bytes(raw[:-2])
    with pytest.raises(ValueError, match="ends inside a node"):
        octree_file.index_of(str(tmp_path / "cut.boc"))


def test_runs_merge_without_an_exchange(spark):
    cells = [spark.range(i, 3000, 2 + i).select((F.col("id") * 7 + 4096).alias("morton"), (F.col("id") % 5 + 1).alias("n")) for i in range(3)]
    for i, c in enumerate(cells):
        ordering.write_run(c, f"test_run_{i}", 4)
    for other in (1, 2):
        plan = ordering.merged(spark, "test_run_0", f"test_run_{other}")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    merged = ordering.merge_runs(spark, [f"test_run_{i}" for i in range(3)], "test_run_all", 4)
    want = cells[0].union(cells[1]).union(cells[2]).groupBy("morton").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect()))
    # the result is a run again: a file for each bucket, each sorted, and it merges without an exchange too
    plan = ordering.merged(spark, "test_run_all", "test_run_1")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(merged.inputFiles()) == 4
    for f in merged.inputFiles():
        codes = [r.morton for r in spark.read.parquet(f).collect()]
        assert codes == sorted(codes)
    for i in (0, 1, 2, "all"):
        spark.sql(f"DROP TABLE test_run_{i}")


@pytest.mark.parametrize("share", [0, 3])
def test_chunks_hold_the_quota_whatever_the_skew(spark, share):
    """A third of all points in one cell, and equal codes across the border of chunks."""
    code = F.pmod(F.xxhash64("id"), F.lit(1 << 12)) + (1 << 12)
    p = spark.range(2000).select(F.when((F.col("id") % 3 == 0) & F.lit(share > 0), F.lit(5000)).otherwise(code).cast("long").alias("morton"), (F.col("id") * 977 % 2000 * 1000).alias("pid"))
    placed = ordering.chunks(p, 4, 90).withColumn("at", F.spark_partition_id()).collect()
    order = sorted((r.morton, r.pid) for r in p.collect())
    assert sorted((r["rank"], r.morton, r.pid) for r in placed) == [(i, *k) for i, k in enumerate(order)]
    by = {}
    for r in placed:
        by.setdefault(r.at, []).append(r)
    assert all(len({r.chunk for r in rows}) == 1 and [r["rank"] for r in rows] == sorted(r["rank"] for r in rows) for rows in by.values())
    assert sorted(len(rows) for rows in by.values()) == [2000 % 90] + [90] * (2000 // 90)


def test_many_small_chunks_share_partitions(spark):
    """Tasks don't grow with the number of chunks; each chunk is whole, sorted and of the quota."""
    p = spark.range(9000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 12)) + (1 << 12)).alias("morton"), F.col("id").alias("pid"))
    made = ordering.chunks(p, 4, 10)
    assert made.rdd.getNumPartitions() <= ordering.OWN_PARTITIONS < 900
    placed = made.withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r.morton, r.pid) for r in placed) == [(r.morton, r.pid) for r in sorted(placed, key=lambda r: r["rank"])]
    by = {}
    for r in placed:
        by.setdefault(r.chunk, []).append(r)
    assert sorted(by) == list(range(900)) and all(len({r["at"] for r in rows}) == 1 and len(rows) == 10 for rows in by.values())
    assert all([r["rank"] for r in rows] == list(range(10 * k, 10 * k + 10)) for k, rows in by.items())


@pytest.mark.parametrize("budget", [0, 36, 500, 20_000, 10**9])
def test_budgets(spark, budget):
    rows = [(0, 1, 3), (1, 8, 2), (1, 9, 2)] + [(2, 64 + i, 1 + i % 4) for i in range(16)] + [(3, 512 + i, 2) for i in range(0, 128, 3)]
    got = {(r.level, r.morton): r.released for r in hierarchy.within_budget(spark.createDataFrame(rows, "level int, morton long, n_contents long"), budget).collect()}
    groups = {}
    for lv, m, n in rows:
        groups[lv, m >> 3] = groups.get((lv, m >> 3), 0) + 36 * n
    used, fits = 0, set()
    for g in sorted(groups):
        used += groups[g]
        if used <= budget:
            fits.add(g)
    assert got == {(lv, m): (lv, m >> 3) not in fits for lv, m, _ in rows}


def test_level_21(spark):
    """Codes with the sign bit are equal, shift and order as others."""
    at = [(0, 0, 0), (2**21 - 1, 2**21 - 1, 2**21 - 1), (5000, 6000, 7000), (1 << 20, 0, 1)]
    d = spark.createDataFrame(at, "x long, y long, z long").withColumn("m", morton.encode(F.col("x"), F.col("y"), F.col("z"), 21))
    d = d.withColumns({"up": morton.parent(F.col("m")), "lv": morton.level_of(F.col("m")), "key": morton.sort_key(F.col("m")), "d": morton.decode(F.col("m"))})
    unsigned = {}
    for r in d.collect():
        code = r.m % (1 << 64)
        assert code >> 63 == 1 and r.lv == 21 and r.up == code >> 3 and (r.d.x, r.d.y, r.d.z) == (r.x, r.y, r.z)
        unsigned[r.key] = code
    assert [unsigned[k] for k in sorted(unsigned)] == sorted(unsigned.values())
    mixed = spark.createDataFrame([(1,), (1 << 60,), (-(1 << 63),), (-1,), ((1 << 63) - 1,)], "m long").orderBy(morton.sort_key(F.col("m")))
    assert [r.m % (1 << 64) for r in mixed.collect()] == sorted([1, 1 << 60, 1 << 63, (1 << 64) - 1, (1 << 63) - 1])
    kids = spark.createDataFrame([(1 << 60,)], "m long").select(F.explode(morton.children(F.col("m"))).alias("c")).withColumn("p", morton.parent(F.col("c")))
    assert [r.p for r in kids.collect()] == [1 << 60] * 8
