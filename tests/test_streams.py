from pyspark.sql import functions as F

from voxelake.operators import hierarchy
from voxelake.streaming import build
from voxelake.streaming.front import Placeholders, prunable

LEVEL = 4


def batch(spark, lo, hi):
    return spark.range(lo, hi).select((F.pmod(F.xxhash64("id"), F.lit(1 << 12)) + (1 << 12)).alias("morton"))


def rows(df):
    return sorted(map(tuple, df.select("level", "morton", "n_points").collect()))


def test_a_tree_batch_by_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build.IncrementalTree, "FOLD", 2)
    tree = build.IncrementalTree(spark, str(tmp_path / "tree"), LEVEL)
    parts = [batch(spark, i * 60, i * 60 + 60) for i in range(5)]
    for i, p in enumerate(parts):
        for _ in range(2):  # a batch that runs again replaces itself
            tree.add(p, i)
            tree.fold(i)
        whole = parts[0]
        for q in parts[1 : i + 1]:
            whole = whole.union(q)
        assert rows(tree.nodes()) == rows(hierarchy.pyramid(hierarchy.cells(whole), LEVEL))
        touched = {r.morton for r in tree.touched(i).collect()}
        assert touched == {r.morton >> (3 * k) for r in p.collect() for k in range(LEVEL + 1)}
    assert tree.cover() == ["02-000000000-000000003", "00-000000004-000000004"]
    assert rows(tree.nodes(3)) == rows(hierarchy.pyramid(hierarchy.cells(parts[0].union(parts[1]).union(parts[2])), LEVEL))
    tree.add(parts[0], 5, taken=parts[1].union(parts[0]))  # points go again
    tree.fold(5)
    left = parts[0].union(parts[2]).union(parts[3]).union(parts[4])
    assert rows(tree.nodes()) == rows(hierarchy.pyramid(hierarchy.cells(left), LEVEL))
    tree.clean()
    assert rows(tree.nodes()) == rows(hierarchy.pyramid(hierarchy.cells(left), LEVEL)) and len(tree.folder.names("runs")) == 3


def test_a_batch_reads_and_writes_what_it_brings(spark, tmp_path):
    """However large the tree is: a batch writes its own nodes, and what it reads is the batch."""
    tree = build.IncrementalTree(spark, str(tmp_path / "tree"), LEVEL)
    sizes = []
    for i, n in enumerate((5000, 20, 20)):
        p = spark.range(i * 5000, i * 5000 + n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 12)) + (1 << 12)).alias("morton"))
        plan = hierarchy.pyramid(hierarchy.cells(p), LEVEL)._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan
        tree.add(p, i)
        sizes.append(tree.touched(i).count())
    assert sizes[0] > 2500 and all(n <= 20 * (LEVEL + 1) for n in sizes[1:])


def test_groups_are_held_back_until_the_end(spark, tmp_path):
    tree = build.IncrementalTree(spark, str(tmp_path / "tree"), LEVEL)
    places = Placeholders(spark, str(tmp_path / "places"), LEVEL - 1)
    for i, p in enumerate((batch(spark, 0, 40), batch(spark, 40, 60))):
        tree.add(p, i)
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        places.follow(build.file_stream(spark, str(tmp_path / "in")), LEVEL)  # each time a restart from the checkpoint
    leaves = {r.morton >> 3 for r in batch(spark, 0, 60).collect()}
    assert {r.morton for r in places.all().collect()} == leaves and places.all().count() == len(leaves)
    nodes = hierarchy.nodes(hierarchy.cells(batch(spark, 0, 60)), LEVEL - 1, LEVEL)
    last = {r.morton >> 6 for r in batch(spark, 40, 60).collect()}
    got = {r.parent: r.prunable for r in prunable(places.all(), nodes, tree).collect()}
    assert got == {m >> 3: (m >> 3) not in last for m in leaves} and not all(got.values())
    tree.finish()
    assert all(r.prunable for r in prunable(places.all(), nodes, tree).collect())
    # nothing loaded: all is pending without a level; the root loaded: it stands for everything
    none = spark.createDataFrame([], "morton long")
    assert [tuple(r) for r in places.pending(none).collect()] == [(None, len(leaves))]
    root = spark.createDataFrame([(1,)], "morton long")
    assert [tuple(r) for r in places.pending(root).collect()] == [(0, len(leaves))]


def test_placeholders_go_on_after_a_failure(spark, tmp_path):
    """A sink that fails in the middle; the stream that is started again gives the same codes, each once."""
    for i in range(3):
        batch(spark, i * 30, i * 30 + 50).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    places = Placeholders(spark, str(tmp_path / "places"), LEVEL - 1)
    cells = build.file_stream(spark, str(tmp_path / "in"), 1).withColumn("morton", F.when(F.lit(True), F.col("morton")))
    broken = cells.withColumn("morton", F.when(F.col("morton") == batch(spark, 100, 101).first()[0], F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("morton")))
    try:
        places.follow(broken, LEVEL)
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "broken" in str(e)
    assert 0 < places.all().count()
    places.follow(cells, LEVEL)
    leaves = {r.morton >> 3 for r in batch(spark, 0, 110).collect()}
    assert {r.morton for r in places.all().collect()} == leaves and places.all().count() == len(leaves)


def test_requests_are_answered_once(spark, tmp_path):
    nodes = spark.createDataFrame([(64 + i, i) for i in range(16)], "morton long, n_points long")
    asked = spark.createDataFrame([(64, 71), (72, 79), (64, 71), (64, 70)], "a long, b long")
    asked.repartition(3).write.parquet(str(tmp_path / "asked"))
    got = sorted(r.morton for r in build.answered(spark, str(tmp_path / "asked"), nodes, 2).collect())
    assert got == list(range(64, 80))


def test_a_stream_reads_only_the_table_it_is_given(spark, tmp_path):
    for name in ("t.parquet", "t.parquet_old"):
        spark.range(10).write.parquet(str(tmp_path / name))
    q = build.file_stream(spark, str(tmp_path / "t.parquet")).writeStream.format("memory").queryName("given").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("given").count() == 10
