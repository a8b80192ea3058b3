import numpy as np
import pytest

from voxelake.sources import octree_store, ply

ROWS = [(1.0, 15.0, 2.0, 0.01, 0.02, 0.03), (3.0, -31.0, 4.0, 0.04, 0.05, 0.06), (-14.0, 5.0, 6.0, 0.07, 0.08, 0.09)]


def ascii_file(path, extra=False, normals=True):
    names = ["x", "y", "z"] + (["nx", "ny", "nz"] if normals else []) + (["red"] if extra else [])
    text = ["ply", "format ascii 1.0", "comment made by a test", f"element vertex {len(ROWS)}", *[f"property float {n}" for n in names], "element face 1", "property list uchar int vertex_indices", "end_header"]
    text += [" ".join(map(str, r[: 6 if normals else 3] + ((7.0,) if extra else ()))) for r in ROWS] + ["3 0 1 2"]
    path.write_text("\n".join(text))
    return str(path)


def rows(df):
    return sorted(tuple(round(float(v), 4) for v in r) for r in df.select("x", "y", "z", "nx", "ny", "nz").collect())


@pytest.mark.parametrize("extra", [False, True])
def test_ascii(spark, tmp_path, extra):
    p = ascii_file(tmp_path / "a.ply", extra)
    assert rows(ply.read(spark, p)) == sorted(ROWS)
    assert ply.read(spark, p, "face").collect()[0][0] == [0, 1, 2]


def test_without_normals(spark, tmp_path):
    p = ascii_file(tmp_path / "a.ply", normals=False)
    assert {r[3:] for r in rows(ply.read(spark, p))} == {(1.0, 0.0, 0.0)}


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary_splits(spark, tmp_path, order):
    at = np.arange(3000, dtype=order + "f4").reshape(500, 6)
    kind = "binary_little_endian" if order == "<" else "binary_big_endian"
    head = "\n".join(["ply", f"format {kind} 1.0", "element vertex 500", *[f"property float32 {c}" for c in ("x", "y", "z", "nx", "ny", "nz")], "end_header"]) + "\n"
    (tmp_path / "b.ply").write_bytes(head.encode() + at.tobytes())
    df = ply.read(spark, str(tmp_path / "b.ply"), rows_per_split=64)
    assert df.rdd.getNumPartitions() == 8
    assert rows(df) == sorted(tuple(map(float, r)) for r in at)


def test_write_merge_and_group(spark, tmp_path):
    p = ascii_file(tmp_path / "a.ply")
    (tmp_path / "g.gp").write_text(f"{p}\n{p}\n{p}\n")
    g = ply.read_group(spark, str(tmp_path / "g.gp"))
    assert g.count() == 9
    faces = ply.read_group(spark, str(tmp_path / "g.gp"), "face")
    from pyspark.sql import functions as F

    from voxelake.operators import keyed

    off = keyed.file_offsets(g.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n")))
    merged = keyed.merge_faces(faces, off).orderBy("file_ord")
    assert [r.vertex_indices for r in merged.collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    out = str(tmp_path / "m.ply")
    with pytest.raises(ply.PlyError):
        ply.write(g, out, merged)
    ply.write(g.withColumn("nth", F.monotonically_increasing_id()), out, merged, "nth", "file_ord")
    assert rows(ply.read(spark, out)) == sorted(ROWS * 3)
    assert [r[0] for r in ply.read(spark, out, "face").collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    again = str(tmp_path / "n.ply")
    ply.merge(str(tmp_path / "g.gp"), spark, again)
    assert (tmp_path / "n.ply").read_bytes() == (tmp_path / "m.ply").read_bytes()
    # triangles by ranges of rows, in the file's order
    df = ply.read(spark, again, "face", rows_per_split=2)
    assert df.rdd.getNumPartitions() == 2 and [r[0] for r in df.collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert [tuple(round(float(v), 4) for v in r) for r in ply.read(spark, again).collect()] == ROWS * 3


def test_parts_in_the_order_of_an_index(spark, tmp_path):
    from pyspark.sql import functions as F

    n = 1000
    rows = spark.range(n).select("id", *[(F.col("id") + k).cast("float").alias(c) for k, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))]).repartition(7, F.rand(1))
    ply.write_parts(rows, str(tmp_path / "parts"), index="id")
    assert [r.x for r in ply.read(spark, str(tmp_path / "parts")).collect()] == list(range(n))
    assert not [p for p in (tmp_path / "parts").iterdir() if p.suffix != ".ply"]
    quads = spark.createDataFrame([([0, 1, 2, 3],), ([3, 4, 5],), ([],)], "vertex_indices array<long>").coalesce(1)
    ply.write_parts(quads, str(tmp_path / "faces"), "face")
    assert sorted(r[0] for r in ply.read(spark, str(tmp_path / "faces"), "face").collect()) == [[], [0, 1, 2, 3], [3, 4, 5]]


@pytest.mark.parametrize("step", [1, 7, 10, 64, 100000])
def test_ascii_by_ranges_of_bytes(spark, tmp_path, step):
    lines = [" ".join(map(str, (i, i / 2, -i, 1, 0, 0))) for i in range(120)]
    (tmp_path / "a.ply").write_text("\n".join(["ply", "format ascii 1.0", "element vertex 120", *[f"property float {c}" for c in ("x", "y", "z", "nx", "ny", "nz")], "end_header", *lines]))
    reader = ply.PlyReader({"path": str(tmp_path / "a.ply"), "bytes_per_split": step}, "vertex")
    splits = reader.partitions()
    got = [x for s in splits for b in reader.read(s) for x in b.column("x").to_pylist()]
    assert got == list(range(120)) and (len(splits) > 1 or step > 10000)


def test_bad_files(spark, tmp_path):
    (tmp_path / "x.ply").write_text("nothing")
    with pytest.raises(Exception, match="PLY"):
        ply.read(spark, str(tmp_path / "x.ply")).collect()
    with pytest.raises(ply.PlyError):
        ply.header_of(str(_short(tmp_path)))


def _short(d):
    p = d / "y.ply"
    p.write_text("ply\nformat ascii 1.0\nelement vertex x\nend_header\n")
    return p


def test_octree_store(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 5), (8, 1, 2), (9, 1, 3), (64, 2, 2), (77, 2, 3)], "morton long, level int, n_points long")
    d = str(tmp_path / "nodes")
    octree_store.write_breadth(nodes, d)
    seen = []
    assert octree_store.read_progressively(spark, d, lambda lv, df: seen.append((lv, df.count())), 60) == 2
    assert seen == [(0, 1), (1, 2), (2, 2)]
    e = str(tmp_path / "deep")
    octree_store.write_depth(nodes, e, 2)
    assert [r.morton for r in spark.read.parquet(e).collect()] and spark.read.parquet(e).count() == 5
    with pytest.raises(ValueError):
        octree_store.read_progressively(spark, e, print)
    meta = octree_store.Meta("p", d, (1.0, 0.5, 0.25), (0.0, 0.0, 0.0), 2)
    octree_store.write_meta(meta, str(tmp_path / "m.oct"))
    kind, table, got = octree_store.open_cloud(spark, str(tmp_path / "m.oct"))
    assert kind == "octree" and table.count() == 5 and got == meta
    (tmp_path / "n.oct").write_text('{"points": "p", "nodes": "n", "depth": 3, "size": {"x": 1, "y": 1, "z": 1}}')
    assert octree_store.read_meta(str(tmp_path / "n.oct")).origin == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        octree_store.open_cloud(spark, "a.txt")


def test_progressive_reading_waits_for_the_writer(spark, tmp_path):
    d = str(tmp_path / "nodes")
    levels = {0: [(1,)], 1: [(8,), (9,)], 2: [(64,), (70,), (77,)]}
    seen = []

    def put(lv):
        octree_store.write_level(spark.createDataFrame(levels[lv], "morton long"), d, lv, lv == 2)

    def each(lv, df):
        seen.append((lv, sorted(r.morton for r in df.collect())))
        if lv < 2:  # the next level comes only now
            put(lv + 1)

    put(0)
    assert octree_store.read_progressively(spark, d, each, 120) == 2
    assert seen == [(lv, [m for (m,) in v]) for lv, v in levels.items()]
    half = str(tmp_path / "half")
    octree_store.write_level(spark.createDataFrame([(1,)], "morton long"), half, 0, False)
    with pytest.raises(TimeoutError):
        octree_store.read_progressively(spark, half, lambda *a: None, 2)


def test_sort_to_file(spark, tmp_path):
    from pyspark.sql import functions as F

    cloud = spark.range(500).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(97)) / 4).alias(a) for k, a in enumerate("xyz")], *[F.lit(v).alias(c) for c, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))])
    meta = octree_store.sort_to_file(cloud, 5, str(tmp_path / "s.ply"), str(tmp_path / "s.oct"), "id")
    assert octree_store.read_meta(str(tmp_path / "s.oct")) == meta and meta.depth == 5
    from voxelake.operators import points

    want = [(r.x, r.y, r.z) for r in cloud.join(points.with_morton(cloud, 5).select("id", "morton"), "id").orderBy("morton", "id").collect()]
    assert [(r.x, r.y, r.z) for r in ply.read(spark, str(tmp_path / "s.ply")).collect()] == want


def test_report(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1), (1, 8)], "level int, n_nodes long")
    octree_store.write_report(stats, str(tmp_path / "report"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "report")).select("level", "n_nodes").collect())) == [(0, 1), (1, 8)]
