"""Faces with lists of any length, cut into splits."""

import struct

import numpy as np
import pytest

from voxelake.sources import ply


def mesh(path, order, entry, before, after, faces, vertices=3):
    """A file of vertices and faces with a property on either side of the list."""
    kind = {"i4": "int", "u2": "ushort"}[entry]
    lines = ["ply", f"format binary_{'big' if order == '>' else 'little'}_endian 1.0", f"element vertex {vertices}", *[f"property float {c}" for c in "xyz"], f"element face {len(faces)}"]
    lines += ["property short a"] * before + [f"property list uchar {kind} vertex_indices"] + ["property double b"] * after + ["end_header", ""]
    body = np.zeros(3 * vertices, order + "f4").tobytes()
    for i, face in enumerate(faces):
        body += struct.pack(order + "h", i % 100) * before + bytes([len(face)]) + np.array(face, order + entry).tobytes() + struct.pack(order + "d", 0.5) * after
    path.write_bytes("\n".join(lines).encode() + body)


def faces_of(n, seed, most=9):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 60000, rng.integers(0, most)).tolist() for _ in range(n)]


@pytest.mark.parametrize("order, entry, before, after", [("<", "i4", 0, 0), (">", "i4", 0, 0), ("<", "u2", 1, 0), (">", "i4", 1, 1), ("<", "i4", 0, 1)])
@pytest.mark.parametrize("step", [300, 1500, 1 << 20])
def test_polygons_in_splits(spark, tmp_path, order, entry, before, after, step):
    faces = faces_of(900, 3) + [list(range(255))] * 3 + [[]] * 40 + faces_of(60, 4)
    mesh(tmp_path / "m.ply", order, entry, before, after, faces)
    path = str(tmp_path / "m.ply")
    found = ply.polygon_ranges(spark, path, step)
    if step == 1 << 20:
        assert found == []
    else:
        assert len(found) > 5 and sum(n for _, n in found) == len(faces)
        h = ply.header_of(path)
        reader = ply.PlyReader({"path": path, "ranges": __import__("json").dumps({path: found})}, "face")
        assert [s.first for s in reader.partitions()] == [at for at, _ in found] and h.elements[1].count == len(faces)
    got = ply.read(spark, path, "face", bytes_per_split=step)
    assert got.rdd.getNumPartitions() == max(1, len(found))
    assert [r.vertex_indices for r in got.collect()] == faces  # splits are in the file's order


def test_blocks_shorter_than_a_row(tmp_path):
    """Places are carried over blocks of any size."""
    faces = faces_of(80, 5)
    mesh(tmp_path / "m.ply", "<", "i4", 0, 0, faces)
    path = str(tmp_path / "m.ply")
    h = ply.header_of(path)
    rows = ply._list_rows(h, h.element("face"))
    end = ply._size_of(path)
    with open(path, "rb") as f:
        whole = ply._scan(f, rows.begin, end, rows)
        for block in (7, 64, 1000):
            to, count = ply._scan(f, rows.begin, end, rows, block)
            assert to[0] == whole[0][0] == 0 and count[0] == whole[1][0] == len(faces)


def test_a_mesh_that_ends_early(spark, tmp_path):
    mesh(tmp_path / "m.ply", "<", "i4", 0, 0, faces_of(500, 6))
    raw = (tmp_path / "m.ply").read_bytes()
    (tmp_path / "cut.ply").write_bytes(raw[:-2000])
    with pytest.raises(ply.PlyError, match="ends early"):
        ply.polygon_ranges(spark, str(tmp_path / "cut.ply"), 400)


def test_what_cannot_be_cut_is_one_split(spark, tmp_path):
    text = "ply\nformat ascii 1.0\nelement vertex 0\nelement face 3\nproperty list uchar int vertex_indices\nend_header\n3 0 1 2\n4 0 1 2 3\n0\n"
    (tmp_path / "a.ply").write_text(text)
    assert ply.polygon_ranges(spark, str(tmp_path / "a.ply"), 4) == []
    assert [r.vertex_indices for r in ply.read(spark, str(tmp_path / "a.ply"), "face", bytes_per_split=4).collect()] == [[0, 1, 2], [0, 1, 2, 3], []]


def test_tasks_do_not_grow_with_small_splits(spark, tmp_path):
    """More splits than MOST_SPLITS grow, over all files together, and one job cuts them all."""
    faces = [faces_of(2500, k) for k in (7, 8)]
    for k in (0, 1):
        mesh(tmp_path / f"{k}.ply", "<", "i4", 0, 0, faces[k])
    got = ply.read(spark, str(tmp_path), "face", bytes_per_split=20)
    assert 100 < got.rdd.getNumPartitions() <= ply.MOST_SPLITS + 2
    assert [r.vertex_indices for r in got.collect()] == faces[0] + faces[1]
    rows = ply.PlyReader({"path": str(tmp_path), "rows_per_split": "1"}, "vertex")
    assert len(rows.partitions()) == 6  # below that number they are as asked for


def test_small_splits_read_their_own_bytes(tmp_path):
    mesh(tmp_path / "m.ply", "<", "i4", 0, 0, faces_of(20_000, 9))
    path = str(tmp_path / "m.ply")
    h = ply.header_of(path)
    seen = []

    class Seen:
        def __init__(self, f):
            self.seek, self._f = f.seek, f

        def read(self, n):
            seen.append(n)
            return self._f.read(n)

    with open(path, "rb") as f:
        rows = ply._list_rows(h, h.element("face"))
        batches = list(ply.PlyReader({"path": path}, "face")._polygons(Seen(f), h, h.element("face"), ply.Split(path, rows.begin, 100, True), 0))
    assert sum(b.num_rows for b in batches) == 100 and sum(seen) < 10_000


def test_bodies_of_polygons(tmp_path):
    faces = faces_of(300, 10) + [list(range(255)), []]
    batch = ply.pa.RecordBatch.from_arrays([ply.pa.array(faces, ply.pa.list_(ply.pa.int64()))], ["vertex_indices"])
    assert ply._body(batch, "face") == b"".join(bytes([len(f)]) + np.array(f, "<i4").tobytes() for f in faces)
    with pytest.raises(ply.PlyError, match="255"):
        ply._body(ply.pa.RecordBatch.from_arrays([ply.pa.array([list(range(256))], ply.pa.list_(ply.pa.int64()))], ["vertex_indices"]), "face")
