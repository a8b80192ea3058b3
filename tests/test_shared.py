"""Published files, and tables that change within a session."""

import threading

from voxelake.plans import catalog
from voxelake.sources.shared import Folder


def test_publish_once_whoever_comes_between(spark, tmp_path, monkeypatch):
    a, b = Folder(spark, str(tmp_path / "f")), Folder(spark, str(tmp_path / "f"))
    place = Folder._place
    met = []

    def slow(self, hidden, target):
        if self is a and not met:  # A has written its file, but not yet put it in place; B reads and publishes
            met.append((b.read("x/1"), b.publish("x/1", {"by": "b"})))
        return place(self, hidden, target)

    monkeypatch.setattr(Folder, "_place", slow)
    assert a.publish("x/1", {"by": "a"}) is False
    assert met == [(None, True)] and a.read("x/1") == b.read("x/1") == {"by": "b"}
    assert not b.publish("x/1", {"by": "c"}) and a.names("x") == ["1"]
    assert [p.name for p in (tmp_path / "f" / "x").iterdir()] == ["1"]


def test_one_of_many_publishers_wins(spark, tmp_path):
    won = []

    def run(i):
        if Folder(spark, str(tmp_path / "f")).publish("v", {"by": i, "more": "x" * 5000}):
            won.append(i)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and Folder(spark, str(tmp_path / "f")).read("v")["by"] == won[0]


def test_rename_where_links_are_not_known(spark, tmp_path, monkeypatch):
    """The way of other file systems."""
    f = Folder(spark, str(tmp_path / "f"))
    monkeypatch.setattr(Folder, "_linked", lambda self: False)
    assert f.publish("a", {"n": 1}) and f.read("a") == {"n": 1}
    hidden = f.at(".late")
    f._fs.create(hidden, False).close()
    assert not f._place(hidden, f.at("a")) and f.read("a") == {"n": 1}


def test_a_table_written_anew_is_read_anew(spark, tmp_path):
    d = str(tmp_path)
    kind = "l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame([(float(i), float(i * 7 % 50), 0.01 * (i % 9)) for i in range(200)], kind).write.parquet(f"{d}/lineitem.parquet")
    first = catalog.stored_nodes(spark, d).where("morton = 1").first().n_points
    assert catalog.built(spark, d) is catalog.built(spark, d)
    spark.createDataFrame([(float(i), float(i * 5 % 40), 0.02 * (i % 5)) for i in range(77)], kind).write.mode("overwrite").parquet(f"{d}/lineitem.parquet")
    assert (first, catalog.stored_nodes(spark, d).where("morton = 1").first().n_points, catalog.line_nodes(spark, d).where("morton = 1").first().n_points) == (200, 77, 77)
