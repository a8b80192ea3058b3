import pytest

from voxelake.sources.key_table import Conflict, KeyTable


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes_in_place(spark, tmp_path):
    t = KeyTable.create(spark, str(tmp_path / "t"), "morton long, v string", bucket_bits=3)
    assert rows(t.read()) == []
    t.upsert(spark.createDataFrame([(k, f"a{k}") for k in range(40)], "morton long, v string"))
    t.upsert(spark.createDataFrame([(5, "b5"), (5, "c5"), (99, "b99")], "morton long, v string"))
    want = {k: f"a{k}" for k in range(40)} | {5: "c5", 99: "b99"}
    assert rows(t.read()) == sorted(want.items())
    # buckets that a change doesn't touch keep their folders
    before, now = t.folder.read("versions/000000001"), t.version()[1]
    assert {k for k in now["buckets"] if now["buckets"][k] != before["buckets"].get(k)} == {"0", "12"}
    assert rows(t.range(6, 9)) == [(k, f"a{k}") for k in range(6, 10)] and rows(t.lookup([5, 1000])) == [(5, "c5")]
    assert len(t.range(6, 9).inputFiles()) < len(t.read().inputFiles())
    t.delete_range(6, 17)
    want = {k: v for k, v in want.items() if not 6 <= k <= 17}
    assert rows(t.read()) == sorted(want.items()) and rows(t.read(1))[6] == (6, "a6")
    t.delete_range(0, 1 << 40)
    assert rows(t.read()) == [] and t.version()[0] == 4
    with pytest.raises(Exception, match="key is null"):
        t.upsert(spark.createDataFrame([(None, "x")], "morton long, v string"))
    t.drop()
    with pytest.raises(FileNotFoundError):
        t.version()


def test_transactions(spark, tmp_path):
    t = KeyTable.create(spark, str(tmp_path / "t"), "id long, v long", key="id")
    one = spark.createDataFrame([(1, 1), (2, 2)], "id long, v long")
    with t.transaction():
        t.upsert(one)
        t.delete_range(2, 2)
        assert rows(t.read()) == [(1, 1)] and rows(KeyTable(spark, str(tmp_path / "t")).read()) == []
    assert rows(t.read()) == [(1, 1)] and t.version()[0] == 1
    with pytest.raises(ZeroDivisionError), t.transaction():
        t.upsert(one)
        raise ZeroDivisionError
    assert rows(t.read()) == [(1, 1)] and t.version()[0] == 1
    other = KeyTable(spark, str(tmp_path / "t"))
    with pytest.raises(Conflict), t.transaction():
        t.upsert(one)
        other.delete_range(1, 1)
    assert rows(t.read()) == []
    with pytest.raises(Conflict):
        KeyTable.create(spark, str(tmp_path / "t"), "id long, v long")
