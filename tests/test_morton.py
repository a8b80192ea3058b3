import pytest
from pyspark.sql import functions as F

from voxelake.functions import morton


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit(v):
    return F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long")


@pytest.mark.parametrize(
    "xyz, level, code",
    [((7, 5, 0), 3, 0x2CB), ((7, 5, 0), 10, 0x400000CB), ((5000, 6000, 7000), 5, 0xEA00), ((5000, 6000, 7000), 13, 0xF8BF396A00), ((5000, 6000, 7000), 21, 0x80000078BF396A00), ((1002999, 501956, 785965), 11, 0x3616E99CD)],
)
def test_encode(spark, xyz, level, code):
    assert one(spark, morton.encode(*map(lit, xyz), level)) % (1 << 64) == code


@pytest.mark.parametrize("level", [1, 5, 10, 11, 20, 21])
def test_round_trip(spark, level):
    n = (1 << level) - 1
    rows = spark.range(200).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n + 1)).alias(a) for k, a in enumerate("xyz")])
    code = morton.encode(F.col("x"), F.col("y"), F.col("z"), level)
    both = rows.withColumn("m", code).select("x", "y", "z", morton.decode(F.col("m")).alias("d"), morton.decode(F.col("m"), level).alias("e"), morton.level_of(F.col("m")).alias("l"))
    for r in both.collect():
        assert (r.x, r.y, r.z) == tuple(r.d) == tuple(r.e) and r.l == level


def test_family(spark):
    c = lit(0x2CB)
    assert one(spark, morton.parent(c)) == 0x59
    assert one(spark, morton.parent(lit(1))) is None
    assert one(spark, morton.children(c)) == list(range(0x1658, 0x1660))
    assert one(spark, morton.children(lit(0x3616E99CD))) == list(range(0x1B0B74CE68, 0x1B0B74CE70))
    assert one(spark, morton.children(lit(1 << 62))) == []
    assert tuple(one(spark, morton.child_interval(lit(1)))) == (8, 15)
    assert [one(spark, morton.is_descendant_of(lit(m), lit(0xF))) for m in (0xFFF7, 0x8FF0, 0x1, 0xCF19ABC, 0xF)] == [True, False, False, False, True]
    assert one(spark, morton.is_child_of(lit(0xF), lit(1))) and not one(spark, morton.is_child_of(lit(0xF), lit(3)))
    assert (morton.level_first(7), morton.level_last(7), morton.level_last(20)) == (0x200000, 0x3FFFFF, 0x1FFFFFFFFFFFFFFF)
    assert [one(spark, morton.level_of(lit(1 << k))) for k in (0, 3, 30, 60)] == [0, 1, 10, 20]
    assert one(spark, morton.path_to_root(lit(0x2CB))) == "0x2cb->0x59->0xb->0x1"
    assert one(spark, morton.ancestor(c, 3, 1)) == 0xB
    assert (one(spark, morton.first_descendant(lit(1), 2)), one(spark, morton.last_descendant(lit(1), 2))) == (64, 127)
    assert one(spark, morton.children(lit(1 << 3))) == list(range(64, 72))
