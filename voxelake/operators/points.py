"""Point views, bounds, normalisation and cell codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.functions import morton

AXES = ("x", "y", "z")


def bounds(points: DataFrame) -> DataFrame:
    """One row: origin (ox, oy, oz), size (sx, sy, sz), scale = 1 / the largest size (1 if that is 0), n."""
    low = [F.min(a).alias(f"o{a}") for a in AXES]
    high = [F.max(a).alias(f"h{a}") for a in AXES]
    b = points.agg(*low, *high, F.count(F.lit(1)).alias("n_points"))
    plus = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))  # noqa: E731  no negative zero
    b = b.select(*[plus(f"o{a}").alias(f"o{a}") for a in AXES], *[(F.col(f"h{a}") - F.col(f"o{a}")).alias(f"s{a}") for a in AXES], "n_points")
    most = F.greatest("sx", "sy", "sz")
    return b.select("ox", "oy", "oz", "sx", "sy", "sz", F.when(most > 0, F.lit(1.0) / most).otherwise(F.lit(1.0)).alias("scale"), "n_points")


def with_grid(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds the one row of `bounds` as struct `grid`: a scalar subquery, run once and inlined."""
    return points.withColumn("grid", grid.select(F.struct("ox", "oy", "oz", "sx", "sy", "sz", "scale").alias("g")).scalar())


def normalize(points: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """pos = (pos - origin) * scale; keeps `grid`."""
    out = with_grid(points, bounds(points) if grid is None else grid)
    return out.withColumns({a: (F.col(a) - F.col(f"grid.o{a}")) * F.col("grid.scale") for a in AXES})


def grid_size() -> list[Column]:
    """The grid's size in normalised space, of rows with `grid`."""
    return [F.col(f"grid.s{a}") * F.col("grid.scale") for a in AXES]


def cell_index(a: str, level: int) -> Column:
    size = F.col(f"grid.s{a}") * F.col("grid.scale") * F.lit(2.0**-level)
    return F.when(size > 0, F.floor(F.col(a) / F.nullif(size, F.lit(0.0)))).otherwise(F.lit(0)).cast("long")


def with_morton(points: DataFrame, level: int, grid: DataFrame | None = None) -> DataFrame:
    """Normalised points with `morton`; a point on the upper face gets index 2^level, which wraps to 0."""
    n = normalize(points, grid).withColumns({f"i{a}__": cell_index(a, level) for a in AXES})
    return n.withColumn("morton", morton.encode(*[F.col(f"i{a}__") for a in AXES], level)).drop(*[f"i{a}__" for a in AXES])
