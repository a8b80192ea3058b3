"""Registered queries on points, boxes, windows and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelake.functions import geometry
from voxelake.plans.catalog import BOXES_SQL, EMBEDDED_SQL, VIEW, _H, _L, boxed, embedded_points, query, table

_WIDTH, _HEIGHT = 1024, 512


def _square(*parts: str) -> str:
    return "(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


def _approx(a: list[str], b: list[str], epsilon: str) -> str:
    return f"{_square(*[f'{x} - {y}' for x, y in zip(a, b)])} <= {epsilon} * {epsilon} * least({_square(*a)}, {_square(*b)})"


_P, _N = ["x", "y", "z"], ["nx", "ny", "nz"]
_MOVED = [f"({p} + {n} * 0.25)" for p, n in zip(_P, _N)]


@query(
    "point_algebra",
    f"SELECT pid, {', '.join(f'{p} + {n} AS s{p}' for p, n in zip(_P, _N))}, {', '.join(f'{p} * 2.5 AS m{p}' for p in _P)}, {_approx(_P, _MOVED, '0.3::DOUBLE')} AS near FROM ({EMBEDDED_SQL})".replace("* 0.25", "* 0.25::DOUBLE").replace("* 2.5", "* 2.5::DOUBLE"),
)
def point_algebra(spark, sf_dir):
    """Sums and multiples by component, and equality up to a relative distance."""
    p, n = [F.col(c) for c in _P], [F.col(c) for c in _N]
    total, many = geometry.add(p, n), geometry.scaled(p, 2.5)
    near = geometry.approx_equal(p, geometry.add(p, geometry.scaled(n, 0.25)), 0.3)
    return embedded_points(spark, sf_dir).select("pid", *[c.alias(f"s{a}") for a, c in zip(_P, total)], *[c.alias(f"m{a}") for a, c in zip(_P, many)], near.alias("near"))


@query(
    "box_algebra",
    f"{BOXES_SQL}, grown AS (SELECT morton >> 3 AS parent, {', '.join([f'min({c}) AS {c}' for c in _L] + [f'max({c}) AS {c}' for c in _H])} FROM x WHERE morton <> 1 GROUP BY x.morton >> 3) "
    f"SELECT parent, {', '.join(_L + _H)}, {', '.join(f'l{a} + (h{a} - l{a}) / 2 AS c{a}' for a in 'xyz')}, ((hx - lx) * ((hy - ly) + (hz - lz)) + (hy - ly) * (hz - lz)) AS half_area FROM grown",
)
def box_algebra(spark, sf_dir):
    """Boxes grown over siblings, with their centres and half areas."""
    low, high = [F.col(c) for c in _L], [F.col(c) for c in _H]
    grown = boxed(spark, sf_dir).where("morton <> 1").groupBy(F.shiftrightunsigned("morton", 3).alias("parent")).agg(*[F.min(c).alias(c) for c in _L], *[F.max(c).alias(c) for c in _H])
    area = geometry.half_area([b - a for a, b in zip(low, high)])
    return grown.select("parent", *_L, *_H, *[c.alias(f"c{a}") for a, c in zip("xyz", geometry.center(low, high))], area.alias("half_area"))


def _window_sql() -> str:
    m = VIEW.view_proj

    def row(i, p):
        return f"((({float(m[i][0])!r}::DOUBLE * {p[0]}) + ({float(m[i][1])!r}::DOUBLE * {p[1]})) + ({float(m[i][2])!r}::DOUBLE * {p[2]}) + ({float(m[i][3])!r}::DOUBLE))"

    def pixel(p, i, size):
        return f"trunc(({row(i, p)} / nullif({row(3, p)}, 0) + 1) * {size / 2!r}::DOUBLE)::BIGINT"

    corners = {"a": _L, "b": _H, "c": ["hx", "hy", "lz"], "d": ["hx", "hy", "(hz + (hz - lz))"]}
    flat = ", ".join(f"{pixel(p, i, size)} AS {k}{v}" for k, p in corners.items() for i, (v, size) in enumerate((("u", _WIDTH), ("v", _HEIGHT))))
    return f"{BOXES_SQL}, w AS (SELECT morton, {flat} FROM x), d AS (SELECT morton, greatest({_square('bu - au', 'bv - av')}, {_square('du - cu', 'dv - cv')}) AS diagonal FROM w) SELECT morton, diagonal::BIGINT AS diagonal, coalesce(diagonal < 900, false) AS renderable FROM d"


@query("window_projection", _window_sql())
def window_projection(spark, sf_dir):
    low, high = [F.col(c) for c in _L], [F.col(c) for c in _H]
    d = geometry.window_diagonal(low, high, VIEW.view_proj, _WIDTH, _HEIGHT)
    return boxed(spark, sf_dir).select("morton", d.alias("diagonal"), geometry.is_renderable_window(low, high, VIEW.view_proj, 900, _WIDTH, _HEIGHT).alias("renderable"))


_LEVELS = "(VALUES " + ", ".join(f"({lv}, {u}::DOUBLE, {v}::DOUBLE)" for lv, (u, v) in sorted(geometry.multipliers("duomo", 0.25).items())) + ") AS t(lv, u, v)"


@query(
    "accumulated_multipliers",
    f"WITH r AS (SELECT a::INTEGER AS first, b::INTEGER AS last FROM (SELECT unnest(range(0, 10)) AS a), (SELECT unnest(range(0, 10)) AS b)) "
    f"SELECT first, last, round(coalesce(product(u), 1), 9) AS mu, round(coalesce(product(v), 1), 9) AS mv FROM r LEFT JOIN {_LEVELS} ON lv BETWEEN first AND last GROUP BY 1, 2",
)
def accumulated_multipliers(spark, sf_dir):
    pairs = spark.range(100).select((F.col("id") % 10).cast("int").alias("first"), F.floor(F.col("id") / 10).cast("int").alias("last"))
    mu, mv = geometry.accumulated_multiplier(F.col("first"), F.col("last"), "duomo", 0.25)
    return pairs.select("first", "last", F.round(mu, 9).alias("mu"), F.round(mv, 9).alias("mv"))


@query("adaptive_threshold", "SELECT event_id, least(1.0::DOUBLE, greatest((2.0 / 1024)::DOUBLE, CASE WHEN abs(value - 40) > 15 THEN t + (value - 40) * 0.001::DOUBLE ELSE t END)) AS threshold FROM (SELECT event_id, value, (event_id % 100)::DOUBLE / 100 AS t FROM events)")
def adaptive_threshold(spark, sf_dir):
    """One step of the control for each event as a frame of `value` milliseconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", geometry.adapt_threshold((F.col("event_id") % 100).cast("double") / 100, F.col("value"), 40.0, 15.0).alias("threshold"))
