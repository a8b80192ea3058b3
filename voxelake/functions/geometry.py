"""Boxes, grids, projections and surfels as Column arithmetic in DOUBLE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import morton

#: Rows of numbers, or of Columns where each row of a table has a matrix of its own.
Matrix = Sequence[Sequence[float]] | Sequence[Sequence[Column]]
AXES = ("x", "y", "z")
EPSILON_Z = 1e-6
EPSILON_NORMAL = 1e-10


def _number(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def product(a: Matrix, b: Matrix) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def planes(view_proj: Matrix) -> list[tuple[float, ...]]:
    """The six clip planes (a, b, c, d), inside where a x + b y + c z + d >= 0: row 4 plus or minus rows 1 to 3."""
    last = view_proj[3]
    return [tuple(w + s * v for w, v in zip(last, view_proj[i])) for i in range(3) for s in (1, -1)]


def is_cullable(low: Sequence[Column], high: Sequence[Column], view_proj: Matrix) -> Column:
    """The box lies wholly outside one plane: its corner farthest along the plane's normal is outside."""
    outside = []
    for a, b, c, d in planes(view_proj):
        reach = [F.greatest(n * low[i], n * high[i]) if isinstance(n, Column) else F.lit(float(n)) * (high[i] if n > 0 else low[i]) for i, n in enumerate((a, b, c))]
        outside.append(reach[0] + reach[1] + reach[2] + _number(d) < 0)
    return reduce(lambda x, y: x | y, outside)


def project(point: Sequence[Column], view_proj: Matrix) -> tuple[Column, Column]:
    """Normalised device x and y (null where w is 0)."""
    row = lambda i: reduce(lambda s, t: s + t, [_number(view_proj[i][k]) * point[k] for k in range(3)]) + _number(view_proj[i][3])
    w = F.nullif(row(3), F.lit(0.0))
    return row(0) / w, row(1) / w


def _length2(a, b) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    return dx * dx + dy * dy


def corner_depths(low: Sequence[Column], high: Sequence[Column]) -> tuple[Column, Column]:
    """z of the two corners; one in the plane z = 0 takes the other's."""
    return F.when(F.abs(low[2]) < EPSILON_Z, high[2]).otherwise(low[2]), F.when(F.abs(high[2]) < EPSILON_Z, low[2]).otherwise(high[2])


def projected_diagonal(low: Sequence[Column], high: Sequence[Column], view_proj: Matrix) -> Column:
    """The larger squared length of two projected diagonals of the box."""
    z0, z1 = corner_depths(low, high)
    a, b = (low[0], low[1], z0), (high[0], high[1], z1)
    first = _length2(project(a, view_proj), project(b, view_proj))
    second = _length2(project((a[0], b[1], b[2]), view_proj), project((b[0], a[1], a[2]), view_proj))
    return F.greatest(first, second)


def is_renderable(low, high, view_proj: Matrix, threshold: float) -> Column:
    return F.coalesce(projected_diagonal(low, high, view_proj) < threshold, F.lit(False))


def to_window(point: Sequence[Column], view_proj: Matrix, width: int, height: int) -> tuple[Column, Column]:
    """Integer pixels, cut towards zero."""
    x, y = project(point, view_proj)
    return tuple(((v + 1) * (size / 2)).cast("long") for v, size in ((x, width), (y, height)))


def window_diagonal(low, high, view_proj: Matrix, width: int, height: int) -> Column:
    """The larger squared length in pixels of the box's diagonal, and of the edge from its near upper corner to a box's depth
    behind the far one."""
    first = _length2(to_window(low, view_proj, width, height), to_window(high, view_proj, width, height))
    beyond = (high[0], high[1], high[2] + (high[2] - low[2]))
    second = _length2(to_window((high[0], high[1], low[2]), view_proj, width, height), to_window(beyond, view_proj, width, height))
    return F.greatest(first, second)


def is_renderable_window(low, high, view_proj: Matrix, threshold: float, width: int, height: int) -> Column:
    return F.coalesce(window_diagonal(low, high, view_proj, width, height) < threshold, F.lit(False))


def add(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x + y for x, y in zip(a, b)]


def scaled(a: Sequence[Column], k: float) -> list[Column]:
    return [x * k for x in a]


def approx_equal(a: Sequence[Column], b: Sequence[Column], epsilon: float) -> Column:
    """The distance is at most epsilon times the shorter of both vectors."""
    square = lambda v: reduce(lambda s, t: s + t, [x * x for x in v])
    return square([x - y for x, y in zip(a, b)]) <= epsilon * epsilon * F.least(square(a), square(b))


def cell_box(code: Column, level: Column | int, size: Sequence[Column], deepest: int = morton.SHALLOW_MAX) -> tuple[list[Column], list[Column]]:
    """Least and greatest corner of a cell in normalised space; size: of the whole grid."""
    at = morton.decode(code, level, deepest)
    part = F.lit(2.0**-level) if isinstance(level, int) else F.pow(F.lit(2.0), -level.cast("double"))
    low = [at[a].cast("double") * (s * part) for a, s in zip(AXES, size)]
    return low, [v + s * part for v, s in zip(low, size)]


def center(low: Sequence[Column], high: Sequence[Column]) -> list[Column]:
    return [a + (b - a) / 2 for a, b in zip(low, high)]


def half_area(extent: Sequence[Column]) -> Column:
    """ex (ey + ez) + ey ez, half of the surface."""
    x, y, z = extent
    return x * (y + z) + y * z


def surfel(position: Sequence[Column], normal: Sequence[Column], size_u: float = 1.0, size_v: float = 1.0) -> tuple[Column, list[Column], list[Column]]:
    """Whether a tangent frame exists, and its vectors u and v.  u points from the position to where the
    tangent plane meets the first axis that the normal has a part along; v = normal x u.  A zero normal, or a
    plane that meets the axis in the position itself, has no frame (null)."""
    d = normal[0] * position[0] + normal[1] * position[1] + normal[2] * position[2]
    along = F.when(F.abs(normal[0]) > EPSILON_NORMAL, 0).when(F.abs(normal[1]) > EPSILON_NORMAL, 1).when(F.abs(normal[2]) > EPSILON_NORMAL, 2)
    to = [F.when(along == i, d / F.nullif(normal[i], F.lit(0.0))).when(along.isNotNull(), F.lit(0.0)) - position[i] for i in range(3)]
    length = F.nullif(F.sqrt(to[0] * to[0] + to[1] * to[1] + to[2] * to[2]), F.lit(0.0))
    u = [t / length for t in to]
    v = [normal[1] * u[2] - normal[2] * u[1], normal[2] * u[0] - normal[0] * u[2], normal[0] * u[1] - normal[1] * u[0]]
    return length.isNotNull(), [c * size_u for c in u], [c * size_v for c in v]


# Tangent multipliers of the published models by model, sample ratio and level; (1, 1) elsewhere.
MULTIPLIERS = {
    ("david", 0.25): {7: (4.2, 4.2), 6: (2.5, 2.0), 5: (2.0, 2.0), 4: (2.0, 2.0), 3: (2.0, 2.0)},
    ("david", 0.2): {7: (4.7, 4.7), 6: (3.0, 2.5), 5: (2.0, 2.0), 4: (2.5, 2.5), 3: (2.0, 2.0)},
    ("david", 0.1): {7: (6.0, 6.0), 6: (3.0, 2.5), 5: (2.0, 2.0), 4: (2.5, 2.5), 3: (2.0, 2.0)},
    ("atlas", 0.25): {7: (3.8, 3.5), 6: (2.5, 2.0), 5: (2.0, 2.0), 4: (2.0, 2.0), 3: (2.0, 2.0)},
    ("atlas", 0.2): {7: (2.0, 2.0), 6: (2.5, 2.0), 5: (2.3, 2.3), 4: (2.3, 2.3), 3: (2.0, 2.0)},
    ("st_mathew", 0.25): {7: (4.2, 4.0), 6: (2.3, 2.0), 5: (2.0, 2.0), 4: (2.0, 2.0), 3: (2.0, 2.0)},
    ("st_mathew", 0.2): {7: (2.0, 2.0), 6: (2.6, 2.3), 5: (2.2, 2.2), 4: (2.5, 2.5), 3: (2.0, 2.0)},
    ("duomo", 0.25): {7: (4.2, 4.2), 6: (2.7, 1.9), 5: (2.6, 1.5), 4: (2.0, 1.7), 3: (2.0, 2.0)},
    ("duomo", 0.2): {7: (4.4, 4.4), 6: (3.0, 2.1), 5: (2.8, 1.8), 4: (2.0, 2.0), 3: (2.0, 1.0)},
}


def multipliers(model: str, ratio: float) -> dict[int, tuple[float, float]]:
    """By level; models but the first share the values of ratio 0.2 at 0.1."""
    return MULTIPLIERS.get((model, ratio)) or (MULTIPLIERS.get((model, 0.2), {}) if ratio == 0.1 else {})


def multiplier(level: Column, model: str, ratio: float) -> tuple[Column, Column]:
    table = multipliers(model, ratio)
    pick = lambda i: reduce(lambda c, lv: c.when(level == lv, table[lv][i]), sorted(table), F.when(F.lit(False), 1.0)).otherwise(F.lit(1.0))
    return pick(0), pick(1)


def accumulated_multiplier(first: Column, last: Column, model: str, ratio: float) -> tuple[Column, Column]:
    """The product over levels first to last (1 if there are none)."""
    levels = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    over = lambda i: F.aggregate(levels, F.lit(1.0), lambda acc, lv: acc * multiplier(lv, model, ratio)[i])
    return over(0), over(1)


def adapt_threshold(threshold: Column, frame_ms: Column, target_ms: float, tolerance_ms: float, gain: float = 1e-3, low: float = 2 / 1024, high: float = 1.0) -> Column:
    """The projection threshold of the next frame: up if frames take too long, down if there is time left."""
    moved = F.when(F.abs(frame_ms - target_ms) > tolerance_ms, threshold + (frame_ms - target_ms) * gain).otherwise(threshold)
    return F.least(F.lit(high), F.greatest(F.lit(low), moved))
