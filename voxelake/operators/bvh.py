"""Bounding volume hierarchy by surface-area insertion.

Insertion depends on the order of the points and is sequential: `build` is the exact form for one group.
`build_partitioned` builds one tree for each group of rows, so groups run side by side; its trees differ from the
single one.  `spatial_groups` makes the groups: the shallowest cells with few enough points, found by counts of cells, so
no task gets more than it can hold however the points are spread.  `one_tree` joins the groups' roots to a single root: eight at
most meet at a time, those of one cell, and the two whose common box has the least surface become a node, until one is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import hierarchy
from voxelake.sources.shared import stored

MAX_LEVEL = 24
#: Points of one tree.
GROUP_POINTS = 4096
TIE = 1e-10
NODES = "node_id long, parent_id long, depth int, ox double, oy double, oz double, ex double, ey double, ez double, is_leaf boolean, n_points long, n_children long, hx double, hy double, hz double"


def _area(lx: float, ly: float, lz: float, hx: float, hy: float, hz: float) -> float:
    x, y, z = hx - lx, hy - ly, hz - lz
    return x * (y + z) + y * z


def _both(a: tuple, b: tuple) -> tuple:
    """The box around two boxes."""
    return (min(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), max(a[5], b[5]))


class Tree:
    """Nodes in lists; a node has a box (low corner, high corner), children (None for leaves) and point numbers (leaves).  Plain
    floats: on three numbers numpy takes ten times as long."""

    def __init__(self, max_level: int = MAX_LEVEL):
        self.max_level = max_level
        self.box: list[tuple[float, ...]] = []
        self.kids: list[list[int] | None] = []
        self.held: list[list[int]] = []
        self.root = -1

    def _add(self, box, kids, held) -> int:
        self.box.append(box)
        self.kids.append(kids)
        self.held.append(held)
        return len(self.kids) - 1

    def _pair(self, leaf: int, new: int) -> int:
        return self._add(_both(self.box[leaf], self.box[new]), [leaf, new], [])

    def _choose(self, options: list[tuple[float, float, int]]) -> tuple[float, int]:
        """The cheapest (cost, squared distance, node); nearer centres win ties."""
        best = options[0]
        for o in options[1:]:
            if (o[1] < best[1]) if abs(o[0] - best[0]) < TIE else o[0] < best[0]:
                best = o
        return best[0], best[2]

    def insert(self, number: int, at) -> None:
        x, y, z = map(float, at)
        here = (x, y, z, x, y, z)
        new = self._add(here, None, [number])
        if self.root < 0:
            self.root = new
            return
        if self.kids[self.root] is None:
            self.root = self._pair(self.root, new)
            return
        node, level = self.root, 1
        while True:
            kids = self.kids[node]
            pairs, inner = [], []
            for k in kids:
                own, below = self.box[k], self.kids[k]
                box = _both(own, here)
                of = box if below is None else own
                cx, cy, cz = (of[0] + of[3]) / 2 - x, (of[1] + of[4]) / 2 - y, (of[2] + of[5]) / 2 - z
                away = cx * cx + cy * cy + cz * cz
                if below is None:
                    pairs.append((2 * _area(*box), away, k))
                else:
                    inner.append((len(below) * (_area(*box) - _area(*own)), away, k))
            box = _both(self.box[node], here)
            area = _area(*box)
            spread = len(kids) * (area - _area(*self.box[node]))
            pair_cost, leaf = self._choose(pairs) if pairs else (math.inf, -1)
            costs = (pair_cost, spread + area, spread if inner else math.inf)
            least = min(costs)
            self.box[node] = box
            if abs(least - costs[0]) < TIE:
                if level == self.max_level - 1:
                    self.held[leaf].append(number)
                    self.box[leaf] = _both(self.box[leaf], here)
                else:
                    kids[kids.index(leaf)] = self._pair(leaf, new)
                return
            if abs(least - costs[1]) < TIE:
                kids.append(new)
                return
            node, level = self._choose(inner)[1], level + 1

    def rows(self) -> Iterable[tuple]:
        """As NODES has them; origin plus size may miss the high corner by a bit, so that comes as well."""
        if self.root < 0:
            return
        todo, number = [(self.root, None, 1)], 0
        while todo:
            node, up, depth = todo.pop()
            kids = self.kids[node]
            low, high = self.box[node][:3], self.box[node][3:]
            yield (number, up, depth, *low, *(h - a for a, h in zip(low, high)), kids is None, len(self.held[node]), len(kids or ()), *high)
            todo += [(k, number, depth + 1) for k in reversed(kids or ())]
            number += 1


def build(positions, max_level: int = MAX_LEVEL) -> Tree:
    tree = Tree(max_level)
    for i, p in enumerate(positions):
        tree.insert(i, p)
    return tree


def spatial_groups(points: DataFrame, level: int, most: int = GROUP_POINTS) -> DataFrame:
    """Points (morton of `level`, pid and others) with `tree`, the shallowest cell of at most `most` points that holds them,
    and `part`: a cell of the deepest level with more (equal points, say) is dealt into parts by pid."""
    counted = hierarchy.cells(points)
    frontier = hierarchy.top_down(hierarchy.pyramid(counted, level), most, level).where(~F.col("is_inner")).select(F.col("morton").alias("tree"), F.ceil(F.col("n_points") / most).alias("parts"))
    up = counted.select("morton", F.explode(morton.ancestors(F.col("morton"), level)).alias("tree"))
    part = F.pmod(F.xxhash64("pid"), F.greatest("parts", F.lit(1)))
    return points.join(up.join(frontier, "tree"), "morton").withColumn("part", part).drop("parts")


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def build_partitioned(points: DataFrame, max_level: int = MAX_LEVEL) -> DataFrame:
    """Node rows of one tree for each (tree, part); points go in in the order of pid.  Groups are few bytes and much work, so they
    are dealt to a number of tasks that isn't made smaller by their size."""
    schema = f"tree long, part long, {NODES}"

    def grow(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("pid", "x", "y", "z"))))
        key = t.column("tree")[0].as_py(), t.column("part")[0].as_py()
        return _arrow([(*key, *r) for r in build([r[1:] for r in rows], max_level).rows()], schema)

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.select("tree", "part", "pid", "x", "y", "z").dropna().repartition(tasks, "tree", "part")
    return dealt.groupBy("tree", "part").applyInArrow(grow, schema)


def roots(nodes: DataFrame, *keys: str) -> DataFrame:
    """For each group of keys n_points, n_leaves and the corners of what all its trees hold, in one pass over the nodes: by tree, a
    cell that was dealt into parts is one group."""
    top = F.col("depth") == 1
    low, high = [F.min(F.when(top, F.col(f"o{a}"))).alias(f"l{a}") for a in "xyz"], [F.max(F.when(top, F.col(f"h{a}"))).alias(f"h{a}") for a in "xyz"]
    return nodes.groupBy(*keys).agg(F.sum("n_points").alias("n_points"), F.count_if("is_leaf").alias("n_leaves"), F.min(F.when(top, F.col("node_id"))).alias("node_id"), *low, *high)


_CORNERS = [f"{k}{a}" for k in "lh" for a in "xyz"]
_ID = ("tree", "part", "node_id")
_JOINED = f"cell long, deal long, tree long, part long, node_id long, up_tree long, up_part long, up_node long, n_points long, {', '.join(f'{c} double' for c in _CORNERS)}"
_FANOUT = 8


def _pair_up(boxes) -> list[tuple[int, int]]:
    """Pairs in the order in which they are joined, numbered after the boxes given; of equal surfaces the first pair."""
    boxes = [tuple(map(float, b)) for b in boxes]
    alive, made = list(range(len(boxes))), []
    while len(alive) > 1:
        i, j = min(((i, j) for k, i in enumerate(alive) for j in alive[k + 1 :]), key=lambda p: _area(*_both(boxes[p[0]], boxes[p[1]])))
        alive = [k for k in alive if k not in (i, j)] + [len(boxes)]
        boxes.append(_both(boxes[i], boxes[j]))
        made.append((i, j))
    return made


def _joined(rows: DataFrame, mark: int) -> DataFrame:
    """Roots grouped by (cell, deal): all of a group with the nodes that join them, `up_*` set but for the one that is left.  New
    nodes are named by the cell, a part below 0 from mark and deal, and their number in the group."""
    columns = [c.split()[0] for c in _JOINED.split(", ")]
    given = columns[:5] + columns[8:]

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in given)), key=lambda r: r[2:5])
        cell, deal = rows[0][:2]
        held, boxes, names, up = [r[5] for r in rows], [r[6:] for r in rows], [r[2:5] for r in rows], [(None, None, None)] * len(rows)
        for i, j in _pair_up(boxes):
            up[i] = up[j] = (cell, -(mark << 40) - deal - 1, len(names) - len(rows))
            names.append(up[i])
            held.append(held[i] + held[j])
            boxes.append(_both(boxes[i], boxes[j]))
            up.append((None, None, None))
        return _arrow([(cell, deal, *n, *u, k, *b) for n, u, k, b in zip(names, up, held, boxes)], _JOINED)

    return rows.select(*given).groupBy("cell", "deal").applyInArrow(join, _JOINED)


def one_tree(nodes: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame]:
    """From the trees of `build_partitioned` over cells down to level `deepest`: (nodes, cells).  nodes: the groups' roots and the
    nodes above, with the name of the node above each (null: the one root), points below and corners; a node of
    a cell of level `deepest` joins parts of that cell, one of a cell above joins cells.  cells: cell, points and corners of the node that stands for each cell.  A cell's parts are joined eight by eight, then cells level by level."""
    tops = roots(nodes, "tree", "part")
    now = stored(tops.select(F.col("tree").alias("cell"), F.col("part").alias("deal"), *_ID, "n_points", *_CORNERS), "roots")
    done, cells, mark = [], [], 1
    most = now.agg(F.max("deal")).first()[0] or 0
    while most > 0:  # parts of one cell
        step = stored(_joined(now.withColumn("deal", F.floor(F.col("deal") / _FANOUT)), mark), "joined")
        done.append(step.where("up_tree is not null"))
        now, most, mark = step.where("up_tree is null"), most // _FANOUT, mark + 1
    now = now.withColumn("deal", F.lit(0).cast("long"))
    for lv in range(deepest, -1, -1):
        here = now.where(morton.level_of(F.col("cell")) == lv)
        cells.append(here.select("cell", "n_points", *_CORNERS))
        if lv == 0:
            done.append(here.withColumns({c: F.lit(None).cast("long") for c in ("up_tree", "up_part", "up_node")}))
            break
        step = stored(_joined(here.withColumn("cell", F.shiftrightunsigned("cell", 3)), mark), "joined")
        done.append(step.where("up_tree is not null"))
        columns = ["cell", "deal", *_ID, "n_points", *_CORNERS]
        now = now.where(morton.level_of(F.col("cell")) < lv).select(columns).unionByName(step.where("up_tree is null").select(columns))
        mark += 1
    names = [*_ID, "up_tree", "up_part", "up_node", "n_points", *_CORNERS]
    return reduce(DataFrame.unionByName, [d.select(names) for d in done]), reduce(DataFrame.unionByName, cells)


def statistics(nodes: DataFrame) -> DataFrame:
    """One row for each tree; averages are whole numbers, null where they would divide by zero."""
    leaf = F.col("is_leaf")
    inner = F.count_if(~leaf)
    return nodes.groupBy("tree", "part").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(leaf).alias("n_leaves"), F.sum("n_points").alias("n_points"), F.max("depth").alias("max_depth"),
        F.floor(F.sum("n_points") / F.nullif(F.count_if(leaf), F.lit(0))).cast("long").alias("avg_points_per_leaf"),
        F.floor(F.sum("n_children") / F.nullif(inner, F.lit(0))).cast("long").alias("avg_children_per_inner"),
        F.min(F.when(leaf, F.col("n_points"))).alias("min_points_per_leaf"), F.max(F.when(leaf, F.col("n_points"))).alias("max_points_per_leaf"),
    )


def violations(nodes: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """Children that aren't smaller than their parent or stick out of it (no rows: the trees are sane)."""
    cols = [f"{k}{a}" for k in "oe" for a in "xyz"]
    up = nodes.select("tree", "part", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in cols])
    both = nodes.join(up, ["tree", "part", "parent_id"])
    x, y, z = (F.col(f"e{a}") for a in "xyz")
    px, py, pz = (F.col(f"p_e{a}") for a in "xyz")
    larger = x * (y + z) + y * z >= px * (py + pz) + py * pz + epsilon
    out = F.lit(False)
    for a in "xyz":
        out = out | (F.col(f"o{a}") < F.col(f"p_o{a}") - epsilon) | (F.col(f"o{a}") + F.col(f"e{a}") > F.col(f"p_o{a}") + F.col(f"p_e{a}") + epsilon)
    return both.where(larger | out).select("tree", "part", "node_id", "parent_id", larger.alias("not_smaller"), out.alias("sticks_out"))
