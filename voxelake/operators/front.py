"""The level-of-detail cut ("front"), its tracking from frame to frame, placeholders and sibling completeness."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelake.functions import geometry, morton
from voxelake.operators import ordering
from voxelake.sources.octree_store import Stored
from voxelake.sources.shared import stored


@dataclass(frozen=True)
class View:
    """What a frame looks at: a 4 x 4 view-projection matrix, a projection threshold and a depth limit; Columns where rows have
    views of their own."""

    view_proj: geometry.Matrix
    threshold: float | Column
    max_depth: int | Column


def own_view() -> View:
    """That of the row, in the columns of VIEWS."""
    return View(tuple(tuple(F.get("m", F.lit(4 * i + k)) for k in range(4)) for i in range(4)), F.col("threshold"), F.col("max_depth"))


#: Columns of a table of views; m has the matrix row by row.
VIEWS = "camera long, m array<double>, threshold double, max_depth int"
#: Columns of fronts; up has the numbers of children of all ancestors, from the root on.
FRONT = "camera long, morton long, level int, is_leaf boolean, n_children long, up array<bigint>"
#: Levels that a descent reads at once.
AT_ONCE = 3


def _stages(view: View, code: str, level: str) -> list[dict[str, Column]]:
    """The columns of `judged`, each step reading those before."""
    size = [F.col(f"grid.s{a}") * F.col("grid.scale") for a in "xyz"]
    low, high = geometry.cell_box(F.col(code), F.col(level), size)
    lo, hi = [F.col(f"l{a}__") for a in "xyz"], [F.col(f"h{a}__") for a in "xyz"]
    z0, z1 = geometry.corner_depths(lo, hi)
    a, b = (lo[0], lo[1], F.col("z0__")), (hi[0], hi[1], F.col("z1__"))
    corners = {"a": a, "b": b, "c": (a[0], b[1], b[2]), "d": (b[0], a[1], a[2])}
    flat = {f"{n}{k}__": v for n, p in corners.items() for k, v in zip("uv", geometry.project(p, view.view_proj))}
    side = lambda p, q, k: (F.col(f"{q}{k}__") - F.col(f"{p}{k}__")) * (F.col(f"{q}{k}__") - F.col(f"{p}{k}__"))
    diagonal = F.greatest(side("a", "b", "u") + side("a", "b", "v"), side("c", "d", "u") + side("c", "d", "v"))
    flags = {"is_culled": geometry.is_cullable(lo, hi, view.view_proj), "is_fine": F.coalesce(F.col("diagonal") < view.threshold, F.lit(False))}
    boxes = {f"l{a}__": v for a, v in zip("xyz", low)} | {f"h{a}__": v for a, v in zip("xyz", high)}
    return [boxes, {"z0__": z0, "z1__": z1}, flat, {"diagonal": diagonal}, flags]


@lru_cache(maxsize=64)
def _known_stages(application: str, view: View | None, code: str, level: str) -> list[dict[str, Column]]:
    """Kept for an application: building some hundred Column objects takes longer than planning with them."""
    return _stages(own_view() if view is None else view, code, level)


def judged(nodes: DataFrame, view: View | None = None, code: str = "morton", level: str = "level") -> DataFrame:
    """Adds diagonal, is_culled and is_fine to rows with `code`, its level and `grid`; without a view each row has its own, in
    the columns of VIEWS.  Corners and projections become columns first, so each is computed once, in generated code.  Optimizer
    rules would move later filters on the flags below these steps and copy the expressions beyond what can be compiled; they
    don't pass a node that collects metrics, so one stands at the end."""
    stages = _known_stages(nodes.sparkSession.sparkContext.applicationId, view, code, level)
    done = nodes
    for columns in stages:
        done = done.withColumns(columns)
    done = done.drop(*[c for columns in stages for c in columns if c.endswith("__")])
    return done.observe(f"judged-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def lod_cut(nodes: DataFrame, view: View, deepest: int) -> DataFrame:
    """The nodes of the cut of a front started at the root: all proper ancestors branch and the node doesn't.

    For a table of nodes that is read as a whole (`descend` reads a stored tree).  No loop over levels: nodes that don't branch are joined, by equal keys, with those among their ancestors
    that don't branch either, and those that have one go.  nodes: morton, level, is_leaf, grid and others."""
    rows = judged(nodes.where(F.col("level") <= view.max_depth), view).drop("grid", "diagonal")
    closed = rows.where(~_opens(view.max_depth))
    inner = closed.where(~F.col("is_leaf")).select(F.col("morton").alias("above"))
    up = F.array(*[F.shiftrightunsigned("morton", 3 * k) for k in range(1, deepest + 1)])
    hidden = closed.select("morton", F.explode(F.filter(up, lambda c: c > 0)).alias("above")).join(inner, "above", "left_semi").select("morton").distinct()
    return closed.join(hidden, "morton", "left_anti")


def _opens(max_depth: int | Column) -> Column:
    return ~F.col("is_leaf") & (F.col("level") < max_depth) & ~F.col("is_culled") & ~F.col("is_fine")


def descend(tree: Stored, grid: Column, view: View) -> DataFrame:
    """The same cut from a stored tree, of which only what is open is read.  AT_ONCE levels are read at a time, and of these the
    files that hold something below nodes of the level before that branch; within them, nodes that have a closed
    ancestor go by equal keys.  Nodes that a view never opens, and levels beyond its depth, are not opened as files."""
    last = min(tree.deepest, view.max_depth)
    open_, parts = None, []
    for first in range(0, last + 1, AT_ONCE):
        levels = range(first, min(first + AT_ONCE, last + 1))
        rows = tree.read(levels, open_)
        if rows is None:
            break
        if open_ is not None:
            above = F.call_function("shiftrightunsigned", F.col("morton"), (F.col("level") - first + 1) * 3)
            rows = rows.withColumn("root__", above).join(open_.select(F.col("morton").alias("root__")), "root__", "left_semi").drop("root__")
        seen = judged(rows.withColumn("grid", grid), view).drop("grid", "diagonal").withColumn("opens__", _opens(view.max_depth))
        if len(levels) > 1:
            up = F.filter(F.array(*[F.when(F.col("level") - k >= first, F.shiftrightunsigned("morton", 3 * k)) for k in range(1, len(levels))]), lambda c: c.isNotNull())
            shut = seen.where(~F.col("opens__") & ~F.col("is_leaf")).select(F.col("morton").alias("above"))
            hidden = seen.select("morton", F.explode(up).alias("above")).join(shut, "above", "left_semi").select("morton").distinct()
            seen = seen.join(hidden, "morton", "left_anti")
        seen = stored(seen, "cut")
        parts.append(seen.where(~F.col("opens__")).drop("opens__"))
        open_ = seen.where(F.col("opens__") & (F.col("level") == levels[-1])).select("morton", "level")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def start(views: DataFrame, tree: Stored) -> DataFrame:
    """A front of the root alone for each camera."""
    first = tree.read([0])
    root = first.select("morton", "level", "is_leaf", "n_children").first() if first is not None else None
    if root is None:
        return views.sparkSession.createDataFrame([], FRONT)
    known = [F.lit(root[c]).cast(kind).alias(c) for c, kind in (("morton", "long"), ("level", "int"), ("is_leaf", "boolean"), ("n_children", "long"))]
    return views.select("camera").distinct().select("camera", *known, F.array().cast("array<bigint>").alias("up"))


def track(fronts: DataFrame, tree: Stored, grid: Column, views: DataFrame) -> DataFrame:
    """One frame of all cameras: FRONT rows and their VIEWS to FRONT rows and is_culled, whether a node is outside the view.

    Siblings of which all are in the front give way to their parent if it is culled or fine; other nodes that branch
    are replaced by their children; the rest stays.  What a camera opened or closed in earlier frames stays until then, which is
    the hysteresis of a tracked front.  Rows carry the child counts of their ancestors, so whether a group is complete needs no
    look at the tree; children are read from the files that hold them.  Cameras without a view keep their front.

    One exchange by (camera, parent), at most eight rows and their parent each: a camera's front is not held in one task."""
    names = FRONT.replace(",", "").split()[::2]
    group = Window.partitionBy("camera", "parent")
    rows = fronts.join(views, "camera", "left").withColumns({"parent": morton.parent(F.col("morton")), "grid": grid})
    rows = rows.withColumns({"here": F.count(F.lit(1)).over(group), "first": F.min("morton").over(group) == F.col("morton")})
    # each node, and beside the first of its siblings the parent, are judged by the same expressions
    own = F.struct(F.col("morton").alias("code"), F.col("level").alias("at"), F.lit(True).alias("own"))
    over = F.struct(F.col("parent").alias("code"), (F.col("level") - 1).alias("at"), F.lit(False).alias("own"))
    both = rows.withColumn("j", F.explode(F.when(F.col("first") & F.col("parent").isNotNull(), F.array(own, over)).otherwise(F.array(own)))).select("*", "j.*").drop("j")
    seen = judged(both, None, "code", "at")
    of_parent = lambda c: F.coalesce(F.max(F.when(~F.col("own"), c)).over(group), F.lit(False))
    seen = seen.withColumns({"up_culled": of_parent(F.col("is_culled")), "up_closed": of_parent(F.col("is_culled") | F.col("is_fine"))}).where("own")
    goes = F.coalesce(F.col("up_closed") & (F.col("here") == F.element_at("up", -1)), F.lit(False))
    seen = seen.withColumns({"goes": goes, "is_culled": F.coalesce("is_culled", F.lit(False))}).withColumn("opens", F.coalesce(~F.col("goes") & _opens(F.col("max_depth")), F.lit(False)))
    seen = stored(seen.select(*names, "is_culled", "parent", "first", "up_culled", "goes", "opens"), "tracked")
    closed = seen.where("goes and first").select("camera", F.col("parent").alias("morton"), (F.col("level") - 1).alias("level"), F.lit(False).alias("is_leaf"), F.element_at("up", -1).alias("n_children"), F.slice("up", 1, F.size("up") - 1).alias("up"), F.col("up_culled").alias("is_culled"))
    out = closed.unionByName(seen.where("not goes and not opens").select(*names, "is_culled"))
    opened = seen.where("opens").select("camera", F.col("morton").alias("parent_morton"), "level", F.concat("up", F.array("n_children")).alias("up"))
    below = tree.children(opened.select(F.col("parent_morton").alias("morton"), "level"))
    if below is None:
        return out
    kids = opened.drop("level").join(below.select("parent_morton", "morton", "level", "is_leaf", "n_children"), "parent_morton").join(views, "camera")
    return out.unionByName(judged(kids.withColumn("grid", grid)).select(*names, "is_culled"))


def step(front: DataFrame, nodes: DataFrame, view: View) -> DataFrame:
    """One tracking pass over an existing front (column morton) and a table of all nodes (`track` does it for many cameras and
    reads a stored tree): complete sibling groups whose parent is culled or
    fine are pruned, other nodes that branch are replaced by their children.  A front that a camera moved
    keeps this hysteresis; repeated from the root it ends at `lod_cut`."""
    known = nodes.select("morton", "level", "is_leaf", "n_children")
    rows = front.select("morton").join(known, "morton")
    up = morton.parent(F.col("morton"))
    groups = rows.withColumn("parent", up).where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("here"))
    parents = groups.join(known.withColumnRenamed("morton", "parent"), "parent").where("here = n_children")
    grid = nodes.select("grid").limit(1).scalar()
    flags = lambda d, c: judged(d.withColumn("grid", grid), view, c)
    pruned = flags(parents, "parent").where("is_culled or is_fine").select("parent")
    stay = rows.withColumn("parent", up).join(pruned, "parent", "left_anti")
    opened = flags(stay, "morton").withColumn("open", _opens(view.max_depth))
    kids = opened.where("open").select(F.explode(morton.children(F.col("morton"))).alias("morton")).join(known.select("morton"), "morton", "left_semi")
    return pruned.select(F.col("parent").alias("morton")).unionByName(opened.where("not open").select("morton")).unionByName(kids)


def within_quota(cut: DataFrame, quota_bytes: int, bytes_per_point: int = 36) -> DataFrame:
    """What of the cut is loaded, coarse levels first, until the quota is used up: level totals first, so that only the level in
    which it runs out is summed row by row, in blocks of codes (`ordering.prefix_scan`)."""
    totals = cut.groupBy("level").agg(F.sum(F.col("n_points") * bytes_per_point).alias("used"))
    before = totals.withColumn("before", F.coalesce(F.sum("used").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = cut.join(F.broadcast(before.select("level", "before", "used")), "level")  # a row for each level
    whole = rows.where(F.col("before") + F.col("used") <= quota_bytes)
    edge = rows.where((F.col("before") < quota_bytes) & (F.col("before") + F.col("used") > quota_bytes))
    summed = ordering.prefix_scan(edge, "morton", F.col("n_points") * bytes_per_point, "running", inclusive=True)
    part = summed.where(F.col("before") + F.col("running") <= quota_bytes).drop("running")
    return whole.unionByName(part).drop("before", "used")


def substitute(placeholders: DataFrame, loaded: DataFrame, level: int) -> DataFrame:
    """placeholder -> substitute, its deepest loaded ancestor (null: none).  Equal keys only: the ancestors are
    spelled out and joined; a deeper code is the greater one."""
    up = placeholders.select(F.col("morton").alias("placeholder"), F.explode(morton.ancestors(F.col("morton"), level)).alias("code"))
    hit = up.join(loaded.select(F.col("morton").alias("code")).distinct(), "code")
    best = hit.groupBy("placeholder").agg(F.max("code").alias("substitute"))
    return placeholders.select(F.col("morton").alias("placeholder")).join(best, "placeholder", "left")


def complete_groups(front: DataFrame, nodes: DataFrame) -> DataFrame:
    """parent, n_here, n_children, complete: whether all of a parent's children are in the front."""
    here = front.where("morton <> 1").groupBy(F.shiftrightunsigned("morton", 3).alias("parent")).agg(F.count(F.lit(1)).alias("n_here"))
    return here.join(nodes.select(F.col("morton").alias("parent"), "n_children"), "parent").select("parent", "n_here", "n_children", (F.col("n_here") == F.col("n_children")).alias("complete"))


def apply_changes(front: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The front after a deferred pass: deletions first, then insertions, as sets of codes."""
    return front.select("morton").join(deleted.select("morton"), "morton", "left_anti").union(inserted.select("morton")).distinct()


def segments(front: DataFrame, deepest: int, count: int) -> DataFrame:
    """morton, segment (1 to count): the front in depth-first order in equal parts, one of which is tracked in a frame.
    Nodes of a front don't hold each other, so their first descendants are as many codes in the same order."""
    lifted = front.select("morton", morton.preorder(F.col("morton"), deepest)[0].alias("first"))
    dealt = ordering.segments(lifted.select(F.col("first").alias("morton")), deepest, count)
    return lifted.join(dealt.select(F.col("morton").alias("first"), "segment"), "first").select("morton", "segment")


def contains(front: DataFrame, codes: DataFrame) -> DataFrame:
    """The codes (column morton) that are in the front."""
    return codes.join(front.select("morton"), "morton", "left_semi")
