"""The octree as tables keyed by Morton code: leaves, levels, statistics, samples, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelake.functions import morton
from voxelake.operators import ordering
from voxelake.sources.shared import stored

RATIO = 0.2
SURFEL_BYTES = 36
#: Rows of one leaf with ids in one range of 2^ID_BITS are numbered together.
ID_BITS = 16
#: Levels of the pyramid that one aggregation makes.
STEP = 8


def cells(points: DataFrame) -> DataFrame:
    """morton, n of the occupied cells."""
    return points.groupBy("morton").agg(F.count(F.lit(1)).alias("n"))


def leaves(cell_counts: DataFrame) -> DataFrame:
    """Leaf nodes: the points of all cells of one parent. morton (of the parent's level), first (least cell), n."""
    return cell_counts.groupBy(F.shiftrightunsigned("morton", 3).alias("morton")).agg(F.min("morton").alias("first"), F.sum("n").alias("n_points"))


def pyramid(cell_counts: DataFrame, level: int, first: int = 0, step: int = STEP, last: int | None = None, children: bool = False) -> DataFrame:
    """level, morton, n_points, of every node from level `first` to `last` (default: `level`, that of the cells).  `step` levels go
    into one aggregation over counted rows, and the next ones over the nodes of its coarsest level, so a deep pyramid
    shuffles a few rows for each cell and not one for each level.  children: n_children as well, by a bit for each child
    that is seen, so that no second pass counts them (0 at the level of the cells)."""
    out, now, at, top = None, cell_counts, level, level if last is None else last
    while True:
        low = max(first, top - step + 1)
        code = F.col("morton")
        bit = lambda lv: F.call_function("shiftleft", F.lit(1), morton.ancestor(code, at, lv + 1).bitwiseAND(7).cast("int")) if lv < at else F.lit(0)  # noqa: B023, E731
        each = F.array(*[F.struct(F.lit(lv).alias("level"), morton.ancestor(code, at, lv).alias("code"), *[bit(lv).alias("bit")][: int(children)]) for lv in range(low, top + 1)])
        seen = [F.bit_count(F.bit_or("a.bit")).cast("long").alias("n_children")][: int(children)]
        part = now.select(F.explode(each).alias("a"), "n").groupBy(F.col("a.level").alias("level"), F.col("a.code").alias("morton")).agg(F.sum("n").alias("n_points"), *seen)
        out = part if out is None else out.unionByName(part)
        if low <= first:
            return out
        now, at, top = part.where(F.col("level") == low).select("morton", F.col("n_points").alias("n")), low, low - 1


def nodes(cell_counts: DataFrame, leaf_level: int, cell_level: int) -> DataFrame:
    """The node table: morton, level, parent_morton, is_leaf, n_points, n_children (leaves: 0).  One shuffle for eight levels."""
    p = pyramid(cell_counts, cell_level, last=leaf_level, children=True)
    is_leaf = F.col("level") == leaf_level
    return p.select("morton", "level", morton.parent(F.col("morton")).alias("parent_morton"), is_leaf.alias("is_leaf"), "n_points", F.when(is_leaf, F.lit(0)).otherwise(F.col("n_children")).cast("long").alias("n_children"))


def sample_size(n: Column, ratio: float = RATIO) -> Column:
    return F.floor(F.greatest(F.lit(1.0), n * F.lit(ratio))).cast("long")


def sampled_pyramid(cell_counts: DataFrame, cell_level: int, ratio: float = RATIO) -> DataFrame:
    """level, morton, n_contents of a hierarchy whose inner nodes sample their children's contents: leaves
    hold all points, a parent floor(max(1, n * ratio)) of the n contents of its children."""
    now = leaves(cell_counts).select("morton", F.col("n_points").alias("n_contents"))
    out = now.withColumn("level", F.lit(cell_level - 1))
    for lv in range(cell_level - 2, -1, -1):
        now = now.groupBy(F.shiftrightunsigned("morton", 3).alias("morton")).agg(sample_size(F.sum("n_contents"), ratio).alias("n_contents"))
        out = out.unionByName(now.withColumn("level", F.lit(lv)))
    return out.select("level", "morton", "n_contents")


def subtrees(node_contents: DataFrame, deepest: int) -> DataFrame:
    """morton -> n_nodes and n_contents of its subtree: each node counts for itself and its ancestors."""
    up = F.filter(F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: F.call_function("shiftrightunsigned", F.col("morton"), k * 3)), lambda c: c > 0)
    return node_contents.select(F.explode(up).alias("morton"), "n_contents").groupBy("morton").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_contents").alias("n_contents"))


def sibling_offsets(level_nodes: DataFrame) -> DataFrame:
    """Adds `offset`: where a child's contents start in its parent's; at most 8 rows in a window."""
    w = Window.partitionBy(F.shiftrightunsigned("morton", 3)).orderBy("morton").rowsBetween(Window.unboundedPreceding, -1)
    return level_nodes.withColumn("offset", F.coalesce(F.sum("n_contents").over(w), F.lit(0)))


def siblings(level_nodes: DataFrame) -> DataFrame:
    """morton with its left and right sibling (null at the ends)."""
    w = Window.partitionBy(F.shiftrightunsigned("morton", 3)).orderBy("morton")
    return level_nodes.select("morton", F.lag("morton").over(w).alias("left_sibling"), F.lead("morton").over(w).alias("right_sibling"))


def ordered_contents(points: DataFrame) -> DataFrame:
    """node (parent of the cell), ord, pid: the points of each leaf numbered by (morton, pid).  Numbers are made
    per (cell, range of ids) and moved by the counts before, so a leaf with a third of all points is shared out."""
    rows = points.select("morton", "pid", F.shiftright("pid", ID_BITS).alias("part"))
    counts = rows.groupBy("morton", "part").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(F.shiftrightunsigned("morton", 3)).orderBy("morton", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0))).select("morton", "part", "base")
    inside = rows.withColumn("nth", F.row_number().over(Window.partitionBy("morton", "part").orderBy("pid")) - 1)
    return inside.join(base, ["morton", "part"]).select(F.shiftrightunsigned("morton", 3).alias("node"), (F.col("nth") + F.col("base")).cast("long").alias("ord"), "pid")


def _stirred(rows: DataFrame, name: str, v: Column) -> DataFrame:
    """Adds 31 bits of v, mixed by two rounds of xor-shift and multiply; no product passes 62 bits.  A column for each step, since
    each is used twice by the next."""
    for shift, factor in ((15, 739982445), (12, 695872825), (15, 1)):
        rows = rows.withColumn(name, F.pmod(v, F.lit(1 << 31)))
        rows = rows.withColumn(name, F.col(name).bitwiseXOR(F.shiftright(name, shift)) * F.lit(factor))
        v = F.col(name)
    return rows


def drawn(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Rows (node, ord, n) with the position that draw `ord` of the node picks of n, from 62 mixed bits: integers only, so that any
    engine repeats it."""
    low = lambda c: F.pmod(F.col(c), F.lit(1 << 31))
    first = _stirred(rows, "high__", low("node") * F.lit(1103515245) + low("ord") * F.lit(1540483477))
    second = _stirred(first, "low__", low("ord") * F.lit(1181783497) + F.col("high__"))
    return second.withColumn(name, F.pmod(F.col("high__") * F.lit(1 << 31) + F.col("low__"), F.col("n"))).drop("high__", "low__")


def sample_levels(contents: DataFrame, leaf_level: int, ratio: float = RATIO) -> DataFrame:
    """level, node, ord, pid of all nodes: leaves as they are, each parent's draws (with replacement) from its
    children's contents in order.  Each level is a table that the one above reads three times."""
    now = stored(contents, "level")
    out = now.withColumn("level", F.lit(leaf_level))
    for lv in range(leaf_level - 1, -1, -1):
        per = now.groupBy("node").agg(F.count(F.lit(1)).alias("n_contents")).withColumnRenamed("node", "morton")
        base = sibling_offsets(per).select(F.col("morton").alias("node"), "offset")
        placed = now.join(base, "node").select(F.shiftrightunsigned("node", 3).alias("node"), (F.col("ord") + F.col("offset")).alias("pos"), "pid")
        totals = per.groupBy(F.shiftrightunsigned("morton", 3).alias("node")).agg(F.sum("n_contents").alias("n"))
        draws = totals.select("node", "n", F.explode(F.sequence(F.lit(0).cast("long"), sample_size(F.col("n"), ratio) - 1)).alias("ord"))
        now = stored(drawn(draws).join(placed, ["node", "pos"]).select("node", "ord", "pid"), "level")
        out = out.unionByName(now.withColumn("level", F.lit(lv)))
    return out.select("level", "node", "ord", "pid")


def collapsed(node_contents: DataFrame, leaf_level: int, ratio: float = RATIO, keep_full: bool = False) -> DataFrame:
    """A parent with a single leaf child becomes the leaf and keeps only its sample (keep_full: all contents)."""
    leaf = node_contents.where(F.col("level") == leaf_level)
    alone = leaf.groupBy(F.shiftrightunsigned("morton", 3).alias("morton")).agg(F.count(F.lit(1)).alias("k"), F.min("morton").alias("only"), F.sum("n_contents").alias("n")).where("k = 1")
    contents = F.col("n") if keep_full else sample_size(F.col("n"), ratio)
    rest = node_contents.join(alone.select(F.col("only").alias("morton")), "morton", "left_anti").join(alone.select("morton"), "morton", "left_anti")
    turned = alone.select("morton", F.lit(leaf_level - 1).alias("level"), contents.cast("long").alias("n_contents"), F.lit(True).alias("is_leaf"))
    return rest.select("morton", "level", "n_contents", (F.col("level") == leaf_level).alias("is_leaf")).unionByName(turned)


def top_down(level_counts: DataFrame, most: int, deepest: int) -> DataFrame:
    """The nodes of a top-down build: a node is split while it has more than `most` points and is above the
    deepest level.  Counts only fall on the way down, so a node exists iff its parent has more than `most`."""
    up = level_counts.select(F.col("morton").alias("up"), F.col("n_points").alias("up_points"))
    kept = level_counts.where(F.col("level") <= deepest).withColumn("parent", morton.parent(F.col("morton"))).join(up, F.col("parent") == F.col("up"), "left")
    inner = (F.col("n_points") > most) & (F.col("level") < deepest)
    return kept.where((F.col("morton") == 1) | (F.col("up_points") > most)).select("level", "morton", "n_points", inner.alias("is_inner"), F.when(inner, F.lit(most)).otherwise(F.col("n_points")).cast("long").alias("n_contents"))


def kept_points(points: DataFrame, level: int, most: int, salts: int = 64) -> DataFrame:
    """level, morton, pid: the points that each node of a top-down build keeps: all if it isn't split, else the `most` first by
    a formula of pid that looks random.  The first of a node are among the first of its children, so each level reads only
    what the one below kept; cells are cut down in salted parts first, whatever share of the points they hold."""
    order = [F.pmod(F.col("pid") * F.lit(1103515245) + F.lit(12345), F.lit(2147483648)), F.col("pid")]

    def first(rows, *keys):
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= most).drop("nth")

    salted = first(points.select("morton", "pid").withColumn("salt", F.pmod(F.xxhash64("pid"), F.lit(salts))), "morton", "salt").select("morton", "pid")
    now = first(salted, "morton")
    out = now.withColumn("level", F.lit(level))
    for lv in range(level - 1, -1, -1):
        now = first(now.select(F.shiftrightunsigned("morton", 3).alias("morton"), "pid"), "morton")
        out = out.unionByName(now.withColumn("level", F.lit(lv)))
    split = top_down(pyramid(cells(points), level), most, level)
    inner = split.where("is_inner").select("level", "morton")
    whole = split.where(~F.col("is_inner")).select("level", F.col("morton").alias("node"))
    # leaves hold all their points, found by the one ancestor of each cell that is a leaf
    up = points.select("morton").distinct().select("morton", F.posexplode(morton.ancestors(F.col("morton"), level)).alias("level", "node"))
    leaf_of = up.join(whole, ["level", "node"]).select("morton", "level", "node")
    held = points.select("morton", "pid").join(leaf_of, "morton").select("level", F.col("node").alias("morton"), "pid")
    return out.join(inner, ["level", "morton"], "left_semi").select("level", "morton", "pid").unionByName(held)


def release_children(nodes: DataFrame, roots: DataFrame, deepest: int) -> DataFrame:
    """The node table without what lies below the roots (column morton), which become leaves."""
    up = F.filter(F.array(*[F.shiftrightunsigned("morton", 3 * k) for k in range(1, deepest + 1)]), lambda c: c > 0)
    below = nodes.select("morton", F.explode(up).alias("above")).join(roots.select(F.col("morton").alias("above")), "above", "left_semi").select("morton").distinct()
    turned = roots.select("morton", F.lit(True).alias("turned")).distinct()
    rest = nodes.join(below, "morton", "left_anti").join(turned, "morton", "left")
    is_root = F.col("turned").isNotNull()
    values = {"is_leaf": F.col("is_leaf") | is_root, "n_children": F.when(is_root, F.lit(0)).otherwise(F.col("n_children")).cast("long")}
    return rest.select(*[values.get(c, F.col(c)).alias(c) for c in nodes.columns])


def within_budget(nodes: DataFrame, budget: int | Column, bytes_per_point: int = SURFEL_BYTES) -> DataFrame:
    """Nodes (level, morton, n_contents) with `released`: what has to go so that the rest fits a budget of bytes.  Levels go from
    the deepest on; in the one where it ends, whole groups of siblings from the end of the Z-order on.  Level totals first,
    then running sums over the groups of that one level, in blocks of codes."""
    used = F.col("n_contents") * bytes_per_point
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    totals = nodes.groupBy("level").agg(F.sum(used).alias("used"))
    above = F.coalesce(F.sum("used").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = totals.withColumn("above", above).select("level", "used", "above")
    rows = nodes.join(F.broadcast(levels), "level")  # a row for each level
    edge = rows.where((F.col("above") + F.col("used") > limit) & (F.col("above") < limit))
    groups = edge.groupBy(F.shiftrightunsigned("morton", 3).alias("group"), "above").agg(F.sum(used).alias("bytes"))
    kept = ordering.prefix_scan(groups, "group", F.col("bytes"), "upto", inclusive=True).where(F.col("above") + F.col("upto") <= limit).select("group", F.lit(True).alias("fits"))
    flagged = rows.withColumn("group", F.when((F.col("above") + F.col("used") > limit) & (F.col("above") < limit), F.shiftrightunsigned("morton", 3))).join(kept, "group", "left")
    whole = F.col("above") + F.col("used") <= limit
    return flagged.withColumn("released", ~(whole | F.coalesce("fits", F.lit(False)))).drop("group", "fits", "used", "above")


def append_points(parts: DataFrame) -> DataFrame:
    """Contents of children (morton, part, contents, parent, is_leaf) as those of their parents: parent, nth, contents, n_children,
    n_leaves.  Children keep their contents in parts of bounded size, and a parent has its children's parts in the
    order of (morton, part), numbered from 0; points are never gathered into one row."""
    w = Window.partitionBy("parent")
    kids = parts.groupBy("parent", "morton").agg(F.max("is_leaf").alias("is_leaf")).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.count_if("is_leaf").alias("n_leaves"))
    return parts.withColumn("nth", (F.row_number().over(w.orderBy("morton", "part")) - 1).cast("long")).join(kids, "parent").select("parent", "nth", "contents", "n_children", "n_leaves")


def joined_parts(parts: DataFrame, sep: str = ",") -> DataFrame:
    """Rows of `append_points` whose contents are texts as one row for each parent, with all of its contents in their order; a
    parent may have up to 2 GB of text."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("nth", "contents"))), lambda c: c["contents"])
    return parts.groupBy("parent").agg(F.array_join(texts, sep).alias("contents"), F.max("n_children").alias("n_children"), F.max("n_leaves").alias("n_leaves"))


def new_levels(level_nodes: DataFrame, deepest: int) -> DataFrame:
    """Breadth-first positions where a level starts: its first code, from level boundaries and not from a lag
    over all rows."""
    return level_nodes.groupBy("level").agg(F.min("morton").alias("first_morton"), F.max("morton").alias("last_morton"), F.count(F.lit(1)).alias("n_nodes"))
