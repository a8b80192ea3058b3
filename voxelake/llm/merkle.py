"""A manifest of documents: a tree of SHA-256 digests with fan-out 8 for each language, and one over the languages.

H is the lowercase hex SHA-256 of concatenated inputs (digests as hex text).  A leaf is H of doc_id, source, lang, n_chars and
text, each `-` if null, else its UTF-8 byte count, a colon and the value.  A proof is what stands before and after the own
node in each run of siblings, from the leaf up through the language's root to the root of all.

How it is built: leaves are put in order by a range exchange and numbered by their place in it, so no window runs over a language.
The octal digits of the number are grouped away one after another inside blocks of BLOCK leaves, each group nesting the
structs of its children: one exchange by block, no join.  Blocks are leaves of the next pass, and so on; languages are
ranked and grouped in the same way.  On the way down a block meets what stands above it by one grouping of both, and a
transform of the nested struct and an explode give a proof for each leaf.  A task holds BLOCK leaves at a time, whatever
share of the rows one language has.

Edge cases: a null doc_id comes first in its language; rows of one doc_id are ordered by their leaf (equal rows can't be
told apart, so the order among them doesn't matter); a null lang is a language of its own, before all others; null and
empty texts differ (`-` and `0:`); texts of any length are hashed whole; an empty table has no rows and no root; other
columns are ignored, whatever their names.  A null doc_id is never tampered with in `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted

FAN_BITS, DIGITS = 3, 3
BLOCK = 1 << FAN_BITS * DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PLACE = 33  # bits that monotonically_increasing_id has for the place inside a partition


def _item(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row of documents, or what it would be with another text."""
    return digest(*[_item(F.col(c) if text is None or c != "text" else text) for c in FIELDS])


def _tree(lang: Column) -> Column:
    """A key that is never null and keeps the order of languages, null first."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang.cast("string")))


def _ranked(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows (tree, ...) with `rank` in its tree by the order and `n`, the tree's rows; the largest n as well.  The table is
    sorted by tree and order once and written with each row's place; the counts of (partition, tree) are few."""
    placed = persisted(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("place", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("place", _PLACE)
    runs = placed.groupBy(part.alias("part"), "tree").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = persisted(runs.select("part", "tree", (ahead - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n")), "merkle-runs")
    most = offsets.agg(F.max("n")).first()[0] or 0
    out = placed.withColumn("part", part).join(offsets, ["part", "tree"])
    return out.withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift"), most


def _up(nodes: DataFrame) -> DataFrame:
    """tree, rank, n, node -> the same of blocks: the three digits of rank are grouped away, the last first, each time nesting
    (digit, node).  A group's digest is that of its children's, but a level of one node has nothing above it."""
    digits = {f"d{k}": F.shiftright("rank", FAN_BITS * k).bitwiseAND((1 << FAN_BITS) - 1).cast("int") for k in range(DIGITS)}
    now = nodes.withColumns(digits).withColumn("block", F.shiftright("rank", FAN_BITS * DIGITS)).select("tree", "block", *digits, "n", "node").repartition("tree", "block")
    for k in range(DIGITS):
        above = [f"d{j}" for j in range(k + 1, DIGITS)]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node")))
        now = now.groupBy("tree", "block", *above).agg(F.max("n").alias("n"), kids.alias("kids"))
        hashed = F.when(F.col("n") > 1, digest(F.array_join(F.transform("kids", lambda c: c["node"]["h"]), ""))).otherwise(F.get("kids", F.lit(0))["node"]["h"])
        node = F.struct(hashed.alias("h"), (F.col("n") > 1).alias("many"), "kids")
        now = now.select("tree", "block", *above, F.shiftright(F.col("n") + 7, FAN_BITS).alias("n"), node.alias("node"))
    return now.withColumnRenamed("block", "rank")


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The blocks of every pass; those of the last have rank 0 and are the roots of their trees."""
    passes = []
    while True:
        passes.append(persisted(_up(nodes), "merkle-blocks"))
        most = -(-most // BLOCK)
        if most <= 1:
            return passes
        nodes = passes[-1].select("tree", "rank", "n", F.struct(F.col("node.h").alias("h"), "rank").alias("node"))


def _down(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, node, above of every leaf; given: tree, above of the roots, where above has the path so far and more."""
    known = above.select("tree", F.lit(0).cast("long").alias("rank"), "above")
    for blocks in reversed(passes):
        node, over = blocks.schema["node"].dataType, known.schema["above"].dataType
        both = blocks.select("tree", "rank", "node", F.lit(None).cast(over).alias("above")).unionByName(known.select("tree", "rank", F.lit(None).cast(node).alias("node"), "above"))
        met = both.groupBy("tree", "rank").agg(F.first("node", ignorenulls=True).alias("node"), F.first("above", ignorenulls=True).alias("above"))
        out = met.select("tree", "above", F.explode(_paths(F.col("node"), DIGITS)).alias("leaf")).select("tree", F.col("leaf.node").alias("node"), F.col("above").withField("path", F.concat("leaf.path", "above.path")).alias("above"))
        known = out.select("tree", F.col("node.rank").alias("rank"), "above") if blocks is not passes[0] else out
    return known


def _paths(node: Column, depth: int) -> Column:
    """All leaves of a nested node as (node, path): array functions only."""
    kids = node["kids"]
    joined = lambda part: F.array_join(F.transform(part, lambda c: c["node"]["h"]), "")

    def step(child, i):
        beside = F.struct(joined(F.slice(kids, 1, i)).alias("before"), joined(F.slice(kids, i + 2, 1 << FAN_BITS)).alias("after"))
        own = F.when(node["many"], F.array(beside)).otherwise(F.array().cast("array<struct<before:string,after:string>>"))
        if depth == 1:
            return F.struct(child["node"].alias("node"), own.alias("path"))
        return F.transform(_paths(child["node"], depth - 1), lambda low: F.struct(low["node"].alias("node"), F.concat(low["path"], own).alias("path")))

    made = F.transform(kids, step)
    return made if depth == 1 else F.flatten(made)


def manifest(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path (array of before, after: siblings as hex text), and the extra columns, computed per row
    of docs."""
    names = [f"x{i}" for i in range(len(extra))]
    made = docs.select(_tree(F.col("lang")).alias("tree"), "doc_id", leaf().alias("h"), *[c.alias(x) for c, x in zip(extra, names)])
    # the number keeps equal rows apart, so that a row repeated without end is still dealt out
    leaves = persisted(made.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    nodes, most = _ranked(leaves, "doc_id", "h", "tie")
    passes = _climb(nodes.select("tree", "rank", "n", F.struct("h", "doc_id", *names).alias("node")), most)
    subroots = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("node.h").alias("h"))
    langs, n_langs = _ranked(subroots, "lang")
    over = _climb(langs.select("tree", "rank", "n", F.struct("h", "lang").alias("node")), n_langs)
    none = F.array().cast("array<struct<before:string,after:string>>")
    root = over[-1].select("tree", F.struct(none.alias("path"), F.col("node.h").alias("root")).alias("above"))
    by_lang = _down(over, root).select(F.col("node.lang").alias("tree"), F.col("above").withField("subroot", F.col("node.h")).alias("above"))
    out = _down(passes, by_lang)
    return out.select("node.doc_id", F.col("node.h").alias("leaf"), "above.subroot", "above.root", "above.path", *[F.col(f"node.{x}").alias(x) for x in names])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of a path."""
    return F.aggregate(path, start, lambda h, p: digest(p["before"], h, p["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def report(docs: DataFrame) -> DataFrame:
    """The manifest with digests of the proofs, and what they say after every third text has been lower-cased."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    m = manifest(docs, F.when(hit, leaf(lower)).otherwise(leaf()))
    done = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("x0"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def _h(*parts: str) -> str:
    return "sha256(" + " || ".join(parts) + ")"


def _sql_item(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END"


def _sql_leaf(text: str) -> str:
    return _h(*[f"({_sql_item(text if c == 'text' else c)})" for c in FIELDS])


_SQL_CLIMB = "SELECT tree, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {t} WHERE n > 1 GROUP BY tree, lvl, pos // 8, n"
#: crc32 by its table, as DuckDB has no such function; trees level by level; siblings of every ancestor; proofs folded upwards.
ORACLE_SQL = f"""WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {_sql_leaf('text')} AS h, {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS crc FROM documents, crc),
p AS MATERIALIZED (SELECT *, CASE WHEN crc % 3 = 0 THEN low ELSE h END AS alt, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, 0 AS lvl, pos, h, n FROM p UNION ALL {_SQL_CLIMB.format(t='t')}),
s AS MATERIALIZED (SELECT tree AS lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS lang_pos, count(*) OVER () AS langs FROM t WHERE n = 1),
u AS (SELECT '' AS tree, 0 AS lvl, lang_pos AS pos, subroot AS h, langs AS n FROM s UNION ALL {_SQL_CLIMB.format(t='u')}),
a AS MATERIALIZED (SELECT tree, lvl, pos, h, n FROM t WHERE n > 1 UNION ALL SELECT tree, lvl, pos, h, n FROM u WHERE n > 1),
b AS MATERIALIZED (SELECT tree, lvl, pos, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM a),
w AS MATERIALIZED (SELECT id, b.lvl AS step, bef, aft FROM p JOIN b ON b.tree = p.tree AND b.pos = p.pos >> (3 * b.lvl) UNION ALL SELECT id, height + b.lvl, bef, aft FROM p JOIN s ON lang = p.tree JOIN b ON b.tree = '' AND b.pos = lang_pos >> (3 * b.lvl)),
f AS (SELECT id, 0 AS step, alt AS h FROM p UNION ALL SELECT f.id, f.step + 1, sha256(bef || f.h || aft) FROM f JOIN w ON w.id = f.id AND w.step = f.step),
g AS (SELECT id, arg_max(h, step) AS folded FROM f GROUP BY 1), q AS (SELECT id, string_agg(bef || aft, '' ORDER BY step) AS proof FROM w GROUP BY 1)
SELECT doc_id, h AS leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON lang = tree JOIN g USING (id) LEFT JOIN q USING (id)"""
