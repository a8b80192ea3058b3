"""Key and range access to tables keyed by Morton code, sets of requests, and merged files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_scan(table: DataFrame, a: int, b: int, key: str = "morton") -> DataFrame:
    """a <= key <= b; on a table clustered by key the parquet statistics skip the rest."""
    return table.where(F.col(key).between(a, b))


def lookup(table: DataFrame, keys: Sequence[int], key: str = "morton") -> DataFrame:
    """One row per asked key, found or not.  The keys are a filter of the scan, so a clustered table is read only where they can
    be, and what is joined are the rows found."""
    keys = [int(k) for k in keys]
    asked = table.sparkSession.createDataFrame([(k,) for k in keys], f"{key} long")
    return asked.join(table.where(F.col(key).isin(keys)).withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete_range(table: DataFrame, a: int, b: int, key: str = "morton") -> DataFrame:
    """The table without a <= key <= b; rows with a null key stay."""
    return table.where(F.coalesce(~F.col(key).between(a, b), F.lit(True)))


def latest(rows: DataFrame, key: str, order: Sequence[str], *values: str) -> DataFrame:
    """Insert-or-replace: of each key the last row in `order`; partial maxima before the shuffle."""
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *values)])


def requests(rows: DataFrame) -> DataFrame:
    """The distinct closed intervals asked for."""
    return rows.select("a", "b").distinct()


def answer(intervals: DataFrame, table: DataFrame, level: int) -> DataFrame:
    """Rows of a single-level table for intervals [first child, last child] of nodes: an equality on the parent,
    never a comparison of ranges."""
    asked = requests(intervals).where((F.shiftrightunsigned("a", 3) == F.shiftrightunsigned("b", 3)) & (F.col("b") - F.col("a") == 7)).select(F.shiftrightunsigned("a", 3).alias("parent"), "a", "b")
    return table.withColumn("parent", F.shiftrightunsigned("morton", 3)).join(asked, "parent").select("a", "b", "morton", *[c for c in table.columns if c != "morton"])


def file_offsets(counts: DataFrame) -> DataFrame:
    """file_ord, n -> adds `offset`, the number of vertices in all files before (one row for each file)."""
    w = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def merge_faces(faces: DataFrame, offsets: DataFrame, indices: Column | None = None) -> DataFrame:
    """Face indices moved by their file's offset, as integers."""
    rows = faces.join(offsets.select("file_ord", "offset"), "file_ord")
    return rows.withColumn("vertex_indices", F.transform(F.col("vertex_indices") if indices is None else indices, lambda i: i + F.col("offset"))).drop("offset")
