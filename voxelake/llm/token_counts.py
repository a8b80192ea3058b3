"""Token counts kept up to date by signed deltas.

A batch holds changes (kind, source, lang, version, n_tokens, old_tokens): an insert adds a document and
its tokens, a delete takes them away, a revise replaces old_tokens by n_tokens.  A batch is summed by
(source, lang, version) and written to a folder of its own; it counts from the moment a small file under
its id names that folder.  That file is put there whole and only where none is, so a batch is there as a whole or not at all,
and a batch whose id is there already changes nothing.  Sums are partial before each shuffle, so a hot source
sends one row from each task.

Before a batch is committed a mark of (id, folder) is left in pending/; a mark counts if the file of its id names its folder, so
the mark of an attempt that lost means nothing.  `compact` writes the sum of the last fold and of the marked batches it
listed into a new folder, and publishes it as the fold with the next number; the fold names the marks it covers, which
then go.  Totals read the last fold and the marks that it doesn't cover: as many small files as batches came since, however long the
history is.  Of two compactions at once one loses and is thrown away; if a fold came while marks were listed, they
are listed again.  So each change counts once, whatever commits and compactions run beside it.  Folders that a fold covers stay until
`clean`, as someone may be reading them.

Edge cases: null source, lang or version is a group of its own; null counts are 0; an unknown kind is an
error; repeated changes in a batch all count; an empty batch is committed and changes nothing; groups
without documents and tokens are left out of the totals; other columns are ignored; batch ids are any text (files are
named by their hash); a commit that was cut off leaves a mark and a folder that don't count, and its id can be sent again.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.sources.shared import Folder, work_dir

from . import bpe
from .common import RESULT, persisted

KEYS = ("source", "lang", "version")
CHANGES = "kind string, source string, lang string, version string, n_tokens long, old_tokens long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
WORD = r"[^\x20\x09-\x0D]+"
BPE_VERSION = "byte_bpe_50k"


def plain_counts(docs: DataFrame, *more: Column) -> DataFrame:
    """source, lang, and each text's tokens in the two versions that need no vocabulary: words, and UTF-8 bytes, the
    tokens of models that read bytes."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), words.alias("words"), size.alias("bytes"), *more)


def bpe_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """source, lang, and each text's tokens by the byte-pair encoding of `bpe` (BPE_VERSION)."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return bpe.numbers(rows, path or bpe.default_path(), ["source", "lang"]).select("source", "lang", f"{RESULT}.n_tokens")


def signed(changes: DataFrame) -> DataFrame:
    """Changes as additive (n_docs, n_tokens) by key."""
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kind = F.col("kind")
    known = F.when(kind == "insert", F.struct(F.lit(1).cast("long").alias("d"), n.alias("t"))).when(kind == "delete", F.struct(F.lit(-1).cast("long").alias("d"), (-n).alias("t"))).when(kind == "revise", F.struct(F.lit(0).cast("long").alias("d"), (n - old).alias("t")))
    known = F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))).otherwise(known)
    return changes.withColumn("s", known).groupBy(*KEYS).agg(F.sum("s.d").alias("n_docs"), F.sum("s.t").alias("n_tokens"))


def _file_name(batch_id: str) -> str:
    return hashlib.sha256(batch_id.encode()).hexdigest()


class Rollup:
    """A folder of committed batches: commits/ (a file for each id), pending/ (a mark for each batch since the last fold), folds/
    (numbered), data/."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.path = self.folder.path

    def _write(self, delta: DataFrame) -> str:
        made = uuid.uuid4().hex
        delta.select(*[F.col(c).cast("long" if c.startswith("n_") else "string").alias(c) for c in (*KEYS, "n_docs", "n_tokens")]).write.parquet(f"{self.path}/data/{made}")
        return made

    def _drop(self, made: str) -> None:
        self.folder.drop(f"data/{made}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """False if the batch was committed before."""
        name = _file_name(batch_id)
        if self.folder.read(f"commits/{name}") is not None:
            return False
        made = self._write(signed(changes))
        mark = f"pending/{name}.{made}"
        self.folder.publish(mark, {})
        if self.folder.publish(f"commits/{name}", {"id": batch_id, "data": made}):
            return True
        self.folder.drop(mark)
        self._drop(made)
        return False

    def snapshot(self) -> tuple[int, dict, dict[str, str]]:
        """Number of the last fold, the fold, and the batches (mark: folder) that it doesn't cover."""
        while True:
            folds = self.folder.names("folds")
            marks = self.folder.names("pending")
            if self.folder.names("folds") == folds:  # else marks of a fold that came meanwhile may be gone
                break
        fold = self.folder.read(f"folds/{folds[-1]}") if folds else {"data": None, "covers": []}
        covered = set(fold["covers"])
        batches = {}
        for mark in marks:
            name, made = mark.split(".")
            if mark not in covered and (says := self.folder.read(f"commits/{name}")) is not None and says["data"] == made:
                batches[mark] = made
        return int(folds[-1]) if folds else 0, fold | {"marks": marks}, batches

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/data/{x}" for x in folders])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        _, fold, batches = self.snapshot()
        return self._sum([*filter(None, [fold["data"]]), *batches.values()]).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, snapshot: tuple[int, dict, dict[str, str]] | None = None) -> bool:
        """Folds what a snapshot (by default of now) holds; False if there is nothing to fold or another compaction was faster."""
        number, fold, batches = snapshot or self.snapshot()
        before = [*filter(None, [fold["data"]])]
        if len(before) + len(batches) < 2:
            return False
        made = self._write(self._sum([*before, *batches.values()]))
        still = set(fold["covers"]) & set(fold["marks"])  # covered, but not gone yet
        if self.folder.publish(f"folds/{number + 1:09d}", {"data": made, "covers": sorted({*batches, *still})}):
            for mark in {*batches, *still}:
                self.folder.drop(f"pending/{mark}")
            return True
        self._drop(made)
        return False

    def clean(self) -> None:
        """Deletes the folders that the last fold covers and those of attempts that lost, when nobody reads or commits."""
        _, fold, batches = self.snapshot()
        live = {fold["data"], *batches.values()}
        for made in self.folder.names("data"):
            if made not in live:
                self._drop(made)


def rollup(totals: DataFrame) -> DataFrame:
    """Totals by source, language and version, and of every coarser level (level: how many keys hold)."""
    return totals.rollup(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (3 - F.length(F.replace(F.bin(F.grouping_id()), F.lit("0"), F.lit("")))).cast("int").alias("level"))


def changes(counts: DataFrame, kind: str, version: str, n, old=None) -> DataFrame:
    return counts.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("version"), n.alias("n_tokens"), (F.lit(None).cast("long") if old is None else old).alias("old_tokens"))


def counted(docs: DataFrame) -> DataFrame:
    """source, lang, and each text's tokens in three versions: the byte-pair encoding, words, and UTF-8 bytes."""
    keep = ["source", "lang", "words", "bytes"]
    tokens = bpe.numbers(plain_counts(docs, F.col("text")), bpe.default_path(), keep)
    return tokens.select(*keep, F.col(f"{RESULT}.n_tokens").alias("tokens"))


def report(docs: DataFrame) -> DataFrame:
    """Inserts every document under three tokenizer versions, first with wrong counts for two of them, which a revision puts
    right, folds what is there, deletes the documents without a word, and sends the revision twice."""
    spark = docs.sparkSession
    counts = persisted(counted(docs), "counts")
    book = Rollup(spark, work_dir(spark, "rollup"))
    t, w, b = F.col("tokens"), F.col("words"), F.col("bytes")
    versions = (BPE_VERSION, t), ("words-1", w), ("bytes-1", b)
    both = lambda *parts: reduce(DataFrame.unionByName, parts)
    book.commit("1", both(*[changes(counts, "insert", v, b) for v, _ in versions[:2]]))
    book.commit("2", changes(counts, "insert", "bytes-1", b))
    revision = both(*[changes(counts, "revise", v, n, b) for v, n in versions[:2]])
    book.commit("3", revision)
    book.compact()
    empty = counts.where("words = 0")
    book.commit("4", both(*[changes(empty, "delete", v, n) for v, n in versions]))
    book.commit("3", revision)
    return rollup(book.totals()).select(*KEYS, "level", "n_docs", "n_tokens")
