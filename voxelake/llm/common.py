"""What the operators share: tables in the shared folder, bounded text chunks and vectorised byte hashing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.sources.shared import Folder, work_dir

#: Bytes of text that a Python worker handles at once (a longer single text is handled alone).
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None
#: Tables of the open `scratch` blocks.
_recorded: list[list[str]] = []


def persisted(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet (with the writer's options) under the shared folder and reads it back: lineage ends there.  Inside
    `scratch` the table goes at the end of the block."""
    return persisted_at(df, name, **options)[0]


def persisted_at(df: DataFrame, name: str, kept: bool = False, **options) -> tuple[DataFrame, str]:
    """persisted, and the path of the table.  kept: `scratch` leaves it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**options).parquet(path)
    if _recorded and not kept:
        _recorded[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    Folder(spark, path).drop()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are persisted inside the block are deleted at its end; what is to stay has to be written by then."""
    _recorded.append([])
    try:
        yield
    finally:
        for path in _recorded.pop():
            drop(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_frame(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (long) and text (null: empty), plus the named columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of an Arrow string column, without making Python strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(col, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of whole rows with at most `limit` bytes, or one row."""
    data, off = utf8(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that all bits of a hash can be used."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * base^i with a leading 0; spans() turns them into hashes of spans."""
    p, _ = powers(len(values) + 1)
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * p[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def byte_prefix(data: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    return prefix_sums(table[data])


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal content has equal hashes wherever it stands."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


def token_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which the table `inside` is true, within each text: starts, ends, text number."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    here = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[off[:-1]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = here[:-1]
    start = np.flatnonzero(here & (~before | edge[:n]))
    edge[:] = False
    edge[off[1:]] = True
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = here[1:]
    end = np.flatnonzero(here & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of flags over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i] ... start[i] + count[i] - 1 of every i, one after another."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(total, dtype=np.int64)


def byte_table(*spans_of_bytes: tuple[int, int]) -> np.ndarray:
    """A truth table with the given closed byte ranges set."""
    t = np.zeros(256, bool)
    for lo, hi in spans_of_bytes:
        t[lo : hi + 1] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RESULT = "result__"


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers bounded by bytes and rows, unless the session has other settings than the defaults:
    10000 texts at once would take hundreds of MB in the JVM's and the worker's buffers."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864", "4194304")):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, default).lower() in (default, default + "b", "64mb"):
            spark.conf.set(name, value)


def map_texts(df: DataFrame, fields: str, make, keep: list[str] | None = None, limit: int = CHUNK_BYTES, raw: bool = False) -> DataFrame:
    """The `keep` columns (default: doc_id) and a struct column RESULT that make()(bytes, offsets) gives for
    each piece of whole texts of column `text` (null: empty).  Row by row, without a shuffle.  raw: the kept
    columns are called k0, k1, ..., so that none of them clashes with another name."""
    small_batches(df.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    at = keep.index("text") if "text" in keep else len(keep)  # a kept text is sent once
    source = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], *[F.col("text").alias("text__")][: at == len(keep)])
    kinds = [source.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]
    schema = ", ".join([f"k{i} {t}" for i, t in enumerate(kinds)] + [f"{RESULT} struct<{fields}>"])
    names = [x.split(":")[0].strip() for x in fields.split(",")]

    def run(batches):
        work = make()
        for batch in batches:
            col = batch.column(at)
            for lo, hi, data, off in chunks(col, limit):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(data, off)]
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.StructArray.from_arrays(made, names)], [*(f"k{i}" for i in range(len(keep))), RESULT])

    out = source.mapInArrow(run, schema)
    return out if raw else out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], RESULT)


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns k0, k1, ... under their own names again."""
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, seed: int, per_value: bool = False) -> DataFrame:
    """(doc_id, label) of at most `rows` labelled documents (of each label 0 and 1, with per_value): those whose
    hashes are least, so that the choice is repeatable.  Null and conflicting labels are left out."""
    one = labels.where(F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("label"), F.max(column).alias("top")).where("label = top and doc_id is not null").select("doc_id", "label")
    ordered = lambda d: d.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    return ordered(one.where("label = 0")).unionByName(ordered(one.where("label = 1"))) if per_value else ordered(one)


def training_texts(rows: DataFrame, most_bytes: int) -> pa.Table:
    """doc_id, text, label for a fit on the driver, from rows (doc_id, text, label) of ids that are already a bounded sample: of
    each id one text (that of the least hash; null and empty ones are left out), and of each label as many, in the order of a
    hash, as most_bytes holds (a text that doesn't fit is passed over).  Texts of any length take part."""
    known = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    # the least of each id is found before the shuffle already, however often an id is repeated
    one = known.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("m")).select("doc_id", "m.*")
    stored = persisted(one, "sample")
    sizes = stored.select("doc_id", "h", "label", F.octet_length("text").alias("size")).toArrow().to_pylist()
    left: dict = {}
    chosen = []
    for r in sorted(sizes, key=lambda r: (r["h"] ^ r["doc_id"], r["doc_id"])):
        room = left.setdefault(r["label"], most_bytes)
        if r["size"] <= room:
            left[r["label"]] = room - r["size"]
            chosen.append((r["doc_id"],))
    names = rows.sparkSession.createDataFrame(chosen, "doc_id long")
    return stored.join(F.broadcast(names), "doc_id").select("doc_id", "text", "label").toArrow().sort_by("doc_id")


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves remainder 0 modulo 5: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
