"""A table keyed by an integer (a Morton code, an id) that is changed in place: create, upsert, delete by range, drop.

Rows lie in buckets of 2^bucket_bits neighbouring keys.  A version is a small file that names the folder of each bucket; a
change writes only the buckets it touches to a new folder and publishes the next version, by a file that is created only
where none is.  So a change is there as a whole or not at all, readers keep the version they began with, and of two writers
at once one fails and may try again.  `transaction` makes several changes one version.

Keys are unique and not null: of several rows of one upsert with a key the one with the greatest values stays; rows with a null key
are refused.  An empty change publishes a version that equals the last one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.sources.shared import Folder

BUCKET_BITS = 12


class Conflict(RuntimeError):
    """Another writer published the version first."""


class KeyTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self._open: dict | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str = "morton", bucket_bits: int = BUCKET_BITS) -> KeyTable:
        """An empty table; an error if there is one."""
        table = cls(spark, path)
        if not table.folder.publish("versions/000000000", {"schema": schema, "key": key, "bits": bucket_bits, "buckets": {}}):
            raise Conflict(f"there is a table at {path}")
        return table

    def drop(self) -> None:
        self.folder.drop()

    def version(self) -> tuple[int, dict]:
        names = self.folder.names("versions")
        for name in reversed(names):
            if (says := self.folder.read(f"versions/{name}")) is not None:
                return int(name), says
        raise FileNotFoundError(f"no table at {self.folder.path}")

    def _now(self) -> dict:
        return self._open["says"] if self._open else self.version()[1]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version (default: the last, inside a transaction its own), with their bucket as partition column left out."""
        says = self._now() if version is None else self.folder.read(f"versions/{version:09d}")
        return self._rows(says, says["buckets"])

    def _rows(self, says: dict, buckets) -> DataFrame:
        paths = [f"{self.folder.path}/data/{says['buckets'][b]}/bucket={b}" for b in buckets]
        if not paths:
            return self.spark.createDataFrame([], says["schema"])
        return self.spark.read.schema(says["schema"]).parquet(*paths)

    def range(self, a: int, b: int) -> DataFrame:
        """Rows with a <= key <= b: only the buckets that the range meets are opened."""
        says = self._now()
        low, high = a >> says["bits"], b >> says["bits"]
        return self._rows(says, [k for k in says["buckets"] if low <= int(k) <= high]).where(F.col(says["key"]).between(a, b))

    def lookup(self, keys) -> DataFrame:
        says = self._now()
        near = {str(k >> says["bits"]) for k in keys}
        return self._rows(says, [k for k in says["buckets"] if k in near]).where(F.col(says["key"]).isin([int(k) for k in keys]))

    def upsert(self, rows: DataFrame) -> None:
        """Inserts rows, in place of those with the same keys."""
        with self._changing() as says:
            self._upsert(rows, says)

    def _upsert(self, rows: DataFrame, says: dict) -> None:
        key = says["key"]
        kind = self.spark.createDataFrame([], says["schema"]).schema
        sound = F.when(F.col(key).isNull(), F.raise_error(F.lit("a key is null"))).otherwise(F.col(key).cast("long"))
        new = rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in kind]).withColumn(key, sound)
        others = [c.name for c in kind if c.name != key]
        new = new.groupBy(key).agg(F.max(F.struct(*others)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])
        new = new.select(*kind.names, F.shiftright(key, says["bits"]).alias("bucket"))
        made = uuid.uuid4().hex
        staged = f"{self.folder.path}/data/{made}-new"
        new.write.partitionBy("bucket").parquet(staged)
        touched = [n.removeprefix("bucket=") for n in self.folder.names(f"data/{made}-new") if n.startswith("bucket=")]
        if touched:
            fresh = self.spark.read.schema(f"{says['schema']}, bucket long").parquet(staged)
            kept = self._rows(says, [b for b in touched if b in says["buckets"]]).join(fresh.select(key), key, "left_anti")
            self._write(kept.select(*kind.names).unionByName(fresh.select(*kind.names)), says, made)
        self.folder.drop(f"data/{made}-new")
        self._change({b: made for b in touched}, [])

    def delete_range(self, a: int, b: int) -> None:
        """Deletes rows with a <= key <= b: whole buckets by name, the two at the ends by rewriting."""
        with self._changing() as says:
            self._delete(a, b, says)

    def _delete(self, a: int, b: int, says: dict) -> None:
        bits = says["bits"]
        met = [k for k in says["buckets"] if a >> bits <= int(k) <= b >> bits]
        whole = [k for k in met if a <= int(k) << bits and ((int(k) + 1) << bits) - 1 <= b]
        edge = [k for k in met if k not in set(whole)]
        made = uuid.uuid4().hex
        left: list[str] = []
        if edge:
            self._write(self._rows(says, edge).where(~F.col(says["key"]).between(a, b)), says, made)
            left = [n.removeprefix("bucket=") for n in self.folder.names(f"data/{made}") if n.startswith("bucket=")]
        self._change({k: made for k in left}, [k for k in met if k not in set(left)])

    def _write(self, rows: DataFrame, says: dict, made: str) -> None:
        """Buckets sorted by key, so that parquet statistics skip row groups inside them."""
        at = F.shiftright(says["key"], says["bits"])
        rows.withColumn("bucket", at).repartitionByRange("bucket", says["key"]).sortWithinPartitions("bucket", says["key"]).write.partitionBy("bucket").parquet(f"{self.folder.path}/data/{made}")

    def _change(self, put: dict[str, str], gone: list[str]) -> None:
        says = self._open["says"]
        self._open["says"] = says | {"buckets": {k: v for k, v in (says["buckets"] | put).items() if k not in set(gone)}}

    @contextmanager
    def _changing(self) -> Iterator[dict]:
        """A change outside a transaction is one of its own, based on the version it reads."""
        if self._open:
            yield self._open["says"]
            return
        with self.transaction():
            yield self._open["says"]

    def _publish(self, number: int, says: dict) -> None:
        if not self.folder.publish(f"versions/{number + 1:09d}", says):
            raise Conflict(f"version {number + 1} was published by another writer")

    @contextmanager
    def transaction(self) -> Iterator[KeyTable]:
        """All changes inside become one version, or none if there is an error."""
        number, says = self.version()
        self._open = {"says": says}
        try:
            yield self
            done = self._open["says"]
        finally:
            self._open = None
        self._publish(number, done)
