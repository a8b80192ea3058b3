"""The folder that driver and executors share, and small files in it that are published once."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="voxelake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small JSON files in a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        """Visible names in a subfolder, sorted; none if it isn't there."""
        if not self._fs.exists(self.at(folder)):
            return []
        return sorted(n for s in self._fs.listStatus(self.at(folder)) if not (n := s.getPath().getName()).startswith((".", "_")))

    def read(self, name: str) -> dict | None:
        """What a file says; None if there is none."""
        if not self._fs.exists(self.at(name)):
            return None
        stream = self._fs.open(self.at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, says: dict) -> bool:
        """Puts the file there, whole, in the one step by which what it names begins to count; False if one is there.  It is
        written under a hidden name of its own first, and never replaces another: on a local disk the step is a hard link, elsewhere
        a rename that fails where the target exists, and as exclusive as the file system makes it."""
        if self._fs.exists(self.at(name)):
            return False
        folder, _, last = name.rpartition("/")
        hidden = self.at(f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/"))
        stream = self._fs.create(hidden, False)
        try:
            stream.write(json.dumps(says).encode())
            stream.close()
            return self._place(hidden, self.at(name))
        finally:
            self._fs.delete(hidden, False)

    def _linked(self) -> bool:
        return self._fs.getUri().getScheme() == "file"

    def _place(self, hidden, target) -> bool:
        try:
            if self._linked():
                at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(at(target), at(hidden))
            else:
                kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                never = self.spark.sparkContext._gateway.new_array(kinds, 1)
                never[0] = kinds.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(hidden, target, never)
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        return True

    def identity(self) -> tuple:
        """Names, lengths and times of the files at the path: another tuple as soon as a table is written anew."""
        files = self._fs.listFiles(self.at(""), True) if self._fs.exists(self.at("")) else None
        found = []
        while files is not None and files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(found))

    def drop(self, name: str = "") -> None:
        self._fs.delete(self.at(name), True)
