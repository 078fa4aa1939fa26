"""Small committed records beside the data they speak for, in whatever store Spark reads.

A record is written under a name of its own and renamed to the name it claims; the rename
never replaces, so of two writers one wins and the other learns that it lost.  Data that
no record names does not exist for readers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Ledger:
    """Named JSON records in a folder; each is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self._conf)

    def commit(self, name: str, record: dict) -> bool:
        """Whether the record now stands under ``name`` by this call; False if another stood there."""
        fs, to, own = self._fs(), self._at(name), self._at(f".{name}.{uuid.uuid4().hex}")
        out = fs.create(own, True)
        try:
            out.write(json.dumps(record, sort_keys=True).encode())
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(own, to, options)
        except Exception as e:
            if not fs.exists(to):
                raise
            fs.delete(own, False)
            if "exist" not in str(e).lower():
                raise
            return False
        return True

    def read(self, name: str) -> dict | None:
        fs, at = self._fs(), self._at(name)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, prefix: str = "") -> list[str]:
        """Names of the records that begin with ``prefix``, in order."""
        fs, at = self._fs(), self._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(at):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(at) if s.isFile()]
        return sorted(n for n in found if n.startswith(prefix) and not n.startswith("."))

    def latest(self, prefix: str) -> tuple[int, dict | None]:
        """(number, record) of the record with the highest number after ``prefix``; (-1, None) without any."""
        names = self.names(prefix)
        return (int(names[-1][len(prefix) :]), self.read(names[-1])) if names else (-1, None)

    def delete(self, folder: str) -> None:
        """Delete a folder of data below this one that no record names (any more)."""
        self._fs().delete(self._at(folder), True)


def numbered(prefix: str, number: int) -> str:
    """Record name whose order is that of the numbers."""
    return f"{prefix}{number:010d}"
