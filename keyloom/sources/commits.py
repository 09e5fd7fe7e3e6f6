"""Numbered commit records: who creates a number's file first has that commit."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class CommitLog:
    """JSON records ``<path>/00000001.json``, ``00000002.json``, ...

    A record is written aside and renamed to its number, which fails where the number is taken:
    of two writers that have read the same latest record one gets the next number, and the
    other learns of it.  The rename is atomic on HDFS and on local disks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        hadoop, conf = self._hadoop()
        p = hadoop.Path(path)
        return p.getFileSystem(conf), p

    def numbers(self) -> list[int]:
        fs, folder = self._fs(self.path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def get(self, number: int) -> dict:
        fs, path = self._fs(f"{self.path}/{number:08d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        found = self.numbers()
        return (found[-1], self.get(found[-1])) if found else (0, None)

    def add(self, number: int, record: dict) -> bool:
        """Commit ``record`` under ``number``; False where another writer was first."""
        hadoop, conf = self._hadoop()
        fs, aside = self._fs(f"{self.path}/.{uuid.uuid4().hex}")
        fs.mkdirs(aside.getParent())
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        final = fs.makeQualified(hadoop.Path(f"{self.path}/{number:08d}.json"))
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), final, options)
        except Exception as failure:
            fs.delete(aside, False)
            if fs.exists(final):
                return False
            raise failure
        return True

    def forget(self, number: int) -> None:
        self.delete(f"{self.path}/{number:08d}.json")

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
