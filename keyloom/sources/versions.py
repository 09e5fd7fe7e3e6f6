"""Parquet tables that are replaced whole: every write is a new folder, readers take the
newest committed one, so a table is never overwritten while it is read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.sources.commits import CommitLog, Conflict


class VersionedTable:
    """A table whose versions are folders named by commit records.

    A version counts once its record is committed; a crashed write leaves a folder that no record names.
    Versions may carry a tag: writing the same tag again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.log = CommitLog(spark, f"{self.path}/commits")

    def versions(self) -> list[int]:
        return self.log.numbers()

    def folder(self, version: int) -> str:
        return f"{self.path}/{self.log.get(version)['folder']}"

    def has(self, tag: str) -> bool:
        return self._tagged(tag) is not None

    def _tagged(self, tag: str) -> int | None:
        return next((v for v in self.versions() if self.log.get(v).get("tag") == tag), None)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version (older than ``before``), None when there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(self.folder(found[-1])) if found else None

    def write(self, df: DataFrame, version: int | None = None, tag: str | None = None) -> int:
        """Write the next version, or a given one; a given version or tag makes a retry harmless.

        Rows that were made from the newest version belong in ``update``: this raises
        ``Conflict`` when another writer commits while it writes.
        """
        done = self.versions()
        if tag is not None and (same := self._tagged(tag)) is not None:
            return same
        version = version if version is not None else (done[-1] if done else 0) + 1
        if version in done:
            return version
        if not self._commit(df, version, tag):
            raise Conflict(f"version {version} of {self.path} was written meanwhile")
        return version

    def update(self, change: Callable[[DataFrame | None], DataFrame], tag: str | None = None, attempts: int = 10) -> int:
        """Write what ``change`` makes of the newest version; made anew from the newer one after a conflict."""
        for _ in range(attempts):
            done = self.versions()
            if tag is not None and (same := self._tagged(tag)) is not None:
                return same
            current = self.spark.read.parquet(self.folder(done[-1])) if done else None
            version = (done[-1] if done else 0) + 1
            if self._commit(change(current), version, tag):
                return version
        raise Conflict(f"{self.path} was written by others {attempts} times in a row")

    def _commit(self, df: DataFrame, version: int, tag: str | None) -> bool:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        if not self.log.add(version, {"folder": name, "tag": tag}):
            self.log.delete(f"{self.path}/{name}")
            return False
        older = [v for v in self.versions() if v < version]
        for old in older[: -self.keep] if self.keep else []:
            self.log.delete(self.folder(old))
            self.log.forget(old)
        return True
