"""A numbered list of files per table: which folders hold its current rows.

Writers put data in folders of their own and then try to create the next number of the list,
which only one of them can: the other gets :class:`CommitConflict`, reads the list anew and
plans again. Readers see whole commits only, and what a lost job left behind is in no list.
The file system's ``create`` must refuse a file that is there (HDFS and local ones do).
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer committed first."""


class Manifest:
    """Numbered JSON files below ``path``, each with all entries (dictionaries) of its version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        if not self._fs.exists(self._folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, version: int | None = None) -> tuple[int, list[dict]]:
        version = self.version() if version is None else version
        if not version:
            return 0, []
        text = "".join(row.value for row in self.spark.read.text(f"{self.path}/{version:09d}.json").toLocalIterator())
        return version, json.loads(text)

    def commit(self, after: int, entries: list[dict]) -> int:
        """Makes version ``after + 1``, unless another writer has."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{after + 1:09d}.json")
        try:
            out = self._fs.create(target, False)
        except Exception as error:
            if self._fs.exists(target):
                raise CommitConflict(f"version {after + 1} of {self.path} is there already") from error
            raise
        out.write(json.dumps(entries).encode())
        out.close()
        return after + 1
