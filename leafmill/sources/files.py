"""Folders that Spark can reach, wherever they are: through Hadoop's file systems, never through open()."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, *parts: str) -> bool:
        fs, at = self._at(*parts)
        return fs.exists(at)

    def names(self, *parts: str) -> list[str]:
        fs, at = self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def size(self, *parts: str) -> int:
        fs, at = self._at(*parts)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def make(self, *parts: str) -> None:
        fs, at = self._at(*parts)
        fs.mkdirs(at)

    def rename(self, a: tuple[str, ...], b: tuple[str, ...]) -> None:
        fs, at = self._at(*a)
        self.make(*b[:-1])
        if not fs.rename(at, self._at(*b)[1]):
            raise OSError(f"{self.path(*a)} could not be renamed to {self.path(*b)}")

    def delete(self, *parts: str) -> None:
        fs, at = self._at(*parts)
        fs.delete(at, True)
