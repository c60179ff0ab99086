"""Local and system documents: keys with JSON values, without revisions; not replicated."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hlc import Clock
from .files import Folder

SCHEMA = "key string, wall long, logical long, value string"


class KeyValue:
    """Appends only; the last entry of a key counts, and one without a value deletes it."""

    def __init__(self, spark: SparkSession, root: str, clock: Clock | None = None):
        self.spark, self.folder, self.clock = spark, Folder(spark, root), clock or Clock()

    def _generation(self) -> int:
        return max((int(n[8:]) for n in self.folder.names() if n.startswith("entries=")), default=0)

    def put_all(self, values: dict[str, Any]) -> None:
        now = self.clock.now()
        rows = [(k, now.wall, now.logical, None if v is None else json.dumps(v, sort_keys=True)) for k, v in values.items()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder.path(f"entries={self._generation()}"))

    def put(self, key: str, value: Any) -> None:
        self.put_all({key: value})

    def delete(self, key: str) -> None:
        self.put_all({key: None})

    def _entries(self) -> DataFrame:
        name = f"entries={self._generation()}"
        return self.spark.read.schema(SCHEMA).parquet(self.folder.path(name)) if self.folder.exists(name) else self.spark.createDataFrame([], SCHEMA)

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max(F.struct("wall", "logical", F.struct("value").alias("v"))).alias("e"))

    def table(self) -> DataFrame:
        """key, value: the entries that hold."""
        return self._last(self._entries()).select("key", F.col("e.v.value").alias("value")).filter("value is not null")

    def get(self, key: str, default: Any = None) -> Any:
        """The filter on the key reaches the scan; no other key is aggregated."""
        row = self._last(self._entries().filter(F.col("key") == key)).select("e.v.value").first()
        return default if row is None or row.value is None else json.loads(row.value)

    def compact(self) -> None:
        """One file of the entries that hold, in place of one for each write; visible by one rename."""
        old, staged = self._generation(), f"staging-{uuid.uuid4().hex}"
        rows = self._last(self._entries()).select("key", "e.wall", "e.logical", F.col("e.v.value").alias("value")).filter("value is not null")
        rows.coalesce(1).write.parquet(self.folder.path(staged))
        self.folder.rename((staged,), (f"entries={old + 1}",))
        self.folder.delete(f"entries={old}")

    def fold(self, prefix: str, fun, start):
        """fun(key, value, accumulator) over the keys with a prefix, in their order."""
        acc = start
        for r in self.table().filter(F.col("key").startswith(prefix)).orderBy("key").toLocalIterator():
            acc = fun(r.key, json.loads(r.value), acc)
        return acc

    def node_id(self) -> str:
        """An identifier of this place, made once."""
        own = self.get("node_id")
        if own is None:
            self.put("node_id", own := uuid.uuid4().hex)
        return own
