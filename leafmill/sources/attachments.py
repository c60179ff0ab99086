"""Blobs of documents, in chunks of 64 KiB, with a digest of the whole."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.conditions import QueryError
from .files import Folder

CHUNK = 65536
#: A writer keeps so many chunks before it writes them.
HELD = 64
CHUNKS = "doc_id string, name string, version string, chunk_no int, data binary"
INFO = "doc_id string, name string, version string, wall long, length long, digest string, content_type string, deleted boolean"


class Writer:
    """Takes a blob in pieces; finish() makes it visible, abort() forgets it."""

    def __init__(self, store: Attachments, doc_id: str, name: str, content_type: str):
        self.store, self.doc_id, self.name, self.content_type = store, doc_id, name, content_type
        self.version, self.hash, self.length, self.number, self.rest, self.held = uuid.uuid4().hex, hashlib.sha256(), 0, 0, b"", []

    def write(self, data: bytes) -> None:
        self.hash.update(data)
        self.length += len(data)
        self.rest += data
        while len(self.rest) >= CHUNK:
            self._hold(self.rest[:CHUNK])
            self.rest = self.rest[CHUNK:]

    def _hold(self, chunk: bytes) -> None:
        self.held.append((self.doc_id, self.name, self.version, self.number, bytearray(chunk)))
        self.number += 1
        if len(self.held) >= HELD:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.store._append("chunks", self.held, CHUNKS)
            self.held = []

    def finish(self) -> dict:
        if self.rest or not self.number:
            self._hold(self.rest)
        self._flush()
        return self.store._announce(self.doc_id, self.name, self.version, self.length, f"sha256-{self.hash.hexdigest()}", self.content_type)

    def abort(self) -> None:
        self.held, self.rest = [], b""


class Attachments:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder, self._tick = spark, Folder(spark, root), 0

    def _append(self, table: str, rows: list, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.folder.path(table))

    def _announce(self, doc_id: str, name: str, version: str, length: int, digest: str, content_type: str, deleted: bool = False) -> dict:
        import time

        self._tick = max(self._tick + 1, time.time_ns() // 1000)
        self._append("info", [(doc_id, name, version, self._tick, length, digest, content_type, deleted)], INFO)
        return {"name": name, "length": length, "digest": digest, "content_type": content_type, "chunks": max(1, -(-length // CHUNK))}

    def writer(self, doc_id: str, name: str, content_type: str = "application/octet-stream") -> Writer:
        return Writer(self, doc_id, name, content_type)

    def put(self, doc_id: str, name: str, data: bytes | Iterable[bytes], content_type: str = "application/octet-stream") -> dict:
        w = self.writer(doc_id, name, content_type)
        for part in [data] if isinstance(data, bytes) else data:
            w.write(part)
        return w.finish()

    def table(self) -> DataFrame:
        """What is there: doc_id, name, version, length, digest, content_type."""
        if not self.folder.exists("info"):
            return self.spark.createDataFrame([], "doc_id string, name string, version string, length long, digest string, content_type string")
        rows = self.spark.read.schema(INFO).parquet(self.folder.path("info"))
        last = rows.groupBy("doc_id", "name").agg(F.max_by(F.struct("version", "length", "digest", "content_type", "deleted"), "wall").alias("a"))
        return last.select("doc_id", "name", "a.*").filter(~F.col("deleted")).drop("deleted")

    def info(self, doc_id: str, name: str) -> dict:
        row = self.table().filter((F.col("doc_id") == doc_id) & (F.col("name") == name)).first()
        if row is None:
            raise QueryError("not_found", (doc_id, name))
        return row.asDict()

    def list(self, doc_id: str) -> list[str]:
        return [r.name for r in self.table().filter(F.col("doc_id") == doc_id).select("name").orderBy("name").collect()]

    def read(self, doc_id: str, name: str) -> Iterator[bytes]:
        """The chunks in their order, one partition at a time."""
        own = self.info(doc_id, name)
        chunks = self.spark.read.schema(CHUNKS).parquet(self.folder.path("chunks"))
        mine = chunks.filter((F.col("doc_id") == doc_id) & (F.col("name") == name) & (F.col("version") == own["version"]))
        for row in mine.orderBy("chunk_no").select("data").toLocalIterator():
            yield bytes(row.data)

    def get(self, doc_id: str, name: str) -> bytes:
        out = b"".join(self.read(doc_id, name))
        if f"sha256-{hashlib.sha256(out).hexdigest()}" != self.info(doc_id, name)["digest"]:
            raise QueryError("corrupt_attachment", (doc_id, name))
        return out

    def delete(self, doc_id: str, name: str) -> None:
        own = self.info(doc_id, name)
        self._announce(doc_id, name, own["version"], own["length"], own["digest"], own["content_type"], True)
