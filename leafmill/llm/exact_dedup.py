"""Exact deduplication through content-defined chunk recipes.

A text, without its white space, is cut where a hash of the last eight bytes says so; the list of its chunks'
identifiers is its recipe. Identifiers are 64-bit; the chunk dictionary checks each against 128 bits of SHA-256, and one
that stands for two contents is replaced by an identifier of the content. Only recipes and digests move, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, mix, prepare, released

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192


def cuts(raw: bytes) -> list[int]:
    """Ends of the content-defined chunks of raw; the last is len(raw). No text has no chunks."""
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    x = x[:-4] | (x[4:] << np.uint64(32))
    marks = np.flatnonzero((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEAN_BITS) == 0) + 8
    out, at = [], 0
    while n - at > MIN_CHUNK:
        i = int(np.searchsorted(marks, at + MIN_CHUNK))
        at = min(int(marks[i]) if i < len(marks) else n, at + MAX_CHUNK, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def recipe(raw: bytes) -> tuple[list[int], list[int], list[int]]:
    """Of each chunk: identifier, and two words that verify it."""
    ids, v1, v2, at = [], [], [], 0
    for end in cuts(raw):
        d = hashlib.sha256(raw[at:end]).digest()
        ids.append(int.from_bytes(d[16:24], "little", signed=True))
        v1.append(int.from_bytes(d[:8], "little", signed=True))
        v2.append(int.from_bytes(d[8:16], "little", signed=True))
        at = end
    return ids, v1, v2


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1)
        ids, v1, v2, sizes, sha, n_bytes = [], [], [], [], [], []
        for t in pc.fill_null(text, "").cast(pa.binary()).to_pylist():
            raw = t.translate(None, SPACES)
            a, b, c = recipe(raw)
            ids += a
            v1 += b
            v2 += c
            sizes.append(len(a))
            sha.append(hashlib.sha256(raw).hexdigest())
            n_bytes.append(len(raw))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        yield pa.record_batch(
            [batch.column(0), pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(sha, pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (ids, v1, v2))],
            names=["doc_id", "n_points", "n_bytes", "text_sha256", "recipe", "v1", "v2"],
        )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without the characters [\\x20\\x09-\\x0D]. The row with the most code points
    in its original text stays, then the smallest doc_id. Null counts as empty, and empty texts are equal to each other.
    A null doc_id loses every tie, and is kept only where no other stands. Rows that repeat both doc_id and text
    count one by one in group_size and share their verdict. Other columns are ignored. No rows give no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_recipes), "doc_id long, n_points long, n_bytes long, text_sha256 string, recipe array<long>, v1 array<long>, v2 array<long>").checkpoint()
    chunks = rows.select(F.explode(F.arrays_zip("recipe", "v1", "v2")).alias("c")).select("c.recipe", "c.v1", "c.v2")
    clash = chunks.groupBy("recipe").agg(F.min("v1").alias("a"), F.max("v1").alias("b"), F.min("v2").alias("c"), F.max("v2").alias("d")).filter("a != b or c != d").select("recipe").checkpoint()
    if not clash.isEmpty():  # two contents under one identifier: use one made of the content
        hit = rows.select("doc_id", "text_sha256", F.posexplode(F.arrays_zip("recipe", "v1", "v2")).alias("i", "c")).select("text_sha256", "i", "c.*")
        mended = hit.join(clash.withColumn("bad", F.lit(True)), "recipe", "left").groupBy("text_sha256").agg(F.sort_array(F.collect_set(F.struct("i", F.when(F.col("bad"), F.xxhash64("v1", "v2")).otherwise(F.col("recipe")).alias("id")))).alias("ids"))
        rows = rows.join(mended, "text_sha256", "left").withColumn("recipe", F.coalesce(F.transform("ids", lambda e: e.id), "recipe")).drop("ids").checkpoint()
    rows = rows.select("doc_id", "n_points", "n_bytes", "text_sha256", "recipe")
    groups = rows.groupBy("n_bytes", "recipe").agg(F.max(F.struct("n_points", (-F.col("doc_id")).alias("id"))).alias("best"), F.count("*").alias("group_size")).select("n_bytes", "recipe", (-F.col("best.id")).alias("keep_id"), "group_size").checkpoint()
    return rows.join(groups, ["n_bytes", "recipe"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
), h as (select doc_id, n, sha256(norm) as text_sha256 from d),
g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id, count(*) over (partition by text_sha256) as group_size from h
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""
