"""Documents as the relation of their leaf paths, and the set operations on document ids that rest on it.

The relation (id, path array<string>, value string, kind, topic) is worked out from documents when needed; Parquet's own
statistics stand in for a stored index. Ids meet in joins and set operators, not in lists on one task.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.topics import leaves
from ..plans.conditions import QueryError

_FOLDS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "=<": operator.le, "==": operator.eq}


def flatten_typed(docs: DataFrame, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """Leaves of typed columns; nesting is taken from the schema, null values are missing. A Generate, no shuffle."""
    use = [f for f in docs.schema.fields if f.name != id_col and (columns is None or f.name in columns)]
    every = F.concat(*(leaves(F.col(f"`{f.name}`"), f.dataType, [F.lit(f.name)]) for f in use))
    out = docs.select(F.col(id_col).alias("id"), F.explode(every).alias("leaf")).select("id", "leaf.path", "leaf.value", "leaf.kind")
    return out.withColumn("topic", F.concat_ws("/", F.array_append("path", F.col("value"))))


def leaf_paths(doc) -> list[tuple[list[str], str, str]]:
    """(path, value as text, kind) of every leaf of a parsed JSON value; empty objects and lists have none."""
    out: list[tuple[list[str], str, str]] = []
    todo = [([], doc)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [([*path, k], x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [([*path, str(i)], x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, bool) or v is None:
            out.append((path, {True: "true", False: "false", None: "null"}[v], "null" if v is None else "bool"))
        elif isinstance(v, float):
            text = f"{v:.10f}".rstrip("0")
            out.append((path, text + "0" if text.endswith(".") else text, "float"))
        else:
            out.append((path, str(v), "int" if isinstance(v, int) else "text"))
    return out


def flatten_json(docs: DataFrame, id_col: str, body: Column) -> DataFrame:
    """Leaves of JSON texts of any depth. Texts that are no JSON have none.

    Depth is data here, not schema, which no column expression unrolls; texts go through Arrow batches once.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values, kinds = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    found = leaf_paths(json.loads(text)) if text is not None else []
                except ValueError:
                    continue
                for path, value, kind in found:
                    at.append(i)
                    paths.append(path)
                    values.append(value)
                    kinds.append(kind)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.list_(pa.string())), pa.array(values, pa.string()), pa.array(kinds, pa.string())], names=["id", "path", "value", "kind"])

    flat = docs.select(F.col(id_col).alias("id"), body.alias("body")).mapInArrow(run, f"id {id_type}, path array<string>, value string, kind string")
    return flat.withColumn("topic", F.concat_ws("/", F.array_append("path", F.col("value"))))


def path_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, topic, change): "removed" where only old has it, "added" where only new has it."""
    a, b = old.select("id", "topic").distinct().withColumn("was", F.lit(1)), new.select("id", "topic").distinct().withColumn("now", F.lit(1))
    both = a.join(b, ["id", "topic"], "full").filter("was is null or now is null")
    return both.select("id", "topic", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))


def doc_paths(paths: DataFrame, doc_id) -> DataFrame:
    return paths.filter(F.col("id") == F.lit(doc_id)).select("path", "value", "kind", "topic")


def cardinality(paths: DataFrame) -> DataFrame:
    """Documents for each path and value; counts are pre-aggregated before they move."""
    return paths.select(F.concat_ws("/", "path").alias("path"), "value", "id").distinct().groupBy("path", "value").agg(F.count("*").alias("n_docs"))


def under(paths: DataFrame, prefix: list[str], descending: bool = False, after: tuple | None = None, size: int | None = None) -> DataFrame:
    """Leaves below a path, ordered by path, value and id; after (path, value, id of the last row seen) and size give a chunk."""
    rows = paths.filter(F.slice("path", 1, len(prefix)) == F.array(*map(F.lit, prefix))) if prefix else paths
    if after is not None:
        key, last = F.struct("path", "value", "id"), F.struct(F.array(*map(F.lit, after[0])).alias("path"), F.lit(after[1]).alias("value"), F.lit(after[2]).alias("id"))
        rows = rows.filter(key < last if descending else key > last)
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in ("path", "value", "id")]
    rows = rows.orderBy(*keys)
    return rows if size is None else rows.limit(size)


def fold_values(paths: DataFrame, path: list[str], op: str, value: float | str, descending: bool = False) -> DataFrame:
    """(id, value) of leaves at a path that compare so (>, >=, <, =<, ==) with value, in order of value and id; numbers compare with numbers, texts with texts."""
    if op not in _FOLDS:
        raise QueryError("invalid_operator", op)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    own = F.col("value").try_cast("double") if number else F.col("value")
    rows = paths.filter((F.col("path") == F.array(*map(F.lit, path))) & (F.col("kind").isin("int", "float") if number else F.col("kind") == "text")).filter(_FOLDS[op](own, F.lit(value)))
    keys = [own.desc() if descending else own.asc(), F.col("id").desc() if descending else F.col("id").asc()]
    return rows.orderBy(*keys).select("id", "value")


def by_value(paths: DataFrame, value: str, kind: str | None = None) -> DataFrame:
    """Value first: (path, id) of every leaf with this value, wherever it stands."""
    rows = paths.filter((F.col("value") == F.lit(value)) & (F.col("kind") == kind if kind else F.lit(True)))
    return rows.select("path", "id").distinct()


def postings(paths: DataFrame, path: list[str], value: str | None = None, prefix: str | None = None) -> DataFrame:
    """Distinct ids of documents that have the path, with this value or start of a value if one is given."""
    rows = paths.filter(F.col("path") == F.array(*map(F.lit, path)))
    if value is not None:
        rows = rows.filter(F.col("value") == F.lit(value))
    if prefix is not None:
        rows = rows.filter(F.col("value").startswith(prefix))
    return rows.select("id").distinct()


def posting_lists(paths: DataFrame, buckets: int = 16) -> DataFrame:
    """Sorted lists of ids: (path, value, bucket, ids, n). A list is dealt over buckets by a hash of the id, so that one value of a third of all documents is no single row."""
    each = paths.select("path", "value", "id").distinct().withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    return each.groupBy("path", "value", "bucket").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("n", F.size("ids"))


def list_contains(lists: DataFrame, doc_id, buckets: int = 16) -> DataFrame:
    """(path, value) of the lists that hold an id; only its bucket is looked into."""
    own = F.lit(doc_id).cast(lists.schema["ids"].dataType.elementType)
    return lists.filter((F.col("bucket") == F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int")) & F.array_contains("ids", own)).select("path", "value")


def intersection(*ids: DataFrame) -> DataFrame:
    """Ids in all of them, by semi joins; an empty one ends it early."""
    out = ids[0].distinct()
    for other in ids[1:]:
        out = out.join(other, "id", "left_semi")
    return out


def union(*ids: DataFrame) -> DataFrame:
    out = ids[0]
    for other in ids[1:]:
        out = out.unionByName(other)
    return out.distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right, "id", "left_anti")


def path_dictionary(paths: DataFrame) -> DataFrame:
    """(path, path_id): numbers from 0 in order of the paths. Tasks number ranges of paths; where each range starts follows from the ranges' sizes, a row for each task."""
    used = paths.select(F.concat_ws("/", "path").alias("path")).distinct().repartitionByRange("path").sortWithinPartitions("path").withColumn("place", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    start, at = 0, {}
    for r in used.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        at[r.part], start = start, start + r.n
    if not at:
        return used.select("path", F.lit(0).alias("path_id"))
    starts = F.create_map(*(F.lit(x) for kv in at.items() for x in kv))
    return used.select("path", (starts[part] + place).cast("int").alias("path_id"))


def reindex(paths: DataFrame, changed: DataFrame, ids: DataFrame) -> DataFrame:
    """The relation after some documents changed: theirs (ids: id) go, and `changed`, the leaves of those that are left, come in."""
    return paths.join(ids.select("id").distinct(), "id", "left_anti").unionByName(changed)
