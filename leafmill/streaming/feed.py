"""Live changes on Structured Streaming: subscriptions by topic pattern or query, push in batches, and continuous replication's source.

The stream's source is the store's log; a query's checkpoint remembers what was delivered. A micro-batch waits for the one before, which is
the back-pressure; deletions never reach a query subscription. A compaction writes old entries anew: of these only such pass as are later than all that
a subscription delivered, which one that was away during a compaction needs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hlc import FIRST, Stamp, literal
from ..functions.topics import body_matches, body_topics
from ..operators.predicate import Typed, Variant, to_column
from ..plans.conditions import QueryError, normalise, path_patterns
from ..sources.files import Folder
from ..sources.store import REVS, Store

#: Changes in a pushed batch, and batches that may wait for their acknowledgement.
PUSH_BATCH, PUSH_PENDING = 100, 5


def stream_log(store: Store, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream: id, rev, deleted, hlc, body (VARIANT), compacted. A batch that is committed later turns up in a later micro-batch."""
    store.folder.make("revs")
    reader = store.spark.readStream.schema(REVS).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(store.folder.path("revs")).filter("hlc is not null")
    return rows.select(F.col("doc_id").alias("id"), "rev", "deleted", "hlc", F.try_parse_json("body").alias("body"), F.col("_metadata.file_path").contains("/base=").alias("compacted"))


class Delivered:
    """The last stamp that a subscription delivered, by micro-batch, so that one that is repeated starts where it did the first time."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def _all(self) -> dict[int, Stamp]:
        parts = [n.split(",") for n in self.folder.names()]
        return {int(b): Stamp(int(w), int(x)) for b, w, x in parts}

    def before(self, batch: int) -> Stamp:
        return max((s for b, s in self._all().items() if b < batch), default=FIRST)

    def note(self, batch: int, top: Stamp) -> None:
        """An empty folder's name holds it, as making one is atomic; all but the last two are removed."""
        have = self._all()
        self.folder.make(f"{batch},{top.wall},{top.logical}")
        for b in sorted(have)[:-1]:
            self.folder.delete(f"{b},{have[b].wall},{have[b].logical}")


def once_each(rows: DataFrame, batch: int, delivered: Delivered, deliver: Callable[[DataFrame, int], None]) -> None:
    """Hands on what of a micro-batch was not delivered before."""
    before = delivered.before(batch)
    seen = rows.agg(F.max("hlc").alias("top"), F.max("compacted").alias("any")).first()
    if seen.any:
        rows = rows.filter(~F.col("compacted") | (F.col("hlc") > literal(before))).dropDuplicates(["id", "hlc"])
    deliver(rows.drop("compacted"), batch)
    if seen.top is not None:
        delivered.note(batch, max(before, Stamp(seen.top.wall, seen.top.logical)))


def in_batches(rows: DataFrame, deliver: Callable[[list, int], Future | None], size: int = PUSH_BATCH, pending: int = PUSH_PENDING) -> int:
    """Rows in order of their stamps, in lists of `size` at most; how many lists. A deliver that returns a Future acknowledges by its end, and no more than
    `pending` wait; an error in one is raised here. One partition at a time is on the driver.
    """
    waiting: deque[Future] = deque()
    held, n = [], 0

    def hand() -> None:
        nonlocal held, n
        answer = deliver(held, n)
        held, n = [], n + 1
        if isinstance(answer, Future):
            waiting.append(answer)
            if len(waiting) >= pending:
                waiting.popleft().result()

    for row in rows.orderBy("hlc").toLocalIterator():
        held.append(row)
        if len(held) == size:
            hand()
    if held:
        hand()
    while waiting:
        waiting.popleft().result()
    return n


def path_events(log: DataFrame, patterns: str | list[str], body: str | None = "body") -> DataFrame:
    """Changes of which one topic matches one pattern; once each, however many match: id, rev, hlc, deleted, paths (its topics). Deletions have no topics."""
    keep = F.lit(False)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        keep = keep | body_matches(p, log.schema, None if body else [c for c in log.columns if c not in ("id", "rev", "deleted", "hlc")], body)
    columns = [c for c in log.columns if c not in ("id", "rev", "deleted", "hlc", "compacted")]
    more = [c for c in ("compacted",) if c in log.columns]
    return log.filter(keep & ~F.col("deleted")).select("id", "rev", "hlc", "deleted", body_topics(log.schema, columns, body).alias("paths"), *more)


def query_events(log: DataFrame, spec: dict, body: str | None = "body") -> DataFrame:
    """Changes after which a document matches the query; not fired for deletions."""
    if "where" not in spec:
        raise QueryError("missing_clause", "where")
    return log.filter(~F.col("deleted") & to_column(normalise(spec["where"]), Variant(body) if body else Typed())).select("id", "rev", *(c for c in ("hlc", "compacted") if c in log.columns))


def query_patterns(spec: dict) -> list[str]:
    """The topic patterns of what a query looks at."""
    return path_patterns(normalise(spec.get("where", [])))


@dataclass
class Subscriptions:
    """Subscriptions of one store; each is a streaming query that hands (rows, batch number) to a function."""

    store: Store
    checkpoints: str
    active: dict[str, StreamingQuery] = field(default_factory=dict)

    def _start(self, name: str, rows: DataFrame, deliver: Callable[[DataFrame, int], None], once: bool, interval: str) -> str:
        if name in self.active and self.active[name].isActive:
            raise QueryError("already_subscribed", name)
        delivered = Delivered(self.store.spark, f"{self.checkpoints}/{name}-delivered")
        writer = rows.writeStream.queryName(name).foreachBatch(lambda part, batch: once_each(part, batch, delivered, deliver)).option("checkpointLocation", f"{self.checkpoints}/{name}")
        self.active[name] = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
        return name

    def subscribe(self, name: str, patterns: str | list[str], deliver, once: bool = False, interval: str = "100 milliseconds") -> str:
        return self._start(name, path_events(stream_log(self.store), patterns), deliver, once, interval)

    def subscribe_query(self, name: str, spec: dict, deliver, once: bool = False, interval: str = "100 milliseconds") -> str:
        return self._start(name, query_events(stream_log(self.store), spec), deliver, once, interval)

    def push(self, name: str, deliver: Callable[[list, int], Future | None], size: int = PUSH_BATCH, pending: int = PUSH_PENDING, once: bool = False, interval: str = "100 milliseconds") -> str:
        """Every change in order, in lists of `size` at most with their number in the micro-batch; in_batches says how deliver acknowledges."""
        rows = stream_log(self.store).select("id", "rev", "hlc", "deleted", "compacted")
        return self._start(name, rows, lambda part, _: in_batches(part, deliver, size, pending), once, interval)

    def unsubscribe(self, name: str) -> None:
        query = self.active.pop(name, None)
        if query is None:
            raise QueryError("not_subscribed", name)
        query.stop()

    def names(self) -> list[str]:
        return sorted(n for n, q in self.active.items() if q.isActive)

    def close(self) -> None:
        for name in list(self.active):
            self.unsubscribe(name)


def active_queries(spark: SparkSession) -> list[str]:
    return sorted(q.name or str(q.id) for q in spark.streams.active)
