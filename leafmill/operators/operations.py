"""What goes around queries: time limits, job descriptions, metrics and sizes."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.conditions import QueryError


@contextmanager
def span(spark: SparkSession, name: str) -> Iterator[str]:
    """Jobs inside bear the name in Spark's UI and logs; gives their tag."""
    tag = f"{name}-{uuid.uuid4().hex[:8]}"
    spark.sparkContext.addJobTag(tag)
    spark.sparkContext.setLocalProperty("spark.job.description", name)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def with_timeout(spark: SparkSession, action: Callable[[], Any], seconds: float = 30.0, name: str = "query") -> Any:
    """action() within a time limit; beyond it its jobs are cancelled and "timeout" is raised."""
    over = threading.Event()
    with span(spark, name) as tag:
        timer = threading.Timer(seconds, lambda: (over.set(), spark.sparkContext.cancelJobsWithTag(tag)))
        timer.start()
        try:
            return action()
        except Exception as e:
            if over.is_set():
                raise QueryError("timeout", seconds) from e
            raise
        finally:
            timer.cancel()


# The measurements, their kind, what they tell, and the upper bounds of a histogram's classes.
METRICS: dict[str, tuple] = {
    "doc_operations": ("counter", "Document operations by database and operation"),
    "doc_operation_seconds": ("histogram", "Seconds of a document operation", (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)),
    "query_operations": ("counter", "Queries by database"),
    "query_seconds": ("histogram", "Seconds of a query", (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)),
    "query_results": ("histogram", "Rows that a query returned", (1, 10, 50, 100, 500, 1000, 5000)),
    "query_timeouts": ("counter", "Queries that reached their time limit"),
    "replication_docs": ("counter", "Documents replicated, by direction"),
    "replication_errors": ("counter", "Failed runs, by task"),
    "replication_lag_seconds": ("gauge", "Seconds by which a task's target is behind"),
    "replication_active": ("gauge", "1 while a task runs, else 0"),
    "db_documents": ("gauge", "Documents of a database"),
    "db_bytes": ("gauge", "Bytes of a database"),
    "db_attachments": ("gauge", "Attachments of a database"),
}


class Metrics:
    """Counters, gauges and histograms by name and labels, in this session; of bounded size, as they hold numbers only. Threads may share one.

    `timed` takes any name besides those of METRICS; such names are counted and timed, without classes.
    """

    def __init__(self):
        self._lock = threading.Lock()
        self._values: dict[tuple[str, tuple], float] = {}
        self._classes: dict[tuple[str, tuple], list] = {}

    @staticmethod
    def _key(name: str, labels: dict, kind: str) -> tuple[str, tuple]:
        if METRICS.get(name, (kind,))[0] != kind:
            raise QueryError("invalid_metric", name)
        return name, tuple(sorted((k, str(v)) for k, v in labels.items()))

    def inc(self, name: str, by: int = 1, **labels: Any) -> None:
        key = self._key(name, labels, "counter")
        with self._lock:
            self._values[key] = self._values.get(key, 0) + by

    def set(self, name: str, value: float, **labels: Any) -> None:
        key = self._key(name, labels, "gauge")
        with self._lock:
            self._values[key] = value

    def observe(self, name: str, value: float, **labels: Any) -> None:
        key = self._key(name, labels, "histogram")
        bounds = METRICS[name][2] if name in METRICS else ()
        with self._lock:
            own = self._classes.setdefault(key, [0, 0.0, [0] * len(bounds)])
            own[0] += 1
            own[1] += value
            own[2] = [n + (value <= b) for n, b in zip(own[2], bounds, strict=True)]

    @contextmanager
    def timed(self, name: str, **labels: Any) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.observe(name, time.perf_counter() - start, **labels)

    @contextmanager
    def doc_operation(self, db: str, operation: str) -> Iterator[None]:
        """Counts and times an operation on documents; one that fails counts too."""
        with self.timed("doc_operation_seconds", db=db, operation=operation):
            try:
                yield
            finally:
                self.inc("doc_operations", db=db, operation=operation)

    def query(self, spark: SparkSession, db: str, df: DataFrame, run: Callable[[DataFrame], Any], seconds: float = 30.0) -> Any:
        """run(df), an action, within a time limit; counts it, its time, its rows (observed while it runs) or its timeout."""
        self.inc("query_operations", db=db)
        seen = Observation(f"query-{uuid.uuid4().hex[:8]}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
        try:
            with self.timed("query_seconds", db=db):
                out = with_timeout(spark, lambda: run(watched), seconds)
        except QueryError as e:
            if e.category == "timeout":
                self.inc("query_timeouts")
            raise
        self.observe("query_results", seen.get["n"], db=db)
        return out

    def database(self, db: str, info: dict, attachments: int) -> None:
        """The gauges of a database, from its store's info() and its count of attachments."""
        self.set("db_documents", info["docs"], db=db)
        self.set("db_bytes", info["bytes"] + info["attachment_bytes"], db=db)
        self.set("db_attachments", attachments, db=db)

    @contextmanager
    def replication(self, task: str, direction: str = "push") -> Iterator[Callable[[dict, float], None]]:
        """Around a run of a task; what it gives is called with the run's stats and the lag in seconds. A failure counts as an error."""

        def done(stats: dict, lag: float = 0.0) -> None:
            self.inc("replication_docs", stats["docs_read"], direction=direction)
            self.set("replication_lag_seconds", lag, task=task)

        self.set("replication_active", 1, task=task)
        try:
            yield done
        except Exception:
            self.inc("replication_errors", task=task)
            raise
        finally:
            self.set("replication_active", 0, task=task)

    def rows(self) -> list[tuple[str, str, dict, float, float, dict]]:
        """(name, kind, labels, count or value, sum, {bound: count}) of all that was measured, in order of name and labels."""
        with self._lock:
            plain = [(n, METRICS[n][0] if n in METRICS else "counter", dict(lab), v, v, {}) for (n, lab), v in self._values.items()]
            split = [(n, "histogram", dict(lab), c, t, dict(zip(METRICS[n][2] if n in METRICS else (), by, strict=True))) for (n, lab), (c, t, by) in self._classes.items()]
        return sorted(plain + split, key=lambda r: (r[0], sorted(r[2].items())))

    def export(self) -> dict[str, dict[str, float]]:
        """Count and seconds (or sum) of each name, over all its labels."""
        out: dict[str, dict[str, float]] = {}
        for name, _, _, count, total, _ in self.rows():
            own = out.setdefault(name, {"count": 0, "seconds": 0.0})
            own["count"] += count
            own["seconds"] += total
        return out

    def export_text(self) -> str:
        """The text format of Prometheus: every name of METRICS with its help and type, and what was measured."""
        quote = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        shown = lambda lab: "{" + ",".join(f'{k}="{quote(v)}"' for k, v in lab.items()) + "}" if lab else ""
        rows, lines = self.rows(), []
        for name in dict.fromkeys([*METRICS, *(r[0] for r in rows)]):
            own = [r for r in rows if r[0] == name]
            kind, text = METRICS[name][:2] if name in METRICS else (own[0][1], name)
            lines += [f"# HELP {name} {text}", f"# TYPE {name} {kind}"]
            for _, _, lab, count, total, classes in own:
                if kind == "histogram":
                    lines += [f"{name}_bucket{shown(lab | {'le': str(b)})} {n}" for b, n in classes.items()]
                    lines += [f"{name}_bucket{shown(lab | {'le': '+Inf'})} {count}", f"{name}_sum{shown(lab)} {total}", f"{name}_count{shown(lab)} {count}"]
                else:
                    lines.append(f"{name}{shown(lab)} {count}")
        return "\n".join(lines) + "\n"


def observed(df: DataFrame, name: str = "rows", **extra: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that has its row count and these aggregates once df was run; no job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in extra.items())), seen
