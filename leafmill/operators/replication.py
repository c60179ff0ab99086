"""Replication between two stores: what the target lacks is an anti join of revisions; filters and checkpoints as the changes feed has them."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import FIRST, Stamp
from ..plans.conditions import QueryError
from . import changes as C
from . import revtree
from .joins import by_key

HISTORY = 20


class Side(Protocol):
    """What replication needs of a store."""

    def revisions(self, as_of: int | None = None) -> DataFrame: ...

    def log(self, as_of: int | None = None) -> DataFrame: ...

    def put_revs(self, rows: DataFrame) -> int: ...

    def put(self, doc: dict) -> str: ...

    local: Any


def replication_id(source: str, target: str, paths: list[str] | None = None, query: Any = None) -> str:
    """Names the checkpoint; differently filtered runs have different ones."""
    return hashlib.sha256(json.dumps([source, target, paths, query], default=str).encode()).hexdigest()[:32]


def read_checkpoint(side: Side, rep_id: str) -> Stamp:
    doc = side.local.get(f"replication-checkpoint/{rep_id}")
    return Stamp.parse(doc["history"][0]["seq"]) if doc and doc["history"] else FIRST


def write_checkpoint(side: Side, rep_id: str, seq: Stamp, stats: dict) -> None:
    old = side.local.get(f"replication-checkpoint/{rep_id}") or {"history": []}
    side.local.put(f"replication-checkpoint/{rep_id}", {"history": [{"seq": str(seq), "stats": stats}, *old["history"]][:HISTORY]})


def replicate(source: Side, target: Side, rep_id: str, paths: list[str] | None = None, query: Any = None) -> dict:
    """One run: the documents that changed since the checkpoint and fit the filters go over with their histories and tombstones.

    The checkpoint is the lower of both sides' and is written once all revisions are. A run that is broken off writes none and may
    be repeated: revisions that the target has are passed over. A filter selects by a document's last state.
    """
    since = min(read_checkpoint(source, rep_id), read_checkpoint(target, rep_id))
    log = source.log()
    last = C.last_seq(log).first().hlc
    end = since if last is None else max(since, Stamp(last.wall, last.logical))
    changed = C.changed(log, since, paths=paths, query=query, body="body").select(F.col("id").alias("doc_id")).checkpoint()
    wanted = source.revisions().select("doc_id", "rev", "parent", "deleted", "body").join(by_key(changed), "doc_id", "left_semi")
    missing = wanted.join(by_key(target.revisions().select("doc_id", "rev").distinct()), ["doc_id", "rev"], "left_anti").checkpoint()
    n_docs, n_revs = changed.count(), missing.count()
    if n_revs:
        target.put_revs(missing)
    stats = {"docs_read": n_docs, "revs_written": n_revs, "start_seq": str(since), "end_seq": str(end)}
    for side in (source, target):
        write_checkpoint(side, rep_id, end, stats)
    return stats


def arrived(source: Side, target: Side) -> bool:
    """Whether target has every revision of source."""
    return revtree.contains(target.revisions(), source.revisions().select("doc_id", "rev").distinct()).count() == source.revisions().select("doc_id", "rev").distinct().count()


def wait_for(source: Side, target: Side, tries: int = 10, pause: float = 0.5) -> bool:
    for i in range(tries):
        if arrived(source, target):
            return True
        if i + 1 < tries:
            time.sleep(pause)
    return False


def put_in_sync(source: Side, doc: dict, targets: dict[str, Side], name: str, tries: int = 10, pause: float = 0.5) -> tuple[str, list[str]]:
    """Writes doc to source and replicates it to each target; its revision, and the targets that have all of source's revisions."""
    rev = source.put(doc)
    for target_name, target in targets.items():
        replicate(source, target, replication_id(name, target_name))
    return rev, [n for n, t in targets.items() if wait_for(source, t, tries, pause)]


@dataclass
class Task:
    name: str
    source: str
    target: str
    direction: str = "push"
    mode: str = "one_shot"
    paths: list[str] | None = None
    query: Any = None
    state: str = "stopped"


class Tasks:
    """Replication tasks by name; they are kept in a store's local documents, so that a new session finds them again."""

    def __init__(self, keep, open_store):
        self.keep, self.open = keep, open_store

    def add(self, task: Task) -> None:
        if task.direction not in ("push", "pull", "both") or task.mode not in ("one_shot", "continuous"):
            raise QueryError("invalid_task", task)
        if "://" in task.source and task.source.startswith("http") or "://" in task.target and task.target.startswith("http"):
            raise QueryError("invalid_task", "only stores that Spark's file systems reach")
        self._save(task)

    def _save(self, task: Task) -> None:
        self.keep.put(f"replication-task/{task.name}", asdict(task))

    def get(self, name: str) -> Task:
        doc = self.keep.get(f"replication-task/{name}")
        if doc is None:
            raise QueryError("not_found", name)
        return Task(**doc)

    def list(self) -> list[Task]:
        return self.keep.fold("replication-task/", lambda _, v, acc: [*acc, Task(**v)], [])

    def delete(self, name: str) -> None:
        self.get(name)
        self.keep.delete(f"replication-task/{name}")

    def set_state(self, name: str, state: str) -> None:
        task = self.get(name)
        task.state = state
        self._save(task)

    def pause(self, name: str) -> None:
        self.set_state(name, "paused")

    def resume(self, name: str) -> dict | None:
        self.set_state(name, "stopped")
        return self.run(name)

    def run(self, name: str) -> dict | None:
        """One round of a task; a paused one does nothing. Continuous tasks are run again for each micro-batch, by streaming.replication."""
        task = self.get(name)
        if task.state == "paused":
            return None
        self.set_state(name, "running")
        a, b = self.open(task.source), self.open(task.target)
        ways = {"push": [(a, b, task.source, task.target)], "pull": [(b, a, task.target, task.source)]}
        stats = {}
        for s, t, x, y in ways.get(task.direction, [*ways["push"], *ways["pull"]]):
            stats[f"{x} -> {y}"] = replicate(s, t, replication_id(x, y, task.paths, task.query), task.paths, task.query)
        self.set_state(name, "running" if task.mode == "continuous" else "done")
        return stats

    def restore(self) -> list[str]:
        """Runs every continuous task that was running when the last session ended."""
        names = [t.name for t in self.list() if t.mode == "continuous" and t.state == "running"]
        for n in names:
            self.run(n)
        return names
