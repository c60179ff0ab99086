"""Continuous replication: a round of a task for every micro-batch of changes in the store that it reads from."""

from __future__ import annotations

import threading

from pyspark.sql.streaming import StreamingQuery

from ..operators.replication import Tasks
from ..plans.conditions import QueryError
from .feed import stream_log


def follow(tasks: Tasks, name: str, checkpoints: str, interval: str = "1 second", once: bool = False) -> list[StreamingQuery]:
    """Starts the streams of a continuous task, one for each store that it reads; stop() on a stream stops it, and pausing the task skips rounds.

    A round replicates from the task's own checkpoint, so a micro-batch that is delivered twice does nothing the second time.
    """
    task = tasks.get(name)
    if task.mode != "continuous":
        raise QueryError("invalid_task", name)
    read = {"push": [task.source], "pull": [task.target]}.get(task.direction, [task.source, task.target])
    out, turn = [], threading.Lock()

    def deliver(*_) -> None:
        with turn:  # both directions write to the same stores, which have one writer at a time
            tasks.run(name)

    for store in read:
        writer = stream_log(tasks.open(store)).select("id", "rev").writeStream.foreachBatch(deliver).option("checkpointLocation", f"{checkpoints}/{name}-{store.replace('/', '_')}")
        out.append((writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start())
    return out
