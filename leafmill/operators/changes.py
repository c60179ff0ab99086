"""The changes feed: over an append-only log, the last change of each document, in order of its clock.

A log has id, rev, deleted, hlc (a struct of wall and logical) and either typed columns of the documents or a VARIANT body.
The last change of a document is found by an aggregation that works on the map side first, so a document
with a third of all changes sends one row from each task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import FIRST, Stamp, encoded, literal
from ..functions.topics import body_matches
from ..plans.conditions import QueryError, normalise
from . import revtree
from .joins import by_key
from .predicate import Typed, Variant, to_column

META = ("id", "rev", "deleted", "hlc")


def latest(log: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each document: its last change, with these columns (all, unless named)."""
    extra = [c for c in log.columns if c not in META] if extra is None else extra
    cols = ["rev", "deleted", "hlc", *extra]
    last = log.groupBy("id").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in cols)), "hlc").alias("last"))
    return last.select("id", *(F.col("last").getField(c).alias(c) for c in cols))


def change_filter(log: DataFrame, doc_ids: list | DataFrame | None = None, paths: list[str] | None = None, query=None, body: str | None = None) -> tuple[Column, DataFrame | None]:
    """The filters, all of which must hold, as a column; ids in a DataFrame are left for a semi join."""
    keep, ids = F.lit(True), None
    if isinstance(doc_ids, DataFrame):
        ids = doc_ids
    elif doc_ids is not None:
        keep = keep & (F.col("id").isin(*doc_ids) if doc_ids else F.lit(False))
    columns = [c for c in log.columns if c not in META]
    if paths is not None:
        own = F.lit(False)
        for p in paths:
            own = own | body_matches(p, log.schema, columns, body)
        keep = keep & own
    if query is not None:
        where = query.get("where") if isinstance(query, dict) else query
        if where is None:
            raise QueryError("missing_clause", "where")
        keep = keep & to_column(normalise(where), Variant(body) if body else Typed())
    return keep, ids


def changed(log: DataFrame, since: Stamp = FIRST, doc_ids=None, paths: list[str] | None = None, query=None, include_docs: bool = False, body: str | None = None) -> DataFrame:
    """Last changes after `since` that pass the filters, in no order: id, rev, deleted, hlc and, if asked for, the documents' columns.

    Filters turn into one boolean before the aggregation, so that no column but those asked for is read for it or moved by it.
    """
    # a stamp up to `since` can't be the last of a document that changed later, so older log rows need not take part
    recent = log.filter(F.col("hlc") > literal(since)) if since != FIRST else log
    by_id, ids = change_filter(log, doc_ids)
    if ids is not None:
        recent = recent.join(ids.select(F.col("id")).distinct(), "id", "left_semi")
    elif doc_ids is not None:
        recent = recent.filter(by_id)
    extra = [c for c in log.columns if c not in META] if include_docs else []
    if paths is None and query is None:
        return latest(recent, extra)
    keep, _ = change_filter(log, None, paths, query, body)
    passes = "passes" + "_" * sum(c.startswith("passes") for c in log.columns)
    rows = latest(recent.withColumn(passes, F.coalesce(keep & ~F.col("deleted"), F.lit(False))), [*extra, passes])
    return rows.filter(F.col(passes)).drop(passes)


def changes(log: DataFrame, since: Stamp = FIRST, doc_ids=None, paths: list[str] | None = None, query=None, include_docs: bool = False, limit: int | None = None, descending: bool = False, style: str = "main_only", revs: DataFrame | None = None, body: str | None = None) -> DataFrame:
    """Changes after `since`, in order of hlc: id, hlc, rev, deleted, changes, num_conflicts (with revs) and, if asked for, the documents' columns.

    paths are topic patterns, of which one must match; query is a where clause or a query; both look at the last state of a document,
    and deletions pass only where neither is given. descending gives the newest first, then cuts at limit.
    style "all_docs" lists all leaf revisions in `changes` and needs revs (doc_id, rev, parent, deleted); "main_only" lists the winner.
    """
    if style not in ("main_only", "all_docs") or style == "all_docs" and revs is None:
        raise QueryError("invalid_style", style)
    rows = changed(log, since, doc_ids, paths, query, include_docs, body).withColumn("changes", F.array("rev"))
    if revs is not None:
        leaf = revtree.leaves(revs).groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_set("rev"), asc=False).alias("leaf_revs"), F.sum((~F.col("deleted")).cast("long")).alias("live"))
        rows = rows.join(by_key(leaf), "id", "left").withColumn("num_conflicts", F.greatest(F.lit(0), F.coalesce("live", F.lit(1)) - (~F.col("deleted")).cast("long"))).drop("live")
        if style == "all_docs":
            rows = rows.withColumn("changes", F.coalesce("leaf_revs", "changes"))
        rows = rows.drop("leaf_revs")
    out = ["id", "hlc", "rev", "deleted", "changes", *(["num_conflicts"] if revs is not None else [])]
    if include_docs:
        out += [c for c in log.columns if c not in META]
    rows = rows.select(*(F.col(f"`{c}`") for c in out)).orderBy(F.col("hlc").desc() if descending else F.col("hlc").asc())
    return rows.limit(limit) if limit is not None else rows


@dataclass(frozen=True)
class ChangePage:
    rows: DataFrame
    last: Stamp
    has_more: bool

    @property
    def token(self) -> str:
        return base64.urlsafe_b64encode(self.last.encode()).decode()


def changes_page(log: DataFrame, token: str | Stamp = FIRST, size: int = 100, **filters) -> ChangePage:
    """A page of up to size changes and the 12-byte stamp, as text, to go on from. One change more is read, to tell whether there are more."""
    try:
        since = Stamp.decode(base64.urlsafe_b64decode(token)) if isinstance(token, str) else token
    except ValueError as e:
        raise QueryError("cursor_not_found", token) from e
    found = changes(log, since, limit=size + 1, **filters)
    stamps = [Stamp(r.wall, r.logical) for r in found.select("hlc.wall", "hlc.logical").collect()]
    more = len(stamps) > size
    last = stamps[size - 1] if more else stamps[-1] if stamps else since
    return ChangePage(found.filter(F.col("hlc") <= literal(last)), last, more)


def fold_changes(log: DataFrame, fun, start, since: Stamp = FIRST, **filters):
    """fun(row, accumulator) in order of the clock, one partition at a time on the driver; fun returns (go on, accumulator)."""
    acc = start
    for row in changes(log, since, **filters).toLocalIterator():
        go, acc = fun(row, acc)
        if not go:
            break
    return acc


def last_seq(log: DataFrame) -> DataFrame:
    """One row: the last stamp and its 12 bytes; nulls for an empty log."""
    return log.agg(F.max("hlc").alias("hlc")).select("hlc", encoded(F.col("hlc")).alias("seq"))


def count_since(log: DataFrame, since: Stamp) -> int:
    return log.filter(F.col("hlc") > literal(since)).select("id").distinct().count()


def has_since(log: DataFrame, since: Stamp) -> bool:
    return not log.filter(F.col("hlc") > literal(since)).isEmpty()


def stream_changes(log: DataFrame, since: Stamp = FIRST, batch: int = 100, **filters) -> Iterator[list]:
    """Pulls changes in batches until there are none; a caller may keep the last stamp and go on later.

    The log is read and sorted once, however many batches there are; one partition at a time is on the driver. Equal stamps may fall into two batches.
    """
    if batch < 1:
        raise QueryError("invalid_clause", ("batch", batch))
    rows = iter(changes(log, since, **filters).toLocalIterator())
    while held := list(islice(rows, batch)):
        yield held
