"""Revision trees as rows: nodes (doc_id, rev, parent, deleted).

Ways to the root double their length in each round, so a history of n revisions takes log2(n) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.revs import rev_key
from ..plans.conditions import QueryError
from .joins import by_key


def leaves(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes without a child: doc_id, rev, deleted, and the largest value of the columns in more. One pass: each node speaks for itself and for its parent, and these meet in one aggregation."""
    kinds = {c: nodes.schema[c].dataType for c in more}
    own = F.struct(F.col("rev").alias("rev"), F.col("deleted").alias("deleted"), F.lit(False).alias("child"), *more)
    above = F.struct(F.col("parent").alias("rev"), F.lit(None).cast("boolean").alias("deleted"), F.lit(True).alias("child"), *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    both = nodes.select("doc_id", F.explode(F.array(own, above)).alias("n"))
    met = both.filter("n.rev is not null").groupBy("doc_id", F.col("n.rev").alias("rev")).agg(F.max("n.child").alias("child"), *(F.max(f"n.{c}").alias(c) for c in ("deleted", *more)))
    return met.filter("not child").select("doc_id", "rev", "deleted", *more)


def winners(nodes: DataFrame, *more: str) -> DataFrame:
    """(doc_id, rev, deleted, and the columns in more) of the leaf with the highest generation, then the highest revision; a tombstone may win."""
    return _best(leaves(nodes, *more), *more)


def _best(leaf: DataFrame, *more: str) -> DataFrame:
    best = leaf.groupBy("doc_id").agg(F.max_by(F.struct("rev", "deleted", *more), rev_key(F.col("rev"))).alias("w"))
    return best.select("doc_id", "w.rev", "w.deleted", *(f"w.{c}" for c in more))


def conflicts(nodes: DataFrame) -> DataFrame:
    """(doc_id, rev) of leaves that are neither deleted nor the winner. Leaves are worked out once: Spark reuses their exchange."""
    leaf = leaves(nodes)
    won = _best(leaf).select("doc_id", F.col("rev").alias("won"))
    return leaf.join(by_key(won), "doc_id").filter(~F.col("deleted") & (F.col("rev") != F.col("won"))).select("doc_id", "rev")


def contains(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted (doc_id, rev), those that the trees hold."""
    return wanted.join(by_key(nodes.select("doc_id", "rev")), ["doc_id", "rev"], "left_semi")


def history(nodes: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """From each of starts (doc_id, rev) to its root: (doc_id, start, rev, dist), dist 0 the start itself; depth revisions at most.

    Each round's tables are checkpointed: the number of rounds grows with the logarithm of the longest history.
    """
    own = nodes.select("doc_id", "rev", "parent")
    jump = own.join(own.select("doc_id", F.col("rev").alias("parent")), ["doc_id", "parent"], "left_semi").select("doc_id", "rev", F.col("parent").alias("up")).checkpoint()
    ways = starts.select("doc_id", F.col("rev").alias("start")).distinct().join(own.select("doc_id", F.col("rev").alias("start")), ["doc_id", "start"], "left_semi")
    ways = ways.select("doc_id", "start", F.col("start").alias("rev"), F.lit(0).alias("dist")).checkpoint()
    step = 1
    while (depth is None or step < depth) and not jump.isEmpty():
        more = ways.join(jump, ["doc_id", "rev"]).select("doc_id", "start", F.col("up").alias("rev"), (F.col("dist") + step).alias("dist"))
        ways = ways.unionByName(more).checkpoint()
        over = jump.select("doc_id", F.col("rev").alias("up"), F.col("up").alias("top"))
        jump = jump.join(over, ["doc_id", "up"]).select("doc_id", "rev", F.col("top").alias("up")).checkpoint()
        step *= 2
    return ways if depth is None else ways.filter(F.col("dist") < depth)


def prune(nodes: DataFrame, depth: int) -> DataFrame:
    """The last depth revisions of every branch; nodes whose parent goes become roots.

    A node keeps one number, its distance from the nearest leaf below, so a round has no more rows than there are nodes.
    """
    if depth < 1:
        raise QueryError("invalid_depth", depth)
    own = nodes.select("doc_id", "rev", "parent")
    jump = own.join(by_key(own.select("doc_id", F.col("rev").alias("parent"))), ["doc_id", "parent"], "left_semi").select("doc_id", "rev", F.col("parent").alias("up")).checkpoint()
    near = leaves(nodes).select("doc_id", "rev", F.lit(0).alias("dist")).checkpoint()
    step = 1
    while step < depth and not jump.isEmpty():
        more = near.join(by_key(jump), ["doc_id", "rev"]).select("doc_id", F.col("up").alias("rev"), (F.col("dist") + step).alias("dist")).filter(F.col("dist") < depth)
        near = near.unionByName(more).groupBy("doc_id", "rev").agg(F.min("dist").alias("dist")).checkpoint()
        step *= 2
        if step < depth:
            jump = jump.join(by_key(jump.select("doc_id", F.col("rev").alias("up"), F.col("up").alias("top"))), ["doc_id", "up"]).select("doc_id", "rev", F.col("top").alias("up")).checkpoint()
    keep = near.select("doc_id", "rev")
    kept = nodes.join(by_key(keep), ["doc_id", "rev"], "left_semi")
    there = keep.select("doc_id", F.col("rev").alias("parent"), F.lit(True).alias("there"))
    return kept.join(by_key(there), ["doc_id", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there").select(nodes.columns)


def revs_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Revisions of source (doc_id, rev) that target lacks, each with the target's revisions of a lower generation, which may be ancestors.

    A document's revisions at the target are one sorted list, made on the map side first, which each missing revision cuts at its own generation; no pairs of revisions are made.
    """
    missing = source.select("doc_id", "rev").distinct().join(target.select("doc_id", "rev"), ["doc_id", "rev"], "left_anti")
    theirs = target.groupBy("doc_id").agg(F.sort_array(F.collect_set("rev")).alias("theirs"))
    older = F.filter("theirs", lambda r: rev_key(r).gen < rev_key(F.col("rev")).gen)
    return missing.join(theirs, "doc_id", "left").select("doc_id", "rev", F.coalesce(older, F.array().cast("array<string>")).alias("possible_ancestors"))
