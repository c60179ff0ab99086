"""Revision identifiers: a generation, "-", and a digest of body, parent and deletion."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.conditions import QueryError


def canonical(body: Any) -> str:
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def make_rev(generation: int, digest: str) -> str:
    return f"{generation}-{digest}"


def parse_rev(rev: str) -> tuple[int, str]:
    head, dash, tail = rev.partition("-") if isinstance(rev, str) else ("", "", "")
    if not dash or not head.isdigit() or not tail:
        raise QueryError("invalid_rev", rev)
    return int(head), tail


def compare_revs(a: str, b: str) -> int:
    x, y = parse_rev(a), parse_rev(b)
    return (x > y) - (x < y)


def next_rev(body: Any, parent: str | None, deleted: bool = False) -> str:
    text = "\n".join((canonical(body), parent or "", "true" if deleted else "false"))
    return make_rev(parse_rev(parent)[0] + 1 if parent else 1, hashlib.sha256(text.encode()).hexdigest())


def encode_revisions(history: list[str]) -> dict:
    """History, newest first, to {start, ids}."""
    return {"start": parse_rev(history[0])[0] if history else 0, "ids": [parse_rev(r)[1] for r in history]}


def parse_revisions(revisions: dict) -> list[str]:
    return [make_rev(revisions["start"] - i, h) for i, h in enumerate(revisions["ids"])]


def trim_history(history: list[str], ancestors: set[str], depth: int) -> list[str]:
    """At most depth revisions, and none behind the first that the other side is known to have."""
    out = []
    for rev in history[:depth]:
        out.append(rev)
        if rev in ancestors:
            break
    return out


def generation(rev: Column) -> Column:
    return F.substring_index(rev, "-", 1).cast("int")


def rev_key(rev: Column) -> Column:
    """Its order: by generation, then by digest."""
    return F.struct(generation(rev).alias("gen"), rev.alias("rev"))


def rev_of(body_json: Column, parent: Column, deleted: Column) -> Column:
    """next_rev over columns; body_json must be canonical JSON, as to_json of a VARIANT is."""
    text = F.concat_ws("\n", F.coalesce(body_json, F.lit("null")), F.coalesce(parent, F.lit("")), deleted.cast("string"))
    return F.concat((F.coalesce(generation(parent), F.lit(0)) + 1).cast("string"), F.lit("-"), F.sha2(text, 256))
