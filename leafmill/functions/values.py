"""Functions on document values: columns over VARIANT, and their like on values in Python."""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.predicate import variant_path
from ..plans.conditions import MISSING, lookup


# --- VARIANT columns ---


def get(body: Column, path: list, kind: str = "variant", default: Any = None) -> Column:
    out = F.try_variant_get(body, variant_path(path), kind)
    return out if default is None else F.coalesce(out, F.lit(default).cast(kind))


def is_key(body: Column, path: list) -> Column:
    return F.variant_get(body, variant_path(path), "variant").isNotNull()


def fields(body: Column) -> Column:
    """The top level as map<string, variant>; null for what is no object."""
    return F.try_variant_get(body, "$", "map<string,variant>")


def keys(body: Column) -> Column:
    return F.array_sort(F.map_keys(fields(body)))


def values(body: Column) -> Column:
    return F.map_values(fields(body))


def entries(body: Column) -> Column:
    return F.map_entries(fields(body))


def size(body: Column) -> Column:
    return F.size(fields(body))


def from_map(m: Column) -> Column:
    """map<string, variant> to an object."""
    return F.parse_json(F.to_json(m))


def filter_keys(body: Column, keep: Callable[[Column, Column], Column]) -> Column:
    return from_map(F.map_filter(fields(body), keep))


def map_values(body: Column, fun: Callable[[Column, Column], Column]) -> Column:
    return from_map(F.transform_values(fields(body), fun))


def remove(body: Column, key: str) -> Column:
    return filter_keys(body, lambda k, _: k != F.lit(key))


def without_meta(body: Column) -> Column:
    """The top level without names that start with "_"."""
    return filter_keys(body, lambda k, _: ~k.startswith("_"))


def set_key(body: Column, key: str, value: Column) -> Column:
    """With key set to a VARIANT value."""
    kept = F.map_filter(fields(body), lambda k, _: k != F.lit(key))
    return from_map(F.map_concat(kept, F.create_map(F.lit(key), value)))


def set_path(body: Column, path: list[str], value: Column) -> Column:
    """With a VARIANT value at a path of names; objects on the way are made, and take the place of what is none."""
    if len(path) == 1:
        return set_key(F.coalesce(_object(body), F.parse_json(F.lit("{}"))), path[0], value)
    return set_path(body, path[:1], set_path(get(body, path[:1]), path[1:], value))


def update_path(body: Column, path: list[str], fun: Callable[[Column], Column]) -> Column:
    """With fun of the VARIANT value at a path (null, if there is none) in its place."""
    return set_path(body, path, fun(get(body, path)))


def _object(body: Column) -> Column:
    return F.when(fields(body).isNotNull(), body)


def fold(body: Column, start: Column, fun: Callable[[Column, Column, Column], Column]) -> Column:
    """fun(accumulator, key, value) over the top level, in order of the keys."""
    ordered = F.array_sort(keys(body))
    return F.aggregate(ordered, start, lambda acc, k: fun(acc, k, F.element_at(fields(body), k)))


def merge(left: Column, right: Column) -> Column:
    """Both objects' fields; the right one wins."""
    mine = fields(right)
    kept = F.map_filter(fields(left), lambda k, _: ~F.map_contains_key(mine, k))
    return from_map(F.map_concat(kept, mine))


def generate_id() -> Column:
    return F.md5(F.expr("uuid()"))


# --- values in Python ---


def doc_get(doc: Any, path: list, default: Any = None) -> Any:
    out = lookup(doc, path)
    return default if out is MISSING else out


def doc_set(doc: Any, path: list, value: Any) -> Any:
    """A copy with the value at path; objects on the way are made, lists are not extended."""
    if not path:
        return value
    out, at = copy.deepcopy(doc) if isinstance(doc, (dict, list)) else {}, None
    at = out
    for s in path[:-1]:
        below = lookup(at, [s])
        if not isinstance(below, (dict, list)):
            below = at[s] = {}
        at = below
    at[path[-1]] = value
    return out


def doc_remove(doc: Any, path: list) -> Any:
    out = copy.deepcopy(doc)
    at = lookup(out, path[:-1])
    if at is not MISSING and lookup(at, path[-1:]) is not MISSING:
        del at[path[-1]]
    return out


def doc_take(doc: Any, path: list) -> tuple[Any, Any]:
    return doc_get(doc, path), doc_remove(doc, path)


def doc_update(doc: Any, path: list, fun: Callable[[Any], Any]) -> Any:
    return doc_set(doc, path, fun(doc_get(doc, path)))


def doc_without_meta(doc: dict) -> dict:
    return {k: v for k, v in doc.items() if not k.startswith("_")}


def make_record(doc: dict) -> dict:
    """id, rev, deleted and body of a document as it is handed in."""
    body = doc_without_meta(doc)
    return {"id": str(body.get("id") or uuid.uuid4().hex), "rev": doc.get("_rev"), "deleted": bool(doc.get("_deleted", False)), "body": json.dumps({k: v for k, v in body.items() if k != "id"}, sort_keys=True, ensure_ascii=False)}
