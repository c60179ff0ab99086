"""Topics and their patterns.

A topic is a leaf's path and its value, joined by "/". A pattern is a topic in which "+" stands for one level and a last "#" for
any levels, none included. Patterns compile to columns: over typed columns only the leaves that may match are
read; over VARIANT values the pattern walks the value.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.conditions import QueryError


def check_pattern(pattern: str) -> list[str]:
    """The levels of a pattern; "#" must be the last, and "#" and "+" a level of their own."""
    levels = pattern.split("/") if isinstance(pattern, str) and pattern else []
    if not levels or "#" in levels[:-1] or any(len(s) > 1 and ("#" in s or "+" in s) for s in levels):
        raise QueryError("invalid_pattern", pattern)
    return levels


def pattern_regex(pattern: str) -> str:
    """An anchored regex for topics, good for Java and Python."""
    levels = check_pattern(pattern)
    if levels == ["#"]:
        return r"^.*$"
    parts = ["[^/]+" if s == "+" else re.sub(r"([^\w\s/-])", r"\\\1", s) for s in levels if s != "#"]
    return "^" + "/".join(parts) + ("(/.*)?$" if levels[-1] == "#" else "$")


def topic_matches(pattern: str, topic: str) -> bool:
    return re.match(pattern_regex(pattern), topic, re.DOTALL) is not None


def prefixes(topic: Column) -> Column:
    """Every hierarchical start of a topic, the whole one last."""
    parts = F.split(topic, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))


def scalar_text(value: Column, kind: T.DataType) -> Column:
    """A value as a topic shows it; floats with up to ten decimals, one at least."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(F.format_string("%.10f", value), r"(\.\d+?)0+$", "$1")
    return value.cast("string")


def leaves(value: Column, kind: T.DataType, path: list[Column]) -> Column:
    """array<struct<path, value, kind>> of a typed value's leaves, nulls left out; any nesting that the schema has."""
    if isinstance(kind, T.StructType):
        parts = [leaves(value.getField(f.name), f.dataType, [*path, F.lit(f.name)]) for f in kind.fields]
        return F.coalesce(F.concat(*parts), F.array().cast(_LEAVES)) if parts else F.array().cast(_LEAVES)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: leaves(x, kind.elementType, [*path, i.cast("string")]))
        return F.coalesce(F.flatten(each), F.array().cast(_LEAVES))
    if isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: leaves(e.value, kind.valueType, [*path, e.key.cast("string")]))
        return F.coalesce(F.flatten(each), F.array().cast(_LEAVES))
    name = "bool" if isinstance(kind, T.BooleanType) else "float" if isinstance(kind, (T.DoubleType, T.FloatType)) else "int" if isinstance(kind, (T.IntegralType, T.DecimalType)) else "text"
    one = F.array(F.struct(F.array(*path).alias("path"), scalar_text(value, kind).alias("value"), F.lit(name).alias("kind")))
    return F.when(value.isNotNull(), one).otherwise(F.array().cast(_LEAVES))


_LEAVES = "array<struct<path:array<string>,value:string,kind:string>>"


def _typed(value: Column, kind: T.DataType, levels: list[str]) -> Column:
    """Whether a leaf of value has a topic that the levels match; they start below value's own path."""
    if isinstance(kind, T.StructType):
        if levels == ["#"]:
            return _any(_typed(value.getField(f.name), f.dataType, levels) for f in kind.fields)
        return _any(_typed(value.getField(f.name), f.dataType, levels[1:]) for f in kind.fields if levels and levels[0] in ("+", f.name))
    if isinstance(kind, T.ArrayType):
        if levels == ["#"]:
            return F.exists(value, lambda x: F.coalesce(_typed(x, kind.elementType, levels), F.lit(False)))
        if not levels or levels[0] != "+" and not levels[0].isdigit():
            return F.lit(False)
        if levels[0] == "+":
            return F.exists(value, lambda x: F.coalesce(_typed(x, kind.elementType, levels[1:]), F.lit(False)))
        return _typed(F.get(value, F.lit(int(levels[0]))), kind.elementType, levels[1:])
    if isinstance(kind, T.MapType):
        if levels == ["#"] or levels and levels[0] == "+":
            return F.exists(F.map_values(value), lambda x: F.coalesce(_typed(x, kind.valueType, levels if levels == ["#"] else levels[1:]), F.lit(False)))
        return _typed(value[levels[0]], kind.valueType, levels[1:]) if levels else F.lit(False)
    return _leaf(scalar_text(value, kind), value.isNotNull(), levels)


def _leaf(text: Column, there: Column, levels: list[str]) -> Column:
    if levels == ["#"]:
        return there
    if not levels:
        return F.lit(False)
    if not {"+", "#"} & set(levels):
        return text == F.lit("/".join(levels))
    return text.rlike("(?s)" + pattern_regex("/".join(levels)))


def _any(parts) -> Column:
    parts = list(parts)
    return functools.reduce(operator.or_, parts) if parts else F.lit(False)


def _variant(value: Column, levels: list[str], depth: int = 24) -> Column:
    tag = F.schema_of_variant(value)
    if levels == ["#"]:
        return value.isNotNull() & ~tag.isin("OBJECT<>", "ARRAY<>", "ARRAY<VOID>")
    if not levels:
        return F.lit(False)
    nested, first, rest = tag.startswith("OBJECT") | tag.startswith("ARRAY"), levels[0], levels[1:]
    scalar = _leaf(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)), ~nested, levels)
    if first == "+":
        inner = lambda xs: F.exists(xs, lambda x: F.coalesce(_variant(x, rest, depth - 1), F.lit(False)))
        below = (tag.startswith("OBJECT") & inner(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")))) | (tag.startswith("ARRAY") & inner(F.try_variant_get(value, "$", "array<variant>")))
    else:
        below = F.lit(False)
        if rest:
            key = "$['" + first.replace("\\", "\\\\").replace("'", "\\'") + "']"
            below = _variant(F.try_variant_get(value, key, "variant"), rest, depth - 1)
            if first.isdigit():
                below = F.coalesce(below, F.lit(False)) | _variant(F.try_variant_get(value, f"$[{first}]", "variant"), rest, depth - 1)
    return F.coalesce(~nested & scalar, F.lit(False)) | F.coalesce(below, F.lit(False))


def body_matches(pattern: str, schema: T.StructType, columns: list[str] | None = None, body: str | None = None) -> Column:
    """Whether a document has a topic that the pattern matches: over columns of the schema, or over the VARIANT column body."""
    levels = check_pattern(pattern)
    if body:
        return F.coalesce(_variant(F.col(body), levels), F.lit(False))
    parts = []
    for f in schema.fields:
        if columns is not None and f.name not in columns:
            continue
        own = F.col(f"`{f.name}`")
        if levels == ["#"]:
            parts.append(_typed(own, f.dataType, levels))
        elif levels[0] in ("+", f.name):
            parts.append(_typed(own, f.dataType, levels[1:]))
    return F.coalesce(_any(parts), F.lit(False))


def body_topics(schema: T.StructType, columns: list[str], body: str | None = None, depth: int = 4) -> Column:
    """array<string> of a document's topics, over columns of the schema or over the VARIANT column body; values nested deeper than depth count as JSON text."""
    if not body:
        every = F.concat(*(leaves(F.col(f"`{f.name}`"), f.dataType, [F.lit(f.name)]) for f in schema.fields if f.name in columns))
        return F.transform(every, lambda e: F.concat_ws("/", F.array_append(e.path, e.value)))
    return _variant_topics(F.col(body), depth)


def _variant_topics(value: Column, depth: int) -> Column:
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    if not depth:
        return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))
    below = lambda k, v: F.transform(_variant_topics(v, depth - 1), lambda t: F.concat(k, F.lit("/"), t))
    of_map = F.flatten(F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: below(e.key, e.value)))
    of_list = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: below(i.cast("string"), x)))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(of_map, of_list, F.array(text)))
