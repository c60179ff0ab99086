"""Conditions to Spark columns.

Two resolvers stand for the two kinds of documents: rows with typed columns, whose fields are columns, and VARIANT
bodies, whose values carry their own type. A condition in positive position stays a bare comparison, which Parquet filters can
take; only below "not" is NULL turned into false.
"""

from __future__ import annotations

import functools
import json
import operator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.conditions import is_var

_COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "=<": operator.le, "==": operator.eq, "=/=": operator.ne}


class Typed:
    """Fields are columns; exists means IS NOT NULL, as a column cannot tell a null from a missing field."""

    def value(self, path: list) -> Column:
        out = F.col(f"`{path[0]}`")
        for s in path[1:]:
            out = F.get(out, F.lit(s)) if isinstance(s, int) else out.getField(s)
        return out

    def exists(self, path: list) -> Column:
        return self.value(path).isNotNull() if path else F.lit(True)

    def equals(self, path: list, v: Any) -> Column:
        return self.value(path).isNull() & F.lit(False) if v is None else self.value(path) == F.lit(v)

    def compare(self, path: list, op: str, v: Any) -> Column:
        if op == "=/=":
            return self.exists(path) & (self.value(path) != F.lit(v))
        return _COMPARE[op](self.value(path), F.lit(v))

    def compare_fields(self, path: list, op: str, other: list) -> Column:
        out = _COMPARE[op](self.value(path), self.value(other))
        return self.exists(path) & self.exists(other) & out if op == "=/=" else out

    def contains(self, path: list, v: Any) -> Column:
        return F.array_contains(self.value(path), F.lit(v))

    def regex(self, path: list, pattern: str) -> Column:
        return self.value(path).rlike(pattern)

    def prefix(self, path: list, text: str) -> Column:
        return self.value(path).startswith(text)


def variant_path(path: list) -> str:
    out = "$"
    for s in path:
        out += f"[{s}]" if isinstance(s, int) else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return out


class Variant:
    """Fields of a VARIANT column. Types are part of equality: 1, 1.0 and "1" differ; only numbers, or only texts, have an order."""

    def __init__(self, body: str = "body"):
        self.body = F.col(body)

    def value(self, path: list) -> Column:
        return F.variant_get(self.body, variant_path(path), "variant") if path else self.body

    def exists(self, path: list) -> Column:
        return self.value(path).isNotNull()

    def equals(self, path: list, v: Any) -> Column:
        return self._same(self.value(path), v)

    @staticmethod
    def _tag(value: Column) -> Column:
        return F.schema_of_variant(value)

    @staticmethod
    def _cast_then_tag(test: Column, tag: Column) -> Column:
        """Both; the tag, which costs more, is looked at only where the cast value passes."""
        return F.coalesce(test, F.lit(False)) & tag

    def _same(self, value: Column, v: Any) -> Column:
        tag = self._tag(value)
        if v is None:
            return F.is_variant_null(value)
        if isinstance(v, bool):
            return self._cast_then_tag(F.try_variant_get(value, "$", "boolean") == F.lit(v), tag == "BOOLEAN")
        if isinstance(v, int):
            whole = tag.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | tag.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
            return self._cast_then_tag(F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(str(v)).cast("decimal(38,0)"), whole)
        if isinstance(v, float):
            return self._cast_then_tag(F.try_variant_get(value, "$", "double") == F.lit(v), tag.isin("DOUBLE", "FLOAT") | tag.startswith("DECIMAL") & ~tag.rlike(r"^DECIMAL\((19|[23]\d),0\)$"))
        if isinstance(v, str):
            return self._cast_then_tag(F.try_variant_get(value, "$", "string") == F.lit(v), tag == "STRING")
        return F.to_json(value) == F.lit(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    def compare(self, path: list, op: str, v: Any) -> Column:
        if op == "==":
            return self.equals(path, v)
        if op == "=/=":
            return self.exists(path) & ~F.coalesce(self.equals(path, v), F.lit(False))
        value = self.value(path)
        if isinstance(v, str):
            return self._cast_then_tag(_COMPARE[op](F.try_variant_get(value, "$", "string"), F.lit(v)), self._tag(value) == "STRING")
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return F.lit(False)
        return self._cast_then_tag(_COMPARE[op](self._number(value), F.lit(v)), self._numeric(value))

    def _numeric(self, value: Column) -> Column:
        return self._tag(value).rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)")

    def _number(self, value: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "decimal(38,10)").cast("double"), F.try_variant_get(value, "$", "double"))

    def compare_fields(self, path: list, op: str, other: list) -> Column:
        a, b = self.value(path), self.value(other)
        equal = (self._tag(a) == self._tag(b)) & (F.to_json(a) == F.to_json(b))
        if op in ("==", "=/="):
            return equal if op == "==" else self.exists(path) & self.exists(other) & ~F.coalesce(equal, F.lit(False))
        texts = (self._tag(a) == "STRING") & (self._tag(b) == "STRING") & _COMPARE[op](F.try_variant_get(a, "$", "string"), F.try_variant_get(b, "$", "string"))
        return self._numeric(a) & self._numeric(b) & _COMPARE[op](self._number(a), self._number(b)) | texts

    def contains(self, path: list, v: Any) -> Column:
        return F.exists(F.try_variant_get(self.value(path), "$", "array<variant>"), lambda e: F.coalesce(self._same(e, v), F.lit(False)))

    def regex(self, path: list, pattern: str) -> Column:
        return self._cast_then_tag(F.try_variant_get(self.value(path), "$", "string").rlike(pattern), self._tag(self.value(path)) == "STRING")

    def prefix(self, path: list, text: str) -> Column:
        return self._cast_then_tag(F.try_variant_get(self.value(path), "$", "string").startswith(text), self._tag(self.value(path)) == "STRING")


def to_column(conditions: list[tuple], fields: Typed | Variant) -> Column:
    """The conjunction of the conditions; an empty one holds."""
    bound: dict[str, list] = {}
    return functools.reduce(operator.and_, [_leaf(c, fields, bound) for c in conditions], F.lit(True)) if conditions else F.lit(True)


def _leaf(c: tuple, f: Typed | Variant, bound: dict[str, list]) -> Column:
    kind = c[0]
    if kind == "and":
        parts = [_leaf(p, f, bound) for p in c[1]]
        return functools.reduce(operator.and_, parts) if parts else F.lit(True)
    if kind == "or":
        parts = [_leaf(p, f, dict(bound)) for p in c[1]]
        return functools.reduce(operator.or_, parts) if parts else F.lit(False)
    if kind == "not":
        return ~F.coalesce(_leaf(c[1], f, dict(bound)), F.lit(False))
    path = c[1]
    if kind == "path":
        if is_var(c[2]):
            bound[c[2]] = path
            return f.exists(path)
        return f.equals(path, c[2])
    if kind == "compare":
        if is_var(c[3]):
            if c[3] in bound:
                return f.compare_fields(path, c[2], bound[c[3]])
            return f.exists(path) if c[2] == "=/=" else F.lit(False)
        return f.compare(path, c[2], c[3])
    if kind == "in":
        if isinstance(f, Typed):
            return f.value(path).isin(*c[2]) if c[2] else F.lit(False)
        parts = [f.equals(path, v) for v in c[2]]
        return functools.reduce(operator.or_, parts) if parts else F.lit(False)
    if kind == "exists":
        return f.exists(path)
    if kind == "missing":
        return ~f.exists(path)
    return getattr(f, kind)(path, c[2])
