"""find(): a compiled query over documents as one lazy DataFrame, and its pages."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.conditions import QueryError, is_var
from ..plans.query import Plan, compile_query
from .predicate import Typed, Variant, to_column


#: Up to so many ids are looked up by a filter.
FEW_IDS = 500


def key_of(field: list | str) -> str:
    return field if isinstance(field, str) else "/".join(map(str, field))


def find(docs: DataFrame, spec: dict | Plan, id_col: str = "id", body: str | None = None, any_rows: bool = False) -> DataFrame:
    """docs filtered, ordered, cut and shaped as spec says.

    body names a VARIANT column; without it the columns are the document's fields. Every row has `id`; include_docs adds `doc`
    (a struct, or VARIANT; or as doc_format says), or with flat the fields themselves; select adds a column for each variable and path, named by the
    path's parts joined by "/". Only the first order counts; ties and unordered limits go by id, so results are stable. any_rows gives up the
    latter: without an order, a limit takes the first rows that are found, and the scan ends with them.
    """
    plan = spec if isinstance(spec, Plan) else compile_query(spec)
    fields = Variant(body) if body else Typed()
    rows = docs.filter(_scan(plan, id_col)) if plan.id_scan else docs.filter(to_column(plan.conditions, fields)) if plan.conditions else docs
    keys = sort_keys(plan, docs, fields, id_col, body)
    if any_rows and not plan.order and not plan.offset and not plan.id_scan:
        keys = []
    if keys and (plan.order or plan.limit is not None or plan.offset or plan.id_scan):
        rows = rows.orderBy(*keys)
    if plan.offset:
        rows = rows.offset(plan.offset)
    if plan.limit is not None:
        rows = rows.limit(plan.limit)
    return rows.select(*shape(plan, docs, fields, id_col, body))


def _scan(plan: Plan, id_col: str) -> Column:
    kind, value = plan.id_scan
    own = F.col(id_col).cast("string")
    if kind == "prefix":
        return own.startswith(value)
    start, end = value
    out = F.lit(True) if start is None else own >= F.lit(start)
    return out if end is None else out & (own < F.lit(end))


def _projections(plan: Plan) -> list[tuple[str, list]]:
    out: dict[str, list] = {}
    for s in plan.select:
        if s == "*":
            out |= plan.bindings
        elif is_var(s):
            if s in plan.bindings:
                out[s] = plan.bindings[s]
        else:
            out[key_of(s)] = s
    return list(out.items())


def shape(plan: Plan, docs: DataFrame, fields: Typed | Variant, id_col: str, body: str | None) -> list[Column]:
    cols = [F.col(id_col).alias("id")]
    if plan.include_docs:
        if plan.flat and not body:
            cols += [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, "id")]
        else:
            whole = F.col(body) if body else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
            if plan.doc_format == "json":
                whole = F.to_json(whole)
            elif plan.doc_format == "binary":
                whole = F.encode(F.to_json(whole), "UTF-8")
            if plan.decoder is not None:
                decode = plan.decoder
                whole = F.pandas_udf(lambda s: s.map(decode, na_action="ignore"), T.StringType())(F.to_json(F.col(body) if body else whole))
            cols.append(whole.alias("doc"))
    return cols + [fields.value(p).alias(name) for name, p in _projections(plan)]


def sort_keys(plan: Plan, docs: DataFrame, fields: Typed | Variant, id_col: str, body: str | None) -> list[Column]:
    """Value order: numbers, false, null or missing, true, texts. Typed fields have one kind, which settles where nulls stand."""
    out: list[Column] = []
    if plan.order:
        by, way = plan.order[0]
        path = plan.bindings.get(by) if isinstance(by, str) else by
        if path is None:
            raise QueryError("invalid_clause", ("order_by", by))
        value = fields.value(path)
        if body:
            tag = F.schema_of_variant(value)
            rank = F.when(fields._numeric(value), 0).when((tag == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean"), 1).when(value.isNull() | (tag == "VOID"), 2).when(tag == "BOOLEAN", 3).when(tag.startswith("OBJECT"), 4).when(tag.startswith("ARRAY"), 5).otherwise(6)
            parts = [rank, F.try_variant_get(value, "$", "decimal(38,10)"), F.try_variant_get(value, "$", "double"), F.to_json(value)]
            out += [p.asc() if way == "asc" else p.desc() for p in parts]
        else:
            number = isinstance(docs.select(value).schema[0].dataType, T.NumericType)
            first = number == (way == "desc")  # a missing number stands behind all numbers, a missing text before all texts
            out.append(getattr(value, f"{way}_nulls_{'first' if first else 'last'}")())
    return [*out, F.col(id_col).asc()]


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    token: str | None

    @property
    def has_more(self) -> bool:
        return self.token is not None


def find_page(docs: DataFrame, spec: dict, size: int = 1000, token: str | None = None, id_col: str = "id", body: str | None = None, version: str = "") -> Page:
    """A page of up to `size` rows in id order, and a token for the next. version names the state of the documents; a token of another has expired.

    A page costs a filter on the id and a top-n: nothing is kept on the driver between pages.
    """
    plan = compile_query(spec)
    if plan.order:
        raise QueryError("invalid_clause", "pages go by id; order_by isn't possible")
    last = None
    if token:
        try:
            state = json.loads(base64.urlsafe_b64decode(token))
            seen, last = state["version"], state["last"]
        except (ValueError, KeyError) as e:
            raise QueryError("cursor_not_found", token) from e
        if seen != version:
            raise QueryError("cursor_expired", token)
    rows = docs if last is None else docs.filter(F.col(id_col) > F.lit(last))
    paged = Plan(**{**plan.__dict__, "limit": size + 1, "offset": plan.offset if last is None else 0})
    found = find(rows, paged, id_col, body)
    ids = [r[0] for r in found.select("id").orderBy("id").collect()]
    more = len(ids) > size
    out = found.filter(F.col("id") <= F.lit(ids[size - 1])) if more else found
    return Page(out, base64.urlsafe_b64encode(json.dumps({"version": version, "last": ids[size - 1]}).encode()).decode() if more else None)


def get_many(docs: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """Documents in the order asked for; `found` is false for ids without one.

    The ids, which the caller holds in memory, meet the documents in a broadcast inner join (up to FEW_IDS as a filter that reaches the scan before it), so no document
    moves but those asked for.
    """
    kind = docs.schema[id_col].dataType
    wanted = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], T.StructType([T.StructField("pos", T.IntegerType()), T.StructField(id_col, kind)]))
    near = docs.filter(F.col(id_col).isin(*ids)) if 0 < len(ids) <= FEW_IDS else docs
    have = near.withColumn("found", F.lit(True)).join(F.broadcast(wanted), id_col)
    rows = wanted.join(have.drop(id_col), "pos", "left")
    return rows.select(id_col, "pos", *(F.col(f"`{c}`") for c in docs.columns if c != id_col), F.coalesce("found", F.lit(False)).alias("found")).orderBy("pos")


def fold_docs(docs: DataFrame, fun: Callable, start, deleted: str | None = None, combine: Callable | None = None):
    """fun(row, accumulator) over all rows, one partition at a time on the driver.

    With combine(accumulator, accumulator) the tasks fold their own rows, each from start, and no row reaches the driver. start must then add nothing, and
    combine must not mind the order.
    """
    rows = docs.filter(~F.col(deleted)) if deleted else docs
    if combine is not None:
        return rows.rdd.treeAggregate(start, lambda acc, row: fun(row, acc), combine)
    acc = start
    for row in rows.toLocalIterator():
        acc = fun(row, acc)
    return acc
