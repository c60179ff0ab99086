"""From a query specification (a dict) to a plan, without Spark; and what explain() says of it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .conditions import QueryError, check_path, is_var, normalise, variables

CLAUSES = {"where", "select", "order_by", "limit", "offset", "include_docs", "flat", "id_prefix", "id_range", "doc_format", "decoder_fun"}


@dataclass(frozen=True)
class Plan:
    conditions: list[tuple]
    bindings: dict[str, list]
    select: list  # "*", "?Var" or a path
    order: list[tuple[Any, str]] = field(default_factory=list)  # ("?Var" or path, "asc" or "desc")
    limit: int | None = None
    offset: int = 0
    include_docs: bool = True
    flat: bool = False
    id_scan: tuple[str, Any] | None = None  # ("prefix", text) or ("range", (start, end))
    doc_format: str = "map"
    decoder: Any = None
    strategy: str = "full_scan"


def compile_query(spec: dict) -> Plan:
    if not isinstance(spec, dict):
        raise QueryError("invalid_clause", spec)
    for key in spec:
        if key not in CLAUSES:
            raise QueryError("invalid_clause", key)
    scan = None
    if "id_prefix" in spec or "id_range" in spec:
        if "where" in spec:
            raise QueryError("id_scan_with_where")
        if "id_prefix" in spec and "id_range" in spec:
            raise QueryError("invalid_id_scan")
        scan = _id_scan(spec)
    elif "where" not in spec:
        raise QueryError("missing_clause", "where")
    conditions = [] if scan else normalise(spec["where"])
    for name, least in (("limit", 1), ("offset", 0)):
        value = spec.get(name)
        if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < least):
            raise QueryError("invalid_clause", (name, value))
    if spec.get("doc_format", "map") not in ("map", "json", "binary"):
        raise QueryError("invalid_clause", ("doc_format", spec["doc_format"]))
    bindings = variables(conditions)
    return Plan(
        conditions, bindings, [_field(x) for x in spec.get("select", ["*"])], _order(spec.get("order_by")), spec.get("limit"), spec.get("offset", 0),
        bool(spec.get("include_docs", True)), bool(spec.get("flat", False)), scan, spec.get("doc_format", "map"), spec.get("decoder_fun"), "id_scan" if scan else strategy(conditions),
    )


def _id_scan(spec: dict) -> tuple[str, Any]:
    if "id_prefix" in spec:
        if not isinstance(spec["id_prefix"], str):
            raise QueryError("invalid_id_scan", spec["id_prefix"])
        return "prefix", spec["id_prefix"]
    ends = spec["id_range"]
    if not isinstance(ends, (tuple, list)) or len(ends) != 2 or any(x is not None and not isinstance(x, str) for x in ends):
        raise QueryError("invalid_id_scan", ends)
    return "range", tuple(ends)


def _field(x: Any) -> Any:
    return x if x == "*" or is_var(x) else check_path(x)


def _order(order: Any) -> list[tuple[Any, str]]:
    if order is None:
        return []
    if isinstance(order, str) or isinstance(order, list) and order and all(isinstance(s, (str, int)) for s in order) and not all(is_var(s) for s in order):
        order = [order]
    out = []
    for o in order if isinstance(order, list) else [order]:
        by, way = o if isinstance(o, tuple) and len(o) == 2 and o[1] in ("asc", "desc") else (o, "asc")
        out.append((_field(by), way))
    return out


def _indexable(c: tuple) -> bool:
    if c[0] == "compare":
        return not is_var(c[3]) and c[2] != "=/="
    return c[0] in ("exists", "prefix") or c[0] == "path" and not is_var(c[2])


def strategy(conditions: list[tuple]) -> str:
    """What shape the conditions have: index_seek for one equality, index_scan for one range, multi_index for several, else full_scan."""
    usable = [c for c in conditions if _indexable(c)]
    if not usable:
        return "full_scan"
    if len(usable) > 1:
        return "multi_index"
    ranged = usable[0][0] in ("exists", "prefix") or usable[0][0] == "compare" and usable[0][2] != "=="
    return "index_scan" if ranged else "index_seek"


def explain(plan: Plan) -> dict:
    return {
        "strategy": plan.strategy, "conditions": plan.conditions, "bindings": plan.bindings, "projections": plan.select, "order": plan.order,
        "limit": plan.limit, "offset": plan.offset, "include_docs": plan.include_docs, "id_scan": plan.id_scan,
    }
