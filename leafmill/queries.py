"""Driver queries of the document engine, each beside the SQL that gives the same rows over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hlc import Stamp, encoded, order, shown, stamp
from .functions.revs import generation
from .functions.topics import prefixes
from .operators import changes as C
from .operators import paths as P
from .operators import revtree
from .operators.find import find, find_page, get_many
from .streaming.feed import path_events, query_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _where(name: str, table: str, key: str, where, columns: list[str], sql_where: str) -> None:
    """A query by condition over a table: the key and these columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(_table(spark, sf_dir, table), {"where": where, "select": [[c] for c in columns], "include_docs": False}, key)

    run.__name__ = name
    query(f"select {', '.join([f'{key} as id', *columns])} from {table} where {sql_where}")(run)


_where("p_eq", "orders", "o_orderkey", [("path", ["o_orderstatus"], "F")], ["o_totalprice"], "o_orderstatus = 'F'")
_where("p_gt", "orders", "o_orderkey", [("compare", ["o_totalprice"], ">", 400000)], ["o_totalprice"], "o_totalprice > 400000")
_where("p_lt", "lineitem", "l_orderkey", [("compare", ["l_quantity"], "<", 3)], ["l_linenumber", "l_quantity"], "l_quantity < 3")
_where("p_gte", "lineitem", "l_orderkey", [("compare", ["l_discount"], ">=", 0.09)], ["l_linenumber", "l_discount"], "l_discount >= 0.09::double")
_where("p_lte", "part", "p_partkey", [("compare", ["p_size"], "=<", 7)], ["p_size"], "p_size <= 7")
_where("p_strict_eq", "part", "p_partkey", [("compare", ["p_size"], "==", 11)], ["p_size"], "p_size = 11")
_where("p_ne", "orders", "o_orderkey", [("compare", ["o_orderstatus"], "=/=", "O")], ["o_orderstatus"], "o_orderstatus is not null and o_orderstatus <> 'O'")
_where("p_and", "orders", "o_orderkey", [("and", [("path", ["o_orderstatus"], "P"), ("compare", ["o_totalprice"], "<", 100000)])], ["o_totalprice"], "o_orderstatus = 'P' and o_totalprice < 100000")
_where("p_or", "orders", "o_orderkey", [("or", [("path", ["o_orderpriority"], "1-URGENT"), ("compare", ["o_totalprice"], ">", 450000)])], ["o_orderpriority"], "o_orderpriority = '1-URGENT' or o_totalprice > 450000")
_where("p_not", "customer", "c_custkey", [("not", ("path", ["c_mktsegment"], "BUILDING"))], ["c_mktsegment"], "not coalesce(c_mktsegment = 'BUILDING', false)")
_where(
    "p_nested", "customer", "c_custkey", [("or", [("and", [("path", ["c_nationkey"], 3), ("not", ("compare", ["c_acctbal"], ">", 5000))]), ("not", ("or", [("compare", ["c_nationkey"], "<", 20), ("prefix", ["c_mktsegment"], "M")]))])],
    ["c_nationkey", "c_acctbal"], "(c_nationkey = 3 and not coalesce(c_acctbal > 5000, false)) or not coalesce(c_nationkey < 20 or starts_with(c_mktsegment, 'M'), false)",
)
_where("p_in", "customer", "c_custkey", [("in", ["c_mktsegment"], ["BUILDING", "MACHINERY"])], ["c_mktsegment"], "c_mktsegment in ('BUILDING', 'MACHINERY')")
_where("p_prefix", "part", "p_partkey", [("prefix", ["p_name"], "red")], ["p_name"], "starts_with(p_name, 'red')")
_where("p_regex", "part", "p_partkey", [("regex", ["p_brand"], "#1[0-5]$")], ["p_brand"], "regexp_matches(p_brand, '#1[0-5]$')")
_where("p_field_compare", "lineitem", "l_orderkey", [("path", ["l_tax"], "?Tax"), ("compare", ["l_discount"], ">", "?Tax")], ["l_linenumber", "l_discount", "l_tax"], "l_tax is not null and l_discount > l_tax")


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


_GAPS = "(select * replace (case when event_type <> 'error' then value end as value) from events)"


@query(f"select event_id as id, value from {_GAPS} where value is not null")
def p_exists(spark, sf_dir):
    return find(_with_gaps(spark, sf_dir), {"where": ("exists", ["value"]), "select": [["value"]], "include_docs": False}, "event_id")


@query(f"select event_id as id, event_type from {_GAPS} where value is null")
def p_missing(spark, sf_dir):
    return find(_with_gaps(spark, sf_dir), {"where": ("missing", ["value"]), "select": [["event_type"]], "include_docs": False}, "event_id")


@query("select doc_id as id, lang from documents where list_contains(string_split(coalesce(text, ''), ' '), 'the')")
def p_contains(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.split(F.coalesce("text", F.lit("")), " ", -1).alias("words"))
    return find(docs, {"where": ("contains", ["words"], "the"), "select": [["lang"]], "include_docs": False}, "doc_id")


@query("select doc_id as id from documents where list_contains(string_split(coalesce(text, ''), ' '), 'and') and lang is not null")
def p_contains_list(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.split(F.coalesce("text", F.lit("")), " ", -1).alias("words"))
    return find(docs, {"where": [("contains", ["words"], "and"), ("exists", ["lang"])], "include_docs": False}, "doc_id")


@query("select l_orderkey as id, l_linenumber, l_tax as \"?Tax\", l_returnflag as \"?Flag\" from lineitem where l_tax is not null and l_returnflag is not null and l_quantity > 45")
def p_bind(spark, sf_dir):
    where = [("path", ["l_tax"], "?Tax"), ("path", ["l_returnflag"], "?Flag"), ("compare", ["l_quantity"], ">", 45)]
    return find(_table(spark, sf_dir, "lineitem"), {"where": where, "select": ["*", ["l_linenumber"]], "include_docs": False}, "l_orderkey")


@query("select c_custkey as id, c_name as \"?Name\", c_acctbal as \"?Bal\" from customer where c_name is not null and c_acctbal is not null and c_nationkey = 7")
def j_select_vars(spark, sf_dir):
    where = [("path", ["c_name"], "?Name"), ("path", ["c_acctbal"], "?Bal"), ("path", ["c_nationkey"], 7)]
    return find(_table(spark, sf_dir, "customer"), {"where": where, "select": ["?Name", "?Bal"], "include_docs": False}, "c_custkey")


@query("select event_id as id, cast(json_extract(props, '$.k') as bigint) as \"props/k\" from events where cast(json_extract(props, '$.k') as bigint) >= 90")
def j_select_path(spark, sf_dir):
    docs = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return find(docs, {"where": ("compare", ["props", "k"], ">=", 90), "select": [["props", "k"]], "include_docs": False}, "event_id")


@query("select n_nationkey as id, n_name, n_regionkey from nation where n_regionkey = 2")
def j_flat(spark, sf_dir):
    return find(_table(spark, sf_dir, "nation"), {"where": ("path", ["n_regionkey"], 2), "flat": True}, "n_nationkey")


@query("select n_nationkey as id, n_nationkey as k, n_name as name from nation where n_regionkey <> 2")
def j_wrapper(spark, sf_dir):
    found = find(_table(spark, sf_dir, "nation"), {"where": ("compare", ["n_regionkey"], "=/=", 2)}, "n_nationkey")
    return found.select("id", F.col("doc.n_nationkey").alias("k"), F.col("doc.n_name").alias("name"))


@query("select c_custkey as id from customer where c_acctbal < 0")
def j_ids_only(spark, sf_dir):
    return find(_table(spark, sf_dir, "customer"), {"where": ("compare", ["c_acctbal"], "<", 0), "include_docs": False}, "c_custkey")


@query("select o_orderkey as id, o_totalprice from orders where o_totalprice is not null order by o_totalprice desc, o_orderkey limit 50")
def o_topk(spark, sf_dir):
    return find(_table(spark, sf_dir, "orders"), {"where": ("exists", ["o_totalprice"]), "order_by": (["o_totalprice"], "desc"), "limit": 50, "select": [["o_totalprice"]], "include_docs": False}, "o_orderkey")


@query("select o_orderkey as id, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000 order by o_totalprice, o_orderkey limit 25")
def o_topk_filter(spark, sf_dir):
    where = [("path", ["o_orderstatus"], "F"), ("compare", ["o_totalprice"], ">", 1000)]
    return find(_table(spark, sf_dir, "orders"), {"where": where, "order_by": ["o_totalprice"], "limit": 25, "select": [["o_totalprice"]], "include_docs": False}, "o_orderkey")


@query("select o_orderkey as id, o_orderdate from orders where o_orderpriority = '2-HIGH' order by o_orderdate, o_orderkey limit 20 offset 100")
def o_offset(spark, sf_dir):
    return find(_table(spark, sf_dir, "orders"), {"where": ("path", ["o_orderpriority"], "2-HIGH"), "order_by": ["o_orderdate"], "offset": 100, "limit": 20, "select": [["o_orderdate"]], "include_docs": False}, "o_orderkey")


@query("select event_id as id, value from events where event_type = 'purchase' order by value desc nulls last, event_id limit 40")
def o_desc(spark, sf_dir):
    return find(_table(spark, sf_dir, "events"), {"where": ("path", ["event_type"], "purchase"), "order_by": (["value"], "desc"), "limit": 40, "select": [["value"]], "include_docs": False}, "event_id")


_PAGED = {"where": ("compare", ["value"], ">", 50), "select": [["value"]], "include_docs": False}


@query("select event_id as id, value from events where value > 50 order by event_id limit 100")
def page_first(spark, sf_dir):
    return find_page(_table(spark, sf_dir, "events"), _PAGED, 100, None, "event_id").rows


@query("select event_id as id, value from events where value > 50 order by event_id limit 100 offset 100")
def page_next(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return find_page(events, _PAGED, 100, find_page(events, _PAGED, 100, None, "event_id").token, "event_id").rows


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").withColumnRenamed("c_name", "id")


@query("select c_name as id, c_custkey from customer where starts_with(c_name, 'Customer#00000001')")
def id_prefix(spark, sf_dir):
    return find(_named(spark, sf_dir), {"id_prefix": "Customer#00000001", "select": [["c_custkey"]], "include_docs": False}, "id")


@query("select c_name as id, c_custkey from customer where c_name >= 'Customer#000000100' and c_name < 'Customer#000000180'")
def id_range(spark, sf_dir):
    return find(_named(spark, sf_dir), {"id_range": ("Customer#000000100", "Customer#000000180"), "select": [["c_custkey"]], "include_docs": False}, "id")


@query("select c_name as id, c_custkey from customer where c_name >= 'Customer#000000900'")
def id_range_open(spark, sf_dir):
    return find(_named(spark, sf_dir), {"id_range": ("Customer#000000900", None), "select": [["c_custkey"]], "include_docs": False}, "id")


@query("select p.pos::int as pos, p.id as c_custkey, c.c_name, c.c_custkey is not null as found from (values (0, 5), (1, -1), (2, 17), (3, 2), (4, 99999999)) p(pos, id) left join customer c on c.c_custkey = p.id")
def get_docs(spark, sf_dir):
    return get_many(_table(spark, sf_dir, "customer"), [5, -1, 17, 2, 99999999], "c_custkey").select("pos", "c_custkey", "c_name", "found")


# --- VARIANT bodies: the same conditions over schemaless documents ---

_JSON = "select event_id as id, json_object('type', event_type, 'user', user_id, 'value', value, 'props', json(props)) as body from events"


def _variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents: a VARIANT body with type, user, value and the nested props."""
    events = _table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"value":'), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit(',"props":'), F.coalesce("props", F.lit("{}")), F.lit("}"))
    return events.select(F.col("event_id").alias("id"), F.parse_json(text).alias("body"))


@query("select event_id as id, cast(json_extract(props, '$.k') as bigint) as k from events where event_type = 'click' and cast(json_extract(props, '$.k') as bigint) < 10")
def v_nested(spark, sf_dir):
    where = [("path", ["type"], "click"), ("compare", ["props", "k"], "<", 10)]
    return find(_variant(spark, sf_dir), {"where": where, "select": [["props", "k"]], "include_docs": False}, "id", "body").select("id", F.try_variant_get("props/k", "$", "bigint").alias("k"))


@query("select event_id as id from events where not coalesce(event_type in ('click', 'view') or value > 20, false)")
def v_not_or(spark, sf_dir):
    return find(_variant(spark, sf_dir), {"where": ("not", ("or", [("in", ["type"], ["click", "view"]), ("compare", ["value"], ">", 20)])), "include_docs": False}, "id", "body")


@query("select event_id as id from events where json_extract(props, '$.k') is null or user_id = 3")
def v_missing_or_eq(spark, sf_dir):
    return find(_variant(spark, sf_dir), {"where": ("or", [("missing", ["props", "k"]), ("path", ["user"], 3)]), "include_docs": False}, "id", "body")


# --- paths ---

_NATION_PATHS = "(select n_nationkey::varchar as id, 'n_name' as path, n_name as value, 'text' as kind from nation where n_name is not null union all select n_nationkey::varchar, 'n_regionkey', n_regionkey::varchar, 'int' from nation where n_regionkey is not null)"


def _nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flatten_typed(_table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string")), "n_nationkey")


_EVENT_PATHS = """(
  select event_id as id, 'event_type' as path, event_type as value, 'text' as kind from events union all
  select event_id, 'user_id', user_id::varchar, 'int' from events union all
  select event_id, 'props/k', json_extract_string(props, '$.k'), 'int' from events where json_extract_string(props, '$.k') is not null
)"""


def _event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flatten_typed(_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.from_json("props", "k bigint").alias("props")), "event_id")


@query(f"select * from {_EVENT_PATHS}")
def paths_flatten(spark, sf_dir):
    return _event_paths(spark, sf_dir).select("id", F.concat_ws("/", "path").alias("path"), "value", "kind")


@query("select event_id as id, 'k' as path, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def paths_flatten_json(spark, sf_dir):
    return P.flatten_json(_table(spark, sf_dir, "events"), "event_id", F.col("props")).select("id", F.concat_ws("/", "path").alias("path"), "value")


@query("select event_id as id, 'value/' || regexp_replace(printf('%.10f', value), '(\\.\\d+?)0+$', '\\1') as topic from events where value is not null")
def paths_topics(spark, sf_dir):
    return P.flatten_typed(_table(spark, sf_dir, "events"), "event_id", ["value"]).select("id", "topic")


@query(f"select id, unnest([path, path || '/' || value]) as prefix from {_NATION_PATHS}")
def paths_prefixes(spark, sf_dir):
    return _nation_paths(spark, sf_dir).select("id", F.explode(prefixes(F.col("topic"))).alias("prefix"))


@query(f"select path, value, count(distinct id) as n_docs from {_EVENT_PATHS} group by path, value")
def paths_cardinality(spark, sf_dir):
    return P.cardinality(_event_paths(spark, sf_dir))


@query("select distinct n_nationkey::varchar as id, unnest(['n_regionkey/' || n_regionkey, 'n_regionkey/' || (n_regionkey + 1)]) as topic, unnest(['removed', 'added']) as change from nation where n_nationkey % 2 = 0")
def paths_diff(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    moved = nation.withColumn("n_regionkey", F.when(F.col("n_nationkey").cast("int") % 2 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")))
    return P.path_diff(P.flatten_typed(nation, "n_nationkey"), P.flatten_typed(moved, "n_nationkey"))


@query(f"select path, (row_number() over (order by path) - 1)::int as path_id from (select distinct path from {_EVENT_PATHS})")
def path_ids(spark, sf_dir):
    return P.path_dictionary(_event_paths(spark, sf_dir))


@query(f"select id, path, value from {_EVENT_PATHS} where path = 'props/k' and value = '42'")
def paths_under(spark, sf_dir):
    return P.under(_event_paths(spark, sf_dir).filter("value = '42'"), ["props"]).select("id", F.concat_ws("/", "path").alias("path"), "value")


@query("select distinct event_id as id from events where event_type = 'signup'")
def postings(spark, sf_dir):
    return P.postings(_event_paths(spark, sf_dir), ["event_type"], "signup")


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _event_paths(spark, sf_dir)
    return P.postings(rows, ["event_type"], "signup"), P.postings(rows, ["props", "k"], prefix="1")


_A, _B = "event_type = 'signup'", "starts_with(json_extract_string(props, '$.k'), '1')"


@query(f"select event_id as id from events where {_A} and {_B}")
def posting_intersect(spark, sf_dir):
    return P.intersection(*_two(spark, sf_dir))


@query(f"select event_id as id from events where {_A} or {_B}")
def posting_union(spark, sf_dir):
    return P.union(*_two(spark, sf_dir))


@query(f"select event_id as id from events where {_A} and not coalesce({_B}, false)")
def posting_difference(spark, sf_dir):
    return P.difference(*_two(spark, sf_dir))


@query(f"select count(*) as n from events where {_A} and {_B}")
def posting_intersect_count(spark, sf_dir):
    return P.intersection(*_two(spark, sf_dir)).agg(F.count("*").alias("n"))


# --- changes: events as a log; a user is a document, an event a change of it ---


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = _table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("id"), F.concat(F.lit("1-"), F.col("event_id").cast("string")).alias("rev"), (F.col("event_type") == "signup").alias("deleted"), stamp(wall, F.col("event_id")).alias("hlc"), "event_type", "value", F.from_json("props", "k bigint").alias("props"))


_LOG = """with log as (select user_id as id, '1-' || event_id as rev, event_type = 'signup' as deleted, epoch_us(ts) as wall, event_id as logical, event_type, value, cast(json_extract(props, '$.k') as bigint) as k from events),
last as (select * from (select *, row_number() over (partition by id order by wall desc, logical desc) as rn from log) where rn = 1), rows as (select id, wall, logical, rev, deleted, event_type, k, value from last)
"""
_OUT = "select id, wall, logical, rev, deleted from rows"
_SINCE = Stamp(1_705_000_000_000_000, 0)


def _changes(df: DataFrame) -> DataFrame:
    return df.select("id", "hlc.wall", "hlc.logical", "rev", "deleted")


@query(_LOG + "select id, wall, logical, rev, deleted, event_type, value, k from rows")
def changes_latest_per_doc(spark, sf_dir):
    return C.changes(_log(spark, sf_dir), include_docs=True).select("id", "hlc.wall", "hlc.logical", "rev", "deleted", "event_type", "value", F.col("props.k").alias("k"))


@query(_LOG + _OUT + f" where wall > {_SINCE.wall}")
def changes_since(spark, sf_dir):
    return _changes(C.changes(_log(spark, sf_dir), _SINCE))


@query(_LOG + _OUT + " where id in (1, 5, 9, 1000000)")
def changes_doc_ids(spark, sf_dir):
    return _changes(C.changes(_log(spark, sf_dir), doc_ids=[1, 5, 9, 1000000]))


@query(_LOG + _OUT + " where not deleted and event_type = 'click'")
def changes_path(spark, sf_dir):
    return _changes(C.changes(_log(spark, sf_dir), paths=["event_type/click"]))


@query(_LOG + _OUT + " where not deleted and (event_type = 'view' or k between 10 and 19)")
def changes_multi_path(spark, sf_dir):
    ten = [f"props/k/{i}" for i in range(10, 20)]
    return _changes(C.changes(_log(spark, sf_dir), paths=["event_type/view", *ten]))


@query(_LOG + _OUT + " where not deleted and value > 30")
def changes_query(spark, sf_dir):
    return _changes(C.changes(_log(spark, sf_dir), query=[("compare", ["value"], ">", 30)]))


@query(_LOG + _OUT + " where not deleted and k is not null and event_type <> 'view'")
def changes_path_and_query(spark, sf_dir):
    return _changes(C.changes(_log(spark, sf_dir), paths=["props/#"], query=[("compare", ["event_type"], "=/=", "view")]))


@query(_LOG + _OUT + " order by wall desc, logical desc limit 10")
def changes_desc_limit(spark, sf_dir):
    return _changes(C.changes(_log(spark, sf_dir), descending=True, limit=10))


@query(_LOG + _OUT + " order by wall, logical limit 30 offset 30")
def changes_second_page(spark, sf_dir):
    log = _log(spark, sf_dir)
    return _changes(C.changes_page(log, C.changes_page(log, size=30).token, 30).rows)


@query(_LOG + f"select count(distinct id) as n from log where wall > {_SINCE.wall} or wall = {_SINCE.wall} and logical > {_SINCE.logical}")
def changes_count(spark, sf_dir):
    return spark.range(1).select(F.lit(C.count_since(_log(spark, sf_dir), _SINCE)).cast("long").alias("n"))


@query(_LOG + "select wall, logical, lpad(printf('%X', wall), 16, '0') || lpad(printf('%X', logical), 8, '0') as seq from log order by wall desc, logical desc limit 1")
def last_seq(spark, sf_dir):
    return C.last_seq(_log(spark, sf_dir)).select("hlc.wall", "hlc.logical", F.hex("seq").alias("seq"))


@query("select user_id as id, '1-' || event_id as rev from events where event_type <> 'signup' and json_extract_string(props, '$.k') is not null")
def sub_path_plus(spark, sf_dir):
    return path_events(_log(spark, sf_dir), "props/+/+", None).select("id", "rev")


@query("select user_id as id, '1-' || event_id as rev from events where event_type in ('click', 'view')")
def sub_path_hash(spark, sf_dir):
    return path_events(_log(spark, sf_dir), ["event_type/click/#", "event_type/view"], None).select("id", "rev")


@query("select user_id as id, '1-' || event_id as rev from events where event_type <> 'signup' and event_type = 'error' and value >= 5")
def sub_query(spark, sf_dir):
    return query_events(_log(spark, sf_dir), {"where": [("path", ["event_type"], "error"), ("compare", ["value"], ">=", 5)]}, None).select("id", "rev")


# --- revision trees: a customer is a document, its n-th order a revision whose parent is the (n div 2)-th ---

_REVS = """with recursive own as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
named as (select o_custkey as doc_id, n, (length(bin(n)) || '-' || lpad(o_orderkey::varchar, 10, '0')) as rev, o_orderstatus = 'F' as deleted from own),
nodes as (select a.doc_id, a.n, a.rev, b.rev as parent, a.deleted, length(bin(a.n))::int as gen from named a left join named b on a.doc_id = b.doc_id and a.n // 2 = b.n),
leaf as (select * from nodes a where not exists (select 1 from nodes b where b.doc_id = a.doc_id and b.parent = a.rev)),
won as (select doc_id, rev, deleted from (select *, row_number() over (partition by doc_id order by gen desc, rev desc) as rn from leaf) where rn = 1)
"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = _table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    named = own.select(F.col("o_custkey").alias("doc_id"), "n", F.concat(F.length(F.bin("n")).cast("string"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("rev"), (F.col("o_orderstatus") == "F").alias("deleted"))
    above = named.select("doc_id", F.col("n").alias("up"), F.col("rev").alias("parent"))
    return named.withColumn("up", F.shiftright("n", 1)).join(above, ["doc_id", "up"], "left").select("doc_id", "rev", "parent", "deleted")


def _checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder for local runs; on a cluster spark.checkpoint.dir names it."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-checkpoint-"))


@query(_REVS + "select doc_id, rev, deleted from leaf")
def rev_leaves(spark, sf_dir):
    return revtree.leaves(_nodes(spark, sf_dir)).select("doc_id", "rev", "deleted")


@query(_REVS + "select doc_id, rev, deleted from won")
def rev_winner(spark, sf_dir):
    return revtree.winners(_nodes(spark, sf_dir))


@query(_REVS + "select doc_id, rev from leaf where not deleted and (doc_id, rev) not in (select doc_id, rev from won)")
def rev_conflicts(spark, sf_dir):
    return revtree.conflicts(_nodes(spark, sf_dir))


@query(_REVS + ", walk as (select doc_id, rev as start, rev, 0 as dist from won union all select w.doc_id, w.start, n.parent, w.dist + 1 from walk w join nodes n on n.doc_id = w.doc_id and n.rev = w.rev where n.parent is not null) select doc_id, start, rev, dist::int as dist from walk")
def rev_history(spark, sf_dir):
    _checkpoints(spark)
    nodes = _nodes(spark, sf_dir)
    return revtree.history(nodes, revtree.winners(nodes))


@query(
    _REVS
    + ", walk as (select doc_id, rev, parent, 0 as dist from leaf union all select n.doc_id, n.rev, n.parent, w.dist + 1 from walk w join nodes n on n.doc_id = w.doc_id and n.rev = w.parent where w.dist < 1), keep as (select distinct doc_id, rev from walk) select n.doc_id, n.rev, k.rev as parent, n.deleted from nodes n join keep o on o.doc_id = n.doc_id and o.rev = n.rev left join keep k on k.doc_id = n.doc_id and k.rev = n.parent"
)
def rev_prune(spark, sf_dir):
    _checkpoints(spark)
    return revtree.prune(_nodes(spark, sf_dir), 2)


@query("select doc_id, gen, count(*) as n from (" + _REVS + "select doc_id, gen from nodes) group by doc_id, gen")
def rev_generations(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("doc_id", generation(F.col("rev")).alias("gen")).agg(F.count("*").alias("n"))


@query(
    _REVS
    + ", theirs as (select * from nodes where not deleted), missing as (select doc_id, rev, gen from nodes where deleted) select m.doc_id, m.rev, coalesce(string_agg(t.rev, ',' order by t.rev) filter (t.gen < m.gen), '') as ancestors from missing m left join theirs t on t.doc_id = m.doc_id group by m.doc_id, m.rev"
)
def revs_diff(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return revtree.revs_diff(nodes, nodes.filter(~F.col("deleted"))).select("doc_id", "rev", F.array_join("possible_ancestors", ",").alias("ancestors"))


_HLC = "epoch_us(ts)"


@query(f"select event_id, lpad(printf('%X', {_HLC}), 16, '0') || lpad(printf('%X', event_id), 8, '0') as raw, {_HLC} || ':' || event_id as shown from events")
def hlc_encode(spark, sf_dir):
    return _log(spark, sf_dir).select(F.col("hlc.logical").alias("event_id"), F.hex(encoded(F.col("hlc"))).alias("raw"), shown(F.col("hlc")).alias("shown"))


@query(f"select event_id, case when {_HLC} < {_SINCE.wall} or ({_HLC} = {_SINCE.wall} and event_id < 0) then -1 when {_HLC} > {_SINCE.wall} or event_id > 0 then 1 else 0 end::int as c from events")
def hlc_compare(spark, sf_dir):
    from .functions.hlc import literal

    return _log(spark, sf_dir).select(F.col("hlc.logical").alias("event_id"), order(F.col("hlc"), literal(_SINCE)).cast("int").alias("c"))


from . import store_queries  # noqa: E402, F401 - it adds its own queries
