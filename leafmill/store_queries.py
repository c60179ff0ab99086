"""Driver queries of what keeps state or works on values: the store, replication, subscriptions, document values and the like.

Stores live below the checkpoint folder, which all executors share. A customer is a document; those whose key 3 divides were changed once, and then
those whose key 5 divides deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .functions.hlc import Clock, Stamp
from .functions.revs import encode_revisions, generation, parse_revisions, rev_of, trim_history
from .operators import changes as C
from .operators import paths as P
from .operators import revtree
from .operators.find import find
from .operators.joins import by_key
from .operators.operations import Metrics, with_timeout
from .operators.replication import Task, Tasks, put_in_sync, replicate, replication_id
from .plans.conditions import QueryError, matches, normalise
from .plans.query import compile_query, explain
from .queries import _LOG, _REVS, _checkpoints, _event_paths, _EVENT_PATHS, _log, _nodes, _table, _variant, query
from .sources.store import Databases, Store
from .streaming.feed import Subscriptions, in_batches, query_patterns


def _store(spark: SparkSession) -> Store:
    _checkpoints(spark)
    return Store(spark, f"{spark.sparkContext.getCheckpointDir()}/stores/{uuid.uuid4().hex}")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("k"), F.to_json(F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("seg"))).alias("body"))


def _lived(spark: SparkSession, sf_dir: str) -> Store:
    store, docs = _store(spark), _customers(spark, sf_dir)
    store.put_docs(docs.select("id", "body"))
    now = store.entities().select("id", "rev")
    moved = docs.filter("k % 3 = 0").join(by_key(now), "id").select("id", F.regexp_replace("body", r'"n":(\d+)', '"n":100$1').alias("body"), "rev")
    store.put_docs(moved)
    store.put_docs(docs.filter("k % 5 = 0").join(by_key(store.entities().select("id", "rev")), "id").select("id", F.lit("{}").alias("body"), "rev", F.lit(True).alias("deleted")))
    return store


_N = "case when c_custkey % 3 = 0 then ('100' || c_nationkey)::bigint else c_nationkey::bigint end"
_GEN = "(1 + (c_custkey % 3 = 0)::int + (c_custkey % 5 = 0)::int)::int"


def _shown(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.try_variant_get("body", "$.n", "bigint").alias("n"), F.try_variant_get("body", "$.seg", "string").alias("seg"), generation(F.col("rev")).alias("gen"))


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"select c_custkey::varchar as id, {_N} as n, c_mktsegment as seg, {_GEN} as gen from customer where c_custkey % 5 <> 0")
def store_docs(spark, sf_dir):
    return _shown(_lived(spark, sf_dir).docs())


@query("select c_custkey::varchar as id, c_nationkey::bigint as n, c_mktsegment as seg, 1::int as gen from customer")
def store_snapshot(spark, sf_dir):
    return _shown(_lived(spark, sf_dir).docs(as_of=1))


@query(f"select c_custkey::varchar as id, {_N} as n, c_mktsegment as seg, {_GEN} as gen from customer where c_custkey % 5 <> 0 and {_N} > 10")
def store_find(spark, sf_dir):
    store = _lived(spark, sf_dir)
    ids = store.find({"where": ("compare", ["n"], ">", 10), "include_docs": False}).select("id")
    return _shown(store.docs().join(by_key(ids), "id", "left_semi"))


@query(
    "select error, count(*) as n from (select unnest([null, case when c_custkey % 2 = 0 then 'conflict' end, 'conflict', 'not_found', 'invalid_doc']) as error, unnest([1, 2, 3, 4, 5]) as kind, c_custkey from customer) where kind <> 2 or c_custkey % 2 = 0 group by error"
)
def store_judged(spark, sf_dir):
    """A batch of new documents, some twice and equal, some with a revision that nobody has, deletions of what is not there, and bodies that are no JSON object."""
    docs = _customers(spark, sf_dir).select("id", "k", "body", F.lit(None).cast("string").alias("rev"), F.lit(False).alias("deleted"))
    other = lambda prefix, **c: docs.withColumns({"id": F.concat(F.lit(prefix), "id"), **c})
    batch = docs.union(docs.filter("k % 2 = 0")).union(other("r", rev=F.lit("7-0"))).union(other("d", deleted=F.lit(True))).union(other("x", body=F.lit("no json")))
    return _store(spark).put_docs(batch.drop("k")).groupBy("error").agg(F.count("*").alias("n"))


@query("select c_custkey::varchar as id, (c_custkey % 4 = 0)::bigint as num_conflicts, (1 + (c_custkey % 4 = 0)::int)::int as leaves, 2::int as gen from customer where c_custkey % 3 = 0")
def store_conflicts(spark, sf_dir):
    """Losing branches come in; the feed goes on to carry the winner, tells of conflicts and lists all leaves."""
    store, docs = _store(spark), _customers(spark, sf_dir).filter("k % 3 = 0")
    store.put_docs(docs.select("id", "body"))
    store.put_docs(docs.join(by_key(store.entities().select("id", "rev")), "id").select("id", F.lit('{"n":1}').alias("body"), "rev"))
    store.put_revs(docs.filter("k % 4 = 0").select(F.col("id").alias("doc_id"), F.lit("1-0").alias("rev"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("deleted"), "body"))
    rows = C.changes(store.log(), style="all_docs", revs=store.revisions(), body="body")
    return rows.select("id", F.col("num_conflicts").cast("long").alias("num_conflicts"), F.size("changes").alias("leaves"), generation(F.col("rev")).alias("gen"))


@query("select 1::int as before, 0::int as after, 9::int as v")
def store_resolve(spark, sf_dir):
    store = _store(spark)
    base = store.put({"id": "d", "v": 1})
    store.put({"id": "d", "v": 2, "_rev": base})
    store.put_rev("d", '{"v":9}', ["2-0", base])
    before = len(store.conflicts("d"))
    store.resolve("d", store.get("d")["rev"], choose="2-0")
    return store.docs().select(F.lit(before).alias("before"), F.lit(len(store.conflicts("d"))).alias("after"), F.try_variant_get("body", "$.v", "int").alias("v"))


@query(f"select c_custkey::varchar as id, {_GEN} as gen, c_custkey % 5 = 0 as deleted, 1::bigint as revs from customer")
def store_compact(spark, sf_dir):
    store = _lived(spark, sf_dir)
    store.compact(1)
    revs = store.revisions().groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("revs"))
    return C.changed(store.log(), body="body").select("id", generation(F.col("rev")).alias("gen"), "deleted").join(by_key(revs), "id")


@query(f"select p.pos::int as pos, p.id, c.n, c.n is not null as found from (values (0, '3'), (1, '5'), (2, 'none'), (3, '1')) p(pos, id) left join (select c_custkey::varchar as id, {_N} as n from customer where c_custkey % 5 <> 0) c on c.id = p.id")
def store_get_many(spark, sf_dir):
    return _lived(spark, sf_dir).get_many(["3", "5", "none", "1"]).select("pos", "id", F.try_variant_get("body", "$.n", "bigint").alias("n"), "found")


@query("select count(*) filter (c_custkey % 5 <> 0) as docs, count(*) filter (c_custkey % 5 = 0) as deleted, 3::bigint as batch from customer")
def store_usage(spark, sf_dir):
    info = _lived(spark, sf_dir).info()
    return _rows(spark, [(info["docs"], info["deleted"], info["batch"])], "docs long, deleted long, batch long")


@query(f"select count(*) as n, sum({_N})::bigint as total from customer where c_custkey % 5 <> 0")
def store_fold(spark, sf_dir):
    import json

    n, total = _lived(spark, sf_dir).fold(lambda r, acc: (acc[0] + 1, acc[1] + json.loads(r.json)["n"]), (0, 0), combine=lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return _rows(spark, [(n, total)], "n long, total long")


@query("select * from (values ('a', true), ('b', false)) t(name, open)")
def store_databases(spark, sf_dir):
    _checkpoints(spark)
    all_ = Databases(spark, f"{spark.sparkContext.getCheckpointDir()}/stores/{uuid.uuid4().hex}")
    all_.create("a").put({"id": "x"})
    all_.create("b")
    return _rows(spark, [(n, all_.open(n).snapshot() > 0) for n in all_.names()], "name string, open boolean")


@query("select r_name as name, length(r_name)::bigint as length, 'sha256-' || sha256(r_name) as digest from region")
def store_attachments(spark, sf_dir):
    store = _store(spark)
    for r in _table(spark, sf_dir, "region").select("r_name").collect():
        store.attachments.put("regions", r.r_name, r.r_name.encode())
    return store.attachments.table().select("name", "length", "digest")


@query("select 'local' as kind, 'r/' || r_regionkey as key, r_name as value from region where r_regionkey <> 1 union all select 'system', 's/0', 'x'")
def store_local_docs(spark, sf_dir):
    store = _store(spark)
    store.local.put_all({f"r/{r.r_regionkey}": r.r_name for r in _table(spark, sf_dir, "region").collect()})
    store.local.delete("r/1")
    store.system.put("s/0", "x")
    shown = lambda kv, kind: kv.table().select(F.lit(kind).alias("kind"), "key", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("value"))
    return shown(store.local, "local").union(shown(store.system, "system"))


# --- replication ---


@query(f"select c_custkey::varchar as id, {_GEN} as gen, c_custkey % 5 = 0 as deleted, 0::bigint as wrong from customer")
def rep_target_feed(spark, sf_dir):
    """The target's feed after a run, beside what differs from the source's."""
    a, b = _lived(spark, sf_dir), _store(spark)
    replicate(a, b, replication_id("a", "b"))
    feed = lambda s: C.changed(s.log(), body="body").select("id", "rev", "deleted")
    wrong = feed(a).join(by_key(feed(b)), ["id", "rev"], "left_anti").count()
    return feed(b).select("id", generation(F.col("rev")).alias("gen"), "deleted", F.lit(wrong).cast("long").alias("wrong"))


@query("select o_orderkey::varchar as id from orders where o_orderstatus = 'F' and o_totalprice > 200000 and o_orderkey not in (select o_orderkey from orders where o_orderpriority = '5-LOW')")
def replicate_filtered(spark, sf_dir):
    """What a run that is filtered by path and query copies to a target that holds the orders of low priority."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.to_json(F.struct("o_orderstatus", "o_totalprice")).alias("body"), "o_orderpriority")
    a, b = _store(spark), _store(spark)
    a.put_docs(orders.select("id", "body"))
    b.put_docs(orders.filter("o_orderpriority = '5-LOW'").select("id", "body"))
    replicate(a, b, "filtered", ["o_orderstatus/F"], [("compare", ["o_totalprice"], ">", 200000)])
    return b.docs().select("id").join(by_key(b.docs(as_of=1).select("id")), "id", "left_anti")


@query("select 0::int as run, count(*) as docs_read, count(*) as revs_written from customer union all select 1, count(*), count(*) from customer where c_custkey % 3 = 0 union all select 2, 0, 0")
def rep_checkpoints(spark, sf_dir):
    """A run, a run after changes, and one with nothing to do; each starts at the checkpoint of the one before."""
    a, b, docs, stats = _store(spark), _store(spark), _customers(spark, sf_dir), []
    a.put_docs(docs.select("id", "body"))
    for run in range(3):
        if run == 1:
            a.put_docs(docs.filter("k % 3 = 0").join(by_key(a.entities().select("id", "rev")), "id").select("id", F.lit("{}").alias("body"), "rev"))
        got = replicate(a, b, "r")
        stats.append((run, got["docs_read"], got["revs_written"]))
    return _rows(spark, stats, "run int, docs_read long, revs_written long")


@query("select 'done' as state, true as passed_over, count(*) + 1 as docs, 'c' as there from nation")
def rep_tasks(spark, sf_dir):
    """A task that is paused, resumed and run; then a write that waits for another target."""
    stores = {n: _store(spark) for n in "abc"}
    nation = _table(spark, sf_dir, "nation")
    stores["a"].put_docs(nation.select(F.col("n_nationkey").cast("string").alias("id"), F.to_json(F.struct("n_name")).alias("body")))
    tasks = Tasks(stores["a"].local, stores.__getitem__)
    tasks.add(Task("t", "a", "b"))
    tasks.pause("t")
    passed = tasks.run("t") is None
    tasks.resume("t")
    state = tasks.get("t").state
    _, there = put_in_sync(stores["a"], {"id": "late"}, {"c": stores["c"]}, "a", 1)
    return stores["c"].docs().agg(F.count("*").alias("docs")).select(F.lit(state).alias("state"), F.lit(passed).alias("passed_over"), "docs", F.lit(",".join(there)).alias("there"))


# --- changes and subscriptions ---


@query(_LOG + "select count(*) as n, max(id) as top from (select id from rows order by wall, logical limit 50)")
def changes_fold(spark, sf_dir):
    n, top = C.fold_changes(_log(spark, sf_dir), lambda r, acc: (acc[0] + 1 < 50, (acc[0] + 1, max(acc[1], r.id))), (0, -1))
    return _rows(spark, [(n, top)], "n long, top long")


_HUNDREDS = _LOG + ", total as (select count(*) as t from rows) select i::int as batch, least(100, t - 100 * i)::int as n from total, range(0, (select (t + 99) // 100 from total)) r(i)"


@query(_HUNDREDS)
def changes_pull(spark, sf_dir):
    log = _log(spark, sf_dir)
    return _rows(spark, [(i, len(b)) for i, b in enumerate(C.stream_changes(log, batch=100))], "batch int, n int")


@query(_HUNDREDS)
def sub_push(spark, sf_dir):
    seen: list[tuple[int, int]] = []
    in_batches(C.changed(_log(spark, sf_dir)), lambda rows, n: seen.append((n, len(rows))))
    return _rows(spark, seen, "batch int, n int")


@query("select c_custkey::varchar as id, c_mktsegment as seg, 2::int as topics, 1::bigint as times from customer where c_mktsegment = 'BUILDING' and c_custkey % 2 = 0")
def sub_stream(spark, sf_dir):
    """A subscription by path on a stream, before and after a compaction: each change is delivered once, with its topics."""
    store, docs, seen = _store(spark), _customers(spark, sf_dir).filter("k % 2 = 0"), []
    subs = Subscriptions(store, store.folder.path("subscriptions"))
    for rest in (0, 1):
        store.put_docs(docs.filter(F.col("k") % 4 == 2 * rest).select("id", "body"))
        for _ in range(2):
            subs.subscribe("s", "seg/BUILDING", lambda rows, _: seen.extend((r.id, sorted(r.paths)) for r in rows.collect()), once=True)
            subs.active["s"].awaitTermination()
            if subs.active["s"].exception():
                raise subs.active["s"].exception()
            store.compact()
    subs.close()
    return _rows(spark, [(i, p[1].split("/")[1], len(p)) for i, p in seen], "id string, seg string, topics int").groupBy("id", "seg", "topics").agg(F.count("*").alias("times"))


@query("select unnest(['a/b/#', 'c/#', 'd/0/#']) as pattern")
def sub_patterns(spark, sf_dir):
    spec = {"where": [("path", ["a", "b"], 1), ("or", [("exists", ["c"]), ("not", ("prefix", ["d", 0], "x"))]), ("missing", ["c"])]}
    return _rows(spark, [(p,) for p in query_patterns(spec)], "pattern string")


# --- values ---

_K = "cast(json_extract(props, '$.k') as bigint)"


@query(f"select event_id as id, event_type as type, {_K} as k, coalesce({_K}, -1) as k_or, {_K} is not null as has_k, false as has_z from events")
def val_get(spark, sf_dir):
    b = F.col("body")
    return _variant(spark, sf_dir).select("id", V.get(b, ["type"], "string").alias("type"), V.get(b, ["props", "k"], "bigint").alias("k"), V.get(b, ["props", "k"], "bigint", -1).alias("k_or"), V.is_key(b, ["props", "k"]).alias("has_k"), V.is_key(b, ["z"]).alias("has_z"))


@query("select event_id as id, 'props,type,user,value' as keys, 4::int as size, 4::int as n_values from events")
def val_keys(spark, sf_dir):
    b = F.col("body")
    return _variant(spark, sf_dir).select("id", F.array_join(V.keys(b), ",").alias("keys"), V.size(b).alias("size"), F.size(V.values(b)).alias("n_values"))


@query(f"select event_id as id, user_id + 1 as m, {_K} as k, 5::bigint as deep, event_type as type from events")
def val_set(spark, sf_dir):
    """A nested value is set beside others, objects on the way are made."""
    b = V.set_path(V.set_path(F.col("body"), ["props", "m"], F.to_variant_object(F.struct((F.try_variant_get("body", "$.user", "bigint") + 1).alias("x")))), ["new", "deep"], F.parse_json(F.lit("5")))
    return _variant(spark, sf_dir).select("id", b.alias("b")).select("id", F.try_variant_get("b", "$.props.m.x", "bigint").alias("m"), F.try_variant_get("b", "$.props.k", "bigint").alias("k"), F.try_variant_get("b", "$.new.deep", "bigint").alias("deep"), F.try_variant_get("b", "$.type", "string").alias("type"))


@query(f"select event_id as id, {_K} * 2 as k from events where {_K} is not null")
def val_update(spark, sf_dir):
    twice = lambda v: F.parse_json((F.try_variant_get(v, "$", "bigint") * 2).cast("string"))
    return _variant(spark, sf_dir).select("id", V.get(V.update_path(F.col("body"), ["props", "k"], twice), ["props", "k"], "bigint").alias("k")).filter("k is not null")


@query("select event_id as id, 'props,user,value' as removed, 'type,user' as filtered, 'new' as type, user_id as user from events")
def val_remove_filter_merge(spark, sf_dir):
    b = F.col("body")
    merged = V.merge(b, F.parse_json(F.lit('{"type":"new","x":1}')))
    return _variant(spark, sf_dir).select("id", F.array_join(V.keys(V.remove(b, "type")), ",").alias("removed"), F.array_join(V.keys(V.filter_keys(b, lambda k, _: k.isin("type", "user"))), ",").alias("filtered"), V.get(merged, ["type"], "string").alias("type"), V.get(merged, ["user"], "bigint").alias("user"))


@query("select event_id as id, 'props;type;user;value;' as folded, length(event_type)::int as mapped from events")
def val_fold_map(spark, sf_dir):
    b = F.col("body")
    sized = V.map_values(V.filter_keys(b, lambda k, _: k == "type"), lambda _, v: F.parse_json(F.length(F.try_variant_get(v, "$", "string")).cast("string")))
    return _variant(spark, sf_dir).select("id", V.fold(b, F.lit(""), lambda acc, k, _: F.concat(acc, k, F.lit(";"))).alias("folded"), V.get(sized, ["type"], "int").alias("mapped"))


@query("select n_nationkey as id, n_name as name, 'n' as keys, '{\"n\":\"' || n_name || '\"}' as json from nation")
def val_meta_json(spark, sf_dir):
    b = V.without_meta(F.parse_json(F.concat(F.lit('{"_rev":"1-x","n":"'), "n_name", F.lit('"}'))))
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), V.get(b, ["n"], "string").alias("name"), F.array_join(V.keys(b), ",").alias("keys"), F.to_json(b).alias("json"))


@query("select count(*) as n, 32::int as length from orders")
def val_generated_ids(spark, sf_dir):
    made = _table(spark, sf_dir, "orders").select(V.generate_id().alias("g"))
    return made.agg(F.count_distinct("g").alias("n"), F.max(F.length("g")).alias("length"))


@query("select n_nationkey::varchar as id, '1-p' as rev, n_nationkey % 2 = 0 as deleted, '{\"name\": \"' || n_name || '\"}' as body from nation")
def val_records(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").collect()
    made = [V.make_record({"id": str(r.n_nationkey), "name": r.n_name, "_rev": "1-p", "_deleted": r.n_nationkey % 2 == 0}) for r in rows]
    return _rows(spark, [(m["id"], m["rev"], m["deleted"], m["body"]) for m in made], "id string, rev string, deleted boolean, body string")


# --- queries without tables, in memory, and their shapes ---


@query("select unnest(['eq', 'range', 'both', 'not', 'prefix', 'ids']) as name, unnest(['index_seek', 'index_scan', 'multi_index', 'full_scan', 'index_scan', 'id_scan']) as strategy")
def explain_strategies(spark, sf_dir):
    eq, over = ("path", ["a"], 1), ("compare", ["b"], ">", 2)
    specs = {"eq": {"where": eq}, "range": {"where": over}, "both": {"where": [eq, over]}, "not": {"where": ("not", eq)}, "prefix": {"where": ("prefix", ["a"], "x")}, "ids": {"id_prefix": "x"}}
    return _rows(spark, [(n, explain(compile_query(s))["strategy"]) for n, s in specs.items()], "name string, strategy string")


@query("select unnest(['missing_clause', 'invalid_clause', 'invalid_operator', 'invalid_regex', 'invalid_in_values', 'invalid_path', 'id_scan_with_where', 'invalid_condition']) as category")
def spec_errors(spark, sf_dir):
    bad = [{}, {"where": ("exists", ["a"]), "limit": 0}, {"where": ("compare", ["a"], "<>", 1)}, {"where": ("regex", ["a"], "(")}, {"where": ("in", ["a"], 3)}, {"where": ("exists", [-1])}, {"where": ("exists", ["a"]), "id_prefix": "x"}, {"where": ("near", ["a"])}]
    found = []
    for spec in bad:
        try:
            compile_query(spec)
        except QueryError as e:
            found.append((e.category,))
    return _rows(spark, found, "category string")


@query("select n_nationkey as id, n_name as name from nation where n_regionkey in (1, 2) and not starts_with(n_name, 'C')")
def match_in_memory(spark, sf_dir):
    where = normalise([("in", ["r"], [1, 2]), ("not", ("prefix", ["name"], "C")), ("path", ["name"], "?Name")])
    rows = [(r.n_nationkey, m["?Name"]) for r in _table(spark, sf_dir, "nation").collect() if (m := matches({"r": int(r.n_regionkey), "name": r.n_name}, where)) is not None]
    return _rows(spark, rows, "id long, name string")


@query("select n_nationkey as id, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as json, length(n_name)::varchar as decoded from nation where n_regionkey = 3")
def doc_formats(spark, sf_dir):
    import json

    nation = _table(spark, sf_dir, "nation")
    spec = {"where": ("path", ["n_regionkey"], 3)}
    plain = find(nation, spec, "n_nationkey").select("id", F.to_json(F.struct("doc.n_nationkey", "doc.n_name")).alias("json"))
    decoded = find(nation, {**spec, "decoder_fun": lambda text: str(len(json.loads(text)["n_name"]))}, "n_nationkey").select("id", F.col("doc").alias("decoded"))
    return plain.join(decoded, "id")


@query("select unnest([0, 1, 2, 3, 4]) as step, unnest(['100:0', '100:1', '200:6', '200:7', 'clock_skew']) as stamp")
def clock_steps(spark, sf_dir):
    """now() twice in one microsecond, sync with a later stamp, now() again, and one that is too far ahead."""
    clock = Clock(lambda: 100, 1000)
    seen = [str(clock.now()), str(clock.now()), str(clock.sync(Stamp(200, 5))), str(clock.now())]
    assert str(clock.peek()) == seen[-1]
    try:
        clock.sync(Stamp(5000, 0))
    except QueryError as e:
        seen.append(e.category)
    return _rows(spark, list(enumerate(seen)), "step int, stamp string")


@query("select n_nationkey as id, '3-' || sha256('{\"n\":\"' || n_name || '\"}' || chr(10) || '2-x' || chr(10) || 'false') as rev from nation")
def rev_ids(spark, sf_dir):
    body = F.to_json(F.struct(F.col("n_name").alias("n")))
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), rev_of(body, F.lit("2-x"), F.lit(False)).alias("rev"))


@query(_REVS + "select doc_id, rev from nodes where gen = 2")
def rev_contains(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    wanted = nodes.filter(generation(F.col("rev")) == 2).select("doc_id", "rev")
    return revtree.contains(nodes, wanted.union(wanted.select("doc_id", F.concat("rev", F.lit("x")))))


@query("select 3::int as start, 'c,b,a' as ids, '3-c,2-b,1-a' as parsed, '3-c,2-b' as trimmed")
def rev_codec(spark, sf_dir):
    history = ["3-c", "2-b", "1-a"]
    packed = encode_revisions(history)
    return _rows(spark, [(packed["start"], ",".join(packed["ids"]), ",".join(parse_revisions(packed)), ",".join(trim_history(history, {"2-b"}, 10)))], "start int, ids string, parsed string, trimmed string")


@query("select 2::int as counted, 'timeout' as category")
def metrics_and_timeouts(spark, sf_dir):
    m, category = Metrics(), ""
    for _ in range(2):
        with m.timed("q"):
            spark.range(3).count()
    try:
        with_timeout(spark, lambda: spark.range(0, 10**13, 1, 2).filter("sqrt(id) < 0").count(), 0.5)
    except QueryError as e:
        category = e.category
    return _rows(spark, [(int(m.export()["q"]["count"]), category)], "counted int, category string")


@query("""
  select 'doc_operations' as name, 'counter' as kind, 'put' as label, 3::bigint as n
  union all select 'db_documents', 'gauge', '', count(*)::bigint from nation where n_regionkey = 2
  union all select 'query_operations', 'counter', '', 2::bigint
  union all select 'query_timeouts', 'counter', '', 1::bigint
  union all select 'query_results', 'histogram', '', 1::bigint
  union all select 'query_results', 'class 1', '', 0::bigint
  union all select 'query_results', 'class 10', '', count(*)::bigint * 0 + 1 from nation where n_regionkey = 2 having count(*) <= 10
  union all select 'replication_docs', 'counter', 'push', 7::bigint
  union all select 'replication_errors', 'counter', '', 1::bigint
  union all select 'replication_active', 'gauge', '', 0::bigint""")
def metrics_measured(spark, sf_dir):
    """Operations, queries, a query that takes too long, a run of a replication and one that fails."""
    store, m = _store(spark), Metrics()
    store.put_docs(_table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias("id"), F.lit("{}").alias("body")))
    for _ in range(3):
        with m.doc_operation("a", "put"):
            pass
    m.database("a", store.info(), 0)
    m.query(spark, "a", store.docs().select("id"), DataFrame.collect)
    try:
        m.query(spark, "a", spark.range(0, 10**13, 1, 2).filter("sqrt(id) < 0"), DataFrame.count, 0.5)
    except QueryError:
        pass
    with m.replication("t") as done:
        done({"docs_read": 7}, 0.5)
    try:
        with m.replication("t"):
            raise QueryError("db_unreachable", "b")
    except QueryError:
        pass
    rows = [(n, k, lab.get("operation") or lab.get("direction") or "", int(c)) for n, k, lab, c, _, _ in m.rows() if n not in ("query_seconds", "doc_operation_seconds", "db_bytes", "db_attachments", "replication_lag_seconds")]
    rows += [(n, f"class {b}", "", c) for n, _, _, _, _, by in m.rows() if n == "query_results" for b, c in by.items() if b <= 10]
    return _rows(spark, rows, "name string, kind string, label string, n long")


@query("select 'r/' || r_regionkey as key, r_name as value, 2::bigint as databases from region where r_regionkey <> 1")
def system_docs(spark, sf_dir):
    """System documents that all databases share; one is deleted; a fold by prefix in order of the keys."""
    _checkpoints(spark)
    all_ = Databases(spark, f"{spark.sparkContext.getCheckpointDir()}/stores/{uuid.uuid4().hex}")
    all_.create("a")
    all_.system.put_all({f"r/{r.r_regionkey}": r.r_name for r in _table(spark, sf_dir, "region").collect()})
    all_.create("b")
    all_.system.delete("r/1")
    all_.system.node_id()
    found = all_.system.fold("r/", lambda k, v, acc: [*acc, (k, v, len(all_.names()))], [])
    return _rows(spark, found, "key string, value string, databases long")


# --- the relation of paths ---


@query(f"select path, value, kind from {_EVENT_PATHS} where id = 7")
def paths_of_doc(spark, sf_dir):
    return P.doc_paths(_event_paths(spark, sf_dir), 7).select(F.concat_ws("/", "path").alias("path"), "value", "kind")


@query(f"select id, path, case when path = 'event_type' and id % 10 = 3 then 'changed' else value end as value from {_EVENT_PATHS} where id % 10 <> 4")
def paths_reindex(spark, sf_dir):
    """Of the documents one in ten changed and one in ten went."""
    own = _event_paths(spark, sf_dir)
    new = own.filter("id % 10 = 3").withColumn("value", F.when(F.concat_ws("/", "path") == "event_type", "changed").otherwise(F.col("value")))
    return P.reindex(own, new, own.filter("id % 10 in (3, 4)").select("id")).select("id", F.concat_ws("/", "path").alias("path"), "value")


@query(f"select distinct path, id from {_EVENT_PATHS} where value = '42'")
def paths_by_value(spark, sf_dir):
    return P.by_value(_event_paths(spark, sf_dir), "42").select(F.concat_ws("/", "path").alias("path"), "id")


@query(f"select path, value, count(distinct id) as n, min(id) as first, max(id) as last from {_EVENT_PATHS} group by path, value")
def posting_lists(spark, sf_dir):
    lists = P.posting_lists(_event_paths(spark, sf_dir))
    return lists.groupBy(F.concat_ws("/", "path").alias("path"), "value").agg(F.sum("n").cast("long").alias("n"), F.min(F.get("ids", F.lit(0))).alias("first"), F.max(F.element_at("ids", -1)).alias("last"))


@query(f"select path, value from {_EVENT_PATHS} where id = 11")
def posting_contains(spark, sf_dir):
    return P.list_contains(P.posting_lists(_event_paths(spark, sf_dir)), 11).select(F.concat_ws("/", "path").alias("path"), "value")


@query(f"select id, value from {_EVENT_PATHS} where path = 'props/k' and value::bigint >= 90")
def paths_fold_compare(spark, sf_dir):
    return P.fold_values(_event_paths(spark, sf_dir), ["props", "k"], ">=", 90, descending=True)


@query(f"select id, path, value from {_EVENT_PATHS} where path = 'props/k' order by value desc, id desc limit 50 offset 50")
def paths_chunk(spark, sf_dir):
    own = _event_paths(spark, sf_dir)
    last = P.under(own, ["props"], descending=True, size=50).collect()[-1]
    return P.under(own, ["props"], True, (list(last.path), last.value, last.id), 50).select("id", F.concat_ws("/", "path").alias("path"), "value")
