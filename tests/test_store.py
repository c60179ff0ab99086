"""The store: writes with revision checks, conflicts, snapshots, changes, attachments, local documents, replication and live subscriptions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill.functions.hlc import FIRST
from leafmill.functions.revs import make_rev
from leafmill.operators import changes as C
from leafmill.operators import revtree
from leafmill.operators.operations import Metrics, observed, with_timeout
from leafmill.operators.replication import Task, Tasks, arrived, put_in_sync, replicate, replication_id, wait_for
from leafmill.plans.conditions import QueryError
from leafmill.queries import QUERIES
from leafmill.sources.store import Databases, Store
from leafmill.streaming.feed import Subscriptions, query_patterns
from leafmill.streaming.replication import follow


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def load(store, rows):
    return store.put_docs(store.spark.createDataFrame([(r["id"], json.dumps(r)) for r in rows], "id string, body string"))


def changed(store, **k):
    return [r.id for r in C.changes(store.log(), body="body", **k).collect()]


def test_put_get_update_delete(store):
    rev = store.put({"id": "a", "v": 1, "_secret": 2})
    assert rev.startswith("1-") and json.loads(store.get("a")["body"]) == {"v": 1}
    for bad in ({"id": "a", "v": 2}, {"id": "a", "v": 2, "_rev": "1-0"}):
        with pytest.raises(QueryError, match="conflict"):
            store.put(bad)
    rev2 = store.put({"id": "a", "v": 2, "_rev": rev})
    assert rev2.startswith("2-") and json.loads(store.get("a")["body"]) == {"v": 2}
    assert json.loads(store.get("a", rev=rev)["body"]) == {"v": 1}
    gone = store.delete("a")
    assert gone.startswith("3-") and store.get("a") is None and store.docs().isEmpty()
    again = store.put({"id": "a", "v": 3})
    assert again.startswith("4-") and store.get("a", conflicts=True)["conflicts"] == []
    assert store.info()["docs"] == 1


def test_batches_judge_each_document(store):
    first = {r.id: r for r in load(store, [{"id": "x", "v": 1}, {"id": "x", "v": 2}, {"id": "y"}]).collect() if r.ok}
    assert set(first) == {"x", "y"} and store.docs().count() == 2
    bad = store.put_docs(store.spark.createDataFrame([("z", "no json")], "id string, body string")).first()
    assert bad.error == "invalid_doc" and store.docs().count() == 2
    assert load(store, []).count() == 0


def test_snapshots_and_find(store):
    load(store, [{"id": "u1", "type": "user"}, {"id": "u2", "type": "user"}, {"id": "p", "type": "post"}])
    at = store.snapshot()
    load(store, [{"id": "u3", "type": "user"}])
    spec = {"where": ("path", ["type"], "user"), "include_docs": False}
    assert store.find(spec).count() == 3 and store.find(spec, as_of=at).count() == 2
    page = store.find_page(spec, 2)
    load(store, [{"id": "u4", "type": "user"}])
    with pytest.raises(QueryError, match="cursor_expired"):
        store.find_page(spec, 2, page.token)
    assert [(r.id, r.found) for r in store.get_many(["u3", "no"]).collect()] == [("u3", True), ("no", False)]
    assert store.fold(lambda r, acc: acc + 1, 0) == 5


def conflicted(store):
    base = store.put({"id": "d", "v": 1})
    store.put({"id": "d", "v": 2, "_rev": base})
    store.put_rev("d", '{"v": 9}', [make_rev(2, "0"), base])
    return store.get("d", conflicts=True)


def test_conflicts_and_their_ends(store):
    now = conflicted(store)
    assert now["conflicts"] == ["2-0"] and json.loads(now["body"]) == {"v": 2}
    with pytest.raises(QueryError, match="invalid_rev"):
        store.resolve("d", now["rev"], choose="2-f00")
    with pytest.raises(QueryError, match="conflict"):
        store.resolve("d", "1-x", choose="2-0")
    store.resolve("d", now["rev"], choose="2-0")
    after = store.get("d", conflicts=True)
    assert after["conflicts"] == [] and json.loads(after["body"]) == {"v": 9}
    with pytest.raises(QueryError, match="no_conflicts"):
        store.resolve("d", after["rev"], choose=after["rev"])
    with pytest.raises(QueryError, match="not_found"):
        store.resolve("none", "1-x", choose="1-x")


def test_merge_ends_a_conflict_and_compaction_keeps_it(store):
    now = conflicted(store)
    store.resolve("d", now["rev"], merged='{"v": 11}')
    assert json.loads(store.get("d")["body"]) == {"v": 11}
    store.compact(1)
    after = store.get("d", conflicts=True)
    assert json.loads(after["body"]) == {"v": 11} and after["conflicts"] == [] and store.snapshot() > 1
    with pytest.raises(QueryError, match="snapshot_expired"):
        store.revisions(1)
    assert [n for n in store.folder.names("revs")] == [f"base={store.snapshot():012d}"] and store.compact(1) == store.snapshot()


def test_changes_feed(store):
    load(store, [{"id": "doc1", "type": "user", "status": "active", "users": {"123": {"name": "A"}}}, {"id": "doc2", "type": "order", "total": 150}, {"id": "doc3", "type": "user", "status": "inactive"}])
    assert sorted(changed(store)) == ["doc1", "doc2", "doc3"]
    assert changed(store, paths=["type/user"], query=[("path", ["status"], "active")]) == ["doc1"]
    assert changed(store, paths=["users/#"]) == ["doc1"] and changed(store, paths=["users/+/name/+"]) == ["doc1"] and changed(store, paths=["users/123"]) == []
    assert changed(store, query=[("compare", ["total"], ">", 100)]) == ["doc2"] and changed(store, doc_ids=["doc3", "x"]) == ["doc3"]
    with pytest.raises(QueryError):
        changed(store, query=[("near", 1)])
    seq = C.last_seq(store.log()).first()
    assert len(bytes(seq.seq)) == 12
    page = C.changes_page(store.log(), FIRST, 2, body="body")
    assert page.has_more and page.rows.count() == 2
    rest = C.changes_page(store.log(), page.token, 2, body="body")
    assert not rest.has_more and rest.rows.count() == 1 and not C.has_since(store.log(), rest.last)
    store.delete("doc1")
    assert C.count_since(store.log(), rest.last) == 1 and changed(store)[-1] == "doc1"
    assert [len(b) for b in C.stream_changes(store.log(), batch=2)] == [2, 1]


def test_num_conflicts_and_style(store):
    conflicted(store)
    row = C.changes(store.log(), style="all_docs", revs=store.revisions(), body="body").first()
    assert row.num_conflicts == 1 and len(row.changes) == 2


def test_attachments(store):
    big = bytes(range(256)) * 700
    info = store.attachments.put("d", "a.bin", big)
    assert info["chunks"] == 3 and store.attachments.get("d", "a.bin") == big
    store.attachments.put("d", "b", b"")
    assert store.attachments.get("d", "b") == b"" and store.attachments.list("d") == ["a.bin", "b"]
    w = store.attachments.writer("d", "c")
    w.write(b"x")
    w.abort()
    store.attachments.put("d", "a.bin", b"new")
    store.attachments.delete("d", "b")
    assert store.attachments.get("d", "a.bin") == b"new" and store.attachments.list("d") == ["a.bin"]
    with pytest.raises(QueryError, match="not_found"):
        store.attachments.info("d", "b")


def test_local_documents(store):
    store.local.put_all({"a/1": {"x": 1}, "a/2": 2, "b": 3})
    store.local.delete("a/2")
    assert store.local.get("a/1") == {"x": 1} and store.local.get("a/2") is None
    assert store.local.fold("a/", lambda k, v, acc: [*acc, k], []) == ["a/1"]
    assert store.local.node_id() == store.local.node_id()


def test_databases(spark, tmp_path):
    d = Databases(spark, f"file://{tmp_path}")
    d.create("one").put({"id": "x"})
    assert d.names() == ["one"] and d.open("one").docs().count() == 1
    for bad in ("One", "", "a" * 64, "a/b"):
        with pytest.raises(QueryError, match="invalid_db_name"):
            d.create(bad)
    with pytest.raises(QueryError, match="already_exists"):
        d.create("one")
    d.delete("one")
    with pytest.raises(QueryError, match="not_found"):
        d.open("one")


def test_replication(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    load(a, [{"id": "u", "type": "user", "n": 1}, {"id": "o", "type": "order"}])
    rep = replication_id("a", "b")
    assert rep != replication_id("a", "b", ["type/user"])
    assert replicate(a, b, rep)["docs_read"] == 2 and arrived(a, b) and wait_for(a, b, 1)
    assert replicate(a, b, rep)["docs_read"] == 0
    a.put({"id": "u", "type": "user", "n": 2, "_rev": a.get("u")["rev"]})
    a.delete("o")
    assert replicate(a, b, rep)["revs_written"] == 2
    assert json.loads(b.get("u", conflicts=True)["body"])["n"] == 2 and b.get("u", conflicts=True)["conflicts"] == [] and b.get("o") is None


def test_filtered_tasks(spark, tmp_path):
    stores = {n: Store(spark, f"file://{tmp_path}/{n}") for n in "ab"}
    load(stores["a"], [{"id": "u", "type": "user", "n": 1}, {"id": "v", "type": "user", "n": 5}, {"id": "o", "type": "order", "n": 9}])
    tasks = Tasks(stores["a"].local, stores.__getitem__)
    tasks.add(Task("t", "a", "b", paths=["type/user"], query=[("compare", ["n"], ">", 2)]))
    tasks.pause("t")
    assert tasks.run("t") is None
    assert tasks.resume("t")["a -> b"]["docs_read"] == 1 and [r.id for r in stores["b"].docs().collect()] == ["v"]
    assert [t.state for t in tasks.list()] == ["done"] and tasks.restore() == []
    tasks.delete("t")
    with pytest.raises(QueryError, match="not_found"):
        tasks.get("t")


def test_continuous_replication_and_put_in_sync(spark, tmp_path):
    stores = {n: Store(spark, f"file://{tmp_path}/{n}") for n in "abc"}
    tasks = Tasks(stores["a"].local, stores.__getitem__)
    tasks.add(Task("both", "a", "b", direction="both", mode="continuous"))
    tasks.add(Task("once", "a", "b"))
    with pytest.raises(QueryError, match="invalid_task"):
        follow(tasks, "once", f"file://{tmp_path}/ck")
    load(stores["a"], [{"id": "x"}])
    load(stores["b"], [{"id": "y"}])
    for q in follow(tasks, "both", f"file://{tmp_path}/ck", once=True):
        q.awaitTermination(90)
        assert q.exception() is None
    assert all(sorted(r.id for r in stores[n].docs().collect()) == ["x", "y"] for n in "ab") and tasks.get("both").state == "running"
    rev, there = put_in_sync(stores["a"], {"id": "z"}, {"c": stores["c"]}, "a", 1)
    assert there == ["c"] and stores["c"].get("z")["rev"] == rev


def test_subscriptions(spark, tmp_path, store):
    seen = {"paths": [], "query": [], "push": []}
    subs = Subscriptions(store, f"file://{tmp_path}/ck")
    keep = lambda name: lambda rows, _: seen[name].extend(r.id for r in rows.collect())

    def go():
        subs.subscribe("paths", ["users/+/profile/#", "type/user"], keep("paths"), once=True)
        subs.subscribe_query("query", {"where": [("compare", ["n"], ">", 1)]}, keep("query"), once=True)
        subs.push("push", lambda rows, _: seen["push"].extend(r.id for r in rows), once=True)
        for q in subs.active.values():
            q.awaitTermination(60)
            assert q.exception() is None

    load(store, [{"id": "a", "users": {"1": {"profile": "x"}}, "type": "user", "n": 1}, {"id": "b", "n": 2}])
    go()
    assert (sorted(seen["paths"]), seen["query"], sorted(seen["push"])) == (["a"], ["b"], ["a", "b"])
    store.delete("b")
    load(store, [{"id": "c", "type": "user", "n": 7}])
    go()
    assert (sorted(seen["paths"]), sorted(seen["query"]), sorted(seen["push"])) == (["a", "c"], ["b", "c"], ["a", "b", "b", "c"])
    assert query_patterns({"where": [("path", ["a", "b"], 1)]}) == ["a/b/#"]
    with pytest.raises(QueryError, match="not_subscribed"):
        subs.unsubscribe("none")
    subs.close()


def test_operations(spark):
    with pytest.raises(QueryError, match="timeout"):
        with_timeout(spark, lambda: spark.range(0, 10**12, 1, 4).filter("sqrt(id) < 0").count(), 1.0)
    assert with_timeout(spark, lambda: spark.range(3).count(), 30) == 3
    m = Metrics()
    with m.timed("q"):
        df, seen = observed(spark.range(5), "five", top=F.max("id"))
        df.collect()
    assert seen.get == {"n": 5, "top": 4} and m.export()["q"]["count"] == 1


def test_metrics_by_labels():
    m = Metrics()
    m.inc("doc_operations", 3, db="a", operation="put")
    m.inc("doc_operations", db='b"\n', operation="put")
    for v in (0.02, 0.3, 99):
        m.observe("query_seconds", v, db="a")
    m.set("db_bytes", 7, db="a")
    m.set("db_bytes", 5, db="a")
    assert m.export()["doc_operations"]["count"] == 4 and m.export()["db_bytes"]["count"] == 5
    text = m.export_text().splitlines()
    assert 'doc_operations{db="a",operation="put"} 3' in text and r'doc_operations{db="b\"\n",operation="put"} 1' in text
    assert [int(x.rsplit(" ", 1)[1]) for x in text if x.startswith("query_seconds_bucket")] == [0, 1, 1, 1, 2, 2, 2, 2, 2, 3]
    assert 'query_seconds_count{db="a"} 3' in text and "# TYPE query_timeouts counter" in text
    assert len([x for x in text if x.startswith("# TYPE")]) == 13
    with pytest.raises(QueryError, match="invalid_metric"):
        m.inc("db_bytes")


def test_metrics_of_failures():
    m = Metrics()
    with pytest.raises(ValueError), m.doc_operation("a", "put"):
        raise ValueError
    with pytest.raises(ValueError), m.replication("t"):
        raise ValueError
    got = {n: c for n, _, _, c, _, _ in m.rows()}
    assert got["doc_operations"] == got["doc_operation_seconds"] == got["replication_errors"] == 1 and got["replication_active"] == 0


def test_system_documents_belong_to_all(spark, tmp_path):
    d = Databases(spark, f"file://{tmp_path}/all")
    d.create("a")
    node = d.system.node_id()
    assert Databases(spark, f"file://{tmp_path}/all").system.node_id() == node and d.names() == ["a"]
    for act in (d.create, d.open, d.delete):
        with pytest.raises(QueryError):
            act("_system")
    assert d.system.get("node_id") == node and d.open("a").local.get("node_id") is None


def test_the_feed_carries_the_winner(store):
    """A losing branch moves its document to the end of the feed, with the revision that still wins."""
    rev = store.put({"id": "d0", "v": 1})
    rev = store.put({"id": "d0", "v": 2, "_rev": rev})
    store.put({"id": "d1"})
    store.put_rev("d0", '{"v": 0}', ["1-00aa"])
    rows = C.changes(store.log(), body="body", include_docs=True).collect()
    assert [(r.id, r.rev) for r in rows][-1] == ("d0", rev) and json.loads(str(rows[-1].body)) == {"v": 2}
    assert store.conflicts("d0") == ["1-00aa"] and store.revisions().count() == 4
    store.put_rev("d0", '{"v": 9}', ["3-ff", rev])
    assert C.changes(store.log(), body="body").collect()[-1].rev == "3-ff" and store.conflicts("d0") == ["1-00aa"]
    before = store.snapshot()
    store.put_rev("d0", '{"v": 9}', ["3-ff", rev])
    assert C.count_since(store.log(), FIRST) == 2 and C.changes(store.log(before), body="body").collect() == C.changes(store.log(), body="body").collect()


def test_equal_rows_of_a_batch(store):
    got = load(store, [{"id": "dup", "v": 1}] * 3).collect()
    assert sorted((r.ok, r.error) for r in got) == [(False, "conflict"), (False, "conflict"), (True, None)] and store.revisions().count() == 1


def test_replication_of_long_histories(spark, tmp_path):
    """Twelve generations, a losing branch, partitions not coalesced: the target's feed shows what the source's does."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a, b = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
        history = [(f"d{d}", make_rev(g, f"{d}{g}"), make_rev(g - 1, f"{d}{g - 1}") if g > 1 else None, False, json.dumps({"g": g})) for d in range(8) for g in range(1, 13)]
        for upto in (4, 9, 12):
            a.put_revs(spark.createDataFrame([h for h in history if int(h[1].split("-")[0]) <= upto], "doc_id string, rev string, parent string, deleted boolean, body string"))
        a.put_rev("d3", '{"g": 0}', ["2-zz", "1-31"])
        assert replicate(a, b, "r")["revs_written"] == 97
        feed = lambda s: {r.id: r.rev for r in C.changes(s.log(), body="body").collect()}
        assert feed(a) == feed(b) == {f"d{d}": f"12-{d}12" for d in range(8)} and b.conflicts("d3") == ["2-zz"]
        a.compact(3)
        assert feed(a) == feed(b) and a.revisions().groupBy("doc_id").count().filter("doc_id <> 'd3' and count <> 3").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_streams_deliver_once_over_compactions(spark, tmp_path, store):
    """Before, over and after a compaction; one that was away during it gets what it missed, once."""
    seen = {"near": [], "far": []}
    subs = Subscriptions(store, f"file://{tmp_path}/ck")

    def go(*names):
        for n in names:
            subs.push(n, lambda rows, _, n=n: seen[n].extend(r.id for r in rows), once=True)
            subs.active[n].awaitTermination(90)
            assert subs.active[n].exception() is None

    load(store, [{"id": f"a{i}"} for i in range(25)])
    go("near", "far")
    load(store, [{"id": f"b{i}"} for i in range(5)])
    go("near")
    store.put({"id": "a0", "v": 2, "_rev": store.get("a0")["rev"]})
    store.compact()
    go("near", "far")
    go("near", "far")
    load(store, [{"id": "c"}])
    go("near", "far")
    assert sorted(seen["near"]) == sorted([*(f"a{i}" for i in range(25)), *(f"b{i}" for i in range(5)), "a0", "c"]) == sorted(seen["far"])
    fresh = []
    subs.push("new", lambda rows, _: fresh.extend(r.id for r in rows), once=True)
    subs.active["new"].awaitTermination(90)
    assert len(fresh) == len(set(fresh)) == 31


def test_push_batches_and_payload(spark, tmp_path, store):
    from concurrent.futures import ThreadPoolExecutor

    from leafmill.streaming.feed import in_batches, path_events

    load(store, [{"id": f"d{i:03d}", "a": {"b": i}, "t": ["x", "y"]} for i in range(250)])
    sizes, order, open_now, most = [], [], [], []
    log = store.log().select("id", "rev", "hlc", "deleted")
    with ThreadPoolExecutor(8) as pool:

        def deliver(rows, n):
            open_now.append(n)
            most.append(len(open_now))
            sizes.append(len(rows))
            order.extend(r.hlc for r in rows)
            return pool.submit(lambda: open_now.remove(n))

        assert in_batches(log, deliver, 100) == 3 and in_batches(log, deliver, 10, 5) == 25
    assert sizes[:3] == [100, 100, 50] and order[:250] == sorted(order[:250]) and max(most) <= 5
    with pytest.raises(ZeroDivisionError), ThreadPoolExecutor(1) as pool:
        in_batches(log, lambda rows, n: pool.submit(lambda: 1 // 0), 100)
    events = path_events(store.log(), "a/b/7").collect()
    assert [(r.id, sorted(r.paths)) for r in events] == [("d007", ["a/b/7", "id/d007", "t/0/x", "t/1/y"])]


def test_local_documents_compact_and_system_documents(store):
    store.local.put_all({"a": 1, "b": 2})
    store.local.delete("b")
    store.local.compact()
    store.local.put("c", 3)
    assert store.local.get("a") == 1 and store.local.get("b") is None and store.local.fold("", lambda k, v, acc: [*acc, k], []) == ["a", "c"]
    store.system.put("a", "system")
    assert store.local.get("a") == 1 and store.system.get("a") == "system" and store.docs().isEmpty()


def test_pulling_reads_the_log_once_and_loses_no_equal_stamps(spark, monkeypatch):
    log = spark.range(7).selectExpr("id", "concat('1-', id) as rev", "false as deleted", "named_struct('wall', if(id < 2, id, 5L), 'logical', 0L) as hlc")
    runs, plain = [], C.changes
    monkeypatch.setattr(C, "changes", lambda *a, **k: runs.append(a) or plain(*a, **k))
    got = list(C.stream_changes(log, batch=2))
    assert [len(b) for b in got] == [2, 2, 2, 1] and sorted(r.id for b in got for r in b) == list(range(7))
    assert [r.id for r in got[0]] == [0, 1] and len(runs) == 1
    assert list(C.stream_changes(log.filter("id > 9"))) == []
    with pytest.raises(QueryError, match="invalid_clause"):
        next(C.stream_changes(log, batch=0))


def broadcasts(spark, run):
    """How many of the executions of run broadcast a table."""
    bus, seen = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = {seen.executionsList().apply(i).executionId() for i in range(seen.executionsList().size())}
    run()
    bus.waitUntilEmpty()
    all_ = [seen.executionsList().apply(i) for i in range(seen.executionsList().size())]
    new = [x.physicalPlanDescription() for x in all_ if x.executionId() not in before]
    assert new
    return sum("BroadcastExchange" in x for x in new)


def many(spark, n=600):
    return spark.range(n).selectExpr("cast(id as string) as id", "concat('{\"n\":', id, '}') as body")


def test_writes_and_folds_send_no_table_to_the_driver(spark, store):
    store.put_docs(many(spark))
    moved = store.entities().selectExpr("id", "'{}' as body", "rev").filter("cast(id as int) >= 50")
    assert broadcasts(spark, lambda: store.put_docs(moved)) == 0
    assert sorted(store.entities().groupBy(F.substring("rev", 1, 1).alias("g")).count().collect()) == [("1", 50), ("2", 550)]
    by_row = store.fold(lambda r, acc: acc + json.loads(r.json).get("n", 0), 0)
    n, total, where = store.fold(lambda r, acc: (acc[0] + 1, acc[1] + json.loads(r.json).get("n", 0), acc[2] | {os.getpid()}), (0, 0, frozenset()), combine=lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] | b[2]))
    assert (n, total) == (600, by_row) == (600, sum(range(50))) and os.getpid() not in where

    assert store.fold(lambda r, acc: acc + 1, 0, combine=lambda a, b: a + b) == 600


def test_a_fold_by_tasks_over_nothing(store):
    assert store.fold(lambda r, acc: acc + 1, 0, combine=lambda a, b: a + b) == 0


def test_compaction_and_pruning_send_no_table_to_the_driver(spark, store):
    store.put_docs(many(spark, 300))
    store.put_docs(store.entities().selectExpr("id", "'{}' as body", "rev").filter("cast(id as int) >= 50"))
    assert broadcasts(spark, lambda: revtree.prune(store.revisions(), 3).collect()) == 0
    assert broadcasts(spark, lambda: store.compact(1)) == 0
    rows = store.revisions().collect()
    assert len(rows) == 300 and sum(r.rev.startswith("2-") for r in rows) == 250 and all(r.parent is None and r.body and r.hlc for r in rows)


@pytest.mark.parametrize("name", ["store_find", "rep_target_feed", "store_conflicts"])
def test_whole_stores_send_no_table_to_the_driver(spark, name):
    assert broadcasts(spark, lambda: QUERIES[name](spark, "/root/testdata/sf0.001").collect()) == 0
