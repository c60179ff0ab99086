"""Topics, values, clock, revisions, paths and trees, on small fixed cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import revs as R
from leafmill.functions import values as V
from leafmill.functions.hlc import Clock, Stamp, decoded, encoded, parsed, shown, stamp
from leafmill.functions.topics import body_matches, topic_matches
from leafmill.operators import paths as P
from leafmill.operators import revtree as T
from leafmill.plans.conditions import QueryError


@pytest.mark.parametrize(
    ("pattern", "topic", "want"),
    [
        ("users/123", "users/123", True), ("users/+/profile", "users/123/profile", True), ("users/+/profile", "users/123/settings", False), ("users/+/profile", "users/1/2/profile", False), ("orders/#", "orders/1/total/5", True),
        ("orders/#", "order", False), ("#", "a/b", True), ("+", "a/b", False), ("a.b", "axb", False), ("a(b", "a(b", True),
    ],
)
def test_patterns(pattern, topic, want):
    assert topic_matches(pattern, topic) is want


@pytest.mark.parametrize("bad", ["", "a/#/b", "a+", "b#", None])
def test_bad_patterns(bad):
    with pytest.raises(QueryError, match="invalid_pattern"):
        topic_matches(bad, "a")


DOCS = [{"type": "user", "n": 1.0, "tags": ["x", {"k": True}]}, {"a": {"b": {"c": None}}, "e": {}, "l": []}, {"type": "a/b", "n": 7}, {}]
PATTERNS = ["type/user", "type/+", "type/#", "n/1.0", "n/7", "tags/+", "tags/0/x", "tags/1/k/true", "tags/+/k/+", "a/#", "a/+/c/null", "a/b/c", "e/#", "l/#", "#", "+/+", "none/#"]


def test_columns_match_as_flattened_topics_do(spark):
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "id int, j string").withColumn("body", F.parse_json("j"))
    got = table.orderBy("id").select(*(body_matches(p, table.schema, body="body").alias(p) for p in PATTERNS)).collect()
    for d, row in zip(DOCS, got, strict=True):
        topics = ["/".join([*path, v]) for path, v, _ in P.leaf_paths(d)]
        for p in PATTERNS:
            if p in ("type/+", "+/+", "n/1.0"):  # a "/" inside a value is a level only where levels are cut from the topic; VARIANT shows 1.0 as 1
                continue
            assert row[p] == any(topic_matches(p, t) for t in topics), (p, d)


def test_typed_columns_match_as_flattened_topics_do(spark):
    row = spark.sql("select 1 as id, 'user' as type, 2.5D as n, named_struct('b', array(1, 2)) as a, map('k', 'v') as m, cast(null as string) as z")
    topics = [r.topic for r in P.flatten_typed(row, "id").collect()]
    assert sorted(topics) == ["a/b/0/1", "a/b/1/2", "m/k/v", "n/2.5", "type/user"]
    for p in ["type/user", "type/x", "n/2.5", "a/b/+/2", "a/#", "a/b/1/+", "m/k/v", "m/+/+", "z/#", "z/+", "#", "a/b/7/#"]:
        cols = [c for c in row.columns if c != "id"]
        assert row.select(body_matches(p, row.schema, cols).alias("m")).first().m == any(topic_matches(p, t) for t in topics), p


def test_leaf_paths():
    assert P.leaf_paths({}) == [] and P.leaf_paths({"a": {}, "b": []}) == []
    assert P.leaf_paths({"items": [{"sku": "ABC"}], "t": [True, None, 1, 1.5, "s"]}) == [
        (["items", "0", "sku"], "ABC", "text"), (["t", "0"], "true", "bool"), (["t", "1"], "null", "null"), (["t", "2"], "1", "int"), (["t", "3"], "1.5", "float"), (["t", "4"], "s", "text"),
    ]


def test_flatten_json_and_sets(spark):
    d = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": 1}'), (3, "no json"), (4, None)], "id int, j string")
    flat = P.flatten_json(d, "id", F.col("j"))
    assert {(r.id, r.topic) for r in flat.collect()} == {(1, "a/1"), (1, "b/x"), (2, "a/1")}
    a, b = P.postings(flat, ["a"], "1"), P.postings(flat, ["b"])
    assert [r.id for r in P.intersection(a, b).collect()] == [1] and [r.id for r in P.difference(a, b).collect()] == [2] and P.union(a, b).count() == 2
    assert P.doc_paths(flat, 1).count() == 2


def test_clock():
    t = iter([10, 10, 5, 20, 20, 20])
    c = Clock(lambda: next(t), max_skew=100)
    assert [c.now(), c.now(), c.now()] == [Stamp(10), Stamp(10, 1), Stamp(10, 2)] and c.now() == Stamp(20)
    assert c.sync(Stamp(50, 3)) == Stamp(50, 4) and c.peek() == Stamp(50, 4)
    with pytest.raises(QueryError, match="clock_skew"):
        c.sync(Stamp(1000))
    assert Stamp.decode(Stamp(5, 6).encode()) == Stamp(5, 6) and Stamp.parse("5:6") == Stamp(5, 6)
    for bad in (lambda: Stamp.decode(b"x"), lambda: Stamp.parse("5")):
        with pytest.raises(QueryError, match="invalid_hlc"):
            bad()


def test_stamps_as_columns(spark):
    s = Stamp(1_700_000_000_123_456, 77)
    row = spark.range(1).select(stamp(F.lit(s.wall), F.lit(s.logical)).alias("h")).select("h", encoded(F.col("h")).alias("e")).select("h", "e", decoded(F.col("e")).alias("d"), parsed(shown(F.col("h"))).alias("p")).first()
    assert bytes(row.e) == s.encode() and row.d == row.h == row.p


def test_revisions(spark):
    assert R.parse_rev("12-ab") == (12, "ab") and R.compare_revs("2-a", "10-a") == -1
    with pytest.raises(QueryError, match="invalid_rev"):
        R.parse_rev("x-1")
    h = ["3-c", "2-b", "1-a"]
    assert R.parse_revisions(R.encode_revisions(h)) == h and R.trim_history(h, {"2-b"}, 9) == ["3-c", "2-b"] and R.trim_history(h, set(), 1) == ["3-c"]
    body = {"b": [1, "é"], "a": None}
    got = spark.createDataFrame([(R.canonical(body), "4-x", False)], "b string, p string, d boolean").select(R.rev_of(F.col("b"), F.col("p"), F.col("d")).alias("r")).first().r
    assert got == R.next_rev(body, "4-x") and got.startswith("5-")


def test_values(spark):
    one = lambda c: json.loads(spark.range(1).select(F.to_json(c).alias("j")).first().j)
    doc = F.parse_json(F.lit('{"a": 1, "_x": 2, "b": {"c": "d"}}'))
    assert one(V.without_meta(doc)) == {"a": 1, "b": {"c": "d"}} and one(V.remove(doc, "a")) == {"_x": 2, "b": {"c": "d"}}
    assert one(V.set_key(doc, "a", F.parse_json(F.lit("[1]"))))["a"] == [1] and one(V.merge(doc, F.parse_json(F.lit('{"a": 5, "z": 6}')))) == {"a": 5, "_x": 2, "b": {"c": "d"}, "z": 6}
    row = spark.range(1).select(V.get(doc, ["b", "c"], "string").alias("g"), V.get(doc, ["q"], "int", 9).alias("d"), V.is_key(doc, ["b"]).alias("k"), V.size(doc).alias("n"), V.keys(doc).alias("ks")).first()
    assert (row.g, row.d, row.k, row.n, row.ks) == ("d", 9, True, 3, ["_x", "a", "b"])
    d = {"a": {"b": [1, 2]}}
    assert V.doc_get(d, ["a", "b", 1]) == 2 and V.doc_set(d, ["a", "c"], 3) == {"a": {"b": [1, 2], "c": 3}} and V.doc_remove(d, ["a", "b", 0]) == {"a": {"b": [2]}}
    assert V.doc_take(d, ["a"]) == ({"b": [1, 2]}, {}) and V.doc_update(d, ["n"], lambda x: x or 1)["n"] == 1 and d == {"a": {"b": [1, 2]}}
    assert V.make_record({"id": "q", "_rev": "1-a", "x": 1}) == {"id": "q", "rev": "1-a", "deleted": False, "body": '{"x": 1}'}


def brute(nodes):
    """Leaves, winner, conflicts and ways to the root of one document's tree {rev: (parent, deleted)}."""
    leaf = set(nodes) - {p for p, _ in nodes.values()}
    won = max(leaf, key=R.parse_rev)
    way, at = [], won
    while at in nodes:
        way.append(at)
        at = nodes[at][0]
    return leaf, won, {r for r in leaf if r != won and not nodes[r][1]}, way


def test_trees_against_brute_force(spark):
    rng, trees = random.Random(4), {}
    for d in range(12):
        nodes = {"1-0": (None, False)}
        for i in range(rng.randrange(14)):
            p = rng.choice(list(nodes))
            nodes[f"{R.parse_rev(p)[0] + 1}-{i}{d}"] = (p, rng.random() < 0.3)
        trees[d] = nodes
    table = spark.createDataFrame([(d, r, p, x) for d, t in trees.items() for r, (p, x) in t.items()], "doc_id int, rev string, parent string, deleted boolean")
    by = lambda df: {d: {r.rev for r in df.filter(F.col("doc_id") == d).collect()} for d in (0, 5, 11)}
    leaf, won, conf = by(T.leaves(table)), by(T.winners(table)), by(T.conflicts(table))
    ways = T.history(table, T.winners(table))
    for d in (0, 5, 11):
        a, b, c, w = brute(trees[d])
        assert (leaf[d], won[d], conf[d]) == (a, {b}, c)
        assert [r.rev for r in ways.filter(F.col("doc_id") == d).orderBy("dist").collect()] == w
    pruned = {(r.doc_id, r.rev): r.parent for r in T.prune(table, 2).collect()}
    for d, t in trees.items():
        keep = {x for r in brute(t)[0] for x in (r, t[r][0]) if x}
        assert {r: (t[r][0] if t[r][0] in keep else None) for r in keep} == {r: p for (e, r), p in pruned.items() if e == d}
    with pytest.raises(QueryError, match="invalid_depth"):
        T.prune(table, 0)
