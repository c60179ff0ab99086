"""Conditions over schemaless documents: fixed cases, errors, and columns against the plain-Python meaning."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.operators.find import find, find_page, get_many
from leafmill.operators.predicate import Variant, to_column
from leafmill.plans.conditions import QueryError, matches, normalise, path_patterns
from leafmill.plans.query import compile_query, explain

SIX = [
    {"id": "user1", "type": "user", "name": "Alice", "age": 30, "status": "active", "org": "org1"},
    {"id": "user2", "type": "user", "name": "Bob", "age": 25, "status": "active", "org": "org1"},
    {"id": "user3", "type": "user", "name": "Charlie", "age": 35, "status": "inactive", "org": "org2"},
    {"id": "post1", "type": "post", "title": "Hello", "author": "user1", "tags": ["intro", "welcome"]},
    {"id": "post2", "type": "post", "title": "World", "author": "user2"},
    {"id": "nested1", "type": "nested", "profile": {"name": "N", "address": {"city": "Paris"}}},
]
FIVE = [{"id": str(i), "n": i, "size": i * 100, "mb": True, "sub": f"Hello World {i}"} for i in range(1, 6)]


def docs(spark, rows):
    return spark.createDataFrame([(r["id"], json.dumps(r)) for r in rows], "id string, j string").select("id", F.parse_json("j").alias("body"))


def ids(spark, rows, where, **spec):
    return [r.id for r in find(docs(spark, rows), {"where": where, "include_docs": False, **spec}, "id", "body").orderBy("id").collect()]


USER = ("path", ["type"], "user")
CASES = [
    ([USER], "user1 user2 user3"),
    ([USER, ("compare", ["age"], "<", 30)], "user2"),
    ([USER, ("in", ["org"], ["org1"])], "user1 user2"),
    ([("or", [USER, ("path", ["type"], "post")])], "post1 post2 user1 user2 user3"),
    ([("path", ["type"], "post"), ("exists", ["tags"])], "post1"),
    ([("path", ["type"], "post"), ("missing", ["tags"])], "post2"),
    ([USER, ("prefix", ["name"], "A")], "user1"),
    ([USER, ("regex", ["name"], "^[AB].*")], "user1 user2"),
    ([USER, ("path", ["org"], "org1"), ("path", ["status"], "nonexistent")], ""),
    ([("path", ["profile", "address", "city"], "Paris")], "nested1"),
    ([("path", ["tags", 0], "intro")], "post1"),
    ([("contains", ["tags"], "welcome")], "post1"),
    ([("not", ("exists", ["type"]))], ""),
    ([("not", ("compare", ["age"], ">", 26))], "nested1 post1 post2 user2"),
    ([("and", [])], "nested1 post1 post2 user1 user2 user3"),
    ([("or", [])], ""),
]


@pytest.mark.parametrize(("where", "want"), CASES)
def test_six(spark, where, want):
    assert ids(spark, SIX, where) == want.split()
    assert sorted(d["id"] for d in SIX if matches(d, normalise(where)) is not None) == want.split()


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ([("compare", ["n"], ">=", 2)], "2 3 4 5"), ([("compare", ["n"], ">=", 2), ("compare", ["n"], "<", 4)], "2 3"), ([("path", ["mb"], True), ("compare", ["n"], ">=", 2), ("compare", ["size"], "=<", 300)], "2 3"),
        ([("prefix", ["sub"], "Hello")], "1 2 3 4 5"), ([("prefix", ["sub"], "Hello"), ("compare", ["n"], ">=", 3)], "3 4 5"),
    ],
)
def test_numbers(spark, where, want):
    assert ids(spark, FIVE, where) == want.split()


def test_variables_order_and_shape(spark):
    found = find(docs(spark, SIX), {"where": [USER, ("path", ["name"], "?Name"), ("path", ["org"], "?Org")], "select": ["?Name", "?Org"], "order_by": "?Name", "include_docs": False}, "id", "body")
    assert [r["?Name"] for r in found.select(F.to_json("?Name").alias("?Name")).collect()] == ['"Alice"', '"Bob"', '"Charlie"']
    two = find(docs(spark, SIX), {"where": USER, "offset": 1, "limit": 2, "include_docs": False}, "id", "body")
    assert [r.id for r in two.collect()] == ["user2", "user3"]
    down = find(docs(spark, SIX), {"where": USER, "order_by": (["age"], "desc"), "include_docs": False}, "id", "body")
    assert [r.id for r in down.collect()] == ["user3", "user1", "user2"]
    assert find(docs(spark, SIX), {"where": USER, "doc_format": "json"}, "id", "body").columns == ["id", "doc"]


def test_pages(spark):
    d = docs(spark, SIX)
    one = find_page(d, {"where": USER}, 2, None, "id", "body", "v1")
    assert one.has_more and [r.id for r in one.rows.orderBy("id").select("id").collect()] == ["user1", "user2"]
    two = find_page(d, {"where": USER}, 2, one.token, "id", "body", "v1")
    assert not two.has_more and [r.id for r in two.rows.select("id").collect()] == ["user3"]
    with pytest.raises(QueryError, match="cursor_expired"):
        find_page(d, {"where": USER}, 2, one.token, "id", "body", "v2")
    with pytest.raises(QueryError, match="cursor_not_found"):
        find_page(d, {"where": USER}, 2, "garbage", "id", "body", "v1")


def test_get_many(spark):
    rows = get_many(docs(spark, SIX), ["post2", "none", "user1"]).select("id", "found").collect()
    assert [(r.id, r.found) for r in rows] == [("post2", True), ("none", False), ("user1", True)]


@pytest.mark.parametrize(
    ("spec", "category"),
    [
        ({}, "missing_clause"), ({"where": [], "join": 1}, "invalid_clause"), ({"where": [("near", ["a"], 1)]}, "invalid_condition"), ({"where": [("compare", ["a"], "<>", 1)]}, "invalid_operator"), ({"where": [("path", [-1], 1)]}, "invalid_path"),
        ({"where": [("regex", ["a"], "(")]}, "invalid_regex"), ({"where": [("prefix", ["a"], 1)]}, "invalid_prefix"), ({"where": [("in", ["a"], 1)]}, "invalid_in_values"), ({"id_prefix": 3}, "invalid_id_scan"), ({"id_prefix": "a", "where": []}, "id_scan_with_where"),
        ({"where": [], "limit": 0}, "invalid_clause"), ({"where": [], "offset": -1}, "invalid_clause"),
    ],
)
def test_errors(spec, category):
    with pytest.raises(QueryError) as e:
        compile_query(spec)
    assert e.value.category == category


@pytest.mark.parametrize(("where", "want"), [([USER], "index_seek"), ([("compare", ["a"], ">", 1)], "index_scan"), ([USER, ("exists", ["b"])], "multi_index"), ([("not", USER)], "full_scan")])
def test_strategy(where, want):
    assert explain(compile_query({"where": where}))["strategy"] == want


def test_patterns_of_a_query():
    assert path_patterns(normalise([USER, ("or", [("exists", ["a", "b"]), ("not", USER)])])) == ["type/#", "a/b/#"]


scalar = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.5, 1.5, -2.25]), st.sampled_from(["", "a", "ab", "b", "é"]))
value = st.recursive(scalar, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.sampled_from("abc"), v, max_size=3)), max_leaves=6)
doc = st.dictionaries(st.sampled_from("abc"), value, max_size=3)
path = st.lists(st.one_of(st.sampled_from("abc"), st.integers(0, 2)), min_size=1, max_size=3)
leaf = st.one_of(
    st.tuples(st.just("path"), path, scalar), st.tuples(st.just("compare"), path, st.sampled_from([">", "<", ">=", "=<", "==", "=/="]), scalar), st.tuples(st.just("in"), path, st.lists(scalar, max_size=3)), st.tuples(st.just("contains"), path, scalar),
    st.tuples(st.sampled_from(["exists", "missing"]), path), st.tuples(st.just("prefix"), path, st.sampled_from(["", "a"])), st.tuples(st.just("regex"), path, st.sampled_from(["^a", "b$"])),
)
condition = st.recursive(leaf, lambda c: st.one_of(st.tuples(st.sampled_from(["and", "or"]), st.lists(c, max_size=3)), st.tuples(st.just("not"), c)), max_leaves=4)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(doc, min_size=1, max_size=12), st.lists(condition, min_size=1, max_size=6))
def test_columns_mean_what_python_means(spark, rows, conditions):
    """Several conditions at a time over several documents: a job each would take too long."""
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "id int, j string").select("id", F.parse_json("j").alias("body"))
    got = table.orderBy("id").select(*(F.coalesce(to_column(normalise([c]), Variant()), F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions))).collect()
    for i, c in enumerate(conditions):
        assert [r[f"c{i}"] for r in got] == [matches(d, normalise([c])) is not None for d in rows], c
