"""Every driver query of the engine against its SQL, and what must hold of plans."""

import pytest

from leafmill import queries as engine
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(engine.ORACLE))
def test_oracle(spark, name):
    same(spark, SF, engine.QUERIES[name], engine.ORACLE[name])


def test_entry_has_the_engine():
    import __spark_entry__ as e

    assert set(engine.QUERIES) <= set(e.queries()) and set(engine.ORACLE) <= set(e.oracle_sql())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "pushed"), [("p_eq", "EqualTo(o_orderstatus,F)"), ("p_gt", "GreaterThan(o_totalprice"), ("p_prefix", "StringStartsWith(p_name,red)"), ("p_in", "In(c_mktsegment")])
def test_filters_reach_the_scan(spark, name, pushed):
    plan = _plan(engine.QUERIES[name](spark, SF))
    assert pushed in plan and "Exchange" not in plan


def test_topk_is_no_full_sort(spark):
    assert "TakeOrderedAndProject" in _plan(engine.QUERIES["o_topk"](spark, SF))


def test_only_the_columns_asked_for_are_read(spark):
    schema = _plan(engine.QUERIES["j_ids_only"](spark, SF)).split("ReadSchema: ")[1].split(">")[0]
    assert schema == "struct<c_custkey:bigint,c_acctbal:double"


def _scan(df):
    return _plan(df).split("ReadSchema: ")[1].split("\n")[0]


def test_changes_read_no_column_they_do_not_need(spark):
    assert "value" not in _scan(engine.QUERIES["changes_since"](spark, SF)) and "props" not in _scan(engine.QUERIES["changes_since"](spark, SF))
    assert "props" not in _scan(engine.QUERIES["changes_query"](spark, SF))


def test_a_few_documents_move_no_table(spark):
    """Without automatic broadcasts: only the ids' side is broadcast, and the filter on ids reaches the scan."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(engine.QUERIES["get_docs"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "In(c_custkey" in plan


def test_trees_take_few_exchanges(spark):
    """Leaves are one aggregation; conflicts work them out once; missing revisions make no pairs; paths are numbered in ranges."""
    from leafmill.operators import paths, revtree

    nodes = spark.range(100).selectExpr("id % 7 as doc_id", "concat('2-', id) as rev", "cast(null as string) as parent", "false as deleted")
    assert _plan(revtree.leaves(nodes)).count("Exchange") == 1 and "Join" not in _plan(revtree.leaves(nodes))
    plan = revtree.conflicts(nodes)
    plan.collect()
    assert _plan(plan).split("Initial Plan")[0].count("Exchange hashpartitioning") <= 5
    assert _plan(revtree.revs_diff(nodes, nodes.filter("doc_id > 3"))).count("Join") == 2
    assert "SinglePartition" not in _plan(paths.path_dictionary(spark.range(50).selectExpr("id", "array(concat('p', id)) as path")))


def test_limits_without_an_order_may_end_early(spark):
    from leafmill.operators.find import find

    rows = spark.read.parquet(f"{SF}/orders.parquet")
    spec = {"where": ("path", ["o_orderstatus"], "F"), "limit": 5, "include_docs": False}
    assert "TakeOrdered" in _plan(find(rows, spec, "o_orderkey"))
    early = find(rows, spec, "o_orderkey", any_rows=True)
    assert "TakeOrdered" not in _plan(early) and "Exchange hash" not in _plan(early) and early.count() == 5
