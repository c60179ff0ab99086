"""Mixing and URL rules: their SQL on odd tables, and what the contracts promise."""

import random
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafmill.llm import url_cascade as U
from leafmill.llm.mixing import mix_sources, source_targets
from leafmill.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import EDGES, clashing, docs, write
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_mixing", "op7_url_filters"])
def test_oracle(spark, name):
    same(spark, SF, QUERIES[name], ORACLE[name])


def test_mixing_against_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [*EDGES[:5], *EDGES[6:], *((100 + i, "w " * int(rng.paretovariate(0.8)), rng.choice(["hot"] * 9 + ["a", "b", "c", "é", None])) for i in range(400))]
    same(spark, write(tmp_path, rows), QUERIES["op3_mixing"], ORACLE["op3_mixing"])


def test_mixing_meets_its_targets_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 60), s) for i, s in enumerate(["big"] * 700 + ["mid"] * 90 + ["tiny"] * 5)]
    got = mix_sources(clashing(docs(spark, rows))).collect()
    assert all(r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size for r in got)
    for s in ("big", "mid", "tiny"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and own[0].target <= 3 * own[0].source_size
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs(spark, rows)).collect()))


def test_mixing_edges(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    got = mix_sources(docs(spark, [(1, None, None), (2, "", None), (None, " ", "a")])).collect()
    assert len(got) == 3 and all(r.taken == 0 and r.size == 0 for r in got)


@pytest.mark.parametrize("kind", ["even", "spread", "doubling", "zeros"])
def test_targets_of_many_sources(spark, kind):
    """Against a plain fill from the smallest cap / weight up, in fractions; sources that double in size cap one after another."""
    rng = random.Random(5)
    size = {"even": lambda i: 100, "spread": lambda i: int(rng.paretovariate(0.5)), "doubling": lambda i: 2**i, "zeros": lambda i: 0}[kind]
    rows = [(None if i == 0 else f"s{i:04d}", size(i)) for i in range(40 if kind == "doubling" else 400)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {r[0]: i % 3 + 1 for i, r in enumerate(order)}
    left, free, want = Fraction(sum(s for _, s in rows)), sum(weight.values()), {}
    for name, s in sorted(rows, key=lambda r: Fraction(3 * r[1], weight[r[0]])):
        want[name] = min(Fraction(3 * s), left * weight[name] / free)
        left, free = left - want[name], free - weight[name]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, source_size long"), (1, 2, 3), 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(float(v), rel=1e-12) for k, v in want.items())
    assert sum(got.values()) == pytest.approx(sum(s for _, s in rows))


URLS = [
    None, "", "no scheme", "http://", "http://COM/en/", "https://a.com/en/x", "https://example.com/en/7", "https://x.Example.COM/en/77?q#f", "ftp://example.com/en/6", "http://net/de/", "http://example.net/de/8", "http://example.net/de/9", "http://notexample.net/de/8", "http://o.org/es/#x",
    "http://o.org?/es/", "://org/es/a", "http://org./es/", "http://a..com/en/", "a://b://c.com/en/", "http://exam ple.com/en/7", "http://com/EN/", "http://org/es", "http://é.org/es/ü", "http://xcom/en/", "http://com\n/en/",
]


def test_urls_against_sql(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array([*range(len(URLS)), 0, None], pa.int64()), "url": pa.array([*URLS, None, URLS[5]], pa.string()), "html": [""] * (len(URLS) + 2), "host": ["clash"] * (len(URLS) + 2)}), f"{tmp_path}/pages.parquet")
    same(spark, str(tmp_path), QUERIES["op7_url_filters"], ORACLE["op7_url_filters"])


def test_urls_stay_in_the_jvm_without_a_join(spark):
    plan = QUERIES["op7_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_cascade_is_exact(spark):
    rng = random.Random(8)
    keys = [f"k{i}" for i in range(3000)]
    listed = set(rng.sample(keys, 300)) | {"absent"}
    universe = spark.createDataFrame([(k,) for k in keys + keys[:50]], "key string")
    levels = U.cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    assert len(levels) > 1
    got = universe.distinct().filter(U.member(levels, F.col("key"))).collect()
    assert {r.key for r in got} == listed - {"absent"}
    assert U.cascade(spark.createDataFrame([], "key string"), universe) == []


def test_large_lists_stay_out_of_plans_and_of_the_driver(spark, monkeypatch):
    """A million listed keys; the filters are run-time values, so that the plan's text does not grow with the list."""
    listed = spark.range(1_000_000).select(F.concat(F.lit("h"), "id").alias("key"))
    universe = spark.range(900_000, 1_100_000).select(F.concat(F.lit("h"), "id").alias("key"))
    levels = U.cascade(listed, universe)
    got = universe.select(F.substring("key", 2, 20).cast("long").alias("i"), U.member(levels, F.col("key")).alias("m"))
    assert got.filter(F.col("m") != (F.col("i") < 1_000_000)).isEmpty()
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    monkeypatch.setattr(U, "MAX_BITS", 1 << 10)
    with pytest.raises(ValueError, match="the most"):
        U.cascade(listed, universe)


def test_rules_as_a_table_and_long_urls(spark):
    rules = spark.createDataFrame([("block", f"h{i}.org", "/a/") for i in range(3000)] + [("allow", "x.h7.org", "/a/b"), ("block", "", "/z")], "verdict string, host string, path string")
    long = "http://a.h7.org/a/" + "p" * 500_000
    urls = [(1, long), (2, "http://x.h7.org/a/b" + "q" * 100_000), (3, "http://h2999.org/a/?x"), (4, "http://h3000.org/a/"), (5, "http://h7.org/b/"), (1, long)]
    got = sorted((r.page_id, r.rule, r.verdict) for r in U.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect() if r.rule or r.page_id > 3)
    assert got == [(1, "h7.org/a/", "block"), (1, "h7.org/a/", "block"), (2, "x.h7.org/a/b", "allow"), (3, "h2999.org/a/", "block"), (4, None, "allow"), (5, None, "allow")]
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
