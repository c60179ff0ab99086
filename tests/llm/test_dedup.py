"""Near and exact duplicates against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, near_dedup
from leafmill.llm.components import components
from leafmill.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import EDGES, clashing, docs, shingle_set, write
from tests.oracle import same


def brute(rows, k, num, den):
    """{doc_id: (set size, smallest doc_id reachable)} over all pairs."""
    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(shingle_set(r[1], k))
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: ({len(s) for s in sets[i]}, root(i)) for i in ids}


def corpus(seed, n_groups=25, size=8):
    """Groups of copies with a few words changed, around the threshold, plus short texts."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 90))]
        for _ in range(rng.randrange(1, size)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary).upper() if rng.random() < 0.3 else rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, (" " if rng.random() < 0.5 else "\n\t").join(t)))
    rng.shuffle(rows)
    return rows


def check_near(spark, rows, k, num, den, **more):
    want = brute(rows, k, num, den)
    got = near_dedup.near_duplicates(clashing(docs(spark, rows)), k, num, den, **more).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_those_of_brute_force(spark, seed):
    check_near(spark, corpus(seed), 3, 85, 100)


def test_large_buckets_lose_no_link(spark):
    """A group larger than what is paired directly: far-off copies of one text, some of which link among themselves alone."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for variant in range(12):
        own = list(base)
        for i in rng.sample(range(120), 4):
            own[i] = f"v{variant}x{i}"
        for copy in range(4):
            t = list(own)
            if copy:
                t[rng.randrange(120)] = f"c{variant}{copy}"
            rows.append((len(rows), " ".join(t)))
    check_near(spark, rows, 3, 85, 100)
    check_near(spark, rows, 5, 80, 100)


def test_near_edges(spark):
    rows = [(i, t) for i, t, _ in EDGES]
    check_near(spark, rows, 3, 85, 100)
    got = near_dedup.near_duplicates(docs(spark, [(None, "a b c"), (2, "a b c"), (1, "A  B\tC"), (None, None)])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("1", 1, True), ("2", 1, False), ("None", None, True), ("None", None, True)]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_sketch_fills_every_place_and_estimates():
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (1, 2, 7, 500, 5000):
        assert near_dedup.sketch(rng.integers(0, 2**63, n, dtype=np.uint64), 160).max() != np.iinfo(np.uint64).max
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    x, y = near_dedup.sketch(a[:2500], 400), near_dedup.sketch(a[500:], 400)
    assert abs((x == y).mean() - 2000 / 3000) < 0.1


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500)] + [(200, 200 + i) for i in range(1, 30)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_against_sql(spark, tmp_path):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n)) for n in (3, 40, 900, 6000)]
    rows = [*EDGES, *((20 + i, rng.choice([t, t.replace(" ", "\n"), t + " ", t[:-1]]), None) for i, t in enumerate(base * 6)), (None, "x", "n")]
    same(spark, write(tmp_path, rows), QUERIES["op2_exact_dedup"], ORACLE["op2_exact_dedup"])


def test_exact_edges(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    got = exact_dedup.exact_duplicates(clashing(docs(spark, [(2, "ab"), (1, "a b"), (3, None), (4, "\n")]))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(1, 1, 2, True), (2, 1, 2, False), (3, 4, 2, False), (4, 4, 2, True)]
    assert got[2].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_recipes_hold_whole_texts_and_survive_inserts():
    rng = random.Random(2)
    raw = bytes(rng.randrange(97, 123) for _ in range(60_000))
    ends = exact_dedup.cuts(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and (sizes[:-1] >= exact_dedup.MIN_CHUNK).all() and sizes.max() <= exact_dedup.MAX_CHUNK
    a, b = set(exact_dedup.recipe(raw)[0]), set(exact_dedup.recipe(raw[:30_000] + b"inserted" + raw[30_000:])[0])
    assert len(a & b) > 0.8 * len(a)
    assert exact_dedup.cuts(b"") == []


def test_an_identifier_of_two_contents_is_mended(spark, monkeypatch):
    """With identifiers of 3 bits, most chunks clash; texts must still be told apart."""
    real = exact_dedup.recipe

    def short(raw):
        ids, v1, v2 = real(raw)
        return [i & 7 for i in ids], v1, v2

    monkeypatch.setattr(exact_dedup, "recipe", short)
    rows = [(i, f"text {i % 40}") for i in range(80)]
    got = exact_dedup.exact_duplicates(docs(spark, rows)).agg(F.sum(F.col("kept").cast("int")), F.min("group_size"), F.max("group_size")).first()
    assert tuple(got) == (40, 2, 2)
