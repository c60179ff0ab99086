"""The pipeline: each stage against what its operator says, and the whole against the stages."""

import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from leafmill.llm.exact_dedup import exact_duplicates
from leafmill.llm.mixing import mix_sources
from leafmill.llm.near_dedup import near_duplicates
from leafmill.llm.toxicity import score_toxicity
from tests.llm.helpers import EDGES, docs, write
from tests.llm.test_dedup import brute

SF = "/root/testdata/sf0.001"


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_do_what_their_operators_say(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    want = {
        "toxicity": lambda x: Counter(r.doc_id for r in score_toxicity(x, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted == 0),
        "exact_dedup": lambda x: Counter(r.doc_id for r in exact_duplicates(x).collect() if r.kept),
        "near_dedup": lambda x: Counter(r.doc_id for r in near_duplicates(x, 5, 80, 100).collect() if r.kept),
        "mixing": lambda x: Counter({r.doc_id: r.copies for r in mix_sources(x).collect() if r.copies}),
    }
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        out = stage[name](spark, d, SF)
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert ids(kept) == want[name](d)
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in d.collect()]
            assert set(ids(kept)) == {i for i, (_, c) in brute(rows, 5, 80, 100).items() if i == c}
        d = kept
    last = stage["byte_bpe"](spark, d, SF).collect()
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assert Counter(r.doc_id for r in last) == ids(d) and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)
    whole = P.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_stages_bear_odd_and_empty_tables(spark, tmp_path):
    sf = write(tmp_path, [])
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), f"{tmp_path}/labels.parquet")
    assert P.run(spark, sf).count() == 0
    for name, stage in P.STAGES:
        assert stage(spark, docs(spark, [*EDGES, (None, "no id", None)]), sf).count() > 0, name


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names and "pipeline" not in e.oracle_sql()


@pytest.mark.parametrize("fold", [0])
def test_near_query_is_brute_force(spark, fold):
    table = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    from leafmill.llm.queries import QUERIES

    want = brute(rows, 3, 85, 100)
    for r in QUERIES["op1_minhash_near_dedup"](spark, SF).collect():
        assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1]
