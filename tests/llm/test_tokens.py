"""Byte-level BPE and token counts against the tokenizer library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as T
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from leafmill.llm import bpe, token_counts
from leafmill.llm.pretokens import pretokens
from leafmill.llm.queries import QUERIES
from tests.llm.helpers import EDGES, clashing, docs

PATH = T.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def agrees(encoding, texts, rows):
    """texts and rows in one order."""
    for t, r in zip(texts, rows, strict=True):
        ids = encoding.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def odd_texts():
    rng = random.Random(9)
    letters = "abcXYZ '\"'s't're've'm'll'd  \t\n\r\x0b\x1c\x1f\x85\u00a0\u2003\u200b\u0301éßñ123²Ⅷ٣中文日本한글🙂👩‍👩‍👧.,;!?-_#@\x00\U000e0041"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + ["don't we'll 'sit 're''ve it's'm", "'", "''s", " 's", "a'sb", "<|endoftext|>", "x" * 3000, "\n" * 50 + "a"]


def test_matches_are_those_of_the_pattern():
    import regex

    pattern = regex.compile(T.PATTERN)
    texts = odd_texts()
    raw = [t.encode() for t in texts]
    starts, match_of = pretokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    whole = b"".join(raw)
    for i, t in enumerate(texts):
        got = [whole[a:b].decode() for a, b in zip(starts[match_of[i] : match_of[i + 1]], starts[match_of[i] + 1 : match_of[i + 1] + 1], strict=True)]
        # the tokenizer library's \s leaves out \x1c to \x1f; texts with them are compared through it below
        if not any("\x1c" <= c <= "\x1f" for c in t):
            assert got == pattern.findall(t), t


def test_encode_decode_on_odd_texts(spark, encoding):
    texts = [*odd_texts(), *(t for _, t, _ in EDGES)]
    got = bpe.encode_decode(clashing(docs(spark, list(enumerate(texts)))), PATH).orderBy("doc_id").collect()
    agrees(encoding, texts, got)


def test_small_dictionaries_and_ids(spark, encoding):
    texts = ["the cat and the dog and the cat", "the", None, "zzzzqqq " * 40]
    got = bpe.encode_decode(docs(spark, list(enumerate(texts))), PATH, ids=True, decoded=True, hot_words=3).orderBy("doc_id").collect()
    agrees(encoding, texts, got)
    assert [r.ids for r in got] == [encoding.encode_ordinary(t or "") for t in texts] and [bytes(r.decoded).decode() for r in got] == [t or "" for t in texts]
    assert bpe.encode_decode(docs(spark, []), PATH).count() == 0


def test_query_on_its_table(spark, encoding):
    table = pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id")
    agrees(encoding, table["text"].to_pylist(), QUERIES["op10_byte_bpe"](spark, SF).orderBy("doc_id").collect())


def test_fold_and_plain_merges_agree(spark, encoding):
    tokens = bpe.load_ranks(PATH)
    ranks = {t: i for i, t in enumerate(tokens)}
    words = [" the", "a", "", "antidisestablishmentarianism", " 日本語", "qzxj" * 9, "aaaaaaaaaaaaaaaa"]
    groups = spark.createDataFrame([(words,)], "words array<string>")
    folded = {r.word: r.ids for r in bpe.fold_words(groups, bpe.rank_map(spark, tokens)).collect()}
    for w in words:
        want = encoding.encode_ordinary(w) if w else []
        assert folded[w] == want == bpe.short_merges(w.encode(), ranks) == bpe.heap_merges(w.encode(), ranks)


def test_rank_files_are_checked(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 2\n")
    with pytest.raises(ValueError, match="gaps"):
        bpe.load_ranks(str(tmp_path / "r"))


def brute_sections(encoding, text, rule):
    """A row for each line, by walking over every character of every token."""
    at, starts = 0, [0]
    for i, c in enumerate(text):
        if c == "\n" and i + 1 < len(text):
            starts.append(i + 1)
    own = np.searchsorted(starts, np.arange(len(text)), "right") - 1
    char_of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    n, touched = [0] * len(starts), [0] * len(starts)
    for i in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(i))
        lines = [own[c] for c in sorted(set(char_of_byte[at : at + size]))]
        at += size
        to = {"first": lines[0], "last": lines[-1], "most": min(set(lines), key=lambda x: (-lines.count(x), x))}[rule]
        n[to] += 1
        for x in set(lines) if len(set(lines)) > 1 else ():
            touched[x] += 1
    return [(k, s, e, a, b) for k, (s, e, a, b) in enumerate(zip(starts, [*starts[1:], len(text)], n, touched, strict=True))]


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_token_counts(spark, encoding, rule):
    texts = [t for t in odd_texts()[:60]] + ["a\n\nb\n", "x\n \n  y", "é\n🙂\n", None, ""]
    got = token_counts.count_tokens(clashing(docs(spark, list(enumerate(texts)))), PATH, rule=rule).orderBy("doc_id", "section").collect()
    want = [(i, *row) for i, t in enumerate(texts) for row in brute_sections(encoding, t or "", rule)]
    assert [tuple(r) for r in got] == want


def test_token_counts_query_adds_up(spark, encoding):
    table = pq.read_table(f"{SF}/documents.parquet")
    got = {r.doc_id: r.n for r in QUERIES["op4_token_counts"](spark, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)}
    with pytest.raises(ValueError, match="unknown rule"):
        token_counts.count_tokens(docs(spark, []), PATH, rule="x")
    assert token_counts.count_tokens(docs(spark, []), PATH).count() == 0
    assert isinstance(pa.array([1]), pa.Array)


def test_token_counts_of_edges_and_very_long_runs(spark, encoding):
    """Null, empty, blank, repeated and long rows; runs of millions of one character, on which the tokenizer library gives up."""
    rows = [(i, t) for i, t, _ in EDGES]
    got = token_counts.count_tokens(clashing(docs(spark, rows)), PATH).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end_char").alias("end")).collect()
    want = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len(encoding.encode_ordinary(t or ""))
    assert {r.doc_id: r.n for r in got} == want and {r.doc_id: r.end for r in got} == {i: len(t or "") for i, t in rows}
    n = 2_000_000
    blank = token_counts.count_tokens(docs(spark, [(1, " " * n + "a"), (2, "\n" * 300_000)]), PATH).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("lines")).orderBy("doc_id").collect()
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(PATH))}
    assert blank[0].n == len(bpe.heap_merges(b" " * (n - 1), ranks)) + 1 and blank[1].lines == 300_000
    for k in (100, 1001, 20_000):
        assert bpe.heap_merges(b" " * k, ranks) == encoding.encode_ordinary(" " * k) and bpe.heap_merges(b"ab" * k, ranks) == encoding.encode_ordinary("ab" * k)


def test_words_that_share_a_hash_are_told_apart(spark, encoding, monkeypatch):
    """With hashes of 6 bits nearly all words clash; ids must still be those of each word's own bytes."""
    real = bpe.match_hashes
    texts = ["the cat and the dog and the cat went on to the house of the old man", "a few more words and a few others", None, "x"] * 3

    def few(data, starts):
        return real(data, starts) & np.uint64(63)

    rows = pa.record_batch([pa.array(list(range(len(texts)))), pa.array(texts)], names=["doc_id", "text"])
    tokens = bpe.load_ranks(PATH)
    words = sorted({w for t in texts if t for w in (" " + t).replace(" ", "\0 ").split("\0") if w})
    monkeypatch.setattr(bpe, "match_hashes", few)
    hot = bpe.Dictionary.build(pa.array(words), pa.array([encoding.encode_ordinary(w) for w in words], pa.list_(pa.int32())))
    value = lambda v: type("Value", (), {"value": v})
    out = [r for b in bpe._encoded(value(hot), value(tokens), ["doc_id"], ["ids"])(iter([rows])) for r in b.column("ids").to_pylist()]
    assert out == [encoding.encode_ordinary(t or "") for t in texts]
