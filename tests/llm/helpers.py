"""Small tables with all that operators must bear: nulls, empty and blank texts, ties, repeated rows, columns with clashing names."""

import re

import pyarrow as pa
import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def docs(spark, rows):
    """(doc_id, text) or (doc_id, text, source) to documents."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], SCHEMA)


def clashing(df):
    """The same with columns named like what operators add."""
    for c in ("kept", "size", "score", "node", "key", "bands", "n", "y", "h", "r", "word", "own", "recipe"):
        df = df.withColumn(c, df["doc_id"] * 0 + 1)
    return df


def write(tmp, rows, name="documents"):
    """(doc_id, text, source) as a Parquet table, for queries and their SQL."""
    ids, texts, sources = ([r[i] for r in rows] for i in range(3))
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * len(rows), pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(table, f"{tmp}/{name}.parquet")
    return str(tmp)


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "x", "a"), (5, "x", "b"), (5, "x", "b"), (6, "Längere Wörter, 日本語 und 🙂 emoji's don't ' 12 3", "b"), (7, "a" * 30_000, "b"), (8, "word " * 20_000, None), (9, "\x00\x1c odd \u00a0\u2003 spaces\r\n\r\n  end  ", "a")]
