"""Token counts by field or section, through the tokens' character spans.

A document is encoded once, whole. Its tokens and its sections are intervals of characters; a search in the section
starts joins them. A token that lies in several sections goes to one of them by rule:
"most": the section with most of its characters, the first of equals; "first", "last": where it begins, or ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, distinct_words, expand, load_ranks
from .common import blocks, prepare
from .pretokens import pretokens


def lines(text: str) -> list[int]:
    """Starts of the lines; a line feed belongs to the line that it ends. No text is one empty line."""
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def char_spans(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of these byte sizes, in order, to the characters that each has a byte of: [start, end). raw: the bytes."""
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = np.cumsum(sizes)
    return lead[ends - sizes + 1] - 1, lead[ends]


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Each section's tokens, and how many tokens touch it together with another section. sections: ascending starts, the first 0."""
    n = len(sections)
    a, b = np.searchsorted(sections, start, "right") - 1, np.searchsorted(sections, end - 1, "right") - 1
    to = (b if rule == "last" else a).copy()
    across = np.flatnonzero(a != b)
    touched = np.zeros(n, np.int64)
    bounds = np.append(sections, np.iinfo(np.int64).max)
    for t in across.tolist():
        i, j = int(a[t]), int(b[t])
        touched[i : j + 1] += 1
        if rule == "most":
            own = np.minimum(bounds[i + 1 : j + 2], end[t]) - np.maximum(bounds[i : j + 1], start[t])
            to[t] = i + int(own.argmax())
    return np.bincount(to, minlength=n), touched


def token_sizes(data: np.ndarray, offs: np.ndarray, merger: Merger, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in bytes of the tokens of a block of texts, and the first token of each text, with a sentinel.

    Each distinct match of the pattern is encoded once a block; long ones, as runs of white space, in n log n.
    """
    starts, match_of = pretokens(data, offs)
    words, back = distinct_words(data, starts)
    n, ids = merger.runs(words)
    sizes = expand(n, np.cumsum(n), length[ids], back)
    return sizes, np.concatenate([[0], np.cumsum(n[back])])[match_of]


def count_tokens(docs: DataFrame, path: str, sections: Callable[[str], list[int]] = lines, rule: str = "most", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs to a row for each section: key, section, start_char, end_char, n_tokens, n_crossing.

    n_tokens of a document add up to its whole encoding by the ranks at path; n_crossing counts tokens that lie in this section
    and another. sections gives ascending section starts, 0 first. Null and empty texts have one section without tokens. Very long texts, lines and runs of
    one kind of character are encoded whole; a text beyond a megabyte is a block of its own. Repeated rows repeat their rows; other
    columns are ignored; no rows give no rows.
    """
    if rule not in ("most", "first", "last"):
        raise ValueError(f"unknown rule {rule}")
    spark = docs.sparkSession
    prepare(spark)
    tokens = spark.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, length = Merger(tokens.value), np.array([len(t) for t in tokens.value], np.int64)
        for batch in batches:
            for i, j, data, offs in blocks(batch.column(1)):
                sizes, first = token_sizes(data, offs, merger, length)
                index, parts = [], []
                for d in range(j - i):
                    raw = data[offs[d] : offs[d + 1]]
                    whole = raw.tobytes().decode()
                    starts = np.array(sections(whole), np.int64)
                    n, crossing = attribute(*char_spans(raw, sizes[first[d] : first[d + 1]]), starts, rule)
                    index.append(np.full(len(starts), i + d))
                    parts.append(np.stack([np.arange(len(starts)), starts, np.append(starts[1:], len(whole)), n, crossing]))
                at, cols = np.concatenate(index), np.concatenate(parts, axis=1)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(cols[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in cols[1:])], names=["key", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, section int, start_char long, end_char long, n_tokens long, n_crossing long").withColumnRenamed("key", key)
