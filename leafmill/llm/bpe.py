"""Byte-level BPE, encoding and decoding.

The merges of a word are a fold of Spark higher-order functions: its state is an array of ids, at first one for each
byte, and an array with the rank of each neighbouring pair; a step merges the first pair of least rank. Ranks come
from a literal map of all pairs of ids that join to another id (open addressing, so a look-up is a few comparisons).

Words are folded once, not once per occurrence: the most frequent distinct words of all documents, a bounded dictionary,
are folded and broadcast; a pass over the documents then replaces matches by their ids. The fold takes some 80
microseconds a word in Spark 4.1 and rare words are as many as the corpus is large, so words outside the dictionary are merged
in that pass by plain code (see the README for figures). No text and no word list is shuffled: only counts of words are.
Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, powers, prepare, release, released
from .pretokens import pieces, pretokens

#: The broadcast dictionary: so many words, of so many bytes each, at most.
HOT_WORDS, HOT_BYTES = 1 << 19, 64
#: Words that are folded in one row; steps for each doubling of a count.
GROUP_WORDS, STEPS = 4096, 16
#: Words of more bytes are merged with a heap; a task keeps the ids of so many words outside the dictionary.
SHORT_BYTES, CACHE_WORDS = 64, 100_000
SLOTS, PROBES, NO_RANK = 524287, 5, 65535
_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_BYTES = (np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id. Ids must be 0 to n - 1, n below 65,535, all single bytes among them."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(path, "rb"))}
    if sorted(ranks) != list(range(len(ranks))) or len(ranks) >= NO_RANK:
        raise ValueError("ids must run from 0 without gaps and stay below 65535")
    return [ranks[i] for i in range(len(ranks))]


def pair_table(tokens: list[bytes]) -> list[int]:
    """Slots with pair << 16 | rank, or 0; pair = left << 16 | right."""
    ranks, out = {t: i for i, t in enumerate(tokens)}, [0] * (SLOTS + PROBES)
    pairs = [(a << 16 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
    for h, key, r in sorted(((key * 40503 + (key >> 7)) % SLOTS, key, r) for key, r in pairs):
        p = next((p for p in range(PROBES) if not out[h + p]), None)
        if p is None:
            raise ValueError("the pair table is too full for this vocabulary")
        out[h + p] = key << 16 | r
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a name for value, which is then worked out once."""
    return F.transform(F.array(value), body)[0]


def rank_map(spark: SparkSession, tokens: list[bytes]) -> Column:
    """struct<table, single>: the pairs' ranks and the single bytes' ids, as a literal that Spark fills in when a query runs.

    As a literal from the start it would stand in every text that Spark makes of the plan, 26 MB a run, and stay in the driver's memory.
    """
    ranks = {t: i for i, t in enumerate(tokens)}
    row = pa.table({"table": pa.array([pair_table(tokens)], pa.list_(pa.int64())), "single": pa.array([[ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int64()))})
    return spark.createDataFrame(row).select(F.struct("table", "single")).scalar()


def fold_words(groups: DataFrame, ranks: Column) -> DataFrame:
    """groups (words array<string>) to (word, ids array<int>); ranks is a rank_map, which a group reads once."""
    with_map = groups.select("words", ranks.alias("t"))
    folded = F.transform("words", lambda w: F.struct(w.alias("word"), fold_merges(w, F.col("t.table"), F.col("t.single")).alias("ids")))
    return with_map.select(F.explode(folded).alias("e")).select("e.word", "e.ids")


def fold_merges(word: Column, table: Column, single: Column) -> Column:
    """The ids of a word, as array<int>, by folding merges in order of rank. single: the ids of the single bytes.

    The state holds the ids and the rank of each neighbouring pair. The ids stand between two ids of no token, so that
    every pair has a neighbour on either side.
    """

    def lookup(key: Column) -> Column:
        h = (key * 40503 + F.shiftright(key, 7)) % SLOTS
        out = F.lit(NO_RANK)
        for p in reversed(range(PROBES)):
            slot = F.get(table, (h + p).cast("int"))
            out = F.when(F.shiftright(slot, 16) == key, slot.bitwiseAND(F.lit(65535)).cast("int")).when(slot == 0, F.lit(NO_RANK)).otherwise(out)
        return out

    def merged(ids: Column, ranks: Column, m: Column, p: Column) -> Column:
        left, right = F.get(ids, p - 2).cast("long") * 65536 + m, m.cast("long") * 65536 + F.get(ids, p + 1)
        return F.struct(
            F.concat(F.slice(ids, 1, p - 1), F.array(m), F.slice(ids, p + 2, 65536)).alias("ids"),
            F.concat(F.slice(ranks, 1, p - 2), F.transform(F.array(left, right), lookup), F.slice(ranks, p + 2, 65536)).alias("ranks"),
        )

    def step(state: Column, _: Column) -> Column:
        least = F.array_min(state.ranks)
        at = F.struct(least.alias("m"), F.array_position(state.ranks, least).cast("int").alias("p"))
        return F.when(least >= NO_RANK, state).otherwise(let(at, lambda t: merged(state.ids, state.ranks, t.m, t.p)))

    def whole(ids: Column) -> Column:
        keys = F.transform(F.slice(ids, 1, F.size(ids) - 1), lambda x, i: x.cast("long") * 65536 + F.get(ids, i + 1))
        start = F.struct(ids.alias("ids"), F.transform(keys, lookup).alias("ranks"))
        return F.aggregate(F.slice(ids, 3, F.size(ids) - 3), start, step, lambda s: F.slice(s.ids, 2, F.size(s.ids) - 2))

    letters = F.filter(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
    edge = F.array(F.lit(NO_RANK))
    first = F.concat(edge, F.transform(letters, lambda c: F.get(single, F.ascii(c)).cast("int")), edge)
    return F.when(F.octet_length(word) > 0, let(first, whole)).otherwise(F.array().cast("array<int>"))


def short_merges(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by search for the least pair, for words that the dictionary does not hold."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    at = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while at:
        m = min(at)
        if m == NO_RANK:
            break
        i = at.index(m)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del at[i]
        if i:
            at[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(at):
            at[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def heap_merges(raw: bytes, ranks: dict[bytes, int], names: list[bytes] | None = None) -> list[int]:
    """The same ids for a long word, in n log n, with some 60 bytes of memory for each of its bytes. ranks in order of id; names: its keys."""
    names, n, bits = names or list(ranks), len(raw), (1 << 40) - 1
    single = [ranks[bytes([b])] for b in range(256)]
    part, after, before = array("i", [single[b] for b in raw]), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    rank = lambda i, j: ranks.get(names[part[i]] + names[part[j]], NO_RANK)
    heap = [r << 40 | i for i in range(n - 1) if (r := rank(i, i + 1)) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        r, i = top >> 40, top & bits
        j = after[i]
        if part[i] < 0 or j >= n or rank(i, j) != r:
            continue
        part[i], part[j], after[i] = r, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := rank(a, b)) != NO_RANK:
                heapq.heappush(heap, r << 40 | a)
    return [p for p in part if p >= 0]


class Merger:
    """Ids of words by plain merges; short words are kept, CACHE_WORDS at most."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.ranks, self.known = tokens, {t: i for i, t in enumerate(tokens)}, {}

    def __call__(self, word: bytes) -> list[int]:
        out = self.known.get(word)
        if out is None:
            out = heap_merges(word, self.ranks, self.tokens) if len(word) > SHORT_BYTES else short_merges(word, self.ranks)
            if len(self.known) < CACHE_WORDS and len(word) <= HOT_BYTES:
                self.known[word] = out
        return out

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the words, and the ids, end to end."""
        own = [self(w) for w in words]
        return np.array([len(o) for o in own], np.int64), np.array([x for o in own for x in o], np.uint16)


def distinct_words(data: np.ndarray, starts: np.ndarray, which: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
    """The distinct matches among those numbered in `which` (all, unless given), and which of them each is; told apart by their bytes."""
    raw = data.tobytes()
    a, b = (starts[:-1], starts[1:]) if which is None else (starts[which], starts[which + 1])
    number: dict[bytes, int] = {}
    back = np.array([number.setdefault(raw[x:y], len(number)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    return list(number), back


def match_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_MULTIPLIER, n), out=sums[1:])
    a, b = starts[:-1], starts[1:]
    return mix((sums[b] - sums[a]) * powers(pow(_MULTIPLIER, -1, 1 << 64), n + 1)[a] + (b - a).astype(np.uint64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in each block, without those too long for the dictionary."""
    for batch in batches:
        for _, _, data, offs in blocks(batch.column(0)):
            starts, _ = pretokens(data, offs)
            _, index, n = np.unique(match_hashes(data, starts), return_index=True, return_counts=True)
            short = (starts[index + 1] - starts[index]) <= HOT_BYTES
            yield pa.record_batch([pieces(data, starts, index[short]), pa.array(n[short], pa.int64())], names=["word", "n"])


class Dictionary:
    """Hashes of the hot words in a table with open addressing, and their ids, end to end."""

    def __init__(self, hashes: np.ndarray, table: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.hashes, self.table, self.sizes, self.flat = hashes, table, sizes, flat
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def build(cls, words: pa.Array, ids: pa.ListArray) -> tuple[np.ndarray, ...]:
        """Its arrays; they are what is broadcast."""
        n = len(words)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        starts = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4).astype(np.int64)
        runs = [match_hashes(data[starts[i] : starts[min(i + 65536, n)]], starts[i : min(i + 65536, n) + 1] - starts[i]) for i in range(0, n, 65536)]
        hashes = np.concatenate([*runs, np.zeros(0, np.uint64)])
        slots = 1 << max(4, int(np.ceil(np.log2(4 * n + 1))))
        table, todo, at = np.full(slots, -1, np.int32), np.arange(n), (hashes & np.uint64(slots - 1)).astype(np.int64)
        while len(todo):
            free = table[at] < 0
            table[at[free]] = todo[free]
            again = table[at] != todo
            todo, at = todo[again], (at[again] + 1) & (slots - 1)
        return hashes, table, np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy().astype(np.uint16)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The word's number, or -1."""
        out, at, todo = np.full(len(h), -1, np.int32), (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(todo):
            got = self.table[at]
            hit = got >= 0
            same = hit & (self.hashes[got] == h[todo])
            out[todo[same]] = got[same]
            on = hit & ~same
            todo, at = todo[on], (at[on] + 1) & np.int64(self.mask)
        return out


def expand(sizes: np.ndarray, ends: np.ndarray, flat: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The entries of flat that belong to the runs numbered in pick, end to end; run i has sizes[i] entries and ends at ends[i]."""
    size = sizes[pick]
    upto = np.cumsum(size)
    return flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(ends[pick] - upto, size)]


def _encoded(hot, tokens, names: list[str], more: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, tok = Dictionary(*hot.value), tokens.value
        runs = []
        for parts in ([b"%d " % i for i in range(len(tok))], tok):  # ids as they are shown, and their bytes
            s = np.array([len(x) for x in parts], np.int64)
            runs.append((s, np.cumsum(s), np.frombuffer(b"".join(parts), np.uint8)))
        hot_ends, merger = np.cumsum(d.sizes), Merger(tok)

        def ids_of(data: np.ndarray, starts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Ids of the matches, end to end, and how many each has; code: their numbers in the dictionary, or -1."""
            miss, sizes, ends, flat = np.flatnonzero(code < 0), d.sizes, hot_ends, d.flat
            if len(miss):
                words, back = distinct_words(data, starts, miss)
                n, own = merger.runs(words)
                sizes, ends, flat = np.concatenate([sizes, n]), np.concatenate([ends, np.cumsum(n) + len(flat)]), np.concatenate([flat, own])
                code[miss] = len(d.sizes) + back
            return expand(sizes, ends, flat, code), sizes[code]

        for batch in batches:
            for i, j, data, offs in blocks(batch.column(len(names))):
                starts, match_of = pretokens(data, offs)
                ids, per = ids_of(data, starts, d.find(match_hashes(data, starts)).astype(np.int64))
                back = expand(*runs[1], ids)
                if not np.array_equal(back, data):  # a word shares its hash with another one in the dictionary: go by bytes
                    ids, per = ids_of(data, starts, np.full(len(starts) - 1, -1, np.int64))
                    back = expand(*runs[1], ids)
                upto = np.concatenate([[0], np.cumsum(per)])[match_of]
                hashed, raw = [], b""
                for (s, e, f), cut in zip(runs, (1, 0), strict=True):
                    raw = (expand(s, e, f, ids) if cut else back).tobytes()
                    at = np.concatenate([[0], np.cumsum(s[ids])])[upto].tolist()
                    hashed.append([hashlib.sha256(raw[x : max(x, y - cut)]).hexdigest() for x, y in zip(at, at[1:])])  # noqa: B905
                columns = [*(batch.column(c).slice(i, j - i) for c in range(len(names))), pa.array(np.diff(upto), pa.int64()), *(pa.array(x, pa.string()) for x in hashed)]
                if "ids" in more:
                    columns.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32))))
                if "decoded" in more:
                    columns.append(pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary()))  # noqa: B905
                yield pa.record_batch(columns, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *more])

    return run


def dictionary(docs: DataFrame, tokens: list[bytes], text: str = "text", hot_words: int = HOT_WORDS) -> tuple[np.ndarray, ...]:
    """The most frequent words of all documents with their ids: at most hot_words of HOT_BYTES each. Words of nearly one count come in together or not at all."""
    counts = docs.select(text).mapInArrow(released(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").checkpoint()
    # a histogram of the counts' logarithms, a few hundred rows, tells from which count on words fit in; no task sorts them all
    step = F.floor(F.log2("n") * STEPS)
    room, least = hot_words, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.col("step").desc()).collect():
        if row.words > room:
            break
        room, least = room - row.words, row.step
    top = counts.filter(step >= least if least is not None else F.lit(False)).select("word")
    groups = top.groupBy(F.pmod(F.xxhash64("word"), F.lit(-(-hot_words // GROUP_WORDS))).alias("g")).agg(F.collect_list("word").alias("words"))
    parts = max(12, docs.sparkSession.sparkContext.defaultParallelism * 2)
    table = fold_words(groups.repartition(parts, "g"), rank_map(docs.sparkSession, tokens)).toArrow()
    out = Dictionary.build(_flat(table.column("word")), _flat(table.column("ids")))
    del table
    release()
    return out


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def encode_decode(docs: DataFrame, path: str, keys: list[str] | None = None, text: str = "text", ids: bool = False, decoded: bool = False, hot_words: int = HOT_WORDS) -> DataFrame:
    """docs to keys, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded (binary): a row for each row.

    Every block of texts is decoded and held against its own bytes: where a word shares its 64-bit hash with another, the block is encoded again by the words' bytes. Very
    long texts are a block of their own, and long words are merged in n log n.

    Each match of the pattern is encoded by the ranks in the file at path, without special tokens; the ids are then
    decoded. Null counts as empty: no tokens, digests of nothing. keys: the columns that are carried along, doc_id unless named;
    others are ignored. Rows that repeat are encoded one by one. No rows give no rows.
    ids_sha256: of the decimal ids, joined by one space. decoded_sha256: of the decoded bytes.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    keys = keys or ["doc_id"]
    tokens = load_ranks(path)
    hot = spark.sparkContext.broadcast(dictionary(docs, tokens, text, hot_words))
    listed = spark.sparkContext.broadcast(tokens)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[k] for k in keys))
    more = {"ids": "array<int>"} if ids else {}
    more |= {"decoded": "binary"} if decoded else {}
    kinds = "".join(f", {n} {k}" for n, k in more.items())
    return docs.select(*keys, F.col(text)).mapInArrow(released(_encoded(hot, listed, keys, list(more))), f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string{kinds}")
