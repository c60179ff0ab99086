"""Near-duplicate detection by Fast Similarity Sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round i every element falls into one of t bins, with a value of i plus a
fraction; a bin keeps its least value. Rounds t to 2t - 1 put every element into the bin i - t, so each coordinate
is filled, whatever the set's size. Bands of the sketch name candidates; links count only once the full sets confirm them.

No pair list grows with the square of a bucket. A bucket first links its members to one pivot. Members that end in
one component need no further test; only where a bucket still spans components are pairs across components made:
directly for small buckets, and for larger ones through an exact prefix filter over the differences from the pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Words, blocks, mix, prepare, released, shingles, signed
from .components import components, parts_for

BANDS, ROWS = 32, 5
#: Buckets that still span components and have up to so many members test all their pairs; larger ones use the prefix filter.
SMALL_BUCKET = 12

_rng = np.random.Generator(np.random.PCG64(77))


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketch(elements: np.ndarray, t: int, salts: np.ndarray | None = None) -> np.ndarray:
    """The t values of a set of distinct 64-bit hashes; every one is filled if the set isn't empty."""
    salts = _salts(2 * t) if salts is None else salts
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n = len(elements)
    if not n:
        return out
    low, enough, i = np.uint64((1 << 40) - 1), int(t * (np.log(t) + 1.5)), 0
    while i < t:
        j = min(t, i + max(1, -(-enough // n)))
        drawn = mix(elements[None, :] ^ salts[i:j, None])
        bins = ((drawn >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
        np.minimum.at(out, bins.ravel().astype(np.intp), ((np.arange(i, j, dtype=np.uint64) << np.uint64(40))[:, None] | (drawn & low)).ravel())
        i = j
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[b] = (np.uint64(t + b) << np.uint64(40)) | (mix(elements ^ salts[t + b]) & low).min()
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    odd = _salts(rows) | np.uint64(1)
    return mix((mix(sketches.reshape(*sketches.shape[:-1], bands, rows)) * odd).sum(axis=-1, dtype=np.uint64) + _salts(bands))


def _sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    for _, _, data, offs in blocks(column):
        words = Words(data, offs, IS_SPACE_NOT)
        hashes = words.hashes()
        yield [np.unique(shingles(hashes[a:b], k)) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


IS_SPACE_NOT = ~IS_SPACE
#: 64-bit words of a set's parity: bit i is the parity of its elements with hash i. Those of two sets differ in no more bits than the sets in elements.
PARITY = 16


def _may_link(p: str, q: str, num: int, den: int) -> Column:
    """False only for sets that cannot be so similar, by size or parity; columns n and parity of p and q."""
    bits = sum((F.bit_count(F.get(f"{p}parity", F.lit(i)).bitwiseXOR(F.get(f"{q}parity", F.lit(i)))) for i in range(PARITY)), F.lit(0))
    sizes = F.col(f"{p}n") + F.col(f"{q}n")
    return (den * F.least(f"{p}n", f"{q}n") >= num * F.greatest(f"{p}n", f"{q}n")) & ((den + num) * bits <= (den - num) * sizes)


def _sketched(k: int, bands: int, rows: int):
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(2 * t)
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for sets in _sets(batch.column(1), k):
                for s in sets:
                    n.append(len(s))
                    d1.append(int(mix(s + np.uint64(11)).sum(dtype=np.uint64)))
                    d2.append(int(mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)))
                    keys.append(sketch(s, t, salts))
            size = np.array(n, np.int64)
            filled = size > 0
            out = signed(band_keys(np.array(keys, np.uint64), bands, rows)[filled].ravel()) if n else np.zeros(0, np.int64)
            digest = lambda d: pa.array(np.array(d, np.uint64).view(np.int64), mask=~filled)
            yield pa.record_batch(
                [batch.column(0), pa.array(size), digest(d1), digest(d2), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * bands)]), pa.int32()), pa.array(out))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for sets in _sets(batch.column(1), k):
                sizes = [len(s) for s in sets]
                values = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                bits = [np.packbits((np.bincount(s & np.uint64(64 * PARITY - 1), minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64) for s in sets]
                lists = lambda n, x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(x))
                yield pa.record_batch([batch.column(0).slice(row, len(sets)), pa.array(sizes, pa.int64()), lists([PARITY] * len(sets), np.concatenate([*bits, np.zeros(0, np.int64)])), lists(sizes, values)], names=["node", "n", "parity", "shingles"])
                row += len(sets)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those with den * intersection >= num * union, counted on the full sets."""
    small = sets.select("node", "n", "parity")
    near = pairs.join(small.toDF("a", "a_n", "a_parity"), "a").join(small.toDF("b", "b_n", "b_parity"), "b").filter(_may_link("a_", "b_", num, den)).select("a", "b", "a_n", "b_n")
    full = sets.select("node", "shingles")
    joined = near.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.select("a", "b", "a_n", "b_n", both.alias("both")).filter(den * F.col("both") >= num * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b")


def _across(members: DataFrame, sets: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """For members (pivot, node, label) that were all tested against their pivot: pairs across labels that may link; complete as to components.

    Let c = (den - num) / (den + num): X and Y link if |X - Y| + |Y - X| <= c (|X| + |Y|). Take each set's difference D from the
    pivot P. If |D(X)| + |D(Y)| <= c (|X| + |Y|) they link for certain; then one of them is in the pivot's component, and a test with the
    best placed member of it does for all. Otherwise they share at least (|D(X)| + |D(Y)| - c (|X| + |Y|)) / 2 elements of
    their differences, so that they meet in prefixes of these, rarest first. What a group's copies have in common is no
    part of the differences; hence a large group of copies that are close, but not close enough, makes few pairs.
    """
    c, ratio = (den - num) / (den + num), num / den
    heads, own = sets.select(F.col("node").alias("pivot"), F.col("n").alias("np"), F.col("shingles").alias("sp")), sets
    apart = members.join(own, "node").join(heads, "pivot").select("pivot", "node", "label", "n", "np", "parity", F.concat(F.array_except("shingles", "sp"), F.array_except("sp", "shingles")).alias("d"))
    apart = apart.withColumn("m", F.size("d").cast("double")).coalesce(4 * parts).checkpoint()
    home = members.filter("node = pivot").select("pivot", F.col("label").alias("home")).distinct().coalesce(parts).checkpoint()
    placed = apart.select("pivot", "node", "label", "n", "m").join(home, "pivot").coalesce(parts).checkpoint()
    best = placed.filter("label = home").groupBy("pivot").agg(F.max(F.struct((c * F.col("n") - F.col("m")).alias("room"), F.col("node").alias("b"))).alias("best")).coalesce(parts).checkpoint()
    sure = placed.filter("label != home").join(best, "pivot").filter(F.col("m") <= c * F.col("n") + F.col("best.room") + 1e-6).select(F.col("node").alias("x"), F.col("best.b").alias("y"))

    spread = apart.filter("node != pivot").select("pivot", "node", "n", "np", "m", F.explode("d").alias("x"))
    shared = spread.groupBy("pivot", "x").agg(F.count("*").alias("f")).filter("f > 1").coalesce(4 * parts).checkpoint()
    ranked = spread.join(shared, ["pivot", "x"]).groupBy("pivot", "node", "n", "np", "m").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("xs"))
    far, least = c * F.col("n") * (1 + 1 / ratio), c * (ratio * F.col("n") + F.col("np"))
    places = lambda overlap: F.col("m") - F.greatest(F.lit(1.0), F.ceil(overlap / 2 - 1e-6)) + 1
    alone = F.col("m") - F.size("xs")
    front = (
        ranked.withColumn("larger", places(F.col("m") - far) - alone)
        .withColumn("smaller", places(F.col("m") + F.greatest("m", least) - far) - alone)
        .select("pivot", "node", "smaller", F.posexplode(F.slice("xs", 1, F.greatest(F.lit(0), F.col("larger").cast("int")))).alias("at", "e"))
        .select("pivot", "node", (F.col("at") < F.col("smaller")).alias("small"), F.col("e.x").alias("x"))
        .join(apart.select("pivot", "node", "label", "n", "m", "parity"), ["pivot", "node"])
        .coalesce(4 * parts)
        .checkpoint()
    )
    p, q = front.alias("p"), front.filter("small").alias("q")
    meet = (F.col("p.pivot") == F.col("q.pivot")) & (F.col("p.x") == F.col("q.x")) & (F.col("p.label") != F.col("q.label"))
    order = (F.col("p.m") > F.col("q.m")) | ((F.col("p.m") == F.col("q.m")) & (F.col("p.node") > F.col("q.node")))
    met = p.join(q, meet & order & _may_link("p.", "q.", num, den)).select(F.col("p.node").alias("x"), F.col("q.node").alias("y"))
    return sure.union(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_shingles, class_id, component_id, kept.

    A document's set: its distinct k-word shingles (words [^\\x20\\x09-\\x0D]+ with A-Z in lower case), or the whole
    sequence as one if it has fewer words. Documents link if den * |both| >= num * |either|. class_id: smallest
    doc_id with the same set; component_id: smallest doc_id reachable over links.

    Null or empty texts and texts of white space have n_shingles 0, link with nothing and are kept. Rows without a
    doc_id link with nothing, have a null component_id and are kept. Rows that repeat a doc_id are one document: with
    different texts, it links through each. Other columns are ignored. An empty table gives an empty result.
    A pair of similarity exactly num / den is missed by the bands with probability (1 - (num / den) ** rows) ** bands,
    7e-9 at 0.85 and 3e-6 at 0.8.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = texts.mapInArrow(released(_sketched(k, bands, rows)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>").checkpoint()
    classes = drawn.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id")).checkpoint()
    head = F.when(F.col("doc_id") == F.col("class_id"), F.col("bands"))
    member = drawn.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), head.alias("bands")).checkpoint()

    heads = member.filter("bands is not null").select("class_id", "bands")
    keyed = heads.select(F.col("class_id").alias("node"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).filter("lo < hi").checkpoint()
    crowded = keyed.join(buckets.filter("size > 2").select("key", "lo", "size"), "key").checkpoint()

    stars = buckets.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(crowded.filter("node != lo").select("lo", "node")).distinct().checkpoint()
    few_parts, parts = parts_for(stars.count()), parts_for(crowded.count())
    stars = stars.coalesce(few_parts)
    wanted = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct().coalesce(few_parts).checkpoint()
    sets = texts.join(wanted, "doc_id").mapInArrow(released(_set_rows(k)), "node long, n long, parity array<long>, shingles array<long>").checkpoint()
    links = _verified(stars, sets, num, den).coalesce(4 * few_parts).checkpoint()
    labels = components(links)

    placed = crowded.coalesce(parts).join(labels, "node", "left").select("key", "node", "lo", "size", F.coalesce("label", "node").alias("label")).coalesce(parts).checkpoint()
    open_ = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("key").coalesce(parts).checkpoint()
    rest = placed.join(open_, "key").coalesce(parts).checkpoint()
    few = rest.filter(F.col("size") <= SMALL_BUCKET)
    p, q = few.alias("p"), few.alias("q")
    direct = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.label") != F.col("q.label"))).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    many = rest.filter(F.col("size") > SMALL_BUCKET).select(F.col("lo").alias("pivot"), "node", "label").distinct().coalesce(parts).checkpoint()
    across = direct if many.isEmpty() else direct.union(_across(many, sets, num, den, parts))
    more = _verified(across.distinct().join(stars, ["a", "b"], "left_anti").coalesce(parts), sets, num, den).coalesce(4 * parts).checkpoint()
    if not more.isEmpty():
        labels = components(links.union(more))
    found = member.join(labels.select(F.col("node").alias("class_id"), "label"), "class_id", "left")
    return found.select("doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
