"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first bytes, hashed to 64 bits. score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over
a text's distinct terms; the pairs say what single terms can't, such as an insult beside the mention of a group.
The model keeps the terms that tell the classes apart best, alone or among the texts that hold another term, a fixed
number of each at most, so it is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_TERM, Words, blocks, fold_of, prepare, release, released, signed
from .labelled import TRAIN_ROWS, labelled_sample

#: Bytes of the prefixes that are terms too.
PREFIXES = (4, 5, 6)
MAX_TERMS, FACTORS, STEPS = 4096, 4, 150
#: A term's rates in the two classes must be so many standard deviations apart; few labels thus give few terms, not noise. DECAY is the weight of the
#: squares of the model's numbers in its loss. Both were chosen by choose_settings, which sees training rows alone.
LEAST_DEVIATIONS, DECAY = 3.5, 2e-4
#: Beside the terms kept for themselves, so many of the commonest others are tried as one half of pairs; chance lets a pair in at this rate in a whole training.
COMMON, CHANCE = 512, 0.05
GROUPS, SLICE, FIT_SLICE = 64, 4096, 1 << 19
FOLDS, HELD = 5, 0


@dataclass
class Machine:
    terms: np.ndarray  # sorted
    bias: float
    w: np.ndarray
    v: np.ndarray  # factors x terms

    def scores(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n texts; (text, term) are the distinct terms of each."""
        out = np.full(n, self.bias) + np.bincount(text, self.w[term], n)
        for f in self.v:
            out += 0.5 * (np.bincount(text, f[term], n) ** 2 - np.bincount(text, f[term] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def term_hashes(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of each word, then of each prefix of longer words."""
    words = Words(data, offs, IS_TERM)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(words.first))
    yield text, words.hashes()
    long = words.ends - words.starts
    for width in PREFIXES:
        keep = long > width
        yield text[keep], words.hashes(width)[keep] ^ np.uint64(width * 0x9E3779B97F4A7C15 & (2**64 - 1))


def known_terms(data: np.ndarray, offs: np.ndarray, terms: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, number of a term of the model)."""
    keys = []
    for text, h in term_hashes(data, offs):
        few = np.flatnonzero(sieve[(h & np.uint64(len(sieve) - 1)).astype(np.int64)])
        h, text = h[few], text[few]
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[at] == h
        keys.append(text[hit] * len(terms) + at[hit])
    both = np.unique(np.concatenate(keys))
    return both // len(terms), both % len(terms)


def sieve_of(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 18, bool)
    out[(terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(1).to_numpy()
        for i, j, data, offs in blocks(batch.column(0)):
            pairs = [np.stack([t.astype(np.uint64), h]) for t, h in term_hashes(data, offs)]
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            terms, back = np.unique(both[1], return_inverse=True)
            toxic = y[i:j][both[0].astype(np.int64)]
            yield pa.record_batch([pa.array(signed(terms)), pa.array(np.bincount(back.ravel(), toxic, len(terms)).astype(np.int64)), pa.array(np.bincount(back.ravel(), minlength=len(terms)).astype(np.int64))], names=["term", "pos", "n"])


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _known_rows(sample: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their keys: keys, y, and starts and numbers of the terms that each holds."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sieve_of(terms)
        for batch in batches:
            for i, j, data, offs in blocks(batch.column(0)):
                text, term = known_terms(data, offs, terms, sieve)
                sizes = np.bincount(text, minlength=j - i)
                yield pa.record_batch([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(term.astype(np.int16)))], names=["y", "key", "terms"])

    rows = sample.select("text", "y", _row().alias("key")).mapInArrow(released(found), "y int, key long, terms array<short>").orderBy("key").toArrow()
    lists = rows.column("terms").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return rows.column("key").to_numpy(), rows.column("y").to_numpy(), lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()


def evidence(n: np.ndarray, a: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """n KL(a / n, rate): chance gives a of n at this rate with probability exp(-evidence) at most (Chernoff), in each direction."""
    part = np.divide(a, n, out=np.zeros(np.broadcast(a, n).shape), where=n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(part > 0, part * np.log(part / rate), 0) + np.where(part < 1, (1 - part) * np.log((1 - part) / (1 - rate)), 0)
    return n * np.where((n > 0) & (rate > 0) & (rate < 1), out, 0)


def pair_terms(sample: DataFrame, kept: np.ndarray, common: np.ndarray, n_terms: int, most: int) -> np.ndarray:
    """Terms not in `kept` that tell the classes apart among the texts that hold a term of `kept` or `common`, and those partners; sorted.

    All terms of three texts or more are tried with all partners, over the whole sample; the bar rises with the number of trials.
    """
    seeds = np.sort(np.concatenate([kept, common]))
    keys, y, start, flat = _known_rows(sample, seeds)
    context = sample.sparkSession.sparkContext
    shared = context.broadcast((seeds, keys, y, start, flat))
    bar = np.log(4 * max(n_terms, 1) * max(len(seeds), 1) / CHANCE)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value[1]
        for batch in batches:
            row = np.searchsorted(keys, batch.column(1).to_numpy())
            for i, _, data, offs in blocks(batch.column(0)):
                text, h = (np.concatenate(x) for x in zip(*term_hashes(data, offs), strict=True))
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                first = (np.diff(text, prepend=-1) != 0) | np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
                text, h = text[first], h[first]
                if len(kept):
                    new = kept[np.minimum(np.searchsorted(kept, h), len(kept) - 1)] != h
                    text, h = text[new], h[new]
                g, row_of = (h % np.uint64(GROUPS)).astype(np.int32), row[i + text].astype(np.int32)
                order = np.lexsort((h, g))
                g, h, row_of = g[order], h[order], row_of[order]
                cut = np.flatnonzero(np.diff(g, prepend=-1))
                cols = [(int(g[x]), *packed(h[x:y], row_of[x:y])) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True)]
                if cols:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cols, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["g", "terms", "counts", "rows"])

    def packed(h: np.ndarray, row: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Terms once with their counts, and rows, in planes of bytes, which compress."""
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(first, len(h))).astype(np.int32)
        return h[first].tobytes(), n.view(np.uint8).reshape(-1, 4).T.tobytes(), row.view(np.uint16).reshape(-1, 2).T.tobytes()

    def unpacked(terms: bytes, counts: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        return np.repeat(np.frombuffer(terms, np.int64), n), np.ascontiguousarray(np.frombuffer(rows, np.uint16).reshape(2, -1).T).view(np.int32).ravel()

    def judged(table: pa.Table) -> pa.Table:
        seeds, _, y, start, flat = shared.value
        size, width = np.diff(start), len(seeds)
        of = np.repeat(np.arange(len(size)), size)
        n_seed, p_seed = np.bincount(flat, minlength=width), np.bincount(flat, y[of], width)
        rate = p_seed / np.maximum(n_seed, 1)
        both = [unpacked(*(v.as_py() for v in r)) for r in zip(*(table.column(c) for c in ("terms", "counts", "rows")), strict=True)]
        term, row = (np.concatenate(x) for x in zip(*both, strict=True))
        order = np.argsort(term, kind="stable")
        term, row = term[order], row[order]
        names, first, count = np.unique(term, return_index=True, return_counts=True)
        out = []

        def counted(at: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
            n = size[rows]
            if not n.sum():
                return np.zeros((k, width))
            where = np.arange(n.sum()) + np.repeat(start[rows] - np.cumsum(n) + n, n)
            return np.bincount(np.repeat(at, n) * width + flat[where], minlength=k * width).reshape(k, width).astype(np.float64)

        many = np.flatnonzero(count >= 3)
        while len(many):
            k = max(1, min(int(np.searchsorted(np.cumsum(count[many]), SLICE, "right")), SLICE // 16))
            now, many = many[:k], many[k:]
            n, a = np.zeros((k, width)), np.zeros((k, width))
            rows = np.concatenate([row[first[t] : first[t] + count[t]] for t in now])
            at = np.repeat(np.arange(k), count[now])
            for i in range(0, len(rows), SLICE):
                r, t = rows[i : i + SLICE], at[i : i + SLICE]
                n += counted(t, r, k)
                a += counted(t[y[r] == 1], r[y[r] == 1], k)
            x = np.nonzero(n >= 3)  # fewer texts can't reach the bar, neither by holding the term nor by lacking it
            m, b, of_seed = n[x], a[x], x[1]
            sure = np.zeros((k, width))
            sure[x] = np.maximum(evidence(m, b, rate[of_seed]), evidence(n_seed[of_seed] - m, p_seed[of_seed] - b, rate[of_seed]))
            sure[signed(seeds)[None, :] == names[now][:, None]] = 0
            best = sure.argmax(axis=1)
            out += [(int(names[t]), int(signed(seeds)[b]), float(v)) for t, b, v in zip(now, best, sure[np.arange(k), best], strict=True) if v >= bar]
        cols = list(zip(*out, strict=True)) or [()] * 3
        release()
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["term", "partner", "evidence"])

    pairs = sample.select("text", _row().alias("key")).mapInArrow(released(postings), "g int, terms binary, counts binary, rows binary").groupBy("g").applyInArrow(judged, "term long, partner long, evidence double")
    got = pairs.orderBy(F.col("evidence").desc(), "term").limit(most).collect()
    shared.unpersist()
    release()
    return np.unique(np.array([x for r in got for x in (r.term, r.partner)], np.int64).view(np.uint64))


def fit(x_text: np.ndarray, x_term: np.ndarray, y: np.ndarray, terms: np.ndarray, factors: int = FACTORS, steps: int = STEPS, decay: float = DECAY) -> Machine:
    """Full-batch Adam on the logistic loss; x_text ascends."""
    n, k = len(y), len(terms)
    rng = np.random.Generator(np.random.PCG64(9))
    rate = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    theta = [np.array([np.log(rate / (1 - rate))]), np.zeros(k), rng.normal(0, 0.02, (factors, k))]
    if not n or not k or y.min() == y.max():
        return Machine(terms, float(theta[0][0]), theta[1], np.zeros((factors, k)))
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    # the whole batch, a slice of texts at a time: arrays over all terms of all texts would fill the driver
    cuts = np.unique(np.concatenate([[0], np.searchsorted(x_text, x_text[FIT_SLICE::FIT_SLICE]), [len(x_text)]])).tolist()
    parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    bounds = [0, *(int(x_text[p.start]) for p in parts[1:]), n]
    for step in range(1, steps + 1):
        b, w, v = theta
        g, dw, dv = np.zeros(n), np.zeros(k), np.zeros((factors, k))
        for p, t0, t1 in zip(parts, bounds[:-1], bounds[1:], strict=True):
            text, term = x_text[p] - t0, x_term[p]
            g[t0:t1] = (Machine(terms, float(b[0]), w, v).scores(text, term, t1 - t0) - y[t0:t1]) / n
            gt = g[t0:t1][text]
            dw += np.bincount(term, gt, k)
            dv += np.stack([np.bincount(term, gt * (np.bincount(text, f[term], t1 - t0)[text] - f[term]), k) for f in v])
        for i, d in enumerate((np.array([g.sum()]), dw + decay * w, dv + decay * v)):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.99 * second[i] + 0.01 * d * d
            theta[i] = theta[i] - 0.08 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Machine(terms, float(theta[0][0]), theta[1], theta[2])


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, max_terms: int = MAX_TERMS, deviations: float = LEAST_DEVIATIONS, decay: float = DECAY) -> Machine:
    """Learns labels.toxic from rows outside fold HELD of FOLDS, `bound` of them at most. Without labels it scores every text alike, below 0.5."""
    sample = labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), FOLDS) == HELD, bound)
    counts = sample.select("text", "y").mapInArrow(released(_term_counts), "term long, pos long, n long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("n").alias("n")).filter("n >= 3")
    total = sample.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = float(total.p or 0), float(total.n)
    have, want = F.col("a") / F.lit(max(p, 1.0)), (F.col("n") - F.col("a")) / F.lit(max(n - p, 1.0))
    gap = F.abs(have - want) / F.sqrt((F.col("n") + 2) / F.lit(max(n, 1.0)))
    rate = (F.col("n") + 2) / F.lit(n + 4)
    sure = F.abs(have - want) >= deviations * F.sqrt(rate * (1 - rate) * F.lit(1 / max(p, 1.0) + 1 / max(n - p, 1.0)))
    counts = counts.select("term", "n", sure.alias("sure"), gap.alias("gap")).persist()
    best = [r.term for r in counts.filter("sure").orderBy(F.col("gap").desc(), "term").limit(max_terms).select("term").collect()]
    terms = np.sort(np.array(best, np.int64).view(np.uint64))
    if 0 < p < n:
        others = counts.filter(~F.coalesce("sure", F.lit(False)) & (F.col("n") < n)).orderBy(F.col("n").desc(), "term").limit(COMMON).select("term").collect()
        common = np.array([r.term for r in others], np.int64).view(np.uint64)
        terms = np.union1d(terms, pair_terms(sample, terms, common, counts.count(), max_terms)) if len(terms) + len(common) else terms
    counts.unpersist()
    if not len(terms):
        return fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), terms)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sieve_of(terms)
        for batch in batches:
            for i, j, data, offs in blocks(batch.column(0)):
                text, term = known_terms(data, offs, terms, sieve)
                sizes = np.bincount(text, minlength=j - i)
                yield pa.record_batch([batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(term.astype(np.int32)))], names=["y", "terms"])

    rows = sample.orderBy("doc_id").select("text", "y").mapInArrow(released(found), "y int, terms array<int>").toArrow()
    lists = rows.column("terms").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes, term, y = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), rows.column("y").to_numpy().astype(float)
    del rows, lists
    machine = fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), term, y, terms, decay=decay)
    del term
    release()
    return machine


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, held_out, score, predicted; labels (doc_id, toxic, ...).

    score: 0 to 1, of the whole text; predicted: 1 if score >= 0.5. Null and empty texts have the score of no terms.
    held_out: crc32 of the id as text, modulo 5, is 0 (false for a null id); such labels teach nothing. Repeated rows are scored one by one,
    other columns ignored; no rows give no rows, and without labels each text scores the same.
    """
    prepare(docs.sparkSession)
    return scored(docs, train(docs, labels, bound)).select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", "predicted")


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score, predicted of each row."""
    model = docs.sparkSession.sparkContext.broadcast((machine.terms, machine.bias, machine.w, machine.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        sieve = sieve_of(m.terms)
        for batch in batches:
            scores = [np.zeros(0)]
            for i, j, data, offs in blocks(batch.column(1)):
                none = np.zeros(0, np.int64)
                scores.append(m.scores(*(known_terms(data, offs, m.terms, sieve) if len(m.terms) else (none, none)), j - i))
            s = np.concatenate(scores)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, score double, predicted int")


def choose_settings(docs: DataFrame, labels: DataFrame, candidates: tuple[tuple[float, float], ...], folds: int = 3, bound: int = TRAIN_ROWS) -> dict[tuple[float, float], tuple[float, float, float]]:
    """For each (deviations, decay): log loss, recall and precision over folds of the training rows; rows of fold HELD take no part.

    Each fold is scored by a machine that learned from the others. The setting of least log loss is the one to take.
    """
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    mine = labels.filter((code % FOLDS != HELD) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), (F.floor(code / FOLDS) % folds).alias("fold")).checkpoint()
    out = {}
    for c in candidates:
        tests = None
        for fold in range(folds):
            machine = train(docs, mine.filter(F.col("fold") != fold), bound, deviations=c[0], decay=c[1])
            own = mine.filter(F.col("fold") == fold).select("doc_id", "toxic")
            part = scored(docs.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi"), machine).join(own, "doc_id")
            tests = part if tests is None else tests.union(part)
        p = F.greatest(F.least("score", F.lit(1 - 1e-9)), F.lit(1e-9))
        hit = (F.col("toxic") * F.col("predicted")).cast("double")
        r = tests.agg(F.avg(-F.when(F.col("toxic") == 1, F.log(p)).otherwise(F.log(1 - p))), F.sum(hit) / F.sum("toxic"), F.sum(hit) / F.greatest(F.sum("predicted"), F.lit(1))).first()
        out[c] = tuple(r)
    return out
