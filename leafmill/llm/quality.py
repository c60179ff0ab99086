"""Quality by a sparse rule ensemble.

Boosted trees over text statistics give paths; each path, a conjunction of comparisons, is a rule. A lasso logistic
regression weighs rules, most of them with 0, and the rest is compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Words, blocks, fold_of, prepare
from .labelled import TRAIN_ROWS, labelled_sample

FOLDS, HELD = 3, 1
TREES, DEPTH, LEAST_LEAF = 40, 3, 15
_POINT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "spaces": list(b" \t\n\x0b\x0c\r"), "lines": [10], "points": _POINT,
    "commas": list(b",.;:'-"), "symbols": list(b"#$%&*+<=>@^_`~|\\/"), "bars": [124], "marks": list(b"!?"), "brackets": list(b"()[]{}"), "high": range(128, 256),
}
STATS = ["n_bytes", "n_words", "word_bytes", *_GROUPS, "distinct", "repeats", "top_byte", "entropy", "pointed_ends", "short_words", "line_bytes", "distinct_lines"]
_MEMBER = np.stack([np.isin(np.arange(256), list(g)) for g in _GROUPS.values()]).astype(np.float64)
_ENDS = np.isin(np.arange(256), list(b"#$%&*!|"))

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether greater, threshold)


def text_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATS for each text; shares are 0 where there is nothing to share."""
    n = len(offs) - 1
    out = np.zeros((n, len(STATS)))
    words = Words(data, offs, ~IS_SPACE)
    hashes = words.hashes()
    size = np.diff(offs)
    count = np.diff(words.first)
    text = np.repeat(np.arange(n), count)
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]))
    ends = np.concatenate([[0], np.cumsum(_ENDS[data[words.ends - 1]])]) if len(hashes) else np.zeros(1, int)
    short = np.concatenate([[0], np.cumsum(words.ends - words.starts <= 1)])
    rows = Words(data, offs, np.arange(256) != 10)
    line = rows.hashes()
    for d in range(n):
        a, b = words.first[d], words.first[d + 1]
        if b == a:
            continue
        tally = np.bincount(data[offs[d] : offs[d + 1]], minlength=256)
        share = tally / size[d]
        some = share[share > 0]
        la, lb = rows.first[d], rows.first[d + 1]
        out[d] = [
            np.log1p(size[d]), np.log1p(b - a), (words.ends[a:b] - words.starts[a:b]).mean(), *(_MEMBER @ share), len(np.unique(hashes[a:b])) / (b - a), (same[b] - same[a + 1]) / (b - a),
            np.delete(share, 32).max(), -(some * np.log2(some)).sum(), (ends[b] - ends[a]) / (b - a), (short[b] - short[a]) / (b - a), np.log1p(size[d] / max(lb - la, 1)), len(np.unique(line[la:lb])) / max(lb - la, 1),
        ]
    return out


def _stats_rows(extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((0, len(STATS)))] + [text_stats(data, offs) for _, _, data, offs in blocks(batch.column(extra))]
            stats = np.concatenate(parts)
            yield pa.record_batch([*(batch.column(i) for i in range(extra)), *(pa.array(np.ascontiguousarray(c)) for c in stats.T)], names=[*batch.schema.names[:extra], *STATS])

    return run


def with_stats(docs: DataFrame, keys: list[str]) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return docs.select(*keys, "text").mapInArrow(_stats_rows(len(keys)), f"{kept}, " + ", ".join(f"{s} double" for s in STATS))


def _grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray) -> None:
    if path:
        rules.append(path)
    total, weight = g[rows].sum(), h[rows].sum()
    best = (1e-3, None)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gs, hs, ns = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (total - gs) ** 2 / (weight - hs + 1) - total**2 / (weight + 1)
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        step[rows] = -total / (weight + 1)
        return
    j, k = best[1]
    low = binned[rows, j] <= k
    for side, greater in ((rows[low], False), (rows[~low], True)):
        _grow(x, edges, binned, g, h, side, depth - 1, (*path, (j, greater, float(edges[j][k]))), rules, step)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted trees, each on a half of the rows."""
    rng = np.random.Generator(np.random.PCG64(5))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    rules: list[Rule] = []
    at = np.full(len(y), np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        step = np.zeros(len(y))
        _grow(x, edges, binned, p - y, p * (1 - p), rows, depth, (), rules, step)
        at += 0.3 * step
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, greater, t in rule:
        out &= (x[:, j] > t) if greater else (x[:, j] <= t)
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """FISTA on the mean logistic loss with an L1 penalty; the intercept goes free."""
    n, k = x.shape
    w, b, z, zb, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    v = np.ones(k) / np.sqrt(max(k, 1))
    for _ in range(20):
        v = x.T @ (x @ v)
        size = np.linalg.norm(v)
        v = v / max(size, 1e-12)
    rate = 1 / (0.25 * (size / n + 1))
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ z + zb, -30, 30))) - y
        new = z - rate * (x.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        newb = zb - rate * g.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / s * (new - w), newb + (t - 1) / s * (newb - b)
        w, b, t = new, newb, s
    return b, w


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, penalty: float = 2e-4) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules, from labels.quality outside fold HELD of FOLDS, `bound` rows at most."""
    sample = labelled_sample(docs, labels, "quality", fold_of(F.col("doc_id"), FOLDS) == HELD, bound)
    rows = with_stats(sample.orderBy("doc_id"), ["y"]).toPandas()
    y, x = rows["y"].to_numpy(float), rows[STATS].to_numpy(float)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return float(np.log(rate / (1 - rate))), []
    rules = tree_rules(x, y)
    if not rules:  # too few rows to split
        return float(np.log(y.mean() / (1 - y.mean()))), []
    b, w = lasso_logistic(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y, penalty)
    return float(b), [(float(c), r) for c, r in zip(w, rules, strict=True) if c]


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for j, greater, t in rule:
        out = out & ((F.col(STATS[j]) > F.lit(t)) if greater else (F.col(STATS[j]) <= F.lit(t)))
    return out


def score_column(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The ensemble as one expression over STATS. Rules are added up in groups, which keeps the expression shallow."""
    parts = [F.when(rule_column(r), F.lit(c)).otherwise(F.lit(0.0)) for c, r in rules]
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    total = F.lit(intercept) + (parts[0] if parts else F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, held_out, score, predicted; labels (doc_id, quality, ...).

    score: 0 to 1, likelihood of label 1 for the whole text; predicted: 1 if score >= 0.5. Null, empty and blank texts have
    statistics of 0 and a score like any other. held_out: crc32 of the id as text, modulo 3, is 1 (false for a null id); such labels teach nothing.
    Repeated rows are scored one by one, other columns ignored; no rows give no rows, and without labels each text scores 0.5.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels, bound)
    scored = with_stats(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"]).withColumn("score", score_column(*model))
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
