"""Licence scans by a trained paragraph classifier.

Word n-grams (one to three words) are the features of a softmax regression over licence families and "unknown", which learns from
names and clauses of licences in their usual company, and for the unknown class from prose, from denials ("not under the GNU GPL") and from
mentions ("an MIT license plate"). Its temperature is fitted on sentences that took no part in the training. Statements are sought in each
line, and in each run of lines over whose line feeds n-grams of one template go on; a line without words ends a run. A family counts where one of its
templates agrees and the classifier takes the template's words, with CONTEXT words around, for that family.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SLOT, IS_TERM, Words, blocks, mix, prepare

#: How licence statements name each family. They are public phrases; each is a template of its family.
FAMILIES = {
    "MIT": ["MIT License", "the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Expat license", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0", "SPDX-License-Identifier: Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "distributed under the License is distributed on an AS IS BASIS"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPLv3", "GPL v2", "GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "LGPL", "LGPL-2.1", "LGPLv3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["GNU Affero General Public License", "AGPL", "AGPLv3", "AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["BSD license", "BSD 3-Clause License", "BSD-2-Clause", "New BSD License", "Simplified BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "creativecommons.org/licenses/by/4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike", "creativecommons.org/licenses/by-sa/3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike", "creativecommons.org/licenses/by-nc/4.0"],
    "CC0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero", "dedicated to the public domain under CC0", "creativecommons.org/publicdomain/zero/1.0"],
    "ISC": ["ISC License", "the ISC license", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["The Unlicense", "This is free and unencumbered software released into the public domain", "unlicense.org"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 1.0", "EPL-2.0", "Eclipse Public License"],
    "proprietary": ["All rights reserved", "Confidential and proprietary", "may not be reproduced without the prior written permission of the publisher", "proprietary license agreement", "unauthorized copying of this file is strictly prohibited"],
}
_LEADS = ["", "", "Licensed under the", "Released under the", "This work is licensed under the", "This software is distributed under", "Available under the terms of the", "License:", "Copyright 2021 the authors.", "The code is covered by the", "Content is available under"]
_TAILS = ["", "", "", ".", "See the LICENSE file for details.", "by the contributors", "unless otherwise noted"]
_OTHER = [
    "the driver got a license to drive", "the licence fee of the broadcaster", "a license plate was found near the house", "he studied at MIT before he moved", "the apache helicopter took off", "the general public was invited to the opening", "public transport is free of charge for children", "the version of the text that was printed",
    "creative work in the commons of the town", "attribution of the painting is in doubt", "released under a full moon", "licensed under the terms of the vendor", "all rights of the child", "Mozilla and Eclipse met in the night", "permission of the owner is needed", "subject to the terms of the sale", "this work is hard", "released to the public", "under the bridge", "the copy of the book", "software of any kind",
    "commercial use of the harbour", "terms and conditions apply", "a person obtaining a passport", "the names of its members", "distribution of goods in the region", "see the file for details", "by the contributors to the fair", "unless otherwise noted the shop is open", "available at the counter", "the authors of the study", "content of the box", "license", "licensed", "under the license", "copyright", "version 2.0", "4.0", "GNU", "public license",
]
#: What denies a licence, or speaks of it without granting it; {} is its name.
_DENIED = [
    "this file is not under the {}", "it is not licensed under the {}", "not released under the {}", "no longer available under the {}", "it was never published under the {}", "is incompatible with the {}", "unlike the {} it forbids copying", "we do not use the {}", "without the {}", "instead of the {}", "is not covered by the {}", "cannot be distributed under the {}",
]
_MENTIONED = [
    "he did not get an {} plate", "the {} plate of the car", "the history of the {}", "a lawyer explained the {}", "an article about the {}", "critics of the {} say", "{} seats were sold out", "{} holders met in town", "the {} was debated for years", "what does the {} mean", "she read the {} twice", "compare it with the {}",
]
UNKNOWN = "unknown"
LEAST_AGREEMENT = 0.6
#: Words on either side of a template's words that the classifier sees, and words without a part in the template within them.
CONTEXT, GAP = 4, 6
#: The unknown class's share of the training's weight; every fourth sentence around a phrase is kept apart for the temperature.
UNKNOWN_SHARE, APART = 0.5, 4


#: Words that open each line of a comment in some languages; they don't part a statement.
_COMMENT = Words(np.frombuffer(b"rem dnl c", np.uint8), np.array([0, 9]), IS_TERM).hashes()


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    """Words, and hashes of the n-grams that start at each word, over line feeds too; 0 where a line without words or the text's end comes before theirs."""
    w = Words(data, offs, IS_TERM)
    h = w.hashes()
    line_of = np.concatenate([[0], np.cumsum(data == 10)])[w.starts] if len(data) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    unit = line_of + text_of  # ascending, and apart for each line of each text
    keep = (np.diff(unit, prepend=-1) == 0) | ~np.isin(h, _COMMENT)
    if not keep.all():
        w.starts, w.ends, h, unit, text_of = (x[keep] for x in (w.starts, w.ends, h, unit, text_of))
        w.first = np.searchsorted(w.starts, offs)
    part = np.cumsum((np.diff(unit, prepend=0) > 1) | (np.diff(text_of, prepend=0) > 0))
    out = [h]
    for n in (2, 3):
        g = np.zeros(len(h), np.uint64)
        if len(h) >= n:
            total = np.full(len(h) - n + 1, n, np.uint64)
            for j in range(n):
                total += h[j : len(h) - n + 1 + j] * _SLOT[j]
            g[: len(h) - n + 1] = np.where(part[: len(h) - n + 1] == part[n - 1 :], mix(total), 0)
        out.append(g)
    w.unit, w.text, w.part = unit, text_of, part
    return w, out


def _features(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w, grams = ngrams(data, offs)
    return [np.unique(np.concatenate([g[a:b][g[a:b] != 0] for g in grams])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _examples() -> list[tuple[str, int, bool]]:
    """(text, class, kept apart). Every fourth wrapping, denial, mention and line of prose is kept apart, with all phrases in it.

    The classifier is asked only where a template agrees, so what is new to it in use is the company that a phrase keeps, not the phrase.
    """
    out, last = [], len(FAMILIES)
    apart = lambda n: n % APART == APART - 1
    for c, phrases in enumerate(FAMILIES.values()):
        for n, p in enumerate(phrases):
            out.append((p, c, False))
            for k in range(n, len(_LEADS) * len(_TAILS), 7):
                lead, tail = k % len(_LEADS), k // len(_LEADS)
                out.append((f"{_LEADS[lead]} {p} {_TAILS[tail]}", c, apart(lead)))
            if len(p.split()) <= 6:
                out += [(t.format(p), last, apart(m)) for m, t in enumerate([*_DENIED, *_MENTIONED])]
    parts = [*_OTHER, *filter(None, _LEADS), *filter(None, _TAILS)]
    for (i, a), b in itertools.product(enumerate(parts), parts[::5]):
        out.append((f"{a} {b}", last, apart(i)))
    return out


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_terms: int, n_classes: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax regression by Adam; rows ascend, each has a term. The unknown class alone has a bias, learned: without terms nothing speaks for a family."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    total = np.bincount(y, minlength=n_classes).astype(float)
    share = np.full(n_classes, (1 - UNKNOWN_SHARE) / (n_classes - 1))
    share[-1] = UNKNOWN_SHARE
    weight = (share / np.maximum(total, 1))[y]
    w, b, state = np.zeros((n_terms, n_classes)), np.zeros(n_classes), [0.0, 0.0, 0.0, 0.0]
    for step in range(1, steps + 1):
        g = _softmax(np.add.reduceat(w[cols], first, axis=0) + b)
        g[np.arange(len(y)), y] -= 1
        g *= weight[:, None]
        spread = g[rows]
        d = np.stack([np.bincount(cols, spread[:, c], n_terms) for c in range(n_classes)], axis=1) + 1e-5 * w
        for i, (x, dx) in enumerate(((w, d), (b, g.sum(axis=0) * (np.arange(n_classes) == n_classes - 1)))):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * dx
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * dx * dx
            x -= 0.05 * (state[2 * i] / (1 - 0.9**step)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**step)) + 1e-8)
    return w, b


@functools.cache
def train(steps: int = 120) -> dict:
    """The model: terms (sorted hashes), weights (terms x classes), biases, temperature, and the templates' n-grams. Small and made from the phrases above alone."""
    names = [*FAMILIES, UNKNOWN]
    texts, y, apart = (list(x) for x in zip(*_examples(), strict=True))
    found, y, apart = _features(texts), np.array(y), np.array(apart)
    terms = np.unique(np.concatenate(found))
    rows, cols = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.searchsorted(terms, np.concatenate(found))

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = which[rows]
        return (np.cumsum(which) - 1)[rows[inside]], cols[inside], y[which]

    w, bias = _fit(*part(~apart), len(terms), len(names), steps)
    r, c, yv = part(apart)
    z = np.add.reduceat(w[c], np.flatnonzero(np.diff(r, prepend=-1)), axis=0) + bias
    temperature = min(np.linspace(0.5, 6, 56), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(yv)), yv] + 1e-12).mean())
    w, bias = _fit(rows, cols, y, len(terms), len(names), steps)
    templates = [np.searchsorted(terms, t) for p in FAMILIES.values() for t in _features(p)]
    member = np.zeros((len(terms), len(templates)), bool)
    for k, t in enumerate(templates):
        member[t, k] = True
    of = np.repeat(np.arange(len(FAMILIES)), [len(p) for p in FAMILIES.values()])
    right = float((z.argmax(axis=1) == yv).mean())
    return {"names": names, "terms": terms, "w": w.astype(np.float32), "bias": bias, "temperature": float(temperature), "of": of, "member": member, "right_apart": right}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Statement:
    unit: int  # of its first line
    family: int
    probability: float
    agreement: float
    words: frozenset  # that the template agrees on


class Hits:
    """Terms of the model in a stretch of words, in order of their words: numbers, first and last words, and lines of these."""

    def __init__(self, w: Words, at: np.ndarray, word: np.ndarray, last: np.ndarray):
        self.at, self.word, self.last = at, word, last
        self.a, self.b = w.unit[word], w.unit[last]

    def within(self, i: int, j: int) -> np.ndarray:
        """Which lie in lines i to j."""
        lo, hi = np.searchsorted(self.a, i), np.searchsorted(self.a, j, "right")
        return lo + np.flatnonzero(self.b[lo:hi] <= j)


def _runs(a: np.ndarray, b: np.ndarray, term: np.ndarray, size: int) -> set[tuple[int, int]]:
    """Runs of lines that hold enough of a template's n-grams (of `size`), which lie in lines a to b.

    Only n-grams carry a run over a line feed. The shortest runs that hold enough are grown while a line more holds n-grams that the run lacks; each step counts.
    """
    out: set[tuple[int, int]] = set()
    feeds = np.unique(np.concatenate([a[b > a], b[b > a] - 1]))
    for feed in np.split(feeds, np.flatnonzero(np.diff(feeds) > 1) + 1):
        low, high = int(feed[0]), int(feed[-1]) + 1
        mine = slice(np.searchsorted(a, low), np.searchsorted(a, high, "right"))
        x, y, t = a[mine], b[mine], term[mine]

        def held(i: int, j: int) -> set:
            lo, hi = np.searchsorted(x, i), np.searchsorted(x, j, "right")  # noqa: B023
            return set(t[lo:hi][y[lo:hi] <= j].tolist())  # noqa: B023

        ending: dict[int, list] = {}
        for p, q, k in zip(x.tolist(), y.tolist(), t.tolist(), strict=True):
            ending.setdefault(q, []).append((p, k))
        starting: dict[int, list] = {}
        count: Counter[int] = Counter()
        i, before = low, low - 1
        for j in range(low, high + 1):
            for p, k in ending.get(j, ()):
                if p >= i:
                    starting.setdefault(p, []).append(k)
                    count[k] += 1
            while i < j:
                gone = Counter(starting.get(i, ()))
                if (len(count) - sum(count[k] == n for k, n in gone.items())) / size < LEAST_AGREEMENT:
                    break
                count -= gone
                i += 1
            if len(count) / size >= LEAST_AGREEMENT and i > before:
                before, p, q = i, i, j
                have = held(p, q)
                while (p, q) not in out:
                    if q > p:
                        out.add((p, q))
                    wider = [(len(h), u, v, h) for u, v in ((p, q + 1), (p - 1, q)) if low <= u and v <= high for h in [held(u, v)]]
                    n, u, v, h = max(wider, key=lambda c: c[0], default=(0, p, q, have))
                    if n <= len(have):
                        break
                    p, q, have = u, v, h
    return out


def _statements(model: dict, hits: Hits, some: np.ndarray) -> Iterator[Statement]:
    """The licence statements in some hits: for each family the template that agrees most, where the classifier confirms it."""
    at, word, last = hits.at[some], hits.word[some], hits.last[some]
    have, sizes = np.unique(at), model["member"].sum(axis=0)
    agreement = model["member"][have].sum(axis=0) / sizes
    for c in np.unique(model["of"][agreement >= LEAST_AGREEMENT]).tolist():
        best, out = None, None
        for k in np.flatnonzero((model["of"] == c) & (agreement >= LEAST_AGREEMENT)).tolist():
            own = model["member"][at, k] & ((last > word) if sizes[k] > 1 else True)
            covered = np.unique(np.concatenate([word[own], last[own]]))
            for cluster in np.split(covered, np.flatnonzero(np.diff(covered) > GAP) + 1):
                if not len(cluster):
                    continue
                lo, hi = cluster[0], cluster[-1]
                inside = own & (word >= lo) & (last <= hi)
                near = (word >= lo) & (last <= hi)
                held = len(np.unique(at[near & model["member"][at, k]])) / sizes[k]
                if held < LEAST_AGREEMENT or best is not None and (held, inside.sum()) <= best:
                    continue
                seen = np.unique(at[(word >= lo - CONTEXT) & (last <= hi + CONTEXT)])
                p = _softmax(((model["w"][seen].sum(axis=0) + model["bias"]) / model["temperature"])[None])[0]
                if int(p.argmax()) == c:
                    words = frozenset(w for x, y in zip(word[inside].tolist(), last[inside].tolist(), strict=True) for w in range(x, y + 1))
                    best, out = (held, inside.sum()), Statement(int(hits.a[some[0]]), c, float(p[c]), float(held), words)
        if out is not None:
            yield out


def _settle(found: list[Statement]) -> list[Statement]:
    """Of statements that rest on the same words the one whose template agrees most."""
    claimed: dict[int, int] = {}
    out = []
    for s in sorted(found, key=lambda s: (-s.agreement, -len(s.words), -s.probability, s.unit)):
        taken = [claimed[k] for k in s.words if k in claimed]
        if s.family not in taken and (2 * len(taken) < len(s.words) or not taken):
            out.append(s)
            claimed.update(dict.fromkeys(s.words, s.family))
    return out


def classify(model: dict, data: np.ndarray, offs: np.ndarray, sieve: np.ndarray) -> list[tuple[int, int, str, float, float]]:
    """(text, line, family, probability, agreement) of the licence statements; line is the first of those it runs over."""
    terms, names, member = model["terms"], model["names"], model["member"]
    w, grams = ngrams(data, offs)
    at, word, last = [], [], []
    for n, g in enumerate(grams):
        few = np.flatnonzero(sieve[(g & np.uint64(len(sieve) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(terms, g[few]), len(terms) - 1)
        hit = terms[k] == g[few]
        at.append(k[hit])
        word.append(few[hit])
        last.append(few[hit] + n)
    at, word, last = np.concatenate(at), np.concatenate(word), np.concatenate(last)
    if not len(at):
        return []
    order = np.argsort(word, kind="stable")
    hits = Hits(w, at[order], word[order], last[order])
    inside = hits.a == hits.b
    sizes = member.sum(axis=0)
    found: dict[int, list[Statement]] = {}
    pairs = np.unique(np.stack([hits.a[inside], hits.at[inside]]), axis=1)
    first = np.flatnonzero(np.diff(pairs[0], prepend=-1))
    held = np.add.reduceat(member[pairs[1]], first, axis=0, dtype=np.int32) / sizes if len(first) else np.zeros((0, len(sizes)))
    for u in pairs[0, first[(held >= LEAST_AGREEMENT).any(axis=1)]].tolist():
        some = hits.within(u, u)
        for s in _statements(model, hits, some):
            found.setdefault(int(w.part[hits.word[some[0]]]), []).append(s)
    # runs of lines: stretches without a blank line in which a template is held, with n-grams over line feeds
    part = w.part[hits.word]
    crossing = np.unique(part[~inside])
    mine = np.flatnonzero(np.isin(part, crossing))
    if len(mine):
        both = np.unique(np.stack([part[mine], hits.at[mine]]), axis=1)
        over = np.unique(np.stack([part[~inside], hits.at[~inside]]), axis=1)
        held, crossed = (np.add.reduceat(member[x[1]], np.flatnonzero(np.diff(x[0], prepend=-1)), axis=0, dtype=np.int32) for x in (both, over))
        wanted = (held / sizes >= LEAST_AGREEMENT) & (crossed > 0)
        for k in np.flatnonzero(wanted.any(axis=1)).tolist():
            own = slice(np.searchsorted(part, crossing[k]), np.searchsorted(part, crossing[k], "right"))
            a, b, t = hits.a[own], hits.b[own], hits.at[own]
            runs: set[tuple[int, int]] = set()
            for c in np.flatnonzero(wanted[k]).tolist():
                of = member[t, c]
                runs |= _runs(a[of], b[of], t[of], int(sizes[c]))
            more = [s for i, j in sorted(runs) for s in _statements(model, hits, hits.within(i, j))]
            if more:
                found.setdefault(int(crossing[k]), []).extend(more)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    out = []
    for s in sorted(itertools.chain(*map(_settle, found.values())), key=lambda s: (s.unit, names[s.family])):
        text = int(w.text[np.searchsorted(w.unit, s.unit)])
        out.append((text, int(s.unit - text - newlines[offs[text]]), names[s.family], s.probability, s.agreement))
    return out


def _scanner(model):
    def blocks_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list]]:
        m = model.value
        sieve = np.zeros(1 << 18, bool)
        sieve[(m["terms"] & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        for i, j, data, offs in blocks(column):
            yield i, j, data, offs, classify(m, data, offs, sieve)

    return blocks_of


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to a row for each licence statement: doc_id, line (from 0; its first), family, probability, agreement."""
    prepare(docs.sparkSession)
    scan = _scanner(docs.sparkSession.sparkContext.broadcast(train()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, _, hits in scan(batch.column(1)):
                if hits:
                    t, line, family, p, a = zip(*hits, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array([i + k for k in t])), pa.array(line, pa.int32()), pa.array(family), pa.array(p), pa.array(a)], names=["doc_id", "line", "family", "probability", "agreement"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line int, family string, probability double, agreement double")


def scan_licences(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_paragraphs, n_licences, licence, families, probability: a row for each row.

    licence: the family of the likeliest statement, the first of equals, or "unknown"; families: all, sorted, joined by a comma; probability: of the likeliest
    statement, 0 without one. n_paragraphs counts lines with a character; a statement may run over several, up to a line without words. Null and empty texts have no paragraphs and are unknown. Rows that
    repeat are scanned one by one; other columns are ignored; no rows give no rows.
    """
    prepare(docs.sparkSession)
    scan = _scanner(docs.sparkSession.sparkContext.broadcast(train()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs, hits in scan(batch.column(1)):
                n = np.diff(Words(data, offs, np.arange(256) != 10).first)
                found: dict[int, list] = {}
                for t, line, family, p, _ in hits:
                    found.setdefault(t, []).append((-p, line, family))
                own = [sorted(found.get(t, [])) for t in range(j - i)]
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array([len(o) for o in own], pa.int64()), pa.array([o[0][2] if o else UNKNOWN for o in own]), pa.array([",".join(sorted({x[2] for x in o})) for o in own]), pa.array([-o[0][0] if o else 0.0 for o in own])],
                    names=["doc_id", "n_paragraphs", "n_licences", "licence", "families", "probability"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_paragraphs long, n_licences long, licence string, families string, probability double")
