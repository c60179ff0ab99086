"""Classifiers by held-out accuracy and their edge cases; films by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafmill.llm import avi, licences, quality, toxicity
from leafmill.llm.queries import QUERIES
from tests.llm.helpers import EDGES, clashing, docs

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("name", "label", "mod", "held"), [("op5_quality", "quality", 3, 1), ("op9_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, mod, held):
    """At sf0.1, whose labels are some thousands; sf0.01 has six toxic ones in the held-out fold, too few to tell."""
    table, known = pq.read_table(f"{LARGE}/documents.parquet"), pq.read_table(f"{LARGE}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES[name](spark, LARGE).collect()}
    assert len(got) == table.num_rows and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % mod == held) for i, r in got.items())
    y = {i: v for i, v in zip(known["doc_id"].to_pylist(), known[label].to_pylist(), strict=True) if i in got and got[i].held_out}
    right = np.mean([got[i].predicted == v for i, v in y.items()])
    pos, neg = [got[i].score for i, v in y.items() if v], [got[i].score for i, v in y.items() if not v]
    area = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    recall = np.mean([got[i].predicted for i, v in y.items() if v])
    assert right >= 0.97 and area >= 0.97 and recall >= 0.85, (right, area, recall)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_tables(spark, score):
    d = clashing(docs(spark, [*EDGES, (None, "no id")]))
    for labels in ([], [(1, 1, 1), (2, None, None), (None, 1, 0)], [(i, i % 2, i % 2) for i in range(1, 10)]):
        got = score(d, labels_of(spark, labels)).collect()
        assert len(got) == len(EDGES) + 1 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert score(docs(spark, []), labels_of(spark, [(1, 1, 1)])).count() == 0


@pytest.mark.parametrize(("score", "mod", "held"), [(quality.score_quality, 3, 1), (toxicity.score_toxicity, 5, 0)])
def test_labels_of_the_held_out_fold_teach_nothing(spark, score, mod, held):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "bad", "word", "thing"]) for _ in range(20))) for i in range(400)]
    d = docs(spark, rows)
    truth = [(i, int("bad" in t), int("bad bad" in t)) for i, t in rows]
    flipped = [(i, 1 - q, 1 - x) if zlib.crc32(str(i).encode()) % mod == held else (i, q, x) for i, q, x in truth]
    a, b = (score(d, labels_of(spark, y)).orderBy("doc_id").collect() for y in (truth, flipped))
    assert a == b


def test_machine_is_the_sum_over_pairs():
    """score = sigmoid(b + sum w_i + sum over i < j of <v_i, v_j>), added up plainly."""
    rng = np.random.Generator(np.random.PCG64(5))
    m = toxicity.Machine(np.arange(9, dtype=np.uint64), 0.3, rng.normal(size=9), rng.normal(size=(3, 9)))
    has = rng.random((50, 9)) < 0.4
    got = m.scores(*np.nonzero(has), 50)
    for row, s in zip(has, got, strict=True):
        own = np.flatnonzero(row).tolist()
        total = m.bias + sum(m.w[i] for i in own) + sum(sum(float(f[i] * f[j]) for f in m.v) for n, i in enumerate(own) for j in own[n + 1 :])
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9


def test_whole_toxicity_score_is_brute_force(spark):
    """Terms found in texts one by one, with words and prefixes by a plain walk, give the scores of the query."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["Horrible", "horribly", "straße", "don't", "x" * 40]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25)))) for i in range(300)]
    d, y = docs(spark, rows), labels_of(spark, [(i, 0, int("orribl" in t)) for i, t in rows])
    m = toxicity.train(d, y)
    assert len(m.terms)

    def hashed(raw):
        return [int(h) for _, hs in toxicity.term_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) for h in hs]

    place = {int(h): k for k, h in enumerate(m.terms)}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, y).collect()}
    for i, t in rows:
        words, own = [], ""
        for c in t + " ":
            if c.isalnum() or ord(c) > 127:
                own += c
            elif own:
                words.append(own)
                own = ""
        held = sorted({place[h] for w in words for h in hashed(w.encode()) if h in place})
        total = m.bias + sum(m.w[k] for k in held) + sum(float(m.v[:, a] @ m.v[:, b]) for n, a in enumerate(held) for b in held[n + 1 :])
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_statistics_are_brute_force():
    """Each of STATS by its plain meaning, over a block of texts at once."""
    texts = [*(t or "" for _, t, _ in EDGES), "One two two, three!\nfour | five* $x\n\nfour | five* $x", "a  b\tc", "UPPER lower 123 (x) [y]?"]
    raw = [t.encode() for t in texts]
    got = quality.text_stats(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for r, row in zip(raw, got, strict=True):
        words = r.split()
        if not words:
            assert not row.any()
            continue
        low = [w.lower() for w in words]
        n, k = len(r), len(words)
        share = lambda group: sum(c in bytes(group) for c in r) / n  # noqa: B023, E731
        lines = [x for x in r.split(b"\n") if x]
        counts = [r.count(bytes([c])) / n for c in set(r)]
        want = {
            "n_bytes": np.log1p(n), "n_words": np.log1p(k), "word_bytes": sum(map(len, words)) / k, "distinct": len(set(low)) / k, "repeats": sum(a == b for a, b in zip(low, low[1:], strict=False)) / k,
            "top_byte": max([r.count(bytes([c])) / n for c in set(r) if c != 32], default=0), "entropy": -sum(c * np.log2(c) for c in counts), "pointed_ends": sum(w[-1] in b"#$%&*!|" for w in words) / k,
            "short_words": sum(len(w) == 1 for w in words) / k, "line_bytes": np.log1p(n / max(len(lines), 1)), "distinct_lines": len({x.lower() for x in lines}) / max(len(lines), 1),
        } | {g: share([int(c) for c in members]) for g, members in quality._GROUPS.items()}
        for name, v in zip(quality.STATS, row, strict=True):
            assert abs(v - want[name]) < 1e-9, (name, r[:40])


def test_whole_quality_score_is_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc $*!\n") for _ in range(rng.randrange(1, 200))) + "$*" * (i % 2) * 20) for i in range(300)]
    d, y = docs(spark, rows), labels_of(spark, [(i, 1 - i % 2, 0) for i, _ in rows])
    intercept, rules = quality.train(d, y)
    assert rules
    for r in quality.score_quality(d, y).collect():
        raw = rows[r.doc_id][1].encode()
        x = quality.text_stats(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        total = intercept + sum(c for c, rule in rules if all((x[j] > t) == greater for j, greater, t in rule))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_machine_learns_pairs():
    """Neither term alone tells the classes apart: only the pair does."""
    rng = np.random.Generator(np.random.PCG64(1))
    has = rng.random((4000, 2)) < 0.5
    y = (has[:, 0] == has[:, 1]).astype(float)
    text, term = np.nonzero(np.concatenate([has, np.ones((4000, 1), bool)], axis=1))
    m = toxicity.fit(text, term, y, np.arange(3, dtype=np.uint64), steps=400)
    assert ((m.scores(text, term, 4000) >= 0.5) == y).mean() > 0.95


def test_training_keeps_pairs(spark):
    """The terms of a pair reach the machine though each is as common in both classes."""
    rows = []
    for i in range(3000):
        a, b = i % 2, i // 2 % 2
        rows.append((i, " ".join(["plain", f"n{i % 37}", *["ant"] * a, *["bee"] * b]), a == b))
    d, y = docs(spark, [r[:2] for r in rows]), labels_of(spark, [(i, 0, int(t)) for i, _, t in rows])
    m = toxicity.train(d, y)
    data = np.frombuffer(b"ant bee", np.uint8)
    both = np.concatenate([h for _, h in toxicity.term_hashes(data, np.array([0, len(data)]))])
    assert np.isin(both, m.terms).all()
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, y).collect()}
    assert np.mean([got[i].predicted == t for i, _, t in rows if got[i].held_out]) > 0.95


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.random((300, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    rules = quality.tree_rules(x, y)
    b, w = quality.lasso_logistic(np.stack([quality.holds(r, x) for r in rules], axis=1).astype(float), y, 2e-3)
    kept = [(float(c), r) for c, r in zip(w, rules, strict=True) if c]
    assert 0 < len(kept) < len(rules)
    want = 1 / (1 + np.exp(-(b + sum(c * quality.holds(r, x) for c, r in kept))))
    assert ((want >= 0.5) == y).mean() > 0.95
    table = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i int, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = [r.s for r in table.withColumn("s", quality.score_column(b, kept)).orderBy("i").select("s").collect()]
    assert np.allclose(got, want)


LICENCES = [
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License", "MIT"), ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA"), ("GNU Lesser General Public License", "LGPL"), ("This is free and unencumbered software released into the public domain", "Unlicense"),
    ("The driver has a license to drive in the public domain of the town.", "unknown"), ("", "unknown"), (None, "unknown"), ("She went to the market and bought apples.", "unknown"),
]


def test_licences(spark):
    rows = [(i, t) for i, (t, _) in enumerate(LICENCES)]
    got = licences.scan_licences(clashing(docs(spark, rows))).orderBy("doc_id").collect()
    assert [r.licence for r in got] == [want for _, want in LICENCES]
    mixed = "Some prose first.\n\nLicensed under the Apache License, Version 2.0.\nMore prose.\nReleased under the MIT License"
    hits = licences.licence_paragraphs(docs(spark, [(7, mixed), (8, "nothing")])).orderBy("line").collect()
    assert [(r.doc_id, r.line, r.family) for r in hits] == [(7, 2, "Apache-2.0"), (7, 4, "MIT")]
    one = licences.scan_licences(docs(spark, [(7, mixed)])).first()
    assert (one.n_paragraphs, one.n_licences, one.families) == (4, 2, "Apache-2.0,MIT")
    assert licences.scan_licences(docs(spark, [])).count() == 0


MORE_LICENCES = [
    ("This file is not under the GNU GPL.", ""), ("He did not get an MIT license plate.", ""), ("All rights reserved seats were sold out.", ""), ("LGPL", "LGPL"), ("CC0", "CC0"), ("License: GPLv3", "GPL"), ("the history of the BSD license", ""), ("Dual licensed under the MIT License or the Apache License, Version 2.0", "Apache-2.0,MIT"),
    ("Copyright 2021 the authors. All rights reserved.", "proprietary"), (" ".join(["He walked on and did not look back for the rest of the day."] * 40) + " Licensed under the Apache License, Version 2.0. " + " ".join(["The sun was not up yet."] * 40), "Apache-2.0"), ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Apache-2.0"),
    (" \n\t\n", ""), ("word " * 200_000 + "\nReleased under the MIT License\n" + "x" * 100_000, "MIT"), ("LGPL", "LGPL"),
]


def test_denials_mentions_and_odd_texts(spark):
    """Denied and mentioned licences are none; several on a line, long and blank texts, repeated rows."""
    rows = [(i, t) for i, (t, _) in enumerate(MORE_LICENCES)] + [(i, t) for i, t, _ in EDGES]
    got = licences.scan_licences(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    own = {r.doc_id: r.families for r in licences.scan_licences(docs(spark, rows[: len(MORE_LICENCES)])).collect()}
    assert own == {i: want for i, (_, want) in enumerate(MORE_LICENCES)}
    assert {r.licence for r in licences.scan_licences(docs(spark, [(i, t) for i, t, _ in EDGES])).collect()} == {"unknown"}


def test_the_temperature_is_fitted_on_sentences_kept_apart():
    """A denial in words that were not learned looks like a grant, so many of the sentences kept apart are misjudged; the temperature owns up to that."""
    apart = [(t, c) for t, c, a in licences._examples() if a]
    assert len(apart) > 500 and not {t for t, _ in apart} & {t for t, _, a in licences._examples() if not a}
    m = licences.train()
    assert 0 < m["right_apart"] < 1 and m["temperature"] > 1


def test_statements_are_brute_force():
    """On single lines: every family whose template shares 0.6 of its n-grams and whose probability by a plain sum wins, by walking over n-grams as texts."""
    m = licences.train()
    index = {int(h): k for k, h in enumerate(m["terms"])}

    def grams(text):
        data = np.frombuffer(text.encode(), np.uint8)
        _, g = licences.ngrams(data, np.array([0, len(data)]))
        return {index[int(h)] for col in g for h in col if h and int(h) in index}

    sieve = np.zeros(1 << 18, bool)
    sieve[(m["terms"] & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    texts = [p for ps in licences.FAMILIES.values() for p in ps] + [t.format("GNU GPL") for t in licences._DENIED + licences._MENTIONED]
    for t in texts:
        have, want = grams(t), set()
        z = (sum(m["w"][k].astype(float) for k in sorted(have)) + m["bias"]) / m["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        for k, c in enumerate(m["of"].tolist()):
            template = set(np.flatnonzero(m["member"][:, k]).tolist())
            if len(have & template) / len(template) >= 0.6 and p.argmax() == c:
                want.add(m["names"][c])
        data = np.frombuffer(t.encode(), np.uint8)
        got = {f for _, _, f, _, _ in licences.classify(m, data, np.array([0, len(data)]), sieve)}
        if len(t.split()) <= 5:  # short enough that a template's context is the whole line
            assert got == want, (t, got, want)


WRAPPED = [
    ("Copyright (c) 2010, The Authors.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:\n\n1. Redistributions of source code", "BSD", "BSD,proprietary"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above", "ISC", "ISC"),
    ("REM Permission is hereby granted, free of charge, to any person obtaining\r\nREM a copy of this software and associated documentation\r\nREM files (the", "MIT", "MIT"),
    (" * you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2", "GPL", "GPL"),
    ("you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation", "LGPL", "LGPL"),
    ("This work is licensed under a Creative Commons Attribution-\nShareAlike 4.0 International License", "CC-BY-SA", "CC-BY-SA"),
    ("Redistribution and use in source and\nbinary forms, with or without modification, are permitted provided that the following conditions are met".replace(" ", "\n"), "BSD", "BSD"),
    ("He studied at MIT\nbefore he got a driving\nlicense.\nRedistribution and use\n\nin source and binary forms, with or", "unknown", ""),
]


def test_wrapped_licences(spark):
    """Statements go on over line feeds, not over blank lines."""
    rows = [(i, t) for i, (t, _, _) in enumerate(WRAPPED)]
    got = licences.scan_licences(docs(spark, rows)).orderBy("doc_id").collect()
    assert [(r.licence, r.families) for r in got] == [w[1:] for w in WRAPPED]
    hits = licences.licence_paragraphs(docs(spark, rows)).filter("doc_id < 2").orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.line, r.family, r.agreement) for r in hits] == [(0, 1, "proprietary", 1.0), (0, 3, "BSD", 1.0), (1, 0, "ISC", 1.0)]


def test_films_hold_any_bytes():
    rng = np.random.Generator(np.random.PCG64(3))
    for raw in (b"", b"a", bytes(range(256)), b"\xff" * 1000, rng.integers(0, 256, 70_001, dtype=np.uint8).tobytes()):
        payload = avi.pad(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(raw)] == raw
        film = avi.read_avi(avi.write_avi(payload))
        levels = avi.decode_levels(film.frames)
        assert levels.tobytes()[: film.stored] == payload
        slow = np.stack([avi._blocks(h, f[h.size : f.rfind(b"\xff\xd9")]) for f in film.frames for h in [avi.read_head(f)]])
        assert (slow.ravel() == levels.ravel()).all()


def test_media_query(spark):
    rows = [*EDGES, (99, EDGES[6][1], "x")]
    got = {r.doc_id: r for r in avi.media_features(clashing(docs(spark, rows))).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload, r = avi.pad(raw), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = avi.write_avi(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert tuple(got[6])[1:] == tuple(got[99])[1:] and got[1][1:] == got[2][1:]
    assert avi.media_features(docs(spark, [])).count() == 0


def test_shots_and_clips(spark):
    """Three scenes of one level each: cuts where they meet, clips with their times."""
    per_frame = avi.ACROSS * avi.MOST_ROWS
    levels = np.concatenate([np.full((20, per_frame), v, np.uint8) for v in (10, 120, 240)])
    assert avi.shots(levels) == [0, 20, 40] and avi.shots(levels[:1]) == [0] and avi.shots(levels[:20]) == [0]
    media = spark.createDataFrame([(1, bytearray(avi.write_avi(levels.tobytes()))), (2, None), (3, bytearray(b"no film"))], "doc_id long, media binary")
    got = avi.clips(media).orderBy("doc_id", "clip").collect()
    assert [(r.doc_id, r.clip, r.error) for r in got[3:]] == [(2, None, "not an AVI file"), (3, None, "not an AVI file")]
    assert [(r.doc_id, r.first_frame, r.n_frames, r.start_s, r.end_s, round(r.level)) for r in got[:3]] == [(1, 0, 20, 0.0, 0.8, 10), (1, 20, 20, 0.8, 1.6, 120), (1, 40, 20, 1.6, 2.4, 240)]
    assert avi.films(docs(spark, [(1, "abc")])).select(F.length("media")).first()[0] > 64


def jpeg_of(spark, rgb):
    """A colour JPEG by Java's own writer: baseline, chroma at half size, standard Huffman tables."""
    jvm, (h, w, _) = spark._jvm, rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int.from_bytes(rgb[y, x].tobytes(), "big"))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def without(jpeg, mark):
    at, out = 2, jpeg[:2]
    while jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        out += b"" if jpeg[at + 1] == mark else jpeg[at : at + 2 + size]
        at += 2 + size
    return out + jpeg[at:]


def avi_of(frames, parts=1, index=True, rec=False):
    """A film of JPEG files, in several RIFF parts, with or without an index and "rec " lists, and with an audio stream before the video."""
    chunk = avi._chunk
    audio, video = (chunk(b"LIST", b"strl" + chunk(b"strh", t + b"\0" * 16 + (1).to_bytes(4, "little") + (10).to_bytes(4, "little") + b"\0" * 20)) for t in (b"auds", b"vids"))
    out, each = b"", -(-len(frames) // parts)
    for p in range(parts):
        body, entries = b"movi", b""
        for f in frames[p * each : (p + 1) * each]:
            for name, data in ((b"00wb", b"sound"), (b"01dc", f)):
                entries += name + (0x10).to_bytes(4, "little") + len(body).to_bytes(4, "little") + len(data).to_bytes(4, "little")
                body += chunk(b"LIST", b"rec " + chunk(name, data)) if rec else chunk(name, data)
        head = chunk(b"LIST", b"hdrl" + audio + video) if not p else b""
        out += chunk(b"RIFF", (b"AVIX" if p else b"AVI ") + head + chunk(b"LIST", body) + (chunk(b"idx1", entries) if index and not p else b""))
    return out


def test_colour_films_of_another_writer(spark):
    """Frames of Java's writer, with their tables and without, in all layouts; block means against the pictures' own luminance."""
    rng = np.random.Generator(np.random.PCG64(8))
    pictures = [np.kron(rng.integers(0, 256, (3, 4, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8))[:21, :30] for _ in range(3)]
    frames = [jpeg_of(spark, p) for p in pictures]
    bare = [without(f, 0xC4) for f in frames]
    assert all(len(b) < len(f) for b, f in zip(bare, frames, strict=True))
    for layout in ({}, {"index": False}, {"index": False, "rec": True}, {"parts": 3}, {"parts": 2, "index": False}):
        for own in (frames, bare):
            film = avi.read_avi(avi_of(own, **layout))
            assert film.frames == own and film.fps == 10
    levels = avi.decode_levels(bare)
    assert (levels == avi.decode_levels(frames)).all() and levels.shape == (3, 12)
    for picture, got in zip(pictures, levels, strict=True):
        luma = picture @ np.array([0.299, 0.587, 0.114])
        for b, (y, x) in enumerate((y, x) for y in range(3) for x in range(4)):
            if y < 2 and x < 3:  # blocks that lie in the picture whole
                assert abs(luma[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].mean() - int(got[b])) <= 4
    media = [(1, bytearray(avi_of(bare, parts=3))), (2, bytearray(avi_of([frames[0][:-40]]))), (3, bytearray(avi_of([])))]
    got = avi.clips(spark.createDataFrame(media, "doc_id long, media binary")).orderBy("doc_id").collect()
    assert sum(r.n_frames for r in got if r.doc_id == 1) == 3 and got[-1].error == "no frames" and got[-2].error


def test_restart_intervals():
    """A frame of the writer, cut into restarts by hand, means the same."""
    levels = np.arange(48, dtype=np.uint8).reshape(1, 48) * 5
    whole = avi.write_avi(avi.pad(levels.tobytes()))
    want = avi.decode_levels(avi.read_avi(whole).frames)
    rows = [avi.read_avi(avi.write_avi(avi.pad(r.tobytes()))).frames[0] for r in want.reshape(-1, 8)]
    head = avi.jpeg_head(8)
    cut = head.index(b"\xff\xda")
    parts = []
    for r in rows:
        h = avi.read_head(r)
        bits = np.unpackbits(np.frombuffer(r[h.size : -2].replace(b"\xff\x00", b"\xff"), np.uint8))[:80]
        parts.append(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
    coded = b"".join(p + (b"\xff" + bytes([0xD0 + i % 8]) if i < 7 else b"") for i, p in enumerate(parts))
    film = head[:cut] + b"\xff\xdd\x00\x04\x00\x08" + head[cut:] + coded + b"\xff\xd9"
    assert (avi.decode_levels([film]) == want).all()
