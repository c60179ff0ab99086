"""Motion-JPEG in AVI: a writer that stores bytes losslessly, a reader that decodes intra frames, and shot detection.

A byte is stored as the level of an 8 x 8 block of a baseline grey JPEG: with a DC quantiser of 8 the coefficient is the level
less 128, so any decoder gets the level back in all 64 pixels. The Huffman table gives the category of s bits a code of
9 - s bits (1 for the eight-bit category, 9 for the empty one): then each DC difference takes 9 bits and, with a
one-bit end of block, each block 10. Whole films thus turn into arrays and back without a loop over symbols. Other
baseline frames, grey or in colour, with their own tables or without, are decoded block by block; of colour the luminance counts.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

UNIT, ACROSS, MOST_ROWS, FPS = 64, 8, 128, 25
#: Frames that are coded or decoded at a time.
SOME = 256
#: A shot begins where histograms differ by more than FLOOR and by more than mean + SPREAD deviations of the WINDOW differences before.
BINS, WINDOW, FLOOR, SPREAD = 16, 8, 0.25, 3.0


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """10-bit words of DC differences -255 to 255 (with the end of block), and differences of 9-bit words."""
    to, back = np.zeros(511, np.uint64), np.zeros(512, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = ((1 << (9 - s)) - 2) if s else 0b111111110
        word = code << s | (d if d >= 0 else d + (1 << s) - 1)
        to[d + 255], back[word] = word << 1, d
    return to, back


_TO, _BACK = _codes()


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


_TABLES = _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1]) * 63) + _segment(0xC4, bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))) + _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))


def jpeg_head(rows: int) -> bytes:
    return b"\xff\xd8" + _TABLES + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0])) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _coded(levels: np.ndarray) -> list[bytes]:
    """The entropy-coded data of some frames, a row of levels each."""
    words = _TO[np.diff(levels.astype(np.int16), axis=1, prepend=np.int16(128)) + 255].reshape(len(levels), -1, 4)
    packed = (words[:, :, 0] << np.uint64(54)) | (words[:, :, 1] << np.uint64(44)) | (words[:, :, 2] << np.uint64(34)) | (words[:, :, 3] << np.uint64(24))
    coded = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(len(levels), -1, 8)[:, :, :5]).reshape(len(levels), -1)
    return [f.tobytes().replace(b"\xff", b"\xff\x00") for f in coded]


def write_avi(payload: bytes) -> bytes:
    """A film of the payload, whose length is a positive multiple of 64. The stream's own data (strd) says how long it is. SOME frames are coded at a time."""
    rows = len(payload) // ACROSS
    frames = -(-rows // MOST_ROWS)
    each = -(-rows // frames)
    head, body, index, at, largest = jpeg_head(each), [], [], 4, 0
    size = each * ACROSS
    for first in range(0, frames, SOME):
        n = min(SOME, frames - first)
        part = np.frombuffer(payload, np.uint8, min(n * size, len(payload) - first * size), first * size)
        for coded in _coded(np.pad(part, (0, n * size - len(part))).reshape(n, size)):
            jpeg = head + coded + b"\xff\xd9"
            body.append(_chunk(b"00dc", jpeg))
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
            at, largest = at + len(body[-1]), max(largest, len(body[-1]))
    width, height = ACROSS * 8, each * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 10000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    stream = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", stream))
    # the movi list is joined once, as it is nearly the whole film
    tail = _chunk(b"idx1", b"".join(index))
    movi = sum(map(len, body)) + 4
    return b"".join([b"RIFF", struct.pack("<I", 4 + len(header) + 8 + movi + len(tail)), b"AVI ", header, b"LIST", struct.pack("<I", movi), b"movi", *body, tail])


@dataclass
class Film:
    frames: list[bytes]  # JPEG files, in order
    fps: float
    stored: int | None  # bytes of a payload, if the stream says so


def read_avi(media: bytes) -> Film:
    """Frames of the first video stream by the index (idx1) or, without one, by walking the movi lists with their "rec " lists; of every further RIFF part
    (OpenDML's AVIX) by walking. Raises ValueError if it isn't an AVI file.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, stored, index, video, streams = float(FPS), None, None, None, 0
    frames: list[bytes] = []
    start, part = 0, 0
    while start + 12 <= len(media) and media[start : start + 4] == b"RIFF":
        end = min(len(media), start + 8 + struct.unpack_from("<I", media, start + 4)[0])
        movies, todo = [], [(start + 12, end)]
        while todo:
            at, stop = todo.pop(0)
            while at + 8 <= stop:
                name, size = struct.unpack_from("<4sI", media, at)
                body = at + 8
                if name == b"LIST":
                    if media[body : body + 4] == b"movi":
                        movies.append((body, min(body + size, stop)))
                    else:
                        todo.append((body + 4, min(body + size, stop)))
                elif name == b"strh" and size >= 28:
                    if media[body : body + 4] == b"vids" and video is None:
                        scale, per = struct.unpack_from("<II", media, body + 20)
                        rate, video = (per / scale if scale and per else rate), b"%02d" % streams
                    streams += 1
                elif name == b"strd" and size == 8:
                    stored = struct.unpack_from("<Q", media, body)[0]
                elif name == b"idx1":
                    index = (body, min(size, stop - body) // 16)
                at = body + size + (size & 1)
        if not movies and not part:
            raise ValueError("no movi list")
        own = lambda name: name[2:] in (b"dc", b"db") and (video is None or name[:2] == video)  # noqa: B023, E731
        if index and not part:
            entries = [struct.unpack_from("<4sIII", media, index[0] + 16 * i) for i in range(index[1])]
            base = movies[0][0] if not entries or entries[0][2] < movies[0][0] else 0  # offsets count from movi, in some files from the start
            frames += [media[base + off + 8 : base + off + 8 + size] for name, _, off, size in entries if own(name)]
        else:
            walk = [(a + 4, b) for a, b in movies]
            while walk:
                at, stop = walk.pop(0)
                while at + 8 <= stop:
                    name, size = struct.unpack_from("<4sI", media, at)
                    if name == b"LIST":
                        at += 12  # its chunks stand in line with the others
                        continue
                    if own(name):
                        frames.append(media[at + 8 : at + 8 + size])
                    at += 8 + size + (size & 1)
        start, part = end + (end & 1), part + 1
    return Film([f for f in frames if f], rate, stored)


@dataclass
class Head:
    width: int
    height: int
    parts: list[tuple[int, int, int, dict, dict]]  # of each component of the scan: blocks across and down in a unit, DC quantiser, tables ((length, code) to symbol)
    across: int  # the most blocks of a component in a unit
    down: int
    every: int  # units between restarts, or 0
    flat: bool  # one of the writer's tables: every block takes ten bits
    size: int


_heads: dict[bytes, Head] = {}

# Fixed values of the JPEG standard, annex K.3: how many codes each length from 1 to 16 has, and the symbols in order. Films may leave them out.
_STANDARD = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12))),
    0x10: (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
            "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    0x11: (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        bytes.fromhex(
            "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
            "82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}


def _table(counts, symbols: bytes) -> dict:
    code, k, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def read_head(jpeg: bytes) -> Head:
    """The segments up to the scan; baseline, with all components in one scan."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quants, tables, frame, every = 2, {}, {k: _table(*t) for k, t in _STANDARD.items()}, None, 0
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("broken JPEG segments")
        mark = jpeg[at + 1]
        if mark == 0xFF:  # fill
            at += 1
            continue
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                tables[body[0]] = _table(body[1:17], body[17:])
                body = body[17 + sum(body[1:17]) :]
        elif mark == 0xDD:
            every = struct.unpack_from(">H", body)[0]
        elif mark in (0xC0, 0xC1):
            deep, height, width, parts = struct.unpack_from(">BHHB", body)
            if deep != 8:
                raise ValueError("only samples of 8 bits are decoded")
            frame = (width, height, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)}, body[6])
        elif mark in (0xC2, 0xC3) or 0xC5 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        at += 2 + size
        if mark == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    width, height, of, first = frame
    scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
    if [c for c, _ in scan] != list(of) or not width or not height:
        raise ValueError("components in scans of their own")
    if len(scan) == 1:
        of = {first: (1, 1, of[first][2])}  # a lone component is not interleaved
    parts = [(*of[c][:2], quants[of[c][2]], tables.get(t >> 4, {}), tables.get(16 + (t & 15), {})) for c, t in scan]
    flat = len(parts) == 1 and _TABLES in jpeg[:at] and not every
    return Head(width, height, parts, max(p[0] for p in parts), max(p[1] for p in parts), every, flat, at)


def _blocks(head: Head, coded: bytes) -> np.ndarray:
    """Mean levels of the 8 x 8 blocks of the first component (grey, or luminance), row by row; AC terms are read and passed over, as they don't change a mean."""
    wide, high = -(-head.width // (8 * head.across)), -(-head.height // (8 * head.down))
    h0, v0 = head.parts[0][:2]
    out = np.zeros((high * v0, wide * h0))
    unit, pieces = 0, re.split(rb"\xff+[\xd0-\xd7]", coded) if head.every else [coded]
    for piece in pieces:
        bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist() + [1] * 64
        at, last = 0, [0] * len(head.parts)

        def symbol(table: dict) -> int:
            nonlocal at
            code, length = 0, 0
            while length < 16:
                code, length, at = code << 1 | bits[at], length + 1, at + 1  # noqa: B023
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("broken Huffman code")

        def number(size: int) -> int:
            nonlocal at
            x = 0
            for b in bits[at : at + size]:  # noqa: B023
                x = x << 1 | b
            at += size
            return x if not size or x >> (size - 1) else x - (1 << size) + 1

        until = min(unit + head.every, wide * high) if head.every else wide * high
        for u in range(unit, until):
            for p, (h, v, quant, dc, ac) in enumerate(head.parts):
                for b in range(h * v):
                    last[p] += number(symbol(dc))
                    if not p:
                        out[u // wide * v + b // h, u % wide * h + b % h] = last[0] * quant / 8 + 128
                    k = 1
                    while k < 64:
                        run = symbol(ac)
                        if run == 0:
                            break
                        number(run & 15)
                        k += (run >> 4) + 1
        unit = until
    if unit < wide * high:
        raise ValueError("frame data ends early")
    return np.clip(np.round(out[: -(-head.height * v0 // (8 * head.down)), : -(-head.width * h0 // (8 * head.across))]), 0, 255).astype(np.uint8).ravel()


def decode_levels(frames: list[bytes]) -> np.ndarray:
    """Block levels, a row for each frame; the frames have one size."""
    if not frames:
        return np.zeros((0, 0), np.uint8)
    cut = frames[0].find(b"\xff\xda")
    key = frames[0][: cut + 2 + struct.unpack_from(">H", frames[0], cut + 2)[0]] if cut >= 0 else b""
    head = _heads.get(key)
    if head is None:
        head = read_head(frames[0])
        if len(_heads) < 512:
            _heads[frames[0][: head.size]] = head
    own = frames[0][: head.size]
    if head.flat and all(f.startswith(own) for f in frames):
        n = (head.width // 8) * (head.height // 8)
        out = np.empty((len(frames), n), np.uint8)
        for i in range(0, len(frames), SOME):
            coded = b"".join(f[head.size : -2].replace(b"\xff\x00", b"\xff") for f in frames[i : i + SOME])
            fives = np.zeros((len(coded) // 5, 8), np.uint8)
            fives[:, :5] = np.frombuffer(coded, np.uint8).reshape(-1, 5)
            packed = fives.view(">u8").astype(np.uint64).ravel()
            words = np.stack([(packed >> np.uint64(s)) & np.uint64(1023) for s in (54, 44, 34, 24)], axis=1)
            diffs = _BACK[(words >> np.uint64(1)).astype(np.int64)].reshape(-1, n)
            out[i : i + SOME] = np.cumsum(diffs, axis=1) + 128
        return out
    return np.stack([_blocks(h, f[h.size : end if (end := f.rfind(b"\xff\xd9")) > h.size else len(f)]) for f in frames for h in [read_head(f)]])


def shots(levels: np.ndarray) -> list[int]:
    """First frames of the shots; the first is 0."""
    n = len(levels)
    if n < 2:
        return [0] * n
    hist = np.bincount((np.arange(n)[:, None] * BINS + (levels >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / levels.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    at = np.arange(n - 1)
    low = np.maximum(0, at - WINDOW)
    k = np.maximum(at - low, 1)
    mean = (s1[at] - s1[low]) / k
    dev = np.sqrt(np.maximum((s2[at] - s2[low]) / k - mean**2, 0))
    return [0, *(np.flatnonzero((diff > FLOOR) & (diff > mean + SPREAD * dev)) + 1).tolist()]


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


#: first frame, number of frames, start and end in seconds, mean level
CLIP = "struct<first_frame: int, n_frames: int, start_s: double, end_s: double, level: double>"
_CLIP = {"first_frame": pa.int32(), "n_frames": pa.int32(), "start_s": pa.float64(), "end_s": pa.float64(), "level": pa.float64()}


def clips_of(levels: np.ndarray, fps: float) -> list[tuple[int, int, float, float, float]]:
    first = shots(levels)
    return [(a, b - a, a / fps, b / fps, float(levels[a:b].mean())) for a, b in zip(first, [*first[1:], len(levels)], strict=True)]


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Films (key, media binary, ...) to timed clips: key, clip, first_frame, n_frames, start_s, end_s, level, error.

    A film that can't be read, a null among them, has one row, whose error says why and whose other columns are null; a film without frames has such a row too.
    Films of any length are read frame by frame; rows that repeat are read one by one, other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    film = read_avi(batch.column(1)[k].as_py() or b"")
                    levels = decode_levels(film.frames)
                    if not len(levels):
                        raise ValueError("no frames")
                    out = [(i, *c, None) for i, c in enumerate(clips_of(levels, film.fps))]
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    out = [(None, None, None, None, None, None, str(e) if isinstance(e, ValueError) else "broken film")]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.record_batch([batch.column(0).take(pa.array([k] * len(out))), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["key", "clip", "first_frame", "n_frames", "start_s", "end_s", "level", "error"])

    prepare(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"key {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double, level double, error string").withColumnRenamed("key", key)


def films(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, media: each whole text as a film."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(1), "").cast(pa.binary())
            for i in range(0, batch.num_rows, 100):
                yield pa.record_batch([batch.column(0).slice(i, 100), pa.array([write_avi(pad(t)) for t in raw.slice(i, 100).to_pylist()], pa.binary())], names=["doc_id", "media"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) to what a film of each text holds once it is written and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the payload decoded from the frames), media_bytes, media_sha256 (of the
    AVI file), feature (frames, shots, cuts, mean level), n_frames, n_shots, clips (CLIP for each shot). Null counts as empty and is 64 zero bytes; equal texts give equal
    values; very long texts are coded SOME frames at a time; repeated rows are worked on one by one, other columns ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in pc.fill_null(batch.column(1), "").cast(pa.binary()):
                text = raw.as_py()
                media = write_avi(pad(text))
                film = read_avi(media)
                levels = decode_levels(film.frames)
                payload = levels.tobytes()[: film.stored]
                found = clips_of(levels, film.fps)
                feature = f"frames={len(levels)};shots={len(found)};cuts={','.join(str(c[0]) for c in found[1:])};level={levels.mean():.3f}"
                out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(levels), len(found), [dict(zip(_CLIP, c, strict=True)) for c in found]))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct(list(_CLIP.items())))]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_shots", "clips"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long, clips array<{CLIP}>")
