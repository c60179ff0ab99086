"""The pre-token pattern of byte-level BPE, worked out on whole arrays of characters.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Characters fall into letters, numbers, white space and others. A match is a run of one class, with one space before
it if there is one; of white space before other text, the last character stands apart; and an apostrophe that starts
a match takes the letters of a contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                out[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), OTHER, c)
        # \x1c to \x1f are no white space to the library whose results are matched
        out[0x1C:0x20] = OTHER
        _classes = out
    return _classes


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of several texts, with their offsets, to (byte positions where matches start, first match of each text); both end with a sentinel."""
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    n = len(points)
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[np.searchsorted(at, offs)] = True
    edge[n] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # white space before other text of the same document: the last character stands apart, or joins what follows if it is a space
    turn = np.flatnonzero(start[1:n] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
    start[turn - 1] = True
    start[turn[points[turn - 1] == 32]] = False
    # contractions
    quote = np.flatnonzero(start[:n] & (points == 39))
    if len(quote):
        edges = np.flatnonzero(edge)
        for q in quote.tolist():
            end = int(edges[np.searchsorted(edges, q, "right")])
            tail = "".join(map(chr, points[q + 1 : min(q + 3, end)].tolist()))
            size = 3 if tail in ("re", "ve", "ll") else 2 if tail[:1] and tail[0] in "stmd" else 0
            if size and (q + 1 >= end or kind[q + 1] == LETTER):
                start[q + 1] = False
                if size == 3:
                    start[q + 2] = False
                if q + size < end:
                    # what follows goes on as if it stood at the start: letters, or a class change that is marked already
                    start[q + size] |= kind[q + size] == LETTER
    starts = np.append(at, n_bytes)[np.flatnonzero(start)]
    return starts, np.searchsorted(starts, offs)


def pieces(data: np.ndarray, starts: np.ndarray, pick: np.ndarray) -> pa.Array:
    """The matches numbered in pick, as strings."""
    a, size = starts[pick], starts[pick + 1] - starts[pick]
    ends = np.cumsum(size)
    where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(a - (ends - size), size)
    return pa.StringArray.from_buffers(len(pick), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data[where].tobytes()))
