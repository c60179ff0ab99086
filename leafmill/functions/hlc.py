"""Hybrid logical clock: timestamps (wall in microseconds, logical), their order, their 12-byte form, and a clock for the driver."""

from __future__ import annotations

import functools
import threading
import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.conditions import QueryError


@functools.total_ordering
@dataclass(frozen=True)
class Stamp:
    wall: int
    logical: int = 0

    def __lt__(self, other: Stamp) -> bool:
        return (self.wall, self.logical) < (other.wall, other.logical)

    def encode(self) -> bytes:
        return self.wall.to_bytes(8, "big") + self.logical.to_bytes(4, "big")

    @classmethod
    def decode(cls, raw: bytes) -> Stamp:
        if len(raw) != 12:
            raise QueryError("invalid_hlc", raw)
        return cls(int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:], "big"))

    def __str__(self) -> str:
        return f"{self.wall}:{self.logical}"

    @classmethod
    def parse(cls, text: str) -> Stamp:
        try:
            wall, logical = text.split(":")
            return cls(int(wall), int(logical))
        except ValueError as e:
            raise QueryError("invalid_hlc", text) from e


FIRST = Stamp(0, 0)


class Clock:
    """now() always moves on; sync() takes over a later stamp from elsewhere unless it is more than max_skew microseconds ahead."""

    def __init__(self, source=lambda: time.time_ns() // 1000, max_skew: int = 60_000_000):
        self._source, self._skew, self._last, self._lock = source, max_skew, FIRST, threading.Lock()

    def now(self) -> Stamp:
        with self._lock:
            wall = self._source()
            self._last = Stamp(wall) if wall > self._last.wall else Stamp(self._last.wall, self._last.logical + 1)
            return self._last

    def peek(self) -> Stamp:
        with self._lock:
            return self._last

    def after(self, own: Stamp) -> None:
        """Moves on beyond a stamp that this side gave itself, however far ahead it is."""
        with self._lock:
            self._last = max(self._last, own)

    def sync(self, remote: Stamp) -> Stamp:
        with self._lock:
            wall = self._source()
            if remote.wall - wall > self._skew:
                raise QueryError("clock_skew", str(remote))
            top = max(self._last.wall, remote.wall, wall)
            same = [s.logical for s in (self._last, remote) if s.wall == top]
            self._last = Stamp(top, max(same) + 1 if same else 0)
            return self._last


def stamp(wall: Column | str, logical: Column | str) -> Column:
    return F.struct((F.col(wall) if isinstance(wall, str) else wall).cast("long").alias("wall"), (F.col(logical) if isinstance(logical, str) else logical).cast("long").alias("logical"))


def literal(s: Stamp) -> Column:
    return stamp(F.lit(s.wall), F.lit(s.logical))


def encoded(hlc: Column) -> Column:
    """12 bytes, big-endian; their byte order is the stamps' order."""
    return F.unhex(F.concat(F.lpad(F.hex(hlc.wall), 16, "0"), F.lpad(F.hex(hlc.logical), 8, "0")))


def decoded(raw: Column) -> Column:
    digits = F.hex(raw)
    return stamp(F.conv(F.substring(digits, 1, 16), 16, 10).cast("long"), F.conv(F.substring(digits, 17, 8), 16, 10).cast("long"))


def shown(hlc: Column) -> Column:
    return F.concat_ws(":", hlc.wall.cast("string"), hlc.logical.cast("string"))


def parsed(text: Column) -> Column:
    parts = F.split(text, ":")
    return stamp(parts[0].cast("long"), parts[1].cast("long"))


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
