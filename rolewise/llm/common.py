"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rolewise.sources.tables import discard, durable

__all__ = ["Index", "documents", "discard", "durable", "in_batches", "mix64", "word_hashes"]

#: A-Z to a-z and ASCII punctuation to a space; bytes over 127 stay, so UTF-8 stays whole.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256)
)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Multiplier of the rolling word hash, odd so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text hashed at a time; a longer text is cut at white space.
BLOCK = 1 << 20
#: Rows that a worker takes at a time, and bytes that it is sent at a time (a longer row comes alone).
ROWS, SENT = 256, 8 << 20
SENT_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Memory of arrays over this size goes back to the system when they do, as workers live on from one task to the next.
KEPT = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with this package on the path of the workers.

    A worker imports the package by name.  Where it isn't installed, the folder that the driver has it from is
    added to the workers' path, as a session may have been started elsewhere.  Batches come in slices of ``ROWS`` rows, so
    that a worker holds the Python objects of few texts at a time, and a session that would send more than ``SENT`` bytes in a batch is set to that,
    as batches are counted in rows otherwise and texts may be long.
    """
    sent = df.sparkSession.conf.get(SENT_SETTING)
    if sent.rstrip("b").isdigit() and int(sent.rstrip("b")) > SENT:
        df.sparkSession.conf.set(SENT_SETTING, f"{SENT}b")
    held = df.sparkSession.sparkContext.environment
    held.setdefault("MALLOC_MMAP_THRESHOLD_", str(KEPT))
    root = str(Path(__file__).resolve().parents[2])
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held.get("PYTHONPATH")]))

    def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(small, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Index:
    """Where different numbers are in an array, by a hash table with open addressing of two to four times their number, all in whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        rest = np.arange(len(keys), dtype=np.int32)
        place = self._first(self.keys)
        while len(rest):
            free = self.slots[place] < 0
            self.slots[place[free]] = rest[free]  # of several the last has it
            out = self.slots[place] != rest
            rest, place = rest[out], (place[out] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``wanted`` (any, if it isn't there), and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(wanted), dtype=np.int32), np.zeros(len(wanted), dtype=bool)
        wanted = wanted.astype(np.uint64)
        place = self._first(wanted)
        at = self.slots[place]
        known = self.keys[at] == wanted  # an empty slot is checked below
        known &= at >= 0
        rest = np.flatnonzero(~known & (at >= 0))
        while len(rest):
            place = (place[rest] + 1) & self.mask if len(place) == len(wanted) else (place + 1) & self.mask
            here = self.slots[place]
            hit = (here >= 0) & (self.keys[here] == wanted[rest])
            at[rest[hit]], known[rest[hit]] = here[hit], True
            more = ~hit & (here >= 0)
            rest, place = rest[more], place[more]
        return at, known


class _Powers:
    """Powers of the hash base and of its inverse, as many as have been asked for."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end at white space; a longer word stays whole."""
    start = 0
    while len(data) - start > size:
        cut = data.rfind(b" ", start, start + size)
        if cut <= start:
            cut = data.find(b" ", start + size)
            if cut < 0:
                break
        yield data[start:cut]
        start = cut + 1
    yield data[start:]


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each white-space separated word of ``text``, in order.

    A word's hash is a polynomial in its bytes.  All prefixes of the block are summed at once, and a word is the
    difference of two sums, shifted to the start: no Python runs for each word.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    out = []
    for piece in blocks(text):
        raw = np.frombuffer(piece, dtype=np.uint8)
        word = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        up, down = _Powers.get(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        out.append(mix64(value ^ (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
