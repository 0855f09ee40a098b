"""Quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is its words and runs of other signs, as they are written, and their pairs, each hashed to one of ``2 ** BITS`` features.  A word that is the one before it again, or the one before
that, is a pair of its own, whichever word it is.  A feature's value is the square root of its
share of the text, so that a text is a sparse vector of length 1 whatever its size, and one feature more is 1 in all texts.  A score is the dot product with the weights.

The proximal form of follow-the-regularised-leader keeps for each feature the sum z of its gradients, less what the weights that it had then account for, and the sum n of their
squares.  Its weight is what minimises all of that with an L1 and an L2 penalty: zero until z is over the first, and slower the more it has moved.  The labelled rows are dealt to
``SHARDS`` shards by their doc_ids.  In each of ``ROUNDS`` rounds every shard starts from the common state and takes its rows one after the other, and
what it adds to z and n is averaged over the shards that had the feature.  Sums are of whole numbers, in units of ``UNIT``, so they don't depend on the order of tasks.

Labels are learned from at most about ``MOST_LABELLED`` rows, a sample by the hash of doc_id that is the same in every run; all rows are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.llm.common import blocks, discard, durable, in_batches, mix64

#: Features are numbered in so many bits; the last number is that of every text.
BITS = 18
#: Labelled rows that are learned from.
MOST_LABELLED = 20_000
SHARDS, ROUNDS = 4, 6
#: Learning rate, its offset, and the penalties on weights and their squares; chosen on the rows that may be learned from, one half held against the other.
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.03, 0.1
#: What whole numbers of z and n count.
UNIT = 2.0**-32
#: The kinds of bytes: white space, letters, digits and bytes over 127, and other signs.
_KIND = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if c > 127 or chr(c).isalnum() else 2 for c in range(256)], dtype=np.int8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


#: What a word is hashed to in a pair with itself, one and two words on.
_AGAIN = mix64(np.array([1, 2], dtype=np.uint64))


def _tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of bytes of one kind but white space, in order, and which of them are words: a polynomial in its bytes, from sums over all that is before its ends."""
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(kind, prepend=0))
    starts = edge[kind[edge] > 0]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    ends = np.append(edge, len(raw))[np.searchsorted(edge, starts) + 1]
    steps = np.full(len(raw) + 1, _BASE, dtype=np.uint64)
    steps[0] = 1
    up = np.cumprod(steps, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    steps[1:] = _INVERSE
    return mix64((sums[ends] - sums[starts]) * np.cumprod(steps, dtype=np.uint64)[starts] ^ (ends - starts).astype(np.uint64)), kind[starts] == 1


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the features of a text, ascending, and how often each is there; the one of every text is last, and there once."""
    shift, before, earlier = np.uint64(64 - bits), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    found, times = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for piece in blocks(text):
        tokens, is_word = _tokens(np.frombuffer(piece, dtype=np.uint8))
        pairs = np.concatenate((before, tokens))
        pairs = mix64(pairs[:-1] * np.uint64(3) + pairs[1:])
        words, old = np.concatenate((earlier, tokens[is_word])), len(earlier)
        again = [np.repeat(_AGAIN[k - 1], np.count_nonzero((words[k:] == words[:-k])[max(old - k, 0) :])) for k in (1, 2)]
        at, n = np.unique(np.concatenate((tokens, pairs, *again)) >> shift, return_counts=True)
        found.append(at)
        times.append(n)
        before, earlier = tokens[-1:] if len(tokens) else before, words[-2:]
    at, n = found[-1], times[-1]
    if len(found) > 2:
        at, place = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(times)).astype(np.int64)
    return np.append(at.astype(np.int64), 1 << bits), np.append(n, 1)


def values(n: np.ndarray) -> np.ndarray:
    """The values of a text's features from how often each is there."""
    out = np.sqrt(n / max(int(n[:-1].sum()), 1))
    out[-1] = 1.0
    return out


@dataclass
class State:
    """What training has gathered for each feature."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, bits: int = BITS) -> State:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        """Takes one row, with the features ``at`` and their values."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip((w * value).sum(), -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``id, label, text`` of the rows of ``docs`` with a label that aren't held out.  A doc_id with several labels is good if all are."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("_label"))
    one = one.where(~held_out(F.col("doc_id")))
    n = one.count()
    if n > most:
        one = one.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) < int(most / n * (1 << 30)))
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").cast("binary").alias("text"))
    # about ``most`` rows of 12 bytes
    return rows.join(F.broadcast(one.withColumnRenamed("doc_id", "_label_id")), F.col("id") == F.col("_label_id")).select("id", F.col("_label").alias("label"), "text")


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """A text's features and how often each is there, compressed: every round shuffles them."""
    return zlib.compress(np.concatenate((np.diff(at, prepend=0), n)).astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(row), dtype="u1").reshape(4, -1).T.copy().view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def featured(rows: DataFrame) -> DataFrame:
    """``shard, turn, label, row`` of ``rows(id, label, text)``, each row's features :func:`packed`; null texts are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [packed(*features(t.as_py() or b"")) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(each, pa.binary())], names=["shard", "turn", "label", "row"])

    turn = F.xxhash64("id", F.lit("turn"))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int").alias("shard"), turn.alias("turn"), "label", "text")
    return in_batches(dealt, run, "shard int, turn bigint, label int, row binary")


def fit(docs: DataFrame, labels: DataFrame) -> State:
    """The state after all rounds over the labelled rows of ``docs``."""
    return trained(labelled(docs, labels))


def trained(rows: DataFrame, rounds: int = ROUNDS) -> State:
    """The state after ``rounds`` over ``rows(id, label, text)``."""
    table = durable(featured(rows), "quality-features")
    state = State.empty()
    for _ in range(rounds):
        state = _round(table, state)
    discard(table)
    return state


def _round(table: DataFrame, state: State) -> State:
    shared = table.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shard = None
        for batch in batches:
            for k, label, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if k != shard:
                    if own is not None:
                        yield moved(own)
                    own, shard = State(shared.value.z.copy(), shared.value.n.copy()), k
                at, n = unpacked(row.as_py())
                own.learn(at, values(n), label)
        if own is not None:
            yield moved(own)

    def moved(own: State) -> pa.RecordBatch:
        at = np.flatnonzero(own.n != shared.value.n)
        z, n = (np.rint((getattr(own, c)[at] - getattr(shared.value, c)[at]) / UNIT).astype(np.int64) for c in ("z", "n"))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(z), pa.array(n)], names=["feature", "z", "n"])

    # each shard's rows in one order, whatever the files: rows alike in turn are copies or null
    dealt = table.repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn", "label", "row")
    sums = in_batches(dealt, run, "feature int, z bigint, n bigint").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("z", "n")], F.count(F.lit(1)).alias("shards")).toArrow()
    shared.unpersist()
    at, shards = sums["feature"].to_numpy(), sums["shards"].to_numpy()
    after = State(state.z.copy(), state.n.copy())
    after.z[at] += sums["z"].to_numpy() * UNIT / shards
    after.n[at] += sums["n"].to_numpy() * UNIT / shards
    return after


def chances(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The chance of label 1 of each text: the dot product of its features' values and the weights, on the logistic curve."""
    bits = (len(weights) - 1).bit_length() - 1
    sums = np.zeros(len(texts))
    for k, text in enumerate(texts):
        at, n = features(text, bits)
        sums[k] = (weights[at] * values(n)).sum()
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def score(docs: DataFrame, labels: DataFrame, state: State | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of each row of ``docs``; the weights are trained on ``docs`` and ``labels`` if not given.

    A null or empty text has the score of the one feature that all texts have.  Without labels all scores are a half, and so predicted 1.  Repeated rows stay; extra columns are left
    out; an empty table gives an empty one.
    """
    weights = (state or fit(docs, labels)).weights().astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chances([t.as_py() or b"" for t in batch.column(2)], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").cast("binary"))
    return in_batches(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns; rows are judged one by one as in :func:`score`."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).weights().astype(np.float32))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(chances(texts, shared.value) >= least))

    return in_batches(docs, run, docs.schema)
