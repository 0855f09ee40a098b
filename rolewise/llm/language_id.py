"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes: counts of the byte that follows each context of up to ``ORDER``
bytes.  A byte seen after the longest context that the tree has costs its share of that context's counts; one not seen there costs
an escape (the share of distinct followers) and is tried after the next shorter context, down to the uniform order
-1.  A text's code length is the sum over all its bytes with the statistics frozen after training, and the
language with the shortest code is predicted.

Counting is distributed: each task counts the (language, context and byte) strings of its rows, the counts are added
up, and those of shorter contexts are sums of the longer ones'.  Contexts of one byte are all in the tree.  A longer one is in it if it
is at least one in ``CONTEXTS`` / languages of its language's bytes, so no order has more than ``CONTEXTS`` contexts in all trees
together, whatever the number of documents: that bounds what the driver collects and the tasks receive.  With frozen statistics
the cost of a byte after a context doesn't depend on the text, so for each string of any tree the costs in all languages, escapes
included, are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolewise.llm.common import Index, discard, durable, in_batches

#: Longest context in bytes, and the contexts of each length over one that the trees of all languages may have.
ORDER, CONTEXTS = 4, 1 << 17
#: Costs that a task holds at a time, over all languages; texts are taken in pieces, whatever their length.
HELD = 1 << 20
#: Bytes that a task counts at a time before it passes the counts on.
COUNTED = 1 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _pieces(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The text's bytes after ``ORDER`` line feeds, in pieces of ``size`` that overlap by the context's length."""
    raw = np.frombuffer(b"\n" * ORDER + text, dtype=np.uint8)
    for i in range(0, len(raw) - ORDER, size):
        yield raw[i : i + size + ORDER]


def _strings(raw: np.ndarray) -> np.ndarray:
    """Each byte but the first ``ORDER`` with those before it, the byte itself lowest."""
    out = np.zeros(max(len(raw) - ORDER, 0), dtype=np.int64)
    for k in range(ORDER + 1):
        out = (out << 8) | raw[k : len(raw) - ORDER + k]
    return out


def _mask(order: int) -> int:
    """What a context of ``order`` bytes and the byte after it take of a string."""
    return (1 << 8 * (order + 1)) - 1


def counts(labelled: DataFrame) -> DataFrame:
    """``lang``, ``string`` (``ORDER`` bytes of context and the byte after), ``n`` over all rows of ``labelled(lang, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for raw in _pieces(text.as_py() or b"", COUNTED):
                    waiting.setdefault(lang, []).append(_strings(raw))
                    size += len(raw)
                    if size > COUNTED:
                        yield from emit(waiting)
                        waiting, size = {}, 0
        yield from emit(waiting)

    def emit(waiting: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            seen, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(seen), dtype=np.int32))), pa.array(seen, pa.int64()), pa.array(n, pa.int64())], names=["lang", "string", "n"])

    rows = in_batches(labelled.select("lang", F.col("text").cast("binary")), run, "lang string, string bigint, n bigint")
    return rows.groupBy("lang", "string").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """The contexts of one length: costs of the strings that any tree has, and escapes, by language."""

    strings: np.ndarray
    costs: np.ndarray  # [string, language]
    contexts: np.ndarray
    escapes: np.ndarray  # [context, language]; 0 where the language's tree lacks the context

    @cached_property
    def indexes(self) -> tuple[Index, Index]:
        return Index(self.strings), Index(self.contexts)

    def __getstate__(self) -> dict:
        """Without the indexes: each worker makes its own."""
        return {k: v for k, v in self.__dict__.items() if k != "indexes"}


@dataclass
class Model:
    """The trees of ``langs``: ``pairs[context byte * 256 + byte, language]`` in bits, and a level for each longer context, shortest first."""

    langs: list[str]
    pairs: np.ndarray
    levels: list[Level] = field(default_factory=list)

    def costs(self, strings: np.ndarray, order: int | None = None) -> np.ndarray:
        """Bits of the byte in each of ``strings`` after up to ``order`` bytes of context, in every language."""
        order = len(self.levels) + 1 if order is None else order
        strings = strings & _mask(order)
        if order == 1:
            return self.pairs[strings]
        level = self.levels[order - 2]
        at, known = level.indexes[0].find(strings)
        out = level.costs[at] if len(level.strings) else np.zeros((len(strings), len(self.langs)), dtype=np.float32)
        rest = np.flatnonzero(~known)
        if len(rest):
            lower = self.costs(strings[rest], order - 1)
            at, known = level.indexes[1].find(strings[rest] >> 8)
            lower[known] += level.escapes[at[known]]
            out[rest] = lower
        return out


def _pair_costs(n: np.ndarray) -> np.ndarray:
    """Bits of each byte after each single byte, from ``n[language, context, byte]``: orders 1, 0 and -1."""
    cost = np.full((n.shape[0], 1, 256), 8.0)
    for level in (n.sum(axis=1, keepdims=True), n):
        total, kinds = level.sum(axis=2, keepdims=True).astype(np.float64), (level > 0).sum(axis=2, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log2((total + kinds) / level)
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
        cost = np.where(level > 0, seen, escape + cost)
    return np.moveaxis(cost, 0, 2).reshape(256 * 256, -1).astype(np.float32)


def _level(model: Model, order: int, lang: np.ndarray, string: np.ndarray, n: np.ndarray) -> Level:
    """The level of contexts of ``order`` bytes from the counts of the trees' strings; ``model`` has the shorter ones."""
    strings, at = np.unique(string, return_inverse=True)
    contexts, of = np.unique(string >> 8, return_inverse=True)
    shape = (len(contexts), len(model.langs))
    total, kinds = np.zeros(shape), np.zeros(shape)
    np.add.at(total, (of, lang), n)
    np.add.at(kinds, (of, lang), 1)
    escapes = np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)).astype(np.float32)
    costs = model.costs(strings, order - 1) + escapes[np.searchsorted(contexts, strings >> 8)]
    costs[at, lang] = np.log2((total + kinds)[of, lang] / n)
    return Level(strings, costs.astype(np.float32), contexts, escapes)


def fit(docs: DataFrame, most_contexts: int = CONTEXTS) -> Model:
    """The frozen trees of all languages from the rows of ``docs`` with a text and a lang that are not held out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counted = durable(counts(rows.select(F.col("lang").cast("string"), F.col("text").cast("string"))), "language-counts")
    sizes = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    number = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1 if langs else F.lit(0)
    share = most_contexts // max(len(langs), 1)
    levels, longer = {}, counted.select(number.alias("lang"), "string", "n")
    for order in range(ORDER, 0, -1):
        longer = longer.groupBy("lang", F.col("string").bitwiseAND(F.lit(_mask(order))).alias("string")).agg(F.sum("n").alias("n"))
        kept = longer
        if order > 1:
            of_context = F.sum("n").over(Window.partitionBy("lang", F.shiftright("string", 8)))  # a context has 256 rows at most
            of_lang = F.element_at(F.lit([sizes[x] for x in langs]), F.col("lang") + 1) if langs else F.lit(0)
            kept = longer.withColumn("of", of_context).where(F.col("of") * share >= of_lang)
        table = kept.select("lang", "string", "n").toArrow()
        levels[order] = [table[c].to_numpy() for c in ("lang", "string", "n")]
    discard(counted)
    n = np.zeros((len(langs), 256, 256), dtype=np.int64)
    lang, pair, times = levels[1]
    n[lang, pair >> 8, pair & 255] = times
    model = Model(langs, _pair_costs(n))
    for order in range(2, ORDER + 1):
        model.levels.append(_level(model, order, *levels[order]))
    return model


def code_lengths(texts: list[bytes], model: Model) -> np.ndarray:
    """``[text, language]``: the bits that each language's trees need for each text."""
    bits = np.zeros((len(texts), len(model.langs)))
    size = max(HELD // max(len(model.langs), 1), 1 << 10)
    waiting: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        starts = np.cumsum([0, *[len(s) for _, s in waiting[:-1]]])
        sums = np.add.reduceat(model.costs(np.concatenate([s for _, s in waiting])), starts, axis=0, dtype=np.float64)
        np.add.at(bits, [k for k, _ in waiting], sums)
        waiting.clear()

    held = 0
    for k, text in enumerate(texts):
        for raw in _pieces(text, size):
            waiting.append((k, _strings(raw)))
            held += len(raw)
            if held >= size:
                add()
                held = 0
    if waiting:
        add()
    return bits


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each row; the trees are trained on ``docs`` if not given.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned.  Otherwise the score is the
    chance of the predicted language if all were as likely before, and equal code lengths go to the first by name.
    Repeated rows stay; extra columns are left out; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _best([t.as_py() for t in batch.column(2)], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(_has_letter(), F.col("text").cast("string").cast("binary")))
    return in_batches(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _has_letter() -> Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def _best(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text with letters, or of a null one none, and its chance."""
    if not model.langs or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits = code_lengths([t or b"" for t in texts], model)
    best = bits.argmin(axis=1)
    chance = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
    there = [t is not None for t in texts]
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, there, strict=True)], np.where(there, chance, 0.0)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted ``und``, with all their columns as they are.

    If no language was learned, as when every lang is null, there is nothing to judge by and all rows with a letter stay.
    """
    model = fit(docs)
    lettered = docs.where(_has_letter())
    if not model.langs:
        return lettered
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _ = _best([t.as_py() for t in batch.column(at).cast(pa.binary())], shared.value)
            yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return in_batches(lettered, run, docs.schema)
