"""SentencePiece encoding and decoding over a table of distinct chunks.

A SentencePiece BPE model marks each space with U+2581.  If no piece has that mark after another character, no merge
can cross the place where a mark follows other text, so a text may be cut there and each chunk (marks, then a word)
segmented alone.

The distinct chunks of all texts are counted.  Of those that occur again, the most frequent, up to ``TABLE_CHARS`` characters, are
the table: each is segmented once by the library, on Spark, and tasks receive the table and join its ids back by position.  The rest
are rare, most of them in one place, and are segmented where they occur, with a small cache: to join them back by position, too, a row for
each would have to be shuffled twice and the texts once, more than the texts' own size (figures in the README).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewise.llm.common import discard, durable, in_batches

MARK = "▁"
#: Characters of the chunks in the table that all tasks receive, in a task's cache, and of the longest chunk that either has.
TABLE_CHARS, CACHE_CHARS, LONGEST = 1 << 21, 1 << 19, 64
#: Characters of distinct chunks that a task counts before it passes the counts on.
COUNTED = 1 << 21
#: Steps of frequency, for each doubling, between which the table ends.
STEPS = 4
_CHUNK = re.compile(" *[^ ]+| +")


def chunks_of(text: str) -> list[str]:
    # a mark written in the text is the same to the model as a space
    return _CHUNK.findall(" " + text.replace(MARK, " "))


class ChunkEncoder:
    """Encodes texts exactly as ``SentencePieceProcessor.encode`` does, by distinct chunks."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        crossing = next((p for p in pieces if MARK in p.lstrip(MARK)), None)
        # the cut is also only right if the library marks every space and changes nothing else
        plain = self.lib.normalize(" a  b\n\tﬁ ") == f"{MARK}{MARK}a{MARK}{MARK}b\n\tﬁ{MARK}"
        self.by_chunk = crossing is None and plain
        self.cache: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def segment(self, chunk: str) -> tuple[int, ...]:
        # the library puts one mark before the text, which stands for the chunk's first space
        return tuple(self.lib.encode(chunk[1:])) if len(chunk) > 1 else self._lone_mark

    def _rare(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk that the table lacks."""
        if (ids := self.cache.get(chunk)) is None:
            ids = self.segment(chunk)
            if len(chunk) <= LONGEST:
                if self.held > CACHE_CHARS:
                    self.cache, self.held = {}, 0
                self.cache[chunk] = ids
                self.held += len(chunk)
        return ids

    @property
    def _lone_mark(self) -> tuple[int, ...]:
        """The ids of a single mark, which the library gives only after other text."""
        a, b = self.lib.encode("a"), self.lib.encode("a ")
        return tuple(b[len(a) :])

    def encode(self, text: str, table: dict[str, tuple[int, ...]] = {}) -> list[int]:  # noqa: B006
        if not text:
            return []
        if not self.by_chunk:
            return self.lib.encode(text)
        rare = self._rare
        return list(chain.from_iterable([table[c] if c in table else rare(c) for c in chunks_of(text)]))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def encoder(model: str) -> ChunkEncoder:
    return ChunkEncoder(model)


def _model_path(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """``chunk``, ``n``: how often each distinct chunk of up to ``LONGEST`` characters is in all the texts of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for text in batch.column(0):
                if value := text.as_py():
                    before = len(seen)
                    seen.update(chunks_of(value))
                    held += (len(seen) - before) * 12  # about
                if held > COUNTED:
                    yield emit(seen)
                    seen, held = Counter(), 0
        yield emit(seen)

    def emit(seen: Counter[str]) -> pa.RecordBatch:
        short = {c: n for c, n in seen.items() if len(c) <= LONGEST}
        return pa.RecordBatch.from_arrays([pa.array(short.keys(), pa.string()), pa.array(short.values(), pa.int64())], names=["chunk", "n"])

    return in_batches(docs.select(F.col("text").cast("string")), run, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))


def _segmented(chunks: DataFrame, model: str) -> DataFrame:
    """``chunk``, ``ids`` of each of ``chunks``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(_model_path(model))
        for batch in batches:
            ids = [coder.segment(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "ids"])

    return in_batches(chunks.select("chunk"), run, "chunk string, ids array<int>")


def chunk_table(docs: DataFrame, model: str, chars: int | None = None) -> pa.Table:
    """``chunk``, ``ids`` of the chunks that occur most often in ``docs``, and more than once: at most ``chars`` characters of them."""
    if not encoder(_model_path(model)).by_chunk:
        return pa.table({"chunk": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    counted = durable(chunk_counts(docs).where("n > 1"), "chunk-counts")
    step = F.floor(F.log2("n") * STEPS)
    steps = sorted(counted.groupBy(step.alias("step")).agg(F.sum(F.length("chunk")).alias("chars")).collect(), reverse=True)
    within = np.cumsum([r.chars for r in steps]) <= (TABLE_CHARS if chars is None else chars)
    least = min((r.step for r, ok in zip(steps, within, strict=True) if ok), default=None)
    found = _segmented(counted.where(F.lit(False) if least is None else step >= least), model).toArrow()
    discard(counted)
    return found


class _Received:
    """The last table that this worker has received, as a dictionary."""

    name, table = "", {}

    @classmethod
    def get(cls, name: str, packed: pa.Table) -> dict[str, tuple[int, ...]]:
        if cls.name != name:
            numbers: dict[int, int] = {}  # one object for each id
            ids = (tuple([numbers.setdefault(i, i) for i in x.as_py()]) for x in packed["ids"])
            cls.name, cls.table = name, dict(zip(packed["chunk"].to_pylist(), ids, strict=True))
        return cls.table


def _with_ids(docs: DataFrame, model: str, made, schema: str) -> DataFrame:
    """``docs`` in batches of doc_id and what ``made`` makes of the library's wrapper and the ids of each text of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, chunk_table(docs, model)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(_model_path(model)), _Received.get(*shared.value)
        for batch in batches:
            columns = made(coder, (coder.encode(t.as_py() or "", table) for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], names=["doc_id", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, {schema}")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", decode: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and, if asked for, ``decoded`` for each row's text.

    No begin or end ids, no sampling.  A null text is an empty one, with no ids and an empty decoded text.  Repeated
    rows stay repeated; other columns are left out, whatever their names; an empty table gives an empty one.
    """

    def made(coder: ChunkEncoder, each: Iterable[list[int]]) -> dict[str, pa.Array]:
        ids = list(each)
        columns = {"ids": pa.array(ids, pa.list_(pa.int32()))}
        return columns | ({"decoded": pa.array([coder.decode(x) for x in ids], pa.string())} if decode else {})

    return _with_ids(docs, model, made, "ids array<int>" + ", decoded string" * decode)


def token_digests(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row's text.

    Encodes and decodes as :func:`encode` does, with the same treatment of null and empty texts, repeated rows, empty
    tables and extra columns; the ids are digested in the task that made them instead of being returned.
    """

    def made(coder: ChunkEncoder, each: Iterable[list[int]]) -> dict[str, pa.Array]:
        rows = [(len(ids), _sha(",".join(map(str, ids))), _sha(coder.decode(ids))) for ids in each]
        counts, first, second = zip(*rows, strict=True) if rows else ((), (), ())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}

    return _with_ids(docs, model, made, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
