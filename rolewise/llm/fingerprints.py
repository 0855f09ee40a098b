"""Document fingerprints: SimHash over weighted terms, and search through permuted block tables.

Terms are words and pairs of adjacent words, case and ASCII punctuation aside.  Each distinct term of a text votes with
its weight, 1 + ln(occurrences), pairs counting ``PAIR_WEIGHT`` times as much, for the bits of its hash and against the
others; the signs of the sums are the fingerprint.

To find all fingerprints within ``radius`` bits, the 64 bits are cut into ``radius + SPARE`` blocks.  Two within the radius agree on at
least ``SPARE`` whole blocks, so for each choice of that many blocks there is a table keyed by them, and every such pair
meets in at least one.  A key under which too many fingerprints meet is keyed again by more blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolewise.llm.common import FOLD, durable, in_batches, mix64, word_hashes

RADIUS, SPARE, PAIR_WEIGHT = 3, 2, 2.0
_CHUNK = 1 << 13


def fingerprint(text: bytes) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; zero without words."""
    words = word_hashes(text.translate(FOLD))
    if not len(words):
        return 0
    pairs = mix64(words[:-1] * np.uint64(3) + words[1:])
    votes = np.zeros(64, dtype=np.float64)
    for terms, weight in ((words, 1.0), (pairs, PAIR_WEIGHT)):
        if not len(terms):
            continue
        distinct, n = np.unique(terms, return_counts=True)
        weights = (weight * (1.0 + np.log(n))).astype(np.float32)
        for i in range(0, len(distinct), _CHUNK):
            bits = np.unpackbits(distinct[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            part = weights[i : i + _CHUNK]
            votes += 2.0 * (part @ bits.astype(np.float32)) - float(part.sum())
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, falling to 0 at half of the bits: the cosine of the angle that the bits stand for."""
    angle = F.bit_count(a.bitwiseXOR(b)) * F.lit(np.pi / 64)
    return F.greatest(F.cos(angle), F.lit(0.0))


# -- each document and the next --------------------------------------------------------------------------------------

_EDITED = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"]
#: What a task gives: whole rows, its last row, which lacks the next, and its first one, which the task before needs.
WHOLE, LAST, FIRST = range(3)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _paired(doc_id, text: str, fp: int, after: str, after_fp: int) -> tuple:
    cut = len(text) // 4
    changed = (text[: len(text) - cut] + after[:cut]).encode("utf-8", "surrogatepass")
    return doc_id, len(text), _sha(changed), fp, fingerprint(changed), after_fp


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.string(), kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "what", "text", *_EDITED])


def _edit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row of the task with the next, and tells its first and last ones with their texts."""
    part, held, kind = TaskContext.get().partitionId(), None, None
    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = text.as_py()
            fp = fingerprint(own.encode("utf-8", "surrogatepass"))
            if held:
                out.append((part, WHOLE, None, *_paired(*held, own, fp)))
            else:
                out.append((part, FIRST, own, doc_id, None, None, fp, None, None))
            held = doc_id, own, fp
        yield _batch(out, kind)
    if held:
        yield _batch([(part, LAST, held[1], held[0], None, None, held[2], None, None)], kind)


def _close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs the last row of a task with the first of the next one that has rows."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield _batch([(None, WHOLE, None, *_paired(*r)) for r in rows], batch.schema.field(0).type)


def edited(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with its fingerprint, that of its edited text and that of the next document.

    Documents go by doc_id, rows without one first, rows that share one by their text's hash; the last is followed by
    the first, a single one by itself.  One shuffle by ranges of that order, which rows that are alike in both don't crowd, as
    any of them may be next, brings each row to the one after it; only the first and last rows of the tasks meet again.
    A null text is empty; extra columns are left out; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, what int, text string, doc_id {kind}, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, next_fp bigint"
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    order = ["doc_id", "hash", "place"]
    given = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    ranged = given.repartitionByRange(*order).sortWithinPartitions(*order)
    done = durable(in_batches(ranged.select("doc_id", "text"), _edit, schema))
    last, first = done.where(F.col("what") == LAST), done.where(F.col("what") == FIRST)
    every = Window.orderBy("part")  # a row for each task
    ends = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    then = first.select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(ends)).alias("next"))
    after = first.select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fp").alias("after_fp"))
    met = last.join(then, "part").join(after, "next").select("doc_id", "text", "fp", "after", "after_fp")
    closed = in_batches(met, _close, schema)
    return done.where(F.col("what") == WHOLE).unionByName(closed).select(*_EDITED)


# -- search ------------------------------------------------------------------------------------------------------------

#: Fingerprints under one key of a table beyond which they are keyed again.
CROWD = 1024


def _signed(bits: Iterable[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _tables(radius: int) -> list[tuple[int, list[int]]]:
    """For each table the mask of its key, and the masks of the radius + 1 parts that the other bits are cut into."""
    size = radius + SPARE
    cut = [list(range(64 * k // size, 64 * (k + 1) // size)) for k in range(size)]
    out = []
    for chosen in combinations(range(size), SPARE):
        rest = [b for k in range(size) if k not in chosen for b in cut[k]]
        parts = [rest[len(rest) * k // (radius + 1) : len(rest) * (k + 1) // (radius + 1)] for k in range(radius + 1)]
        out.append((_signed(b for k in chosen for b in cut[k]), [_signed(p) for p in parts]))
    return out


def within(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """``query``, ``fp``, ``bits``: all pairs of a fingerprint ``fp`` of ``queries`` and one of ``stored`` within ``radius`` bits.

    Both have distinct fingerprints.  Two that share a table's key differ in at most ``radius`` of the other bits, so if
    those are cut into one part more, a part agrees: under a crowded key they meet again by key and part, and no pair is lost.
    """
    tables = _tables(radius)
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for t, (mask, _) in enumerate(tables)])
    crowded = stored.select(F.inline(keys)).groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("table", "key", F.lit(True).alias("crowded"))
    masks = F.array(*[F.array(*[F.lit(m) for m in parts]) for _, parts in tables])
    again = F.transform(F.element_at(masks, F.col("table") + 1), lambda m, k: F.struct((k + 1).alias("part"), m.bitwiseAND(F.col("fp")).alias("value")))
    once = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("value")))

    def keyed(df: DataFrame) -> DataFrame:
        marked = df.select("fp", F.inline(keys)).join(crowded, ["table", "key"], "left")
        return marked.select("fp", "table", "key", F.inline(F.when(F.col("crowded"), again).otherwise(once)))

    met = keyed(queries).withColumnRenamed("fp", "query").join(keyed(stored), ["table", "key", "part", "value"])
    bits = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return met.where(bits <= radius).select("query", "fp", bits.alias("bits")).distinct()


def compared(docs: DataFrame, every: int = 20, radius: int = RADIUS) -> DataFrame:
    """The fingerprints of each document and of its edited text, how like they are, and how many others are near.

    ``near_edited`` and ``near_next`` are the likeness to the edited text's and the next document's fingerprint.
    ``near_docs`` is, for rows with a doc_id divisible by ``every``, the number of other rows within ``radius`` bits of all
    rows; for others it is null.  See :func:`edited` for the order and for null and repeated rows.
    """
    rows = durable(edited(docs))
    stored = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") % every == 0).alias("asked"))
    found = within(stored.where("asked").select("fp"), stored.select("fp"), radius)
    near = found.join(stored, "fp").groupBy("query").agg((F.sum("n") - 1).alias("others"))
    joined = rows.join(near, rows["fp"] == near["query"], "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("others")).alias("near_docs"),
    )
