"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has eight bytes.  Two that differ in at most two bits share the bytes of at least six positions, the
guaranteed minimum.  A posting list for one byte of one position would hold a 256th of all fingerprints, so lists are
kept for two pairs of adjacent positions at once: with the eight positions in four pairs, six shared positions leave two
pairs whole, so every link meets in one of the six lists of (two pairs, their four bytes).  For the pairs of a list the
shared positional bytes are tallied, those under the minimum go, and the bits of the rest are compared.

A list with more than ``CROWD`` fingerprints is not paired.  Two fingerprints are within two bits exactly if some value
is within one bit of both, so each member is sent to the 65 values around it and those that meet are linked to the
least of them: at most 65 can meet, and the work is in proportion to the members.  Both ways lose no component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.llm.common import durable, in_batches
from rolewise.operators.graph import components as linked_components

SHINGLE, SEED, RADIUS, LEAST_SHARED = 3, 42, 2, 6
#: Fingerprints of one posting list that are still paired.
CROWD = 32
_CHUNK = 1 << 14
#: Masks of two of the four pairs of positions.
_MASKS = [
    sum(0xFFFF << (16 * p) for p in pair) for pair in combinations(range(4), 2)
]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; zero if it is null or has no word."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    spaced = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    if len(words) < shingle:
        spans = [(0, len(spaced))]
    else:
        spans = list(zip(starts, [e - 1 for e in ends[shingle - 1 :]], strict=False))
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), _CHUNK):
        part = spans[i : i + _CHUNK]
        values = np.fromiter((digest(spaced[s:e], SEED) for s, e in part), dtype="<u8", count=len(part))
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, content: Column | None = None) -> DataFrame:
    """``doc_id``, ``fp`` (signed 64 bits) and ``content``, a number that the caller wants along (0 if none), of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64()), batch.column(2)], names=["doc_id", "fp", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = F.lit(0).cast("bigint") if content is None else content
    return in_batches(docs.select("doc_id", F.col("text").cast("string").cast("binary"), given.alias("content")), run, f"doc_id {kind}, fp bigint, content bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _shared_bytes(x: Column) -> Column:
    """How many of the eight bytes of ``x``, the difference of two fingerprints, are zero."""
    total = F.lit(0)
    for k in range(8):
        total = total + F.when(x.bitwiseAND(F.lit(_signed(0xFF << (8 * k)))) == 0, 1).otherwise(0)
    return total


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``a``, ``b`` between the different fingerprints ``fp`` that join all within two bits of each other.

    Below ``crowd`` every such pair is a link; in a crowded list only links to the least member around a value.
    """
    lists = F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_MASKS)])
    index = distinct.select("fp", F.inline(lists))
    sizes = index.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = index.join(sizes, ["list", "key"])
    found = shared.where(F.col("n") <= crowd).groupBy("list", "key").agg(F.collect_list("fp").alias("fps"))

    def partners(a: Column) -> Column:
        def near(b: Column) -> Column:
            x = a.bitwiseXOR(b)
            return (b > a) & (_shared_bytes(x) >= LEAST_SHARED) & (F.bit_count(x) <= RADIUS)

        return F.transform(F.filter("fps", near), lambda b: F.struct(a.alias("a"), b.alias("b")))

    paired = found.select(F.inline(F.flatten(F.transform("fps", partners))))
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    met = crowded.select("fp", F.explode(around).alias("value")).groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    starred = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return paired.union(starred).distinct()


def components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the least doc_id reachable by links.

    Null and empty texts, and texts of white space alone, have the fingerprint zero and are linked like any other.
    Equal texts have equal fingerprints and so one component; repeated rows stay repeated.  A null doc_id never names a
    component unless it has no other.  Extra columns are left out; an empty table gives an empty one.
    """
    printed = durable(fingerprints(docs))
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = _labelled(distinct)
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = linked.join(least, "label").select("fp", "component_id")
    return printed.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(distinct: DataFrame) -> DataFrame:
    """The rows of ``distinct``, one for each ``fp``, with the ``label`` of their component."""
    labels = linked_components(links(distinct.select("fp")).toDF("src", "dst"))
    return distinct.join(labels.toDF("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one with the least doc_id, or without any if none has one.

    Of rows that share that doc_id, the one whose columns have the least hash; of rows alike in every column, one.
    """
    hashed = F.xxhash64(*[F.to_json(docs[f.name]) if f.dataType.typeName() == "map" else docs[f.name] for f in docs.schema.fields])
    printed = durable(fingerprints(docs, hashed))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content"))
    linked = _labelled(printed.groupBy("fp").agg(first.alias("first")))
    best = linked.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.content")
    times = printed.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    kept = durable(best.join(times, [best["doc_id"].eqNullSafe(times["doc_id"]), best["content"] == times["content"]]).select(best["doc_id"].alias("kept_id"), best["content"].alias("kept_content"), "n"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), hashed.alias("content"))

    def of(which: str) -> DataFrame:
        table = kept.where(which)
        return rows.join(table, [F.col("id").eqNullSafe(F.col("kept_id")), F.col("content") == F.col("kept_content")], "left_semi")

    single = of("n = 1").select("row.*")
    if kept.where("n > 1").isEmpty():
        return single
    return single.unionByName(of("n > 1").groupBy("id", "content").agg(F.first("row").alias("row")).select("row.*"))
