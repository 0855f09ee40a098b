"""Source divergence audit: how each source's words differ from each other source's of its language, by systolic rotation.

Words are counted once over all texts.  The kept terms of a language are cut into strips of a bounded number of terms, and each (language,
source) group becomes one compressed vector a strip: which terms it has, and how often.  Vectors don't meet by a join of terms.  A group's vector *resides*
in one place for each strip, and those of its peers come round to it: in a round-robin tournament of G groups every group meets one other in
each of its rounds, one of the two is the visitor, and the visitor's vector is sent to the resident's place under the number of the round.  A task sorts
what came to it, so it holds one resident and one visitor at a time, takes the rounds in order and evaluates both directions of a meeting at once.
Vectors are cut by terms, so neither a source that has a third of all rows nor a large vocabulary makes a meeting larger.

A meeting's value is a sum over all kept terms.  Terms that neither group has are alike in value, so a strip gives the sum over those that
one has, and the number of the rest is multiplied.  While a resident waits, a heap of ``TOP`` of its own terms against the language's is kept; the heaps of
all strips are merged at the end.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolewise.llm.common import blocks, durable, in_batches

#: Documents that a term must be in to be kept, terms of a strip, terms told of each group.
LEAST_DOCS, STRIP, TOP = 10, 4096, 10
#: The scale of shares, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2
#: Terms that a task counts before it passes the counts on, and bytes of text split at a time.
COUNTED, SPLIT = 1 << 18, 1 << 20
#: A-Z to a-z, other letters and bytes over 127 as they are, all else to a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: how often each term is in the texts of a group, and in how many of its rows.  Nulls are empty."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                group, own = held.setdefault((lang, source), {}), Counter()
                for piece in blocks(text.as_py().translate(_TERMS), SPLIT):
                    own.update(piece.split())
                before = len(group)
                for term, k in own.items():
                    entry = group.get(term)
                    if entry is None:
                        group[term] = [k, 1]
                    else:
                        entry[0] += k
                        entry[1] += 1
                size += len(group) - before
                if size > COUNTED:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), group in held.items():
            terms, values = list(group), np.array(list(group.values()), dtype=np.int64).reshape(-1, 2)
            for i in range(0, len(terms), 1 << 14):
                part = [t.decode() for t in terms[i : i + (1 << 14)]]
                cut = values[i : i + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part), pa.array(cut[:, 0]), pa.array(cut[:, 1])], names=["lang", "source", "term", "n", "docs"])

    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    made = in_batches(rows, run, "lang string, source string, term string, n bigint, docs bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(p - q)^2 / (p + q) of whole numbers up to 1 + ``SCALE``, rounded down; the square is under 2^63."""
    return (p - q) * (p - q) // (p + q)


def _shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The shares of counts in a ``total`` over so many ``terms``, smoothed and scaled, rounded down; exact beyond 64 bits, too."""
    below = total + ADDED * terms
    if (int(n.max(initial=0)) + ADDED) * SCALE < 1 << 63:
        return 1 + (n + ADDED) * SCALE // below
    return np.array([1 + (int(x) + ADDED) * SCALE // below for x in n], dtype=np.int64)


def packed(places: np.ndarray, n: np.ndarray) -> bytes:
    """A group's terms in a strip by their places, ascending, and their counts, compressed."""
    steps = np.diff(places, prepend=0)
    return zlib.compress(steps.astype("<u2").tobytes() + n.astype("<i8").view("u1").reshape(-1, 8).T.tobytes(), 1)


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(vector)
    size = len(raw) // 10
    places = np.cumsum(np.frombuffer(raw[: 2 * size], dtype="<u2").astype(np.int64))
    return places, np.frombuffer(raw[2 * size :], dtype="u1").reshape(8, size).T.copy().view("<i8").reshape(-1)


def vectors(docs: DataFrame) -> DataFrame:
    """``lang, source, g, groups, strip, n, terms, of_lang`` and ``items``, the terms that each group has in each strip of its language.

    ``g`` is the group's number of ``groups`` in the language, ``n`` its occurrences of kept terms, ``terms`` how many are kept in the language, ``of_lang`` their occurrences.
    An item is a term's place in the strip, the term, its count in the group and in the language.  A group has a row for each strip, also without items.
    """
    counted = durable(counts(docs), "divergence-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= LEAST_DOCS)
    sized = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("of_lang"))
    groups = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_name = Window.partitionBy("lang")
    groups = groups.withColumn("g", F.row_number().over(by_name.orderBy("source")) - 1).withColumn("groups", F.count(F.lit(1)).over(by_name))
    strips = F.expr(f"greatest(1, (terms + {STRIP - 1}) div {STRIP})")
    # a strip is a bucket of hashes, so its terms are about STRIP; places are given within it
    # dealt by both, as a language alone may hold most terms
    placed = kept.join(sized, "lang").withColumn("strip", F.pmod(F.xxhash64("term"), strips)).repartition("lang", "strip")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "strip").orderBy("term")) - 1)
    placed = durable(placed.select("lang", "term", "total", "strip", "place"), "divergence-terms")
    has = counted.join(placed, ["lang", "term"])
    items = durable(has.groupBy("lang", "source", "strip").agg(F.array_sort(F.collect_list(F.struct("place", "term", "n", "total"))).alias("items"), F.sum("n").alias("here")), "divergence-items")
    of_group = items.groupBy("lang", "source").agg(F.sum("here").alias("n"))
    every = groups.join(sized, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["terms", "of_lang", "n"])
    every = every.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("bigint"), strips - 1)))
    in_strip = placed.groupBy("lang", "strip").agg(F.count(F.lit(1)).alias("width"))
    return every.join(items.drop("here"), ["lang", "source", "strip"], "left").join(in_strip, ["lang", "strip"], "left").na.fill(0, ["width"])


def tournament(g: Column, groups: Column) -> Column:
    """The meetings in which group ``g`` of ``groups`` is the visitor: structs of ``round`` and ``resident``.

    By the circle method: groups i and j meet in round (i + j) mod (m - 1), m being the even number of places at the table, and the last place meets i in
    round 2i mod (m - 1).  The one with the lower number stays where the numbers' sum is odd, and the other elsewhere, so each receives about half of its peers.
    """
    turns = groups + F.pmod(groups, F.lit(2)) - 1
    others = F.filter(F.sequence(F.lit(0), groups - 1), lambda j: (j != g) & F.when(F.pmod(g + j, F.lit(2)) == 1, j < g).otherwise(j > g))

    def meeting(j: Column) -> Column:
        last, first = F.greatest(g, j), F.least(g, j)
        return F.struct(F.when(last == turns, F.pmod(2 * first, turns)).otherwise(F.pmod(g + j, turns)).alias("round"), j.alias("resident"))

    return F.transform(others, meeting)


def meetings(rows: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` from :func:`vectors`: what each strip adds to each pair of groups, both ways, and each strip's heap of terms."""

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column(batch.schema.get_field_index("items")):
                listed = items.values if items.is_valid else None
                out.append(packed(*(listed.field(k).to_numpy().astype(np.int64) for k in ("place", "n"))) if listed is not None else packed(np.zeros(0, np.int64), np.zeros(0, np.int64)))
            yield batch.append_column("vector", pa.array(out, pa.binary()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    told = durable(in_batches(rows, compress, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", vector binary"), "divergence-vectors")
    who = F.struct("g", "source", "n", "vector").alias("who")
    resident = told.select("lang", "strip", F.col("g").alias("at"), F.lit(-1).alias("round"), who, "terms", "width", "of_lang", "items")
    meets = told.withColumn("meeting", F.explode(tournament(F.col("g"), F.col("groups").cast("int"))))
    visits = meets.select("lang", "strip", F.col("meeting.resident").alias("at"), F.col("meeting.round").alias("round"), who, "terms", "width", "of_lang", F.lit(None).cast(kinds["items"]).alias("items"))
    dealt = resident.unionByName(visits).repartition("lang", "strip", "at").sortWithinPartitions("lang", "strip", "at", "round")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        for batch in batches:
            out: list[tuple[str, str, str, str, int]] = []
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                who, lang = columns["who"][k].as_py(), columns["lang"][k].as_py()
                terms, width = columns["terms"][k].as_py(), columns["width"][k].as_py()
                places, n = unpacked(who["vector"])
                dense = np.zeros(width, dtype=np.int64)
                dense[places] = n
                p = _shares(dense, who["n"], terms) if width else dense
                if columns["round"][k].as_py() < 0:
                    here = (who["source"], p)
                    items = columns["items"][k]
                    if items.is_valid:
                        out += [(lang, who["source"], "term", term, value) for value, term in heap(items.values, p, columns["of_lang"][k].as_py(), terms)]
                else:  # one meeting, both directions
                    value = int(apart(here[1], p).sum())
                    out += [(lang, here[0], "pair", who["source"], value), (lang, who["source"], "pair", here[0], value)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["lang", "source", "part", "item", "value"])

    def heap(items: pa.StructArray, p: np.ndarray, of_lang: int, terms: int) -> list[tuple[int, str]]:
        own = p[items.field("place").to_numpy()]
        q = _shares(items.field("total").to_numpy(), of_lang, terms)
        value = np.where(own > q, apart(own, q), -1)
        least = np.partition(value, -TOP)[-TOP] if len(value) > TOP else 0
        some = np.flatnonzero((value >= max(least, 0)) & (own > q))
        named = zip(value[some].tolist(), items.field("term").take(pa.array(some)).to_pylist(), strict=True)
        return heapq.nsmallest(TOP, named, key=lambda x: (-x[0], x[1].encode()))

    return in_batches(dealt, run, "lang string, source string, part string, item string, value bigint")


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's divergence from every other of its language, and its ``TOP`` terms that stand out from the language.

    In part ``pair`` the item is the other source and the value the sum over the language's kept terms, 0 if there are none; in part ``term`` the item is a kept
    term that is more frequent in the source than in the language.  Ranks are by value, then by item.  Null texts, languages and sources are empty ones; a source without terms has pairs and no terms, a
    source that is alone in its language no pairs.  Repeated rows count as often as they are there; extra columns are left out; an empty table gives an empty one.
    """
    found = meetings(vectors(docs)).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # a group has one row for each peer, and TOP terms from each strip
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(f"part = 'pair' OR rank <= {TOP}").select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), said AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM said GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
here AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM groups g LEFT JOIN here h USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS count, 1 + {SCALE}::HUGEINT * (coalesce(h.n, 0) + {ADDED}) // (s.n + {ADDED} * l.v)::HUGEINT AS p,
         1 + {SCALE}::HUGEINT * (k.total + {ADDED}) // (l.n + {ADDED} * l.v)::HUGEINT AS q
  FROM sizes s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang LEFT JOIN here h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) t
    ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE count > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
