"""Merkle manifest of a dataset: every row's authentication path by fractal traversal, up to one root.

A row is a leaf.  The leaves of a source are in the order of their doc_ids, and runs of ``FAN`` nodes become their hash until one
is left; the sources' roots become the root of all in the same way.

Leaves are placed by a sort of ranges, whatever a source holds, and cut into aligned blocks of ``FAN ** DEPTH``.  The blocks' own
hashes and all that is above them are aggregations of runs, a fraction of ``FAN`` smaller at each level.  Then a task walks each of its blocks leaf by
leaf.  It keeps, stacked by level, the *existing* run that the path of the present leaf goes through, and the *desired* run
next to it, which takes one leaf further on at each step: when the walk leaves an existing run, the desired one is ready and takes its place.  So
successive paths come in order, a leaf is hashed once a level, and a task holds one block's leaves and two runs a level.  The path from the
block to the root comes with the block, as one row before its leaves, and is appended to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolewise.llm.common import durable, in_batches

#: Nodes that become one, and the levels of a block.
FAN, DEPTH = 16, 3
#: Leaves whose paths a task passes on at a time.
ROWS = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place:int,siblings:string>>"
_ENTRY = pa.struct([("place", pa.int32()), ("siblings", pa.string())])


def leaf_hash(*values: Column) -> Column:
    """SHA-256 in hex of ``values``, each with its length in bytes before it, or a dash if it is null."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


def placed(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``doc_id, leaf, changed`` with ``s`` and ``at``, the places of each row's source and of the row within it, ``n``, the rows of the source.

    ``changed`` is the leaf of the row with that for its text, and null where that is null.  Rows alike in source and doc_id are in the order of
    their leaves.  The rank of sources is a window over one row for each source and task, not over rows.
    """
    fields = [docs[c] for c in FIELDS]
    other = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf_hash(*fields[:-1], changed))
    # rows alike in all that they are ordered by may be many: equal leaves are interchangeable, so a number deals them out
    told = durable(docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), leaf_hash(*fields).alias("leaf"), other.alias("changed"), (F.monotonically_increasing_id() % 1024).alias("salt")), "merkle-leaves")
    keys = ["source", "doc_id", "leaf", "salt"]
    number = F.monotonically_increasing_id()
    ordered = durable(told.repartitionByRange(*keys).sortWithinPartitions(*keys).select("source", "doc_id", "leaf", "changed", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "merkle-ordered")
    of_source = Window.partitionBy("source")
    earlier = of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ordered.groupBy("part", "source").agg(F.count(F.lit(1)).alias("here"), F.min("row").alias("first"))
    runs = runs.select(
        F.col("part").alias("of_part"), F.col("source").alias("of_source"), (F.coalesce(F.sum("here").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(of_source).alias("n"),
        (F.dense_rank().over(Window.orderBy("source")) - 1).cast("bigint").alias("s"),
    )
    found = ordered.join(runs, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    return durable(found.select("s", "n", (F.col("row") + F.col("shift")).alias("at"), "doc_id", "leaf", "changed"), "merkle-placed")


def _runs(nodes: DataFrame, *within: str) -> DataFrame:
    """``s, n, at, run``: the digests of each run of ``nodes(s, n, at, digest)``, ``at`` being the run's place."""
    run = F.expr(f"at div {FAN}")
    return nodes.groupBy("s", "n", *within, run.alias("run_at")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("nodes")).select("s", "n", *within, F.col("run_at").alias("at"), F.col("nodes.digest").alias("run"))


def _raised(runs: DataFrame, level: int, *within: str) -> DataFrame:
    """The nodes over ``runs`` of nodes at ``level``; where a tree has one node already, that stays."""
    digest = F.when(F.col("n") > FAN**level, F.sha2(F.concat_ws("", "run"), 256)).otherwise(F.col("run")[0])
    return runs.select("s", "n", *within, "at", digest.alias("digest"))


def _height(n: int) -> int:
    """Levels until ``n`` nodes are one."""
    height = 0
    while FAN**height < n:
        height += 1
    return height


def _climbed(below: DataFrame, nodes: DataFrame, start: int, height: int) -> tuple[DataFrame, DataFrame]:
    """``below(s, n, at, path)`` with the paths from level ``start`` to ``height`` appended, and the nodes there.

    ``nodes`` are those at level ``start``, and ``below`` names the one that each of its rows is under.
    """
    for level in range(start, height):
        runs = _runs(nodes)
        node = F.expr(f"at div {FAN ** (level - start)}L")
        side = runs.select(F.col("s").alias("_s"), F.col("at").alias("_run"), "run")
        met = below.join(side, (F.col("s") == F.col("_s")) & (F.expr(f"at div {FAN ** (level - start + 1)}L") == F.col("_run")))
        place = (node % FAN).cast("int")
        others = F.concat(F.concat_ws("", F.slice("run", F.lit(1), place)), F.concat_ws("", F.slice("run", place + 2, F.lit(FAN))))
        entry = F.struct(place.alias("place"), others.alias("siblings"))
        below = met.withColumn("path", F.when(F.col("n") > FAN**level, F.concat("path", F.array(entry))).otherwise(F.col("path"))).drop("_s", "_run", "run")
        nodes = _raised(runs, level)
    return below, nodes


class Treehash:
    """Runs of a subtree in the making, one for each level up to ``top``; it takes leaves in order."""

    def __init__(self, top: int):
        self.stack: list[list[str]] = [[] for _ in range(top + 1)]

    def take(self, digest: str) -> None:
        for run in self.stack[:-1]:
            run.append(digest)
            if len(run) < FAN:
                return
            digest = _digest(run)
            run.clear()
        self.stack[-1].append(digest)

    def finished(self) -> list[str]:
        """The run at the top, when there are no more leaves: runs that are not full become their hash, too."""
        for run, above in zip(self.stack, self.stack[1:], strict=False):
            if run:
                above.append(_digest(run))
                run.clear()
        return self.stack[-1]


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def traversed(leaves: list[str], levels: int) -> Iterator[list[tuple[int, str]]]:
    """For each of a block's ``leaves`` in turn its path within the block, (place, siblings) at each of ``levels``."""
    exist, desired, begun = [], [Treehash(level) for level in range(levels)], [FAN ** (level + 1) for level in range(levels)]
    for level in range(levels):
        first = Treehash(level)
        for leaf in leaves[: begun[level]]:
            first.take(leaf)
        exist.append(first.finished())
    path: list[tuple[int, str]] = [(-1, "")] * levels
    for k in range(len(leaves)):
        for level in range(levels):
            span = begun[level]
            if k and k % span == 0:
                exist[level], desired[level] = desired[level].finished(), Treehash(level)
            if k % FAN**level == 0:
                run, place = exist[level], k // FAN**level % FAN
                path[level] = place, "".join(run[:place]) + "".join(run[place + 1 :])
            if k + span < len(leaves):
                desired[level].take(leaves[k + span])
        yield path


def paths(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``changed``, ``subroot``, ``root`` and ``path`` of each row of ``docs``.

    ``path`` has for each level, from the leaf to the root of all, the ``place`` within the run and the run's other digests, left to right.  ``changed`` is what the leaf
    would be with another text, if the column of that name is given and not null: see :func:`folded`.

    A null source is one of its own, before all others; rows without a doc_id are before the others of their source, and rows that share one are in the order of their leaves.
    Repeated rows are a leaf each.  Nulls, and empty and very long texts, are hashed as they are.  Extra columns are left out; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, leaf string, changed string, subroot string, root string, path {PATH}"
    rows = placed(docs, changed)
    most, sources = rows.agg(F.max("n"), F.max("s") + 1).first()
    if not most:
        return docs.sparkSession.createDataFrame([], result)
    size = FAN**DEPTH
    block = F.expr(f"at div {size}")
    nodes = rows.select("s", "n", block.alias("block"), "at", F.col("leaf").alias("digest")).repartition("s", "block")
    for level in range(DEPTH):
        nodes = _raised(_runs(nodes, "block"), level, "block")
    blocks = durable(nodes.select("s", "n", F.col("block").alias("at"), "digest"), "merkle-blocks")
    empty = F.array().cast(PATH)
    below, roots = _climbed(blocks.select("s", "n", "at", empty.alias("path")), blocks, DEPTH, _height(most))
    roots = durable(roots, "merkle-roots").select(F.lit(0).alias("s"), F.lit(sources).alias("n"), F.col("s").alias("at"), "digest")
    over, top = _climbed(roots.select("s", "n", "at", empty.alias("path"), F.col("digest").alias("subroot")), roots, 0, _height(sources))
    root = top.first()["digest"]
    over = over.select(F.col("at").alias("_source"), "subroot", F.col("path").alias("_over"))
    heads = durable(below.join(over, F.col("s") == F.col("_source")).select("s", "n", "at", "subroot", F.concat("path", "_over").alias("path")), "merkle-heads")

    null = lambda of: F.lit(None).cast(of)
    first = heads.select("s", F.col("at").alias("block"), F.lit(-1).cast("bigint").alias("at"), "n", null(kind).alias("doc_id"), null("string").alias("leaf"), null("string").alias("changed"), "subroot", "path")
    rest = rows.select("s", block.alias("block"), "at", "n", "doc_id", "leaf", "changed", null("string").alias("subroot"), null(PATH).alias("path"))
    walked = first.unionByName(rest).repartition("s", "block").sortWithinPartitions("s", "block", "at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, waiting = None, []
        for batch in batches:
            starts = np.flatnonzero(batch.column(2).to_numpy() < 0)
            for i, j in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if j > i and head is not None:
                    part = batch.slice(i, j - i)
                    waiting.append(part if part.column(2)[0].as_py() >= 0 else part.slice(1))
                if j < batch.num_rows:
                    if head is not None:
                        yield from walk(head, waiting)
                    head, waiting = batch.slice(j, 1).to_pylist()[0], []
        if head is not None:
            yield from walk(head, waiting)

    def walk(head: dict, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, leaves, others = (pa.chunked_array([p.column(k) for p in parts]) for k in (4, 5, 6))
        digests, above = leaves.to_pylist(), [(x["place"], x["siblings"]) for x in head["path"]]
        places, siblings, offsets, begun = [], [], [0], 0

        def emit() -> pa.RecordBatch:
            n = len(offsets) - 1
            entries = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.string())], fields=list(_ENTRY))
            path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            same = [pa.array([text] * n, pa.string()) for text in (head["subroot"], root)]
            cut = [c.slice(begun, n).combine_chunks() for c in (ids, leaves, others)]
            return pa.RecordBatch.from_arrays([*cut, *same, path], names=["doc_id", "leaf", "changed", "subroot", "root", "path"])

        for within in traversed(digests, min(DEPTH, _height(head["n"]))):
            for place, others_there in (*within, *above):
                places.append(place)
                siblings.append(others_there)
            offsets.append(len(places))
            if len(offsets) > ROWS:
                yield emit()
                begun += len(offsets) - 1
                places, siblings, offsets = [], [], [0]
        if len(offsets) > 1:
            yield emit()

    return in_batches(walked, run, result)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""

    def step(node: Column, entry: Column) -> Column:
        cut = entry["place"] * 64
        return F.sha2(F.concat(F.substring(entry["siblings"], F.lit(1), cut), node, F.substring(entry["siblings"], cut + 1, F.lit(64 * FAN))), 256)

    return F.aggregate(path, leaf, step)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def checked(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: every row's proof, held against the row as it is or tampered with.

    Where 5 divides the crc32 of the doc_id as text, the text is in lower case when its leaf is made anew.  A null doc_id or text is not tampered with.
    """
    tampered = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    found = paths(docs, F.when(tampered, lowered(docs["text"].cast("string"))))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: x["siblings"]), ""), 256)
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"), (again == F.col("root")).alias("verified"))


def _oracle(levels: int = 5, over: int = 3) -> str:
    """The manifest as SQL: one query for each level, of up to ``FAN ** levels`` rows a source and ``FAN ** over`` sources."""
    told = ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1])
    own = "coalesce(strlen({0}) || ':' || {0}, '-')"
    hashed = lambda text: f"sha256(concat({told}, {own.format(text)}))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "xor(c >> 1, 3988292384::BIGINT * (c & 1))"
    byte = f"lambda c, k: list_reduce(range(9), lambda c, j: CASE WHEN j = 0 THEN c ELSE {bit} END, xor(c, ascii(substr(doc_id::VARCHAR, k::INTEGER, 1))::BIGINT))"
    crc = f"xor(list_reduce(range(1, strlen(doc_id::VARCHAR) + 1), {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"
    parts = [
        f"""rows_ AS (
  SELECT doc_id, source, {hashed("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed(low)} END AS changed FROM documents
), placed AS (
  SELECT doc_id, leaf, coalesce(changed, leaf) AS f0, '' AS p0, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM rows_
), n0 AS (SELECT s, n, pos, leaf AS h FROM placed)"""
    ]

    def climb(name: str, level: int) -> None:
        parts.append(f"{name}r{level} AS (SELECT s, n, pos // {FAN} AS pos, list(h ORDER BY pos) AS run FROM {name}{level} GROUP BY ALL)")
        parts.append(f"{name}{level + 1} AS (SELECT s, n, pos, CASE WHEN n > {FAN**level} THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}r{level})")

    def walk(into: str, frm: str, runs: str, level: int, key: str, place: str, count: str) -> None:
        at = f"({place} // {FAN**level}) % {FAN}"
        left, right = f"array_to_string(run[1:{at}], '')", f"array_to_string(run[{at} + 2:], '')"
        parts.append(
            f"{into} AS (SELECT t.* EXCLUDE (f0, p0), CASE WHEN {count} > {FAN**level} THEN sha256({left} || f0 || {right}) ELSE f0 END AS f0, "
            f"CASE WHEN {count} > {FAN**level} THEN p0 || {left} || {right} ELSE p0 END AS p0 FROM {frm} t JOIN {runs} r ON r.s = {key} AND r.pos = {place} // {FAN ** (level + 1)})"
        )

    for level in range(levels):
        climb("n", level)
        walk(f"w{level + 1}", f"w{level}" if level else "placed", f"nr{level}", level, "t.s", "t.pos", "t.n")
    parts.append(f"m0 AS (SELECT 0 AS s, count(*) OVER () AS n, s AS pos, h FROM n{levels})")
    parts.append(f"v0 AS (SELECT t.*, m0.h AS subroot, m0.n AS sources FROM w{levels} t JOIN m0 ON m0.pos = t.s)")
    for level in range(over):
        climb("m", level)
        walk(f"v{level + 1}", f"v{level}", f"mr{level}", level, "0", "t.s", "t.sources")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(p0) AS proof_sha256, f0 AS folded_root, f0 = h AS verified FROM v{over}, m{over}"


ORACLE_SQL = _oracle()
