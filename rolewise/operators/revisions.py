"""Tables of revisions held against what they say they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.operators import ancestry
from rolewise.sources.tables import discard, durable


def revision_id(content: Column, parents: Column) -> Column:
    """The hash of a revision: of its canonical content and the hashes that its parents are named by, in order; null parents are none."""
    return F.sha2(F.concat_ws("\n", content, F.array_sort(F.array_compact(parents))), 256)


def verified(revisions: DataFrame, parents: DataFrame) -> DataFrame:
    """``revision, status, recomputed, missing, cycle`` for ``revisions(revision, content, stored)`` and ``parents(revision, parent)``.

    Each revision's hash is computed anew from its content and its parents' stored hashes.  If it is another the revision is a ``mismatch``, and as a hash stands for all that it was
    made from, what comes after one is ``tainted``, however far.  A revision with a parent that isn't there is ``dangling`` and names it (the least, if several), and one that comes before
    itself is ``cyclic`` and names the cycle.  The first of mismatch, cyclic, dangling, tainted and ``verified`` that applies is told.

    The hashes are one join and one aggregation, and what comes after a mismatch is searched from there by runs, so nothing is computed level by level.  Repeated rows of
    ``parents`` count once; of a repeated revision each row is judged.
    """
    links = durable(parents.select("revision", "parent").where("revision IS NOT NULL AND parent IS NOT NULL").distinct(), "verified-links")
    named = revisions.groupBy(F.col("revision").alias("parent")).agg(F.min("stored").alias("hash"), F.lit(True).alias("there"))
    found = links.join(named, "parent", "left").groupBy("revision").agg(F.array_compact(F.collect_list("hash")).alias("hashes"), F.min(F.when(F.col("there").isNull(), F.col("parent"))).alias("missing"))
    again = revisions.join(found, "revision", "left").withColumn("recomputed", revision_id(F.col("content"), F.coalesce("hashes", F.array().cast("array<string>"))))
    seen = durable(again.select("revision", "stored", "recomputed", "missing", (~F.col("stored").eqNullSafe(F.col("recomputed"))).alias("wrong")), "verified-seen")
    index = ancestry.runs(links.select(F.col("revision").alias("dst"), F.col("parent").alias("src")))
    after = ancestry.reached(index, seen.where("wrong").select(F.col("revision").alias("node")))
    at, cycles = ancestry.levels(links.toDF("src", "dst"))
    row = seen.join(after.select(F.col("node").alias("revision"), F.lit(True).alias("after")), "revision", "left").join(cycles.select(F.col("node").alias("revision"), "cycle"), "revision", "left")
    status = F.when(F.col("wrong"), "mismatch").when(F.col("cycle").isNotNull(), "cyclic").when(F.col("missing").isNotNull(), "dangling").when(F.col("after"), "tainted").otherwise("verified")
    out = durable(row.select("revision", status.alias("status"), "recomputed", "missing", "cycle"), "verified")
    index.drop()
    discard(links, seen, after, at, cycles)
    return out
