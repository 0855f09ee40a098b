"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions alone.

A source that is to give a share r of its size takes every document floor(r) times and once more with a chance of the
rest of r.  The extra copies aren't drawn one by one: two documents with fractional chances meet, and mass (chance times
size) moves from one to the other, in a random direction chosen so that neither chance changes on average, until one of
the two is whole.  The sum of the masses, and so the words that a source gives, stays as it is.  What is still
fractional goes on to the next meeting.  Documents meet within blocks, each block leaves at most one, and these meet in
blocks again: a reduction tree with one level for every factor ``BLOCK`` of documents.  Only the last document of a source
is rounded by itself.

Rows that share source, doc_id and size are alike to the mix: between them mass moves until all but one are whole, which needs no
meeting but a count.  So they are one row with a number until the end, and many rows without an id crowd no block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolewise.llm.common import durable

#: Words as the contract has them, the highest ratio of a target to its source's size, and documents that meet in a block.
WORD, MOST, BLOCK = "[^\\x20\\x09-\\x0D]+", 3, 64
#: Rows that one row with a number becomes in a task.
SPREAD = 1 << 14


def targets(sized: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``n``, ``target`` from ``source``, ``size`` and ``rows`` (how many such documents): a row for each source.

    Filling up by weight, with every source's target stopped at ``MOST`` times its size, gives each the smaller of that
    and weight times one common level.  Sources are taken in the order in which they stop, and the level is what is
    left over the weights left at the first source that does not.
    """
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("most", F.col("source_size") * MOST)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stepped = (
        weighed.withColumn("left", F.sum("source_size").over(all_rows) - before)
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level")))
        .withColumn("level", F.min("open").over(all_rows)["level"])
    )
    fill = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return stepped.select("source", "source_size", "n", F.coalesce(fill, F.col("most").cast("double")).alias("target"))


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the values of ``parts`` alone, so that reruns agree."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def _meet(level: int):
    """The type and the step of a block's fold: ``open``, the document that is still fractional, and ``done``, the others."""
    item = "struct<doc_id:{id},source:string,size:bigint,rows:bigint,extra:bigint,mass:double>"
    kind = f"struct<open:{item},done:array<{item}>>"

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        up = F.least(a["size"] - a["mass"], x["mass"])
        down = F.least(a["mass"], x["size"] - x["mass"])
        raised = _chance(F.lit(level), a["doc_id"], x["doc_id"], a["size"], x["size"]) * (up + down) < down
        moved = F.when(raised, up).otherwise(-down)
        # what fills or empties a document does so exactly
        mine = F.when(raised & (up == a["size"] - a["mass"]), a["size"].cast("double")).when(~raised & (down == a["mass"]), F.lit(0.0)).otherwise(a["mass"] + moved)
        theirs = F.when(raised & (up == x["mass"]), F.lit(0.0)).when(~raised & (down == x["size"] - x["mass"]), x["size"].cast("double")).otherwise(x["mass"] - moved)
        first, second = a.withField("mass", mine), x.withField("mass", theirs)
        settled = (mine <= 0) | (mine >= a["size"])
        met = F.struct(F.when(settled, second).otherwise(first).alias("open"), F.concat(state["done"], F.array(F.when(settled, first).otherwise(second))).alias("done"))
        return F.when(a.isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(met)

    return kind, step


def _size(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("bigint")


def decided(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``rows`` (how many rows of ``docs`` have these), ``source_size``, ``target``, ``whole``, ``extra``.

    The mix takes each of the rows ``whole`` times, and ``extra`` of them once more.
    """
    one = docs.select("doc_id", F.col("source").cast("string").alias("source"), _size(docs).alias("size"))
    sized = durable(one.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    goals = durable(targets(sized))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # what all rows alike are due over their whole copies: so many more, and a chance of another
    due = (ratio - F.floor(ratio)) * F.col("rows")
    aimed = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).select(
        sized["doc_id"], sized["source"], "size", "rows", "n", F.when(F.col("size") > 0, F.floor(due)).otherwise(0).alias("extra"), ((due - F.floor(due)) * F.col("size")).alias("mass")
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    largest = goals.agg(F.max("n")).first()[0] or 0
    names = ["doc_id", "source", "size", "rows", "extra", "mass"]
    open_rows = aimed.where("mass > 0").select(*names, "n")
    settled = [aimed.where("NOT mass > 0").select(*names)]
    for level in range(max(1, math.ceil(math.log(max(largest, 2), BLOCK)))):
        blocks = F.ceil(F.col("n") / F.lit(float(BLOCK) ** (level + 1)))
        spread = F.xxhash64(F.lit(level), "doc_id", "size").bitwiseAND(F.lit((1 << 62) - 1))
        kind, step = _meet(level)
        kind = kind.format(id=id_type)
        grouped = open_rows.withColumn("block", spread % blocks).groupBy("source", "n", "block").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
        start = F.from_json(F.lit('{"open":null,"done":[]}'), kind)
        folded = durable(grouped.select("source", "n", F.aggregate("items", start, step).alias("state")))
        settled.append(folded.select(F.inline("state.done")))
        open_rows = folded.select("state.open.*", "n")
    last = F.when(_chance(F.lit("last"), "doc_id", "size") * F.col("size") < F.col("mass"), F.col("size")).otherwise(0).cast("double")
    rounded = open_rows.select(*names).withColumn("mass", last)
    for rows in settled:
        rounded = rounded.unionByName(rows)
    goal = goals.select(F.col("source").alias("of"), "source_size", "target")
    extra = (F.col("extra") + (F.col("mass") > 0).cast("bigint")).alias("extra")
    return rounded.join(goal, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "rows", "source_size", "target", F.floor(ratio).cast("int").alias("whole"), extra)


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row) of each row.

    A null or empty text has size 0 and is taken as often as its source's target allows in full, adding no words.  A null
    source is a source of its own.  Rows that repeat a doc_id, or have none, are documents of their own with the same chances.  If no
    text has a word, all targets are 0.  Extra columns are left out; an empty table gives an empty one.
    """
    found = decided(docs)
    names = ["doc_id", "source", "size", "source_size", "target"]
    single = found.where("rows = 1").select(*names, (F.col("whole") + F.col("extra")).cast("int").alias("copies"))
    # a row with a number becomes that many rows again, in many tasks if they are many
    parts = found.where("rows > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(rows - 1) div {SPREAD}"))))
    spread = parts.repartition("doc_id", "source", "size", "part")
    numbers = F.sequence(F.col("part") * SPREAD + 1, F.least(F.col("rows"), (F.col("part") + 1) * SPREAD))
    many = spread.withColumn("number", F.explode(numbers)).select(*names, (F.col("whole") + (F.col("number") <= F.col("extra")).cast("int")).cast("int").alias("copies"))
    return single.unionByName(many)


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of each row."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it; see :func:`copies` for odd rows.

    Of rows that share doc_id, source and size, and of which only some are taken once more, the first ones by their place in a written
    table are: numbered within the table's parts, after the counts of the parts before.
    """
    keys = ["doc_id", "source", "size"]
    found = decided(docs).select(*[F.col(k).alias(f"of_{k}") for k in keys], "rows", "whole", "extra")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), _size(docs).alias("size"))
    alike = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("rows"))

    def repeated(table: DataFrame, once_more: Column) -> DataFrame:
        taken = table.withColumn("copies", (F.col("whole") + F.when(once_more, 1).otherwise(0)).cast("int")).where("copies > 0")
        return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

    out = repeated(rows.join(found.where(~some), alike), F.col("extra") > 0)
    if found.where(some).isEmpty():
        return out
    split = durable(rows.join(found.where(some), alike).withColumn("place", F.monotonically_increasing_id()), "mixing-alike").withColumn("part", F.shiftright("place", 33))
    numbered = split.withColumn("number", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("place")))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = split.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("part").alias("b_part"), "before")
    placed = numbered.join(before, [*[F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys], F.col("part") == F.col("b_part")])
    return out.unionByName(repeated(placed, F.col("before") + F.col("number") <= F.col("extra")))
