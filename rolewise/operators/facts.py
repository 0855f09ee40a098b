"""Fact populations: wide rows, their projections and the canonical long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def facts_of(table: DataFrame, **roles: str) -> DataFrame:
    """A fact's rows from a table: role name to column.  A row with a null in a role states no fact."""
    named = table.select(*[F.col(c).alias(r) for r, c in roles.items()])
    return named.where(reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in roles]))


def project(fact: DataFrame, *roles: str) -> DataFrame:
    """The distinct projection on a sequence of roles."""
    return fact.select(*roles).distinct()


def duplicates(fact: DataFrame, *roles: str) -> DataFrame:
    """Set semantics: tuples that are stated more than once, and ``n``."""
    return fact.groupBy(*roles).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merged(*populations: DataFrame) -> DataFrame:
    """The union of fact populations as a set."""
    return reduce(lambda a, b: a.unionByName(b), populations).distinct()


def literal_conflicts(values: DataFrame) -> DataFrame:
    """Instances of ``values(instance_id, literal)`` to which merged populations give different literals."""
    return values.groupBy("instance_id").agg(F.count_distinct("literal").alias("n")).where("n > 1")


def lengthen(table: DataFrame, entity: str, key: str, fields: Sequence[str]) -> DataFrame:
    """A wide table as ``entity, owner, field, value`` rows; null fields state nothing.  One scan, no shuffle."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = table.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("owner"), F.inline(cells))
    return long.where(F.col("owner").isNotNull() & F.col("value").isNotNull())


def widen(long: DataFrame, fields: Sequence[str], keep_multiple: bool = False) -> DataFrame:
    """``owner, field, value`` rows as one wide row for each owner: the physical form of an entity's fields.

    The fields are given, so that no pass is needed to find them.  A field with several values keeps the least; with
    ``keep_multiple`` the column ``multivalued`` counts the fields that a wide row cannot hold, which are those with a greater value, too.
    """
    at = lambda f: F.when(F.col("field") == f, F.col("value"))
    cells = [F.min(at(f)).alias(f) for f in fields]
    if keep_multiple:
        cells.append(reduce(lambda a, b: a + b, [F.coalesce((F.max(at(f)) > F.min(at(f))).cast("int"), F.lit(0)) for f in fields]).alias("multivalued"))
    return long.where(F.col("field").isin(*fields)).groupBy("owner").agg(*cells)


def following(rows: DataFrame, group: str, order: Sequence[str], value: str, part: Column) -> DataFrame:
    """``rows`` with ``following``: the value of the next row of the group by ``order``; null after the last.

    ``part`` cuts every group into runs in that order, such as the hours of a time that leads the order.  A run is what a task sorts; the last row of
    one takes the first value of the next run that has rows, from a table with a row for each run.  So no group is sorted whole.
    """
    cut = rows.withColumn("_part", part)
    within = cut.withColumn("_next", F.lead(F.struct(value)).over(Window.partitionBy(group, "_part").orderBy(*order)))
    firsts = cut.groupBy(group, "_part").agg(F.min_by(F.struct(value), F.struct(*order)).alias("_first"))
    after = firsts.select(F.col(group).alias("_group"), F.col("_part").alias("_run"), F.lead("_first").over(Window.partitionBy(group).orderBy("_part")).alias("_after"))
    joined = within.join(after, F.col(group).eqNullSafe(F.col("_group")) & F.col("_part").eqNullSafe(F.col("_run")))
    return joined.select(*rows.columns, F.coalesce("_next", "_after")[value].alias("following"))


def multivalued(long: DataFrame, *key: str, value: str = "value") -> DataFrame:
    """Keys with several different values, which a single-valued target cannot hold, and ``n``."""
    return long.groupBy(*key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def contiguity(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """For each key the number of rows ``n`` and whether its ordinals are 0, 1, ..., n - 1, each once."""
    agg = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ordinal).alias("d"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    ok = (F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return agg.select(key, "n", F.coalesce(ok, F.lit(False)).alias("contiguous"))


def gather(rows: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """Each key's values in the order of their ordinals, for keys of bounded size such as a fact type's roles."""
    items = F.sort_array(F.collect_list(F.struct(ordinal, value)))
    return rows.groupBy(key).agg(F.transform(items, lambda x: x[value]).alias("values"))


def absorbed(owners: DataFrame, key: str, fact: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """A binary fact absorbed into its owner's row: all owners, with the fact's columns where it is stated.

    The fact must hold one row at most for each owner; further rows stay further rows, so that they can be found.
    """
    return owners.join(fact.select(F.col(on).alias("_on"), *columns), F.col(key) == F.col("_on"), "left").drop("_on")


def folded(owners: DataFrame, key: str, facts: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> tuple[DataFrame, DataFrame]:
    """Many facts absorbed into their owners' rows at once: the owners with the columns ``<fact>__<column>``, and what had no place in them.

    ``facts`` name (rows, the column of the owner, columns).  All of them are one union, tagged by fact, and one aggregation by owner takes the least row of each fact into its slot, before the
    shuffle: however many facts there are, owners are joined once.  The overflow ``fact, owner, row, n`` has as JSON what came beside a slot: other rows of the same owner and fact, and the same row ``n`` times more; and
    rows of owners that aren't there.  A null owner states nothing.
    """
    tagged = None
    for name, (rows, on, columns) in facts.items():
        one = rows.select(F.lit(name).alias("fact"), F.col(on).alias("owner"), F.struct(*[F.col(c).alias(f"{name}__{c}") for c in columns]).alias(f"_{name}")).where("owner IS NOT NULL")
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    counted = tagged.groupBy("fact", "owner", *[f"_{n}" for n in facts]).agg(F.count(F.lit(1)).alias("times"))
    slots = counted.groupBy("owner").agg(*[F.min(f"_{n}").alias(f"_{n}") for n in facts])
    there = owners.join(slots, F.col(key) == F.col("owner"), "left")
    wide = there.select(*owners.columns, *[F.col(f"_{n}.{n}__{c}").alias(f"{n}__{c}") for n, (_, _, columns) in facts.items() for c in columns])
    taken = slots.join(owners.select(F.col(key).alias("owner")).distinct(), "owner", "left_semi").select(F.col("owner").alias("_owner"), *[F.col(f"_{n}").alias(f"_slot_{n}") for n in facts])
    met = counted.join(taken, F.col("owner") == F.col("_owner"), "left")
    in_slot = reduce(lambda a, b: a | b, [(F.col("fact") == n) & F.col(f"_{n}").eqNullSafe(F.col(f"_slot_{n}")) for n in facts])
    left = F.when(F.coalesce(in_slot & F.col("_owner").isNotNull(), F.lit(False)), F.col("times") - 1).otherwise(F.col("times"))
    text = F.coalesce(*[F.to_json(f"_{n}") for n in facts])
    return wide, met.select("fact", "owner", text.alias("row"), left.alias("n")).where("n > 0")


def presence(wide: DataFrame, *columns: str) -> DataFrame:
    """How many rows state an absorbed fact: those whose columns are not null."""
    return wide.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).agg(F.count(F.lit(1)).alias("present"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """What one of two populations of the same columns has and the other has not, as bags, with the ``side``."""
    columns = a.columns
    left = a.exceptAll(b.select(columns)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(columns).exceptAll(a).withColumn("side", F.lit("right")))


def source_facts(facts: DataFrame, hints: DataFrame) -> DataFrame:
    """The facts of ``facts(fact, ...)`` that are stated as such, and not as a field of ``hints(field_fact, ...)``."""
    return facts.join(hints.select(F.col("field_fact").alias("fact")).distinct(), "fact", "left_anti")


def unused_values(objects: DataFrame, roles: DataFrame, fields: DataFrame) -> DataFrame:
    """``name``: the value types of ``objects(name, kind)`` that play no role and are the type of no field, so that no target has a column for them."""
    used = roles.select(F.col("player").alias("name")).union(fields.select("type"))
    return objects.where("kind = 'value'").select("name").join(used.distinct(), "name", "left_anti")


def physical_columns(mapping: DataFrame) -> DataFrame:
    """``table, columns``: all columns that ``mapping(table, column)`` needs of each table, in order."""
    return mapping.where("column IS NOT NULL").groupBy("table").agg(F.sort_array(F.collect_set("column")).alias("columns"))
