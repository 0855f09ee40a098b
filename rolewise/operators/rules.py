"""The rules of fact-oriented models: each returns the keys that violate it.

Facts are DataFrames with a column for each role.  All but :func:`frequency` with ``sample=True`` treat them as sets, so
a repeated row counts once.  Joins are equi-joins on keys and left to Spark to plan; projections are made distinct before
they are joined where the other side can then drop rows early.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.functions import scalar


# -- cardinality -----------------------------------------------------------------------------------------------------


def uniqueness(fact: DataFrame, key: Sequence[str], roles: Sequence[str]) -> DataFrame:
    """Keys with more than one distinct tuple, and ``n``.  A key that spans the fact is unique by set semantics."""
    if set(key) == set(roles):
        return fact.select(*key, F.lit(0).cast("bigint").alias("n")).limit(0)
    return fact.select(*roles).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def uniqueness_sample(fact: DataFrame, key: Sequence[str], roles: Sequence[str], order: str) -> DataFrame:
    """Rows of a sample that differ from the first row, by ``order``, of their key."""
    others = [r for r in roles if r not in key]
    first = fact.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(F.struct(*others), order).alias("_first"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    return fact.join(first, on).where(F.struct(*others) != F.col("_first")).select(*fact.columns)


def frequency(fact: DataFrame, key: Sequence[str], roles: Sequence[str], low: int = 0, high: int | None = None, sample: bool = False) -> DataFrame:
    """Keys that occur fewer than ``low`` or more than ``high`` times, and ``n``.

    Only keys that occur are bound.  A closed population is counted by distinct tuples, a sample by rows.
    """
    rows = fact.select(*roles) if sample else fact.select(*roles).distinct()
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    outside = F.col("n") < low
    return n.where(outside | (F.col("n") > high) if high is not None else outside)


# -- participation and set comparison --------------------------------------------------------------------------------


def _paired(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in zip(left, right, strict=True)])


def _missing(left: DataFrame, roles: Sequence[str], right: DataFrame, others: Sequence[str], how: str, keyed: bool = False) -> DataFrame:
    """Both sides are made distinct, which aggregates before the shuffle; a right side that is ``keyed`` by its columns is so already."""
    to = right.select(*others) if keyed else right.select(*others).distinct()
    return left.select(*roles).distinct().alias("l").join(to.alias("r"), _paired(roles, others), how)


def mandatory(members: DataFrame, key: str, fact: DataFrame, role: str) -> DataFrame:
    """Members that play the role in no fact."""
    return _missing(members, [key], fact, [role], "left_anti")


def subset(left: DataFrame, roles: Sequence[str], right: DataFrame, others: Sequence[str]) -> DataFrame:
    """Tuples of the left projection that the right one has not."""
    return _missing(left, roles, right, others, "left_anti")


def exclusion(left: DataFrame, roles: Sequence[str], right: DataFrame, others: Sequence[str]) -> DataFrame:
    """Tuples that both projections have."""
    return _missing(left, roles, right, others, "left_semi")


def equality(left: DataFrame, roles: Sequence[str], right: DataFrame, others: Sequence[str]) -> DataFrame:
    """Tuples that one projection has and the other has not, with the ``side`` that has them."""
    one = subset(left, roles, right, others).withColumn("side", F.lit("left"))
    two = subset(right, others, left, roles).toDF(*roles).withColumn("side", F.lit("right"))
    return one.unionByName(two)


def subtype(sub: DataFrame, key: str, sup: DataFrame, other: str) -> DataFrame:
    """Members of the subtype that the supertype has not."""
    return _missing(sub, [key], sup, [other], "left_anti", keyed=True)


def role_player(fact: DataFrame, role: str, members: DataFrame, key: str) -> DataFrame:
    """Players of a role that are no members of its type; ``key`` must identify the members."""
    return _missing(fact, [role], members, [key], "left_anti", keyed=True)


# -- within a fact ---------------------------------------------------------------------------------------------------


def symmetry(fact: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs without their reverse."""
    pairs = fact.select(a, b).distinct()
    return pairs.alias("l").join(pairs.alias("r"), (F.col(f"l.{a}") == F.col(f"r.{b}")) & (F.col(f"l.{b}") == F.col(f"r.{a}")), "left_anti")


def unordered(fact: DataFrame, group: Sequence[str], roles: Sequence[str]) -> DataFrame:
    """Unordered facts that are stated in more than one order: the sorted ``players``, the other roles, and ``n``."""
    others = [r for r in roles if r not in group]
    sorted_players = F.array_sort(F.array(*group)).alias("players")
    return fact.select(*roles).distinct().groupBy(sorted_players, *others).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unordered_canonical(fact: DataFrame, group: Sequence[str]) -> DataFrame:
    """The facts with the players of the group in order, as samples are read."""
    inside = F.array_sort(F.array(*group))
    return fact.withColumns({r: inside[k] for k, r in enumerate(group)})


def identifier(owners: DataFrame, key: str, components: Sequence[DataFrame]) -> DataFrame:
    """Identifier tuples that several owners share, and ``n``.

    Each component is a DataFrame ``owner, value``.  Only owners with exactly one row in every component take part: a
    missing or repeated value belongs to other rules.
    """
    joined = owners.select(F.col(key).alias("owner")).distinct()
    names = []
    for k, component in enumerate(components):
        one = component.groupBy("owner").agg(F.count(F.lit(1)).alias("_n"), F.first("value").alias(f"c{k}")).where("_n = 1").drop("_n")
        joined = joined.join(one, "owner")
        names.append(f"c{k}")
    return joined.groupBy(*names).agg(F.count_distinct("owner").alias("n")).where("n > 1")


def identifier_columns(table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """:func:`identifier` of fields that are columns of the owner's table: one aggregation and no join.

    ``key`` must identify the table's rows, so each owner has at most one value of each field.
    """
    whole = table.dropna(subset=[key, *columns])
    return whole.groupBy(*columns).agg(F.count_distinct(key).alias("n")).where("n > 1")


# -- values ----------------------------------------------------------------------------------------------------------


def value_range(table: DataFrame, column: str, low: object, high: object, kind: str) -> DataFrame:
    """Rows whose value is present and outside the range, or no literal of the kind."""
    return table.where(F.col(column).isNotNull() & ~scalar.in_range(F.col(column), low, high, kind))


def value_oneof(table: DataFrame, column: str, allowed: Sequence[object], kind: str) -> DataFrame:
    """Rows whose value is present and not among the allowed ones."""
    return table.where(F.col(column).isNotNull() & ~scalar.one_of(F.col(column), allowed, kind))


def required(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """A row for each required field that a row of the table lacks: ``key`` and ``field``.  One scan for all fields."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return table.select(key, F.explode(lacking).alias("field"))


def missing_literal(members: DataFrame, values: DataFrame) -> DataFrame:
    """Value instances ``instance_id`` without a literal in ``values``."""
    return _missing(members, ["instance_id"], values, ["instance_id"], "left_anti")


def value_type_mismatch(members: DataFrame) -> DataFrame:
    """Instances of ``members(value_type, instance_id)`` in several value types, and ``n``."""
    return members.groupBy("instance_id").agg(F.count_distinct("value_type").alias("n")).where("n > 1")


def arity(rows: DataFrame, fact_arity: DataFrame) -> DataFrame:
    """Long fact rows (``fact, row_index, players``) whose number of players is not that of ``fact_arity(fact, arity)``."""
    joined = rows.join(fact_arity, "fact")  # one row for each fact type of the model
    return joined.where(F.size("players") != F.col("arity")).select("fact", "row_index", F.size("players").alias("n"))


def unknown_types(population: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """Types that a population names and the model does not have."""
    return _missing(population, [column], catalog, [column], "left_anti")


# -- objectification -------------------------------------------------------------------------------------------------


def objectification_occurrence(bindings: DataFrame, rows: DataFrame) -> DataFrame:
    """Bindings (``instance_id, fact, row_index``) to a row that is not there."""
    return bindings.alias("l").join(rows.select("fact", "row_index").alias("r"), ["fact", "row_index"], "left_anti")


def objectification_injectivity(bindings: DataFrame, *occurrence: str, instance: str = "instance_id") -> DataFrame:
    """Row occurrences that are bound to more than one instance, and ``n``."""
    return bindings.groupBy(*occurrence).agg(F.count_distinct(instance).alias("n")).where("n > 1")


def objectification_types(bindings: DataFrame, catalog: DataFrame, members: DataFrame) -> DataFrame:
    """What is wrong with each binding's type, as ``instance_id`` and ``code``.

    ``bindings(instance_id, object_type, fact)``, ``catalog(object_type, objectifies)`` with null for types that are no
    objectified facts, ``members(object_type, instance_id)``.
    """
    held = members.select("object_type", "instance_id").distinct().withColumn("_member", F.lit(True))
    seen = bindings.join(catalog, "object_type", "left").join(held, ["object_type", "instance_id"], "left")
    is_type = F.col("objectifies").isNotNull()
    codes = F.array_compact(F.array(
        F.when(~is_type, "OBJECTIFICATION_TYPE"),
        F.when(is_type & F.col("_member").isNull(), "OBJECTIFICATION_MEMBERSHIP"),
        F.when(is_type & (F.col("fact") != F.col("objectifies")), "OBJECTIFICATION_FACT"),
    ))
    return seen.select("instance_id", F.explode(codes).alias("code"))
