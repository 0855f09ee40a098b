"""What is wrong with a model that is given as relations, before it is one: a code for each fault, in the order of reports.

The relations are those of :mod:`rolewise.plans.catalog`, and ``identifiers(object, field)`` where identifiers are stated apart from fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.functions.scalar import placeholders

SEVERITIES = ["error", "warning", "info"]


def _told(df: DataFrame, code: str, element: Column | str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), (F.col(element) if isinstance(element, str) else element).cast("string").alias("element")).distinct()


def diagnostics(relations: dict[str, DataFrame]) -> DataFrame:
    """``severity, code, element`` of every fault of the relations; relations that are missing are not looked at."""
    col, each = F.col, []
    has = lambda *names: all(n in relations for n in names)
    if has("facts", "roles"):
        facts, roles = relations["facts"].select(col("name").alias("fact")).distinct(), relations["roles"]
        each.append(_told(facts.join(roles.select("fact"), "fact", "left_anti"), "FACT_ARITY_ZERO", "fact"))
        each.append(_told(roles.groupBy("fact", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "DUPLICATE_ROLE", "fact"))
        if has("readings"):
            used = relations["readings"].join(facts, "fact", "left_semi").select("fact", F.explode(placeholders(col("text"))).alias("name"))
            each.append(_told(used.join(roles.select("fact", "name"), ["fact", "name"], "left_anti"), "READING_UNKNOWN_ROLE", "fact"))
        if has("rules"):
            rules = relations["rules"].join(facts, "fact", "left_semi")
            key = F.concat(col("kind"), F.lit(":"), col("fact"), F.lit("("), F.array_join("roles", ","), F.lit(")"))
            players = rules.where("kind = 'unordered'").select(key.alias("rule"), "fact", F.explode_outer("roles").alias("name")).join(roles.select("fact", "name", "player"), ["fact", "name"], "left")
            counted = players.groupBy("rule").agg(F.count("name").alias("n"), F.count_distinct("player").alias("kinds"), F.count_if(col("name").isNotNull() & col("player").isNull()).alias("lost"))
            each.append(_told(counted.where("lost = 0 AND (n < 2 OR kinds <> 1)"), "BAD_UNORDERED_GROUP", "rule"))
            rings = rules.where("kind = 'symmetric'").select("fact").distinct().join(roles.groupBy("fact").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("player").alias("kinds")), "fact", "left")
            each.append(_told(rings.where("n IS NULL OR n <> 2 OR kinds <> 1"), "BAD_SYMMETRIC_RING", F.concat(F.lit("symmetric:"), "fact", F.lit("()"))))
            bad = (F.size("roles") == 0) | col("low").isNull() | (col("low") < 0) | (col("high") < col("low"))
            each.append(_told(rules.where("kind = 'frequency'").where(F.coalesce(bad, F.lit(False))), "BAD_FREQUENCY", key))
            each.append(_told(rules.where("kind IN ('subset', 'equality', 'exclusion')").where(F.size("roles") != F.size("other_roles")), "SET_CONSTRAINT_ARITY", key))
    if has("domains", "objects"):
        values = relations["objects"].where("kind = 'value'").select(col("name").alias("value"))
        each.append(_told(relations["domains"].join(values, "value", "left_anti"), "VALUE_CONSTRAINT_BAD_TYPE", "value"))
    if has("identifiers", "objects", "fields"):
        ids, objects = relations["identifiers"], relations["objects"].select(col("name").alias("object"))
        each.append(_told(ids.join(objects, "object", "left_anti"), "IDENTIFIER_UNKNOWN_OBJECT", "object"))
        fields = relations["fields"].select(col("owner").alias("object"), col("name").alias("field"))
        each.append(_told(ids.join(objects, "object", "left_semi").join(fields, ["object", "field"], "left_anti"), "IDENTIFIER_NOT_FIELD", F.concat_ws(".", "object", "field")))
    if not each:
        raise ValueError("there are no relations to look at")
    found = reduce(lambda a, b: a.unionByName(b), each)
    return ordered(found.select(F.lit("error").alias("severity"), "code", "element"))


def ordered(found: DataFrame) -> DataFrame:
    """Diagnostics in the order of reports: severity, code, element."""
    return found.orderBy(F.array_position(F.lit(SEVERITIES), F.col("severity")), "code", F.coalesce("element", F.lit("")))
