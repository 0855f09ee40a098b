"""Canonical JSON: one text for all that say the same, whoever wrote it, and what two documents say differently.

A text becomes a VARIANT, which keeps the keys of its objects in order at every depth, reads escapes, and has one form of each number; written again it is canonical.  Order of keys is that of
their UTF-16 units.  Numbers are exact up to 38 digits and beyond that the nearest double, so longer ones belong in strings.  An object with a key twice, and what is no JSON at all, is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: Column, kind: T.DataType | None = None) -> Column:
    """The canonical text of JSON text, or, if its ``kind`` is another type, of a struct, map or array with the same content."""
    variant = F.try_parse_json(value) if kind is None or isinstance(kind, T.StringType) else F.call_function("to_variant_object", value)
    return F.to_json(variant)


def content_id(value: Column, digits: int = 24, kind: T.DataType | None = None) -> Column:
    """The first ``digits`` hex digits of the SHA-256 of the canonical text: equal for documents that say the same."""
    return F.left(F.sha2(canonical(value, kind), 256), F.lit(digits))


def leaves(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``key, path, value``: all that a document says, at every depth: the canonical text of each value that is neither an object nor an array with content.

    Rounds open the containers of one depth, so they are as many as the deepest document has levels.  Keys in paths are quoted, so a key with a dot is no path.  Malformed documents have no row.
    """
    open_ = docs.select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.try_parse_json(column).alias("value")).where("value IS NOT NULL")
    found = None
    opened = lambda v: F.to_json(v).rlike(r"^[{\[][^}\]]")
    while True:
        done = open_.where(~opened(F.col("value"))).select("_key", "path", F.to_json("value").alias("value"))
        found = done if found is None else found.unionByName(done)
        rest = open_.where(opened(F.col("value")))
        if rest.isEmpty():
            return found.withColumnRenamed("_key", key)
        inner = rest.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "name", "inner"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.to_json(F.call_function("to_variant_object", F.array("name")))))
        open_ = inner.select("_key", F.concat("path", step).alias("path"), F.col("inner").alias("value"))


def differences(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """``key, path, before, after`` of every leaf that two tables of documents don't share; a null side says nothing there."""
    left, right = (leaves(df, key, column).withColumnRenamed("value", name) for df, name in ((a, "before"), (b, "after")))
    return left.join(right, [key, "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
