"""Shard placement through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size.  The shards take turns and each
claims the first slot of its order that is still free, until the table is full; so each gets the same number of slots to
within one, and adding or removing a shard moves little more than that shard's share.  A key's hash picks a slot and the
broadcast table, ``slots`` rows whatever the data, gives the shard: no shuffle and constant time for each row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: shards, and a prime number of slots over a hundred times as large.
SHARDS, SLOTS = 16, 2039


def _digits(text: str) -> int:
    """The first 60 bits of the text's SHA-256."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def fill(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot.  ``slots`` must be prime and at least ``shards``.

    Shard i prefers (offset + k * skip) mod slots for k = 0, 1, ..., with offset and skip from the hash of its name.
    """
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < shards <= slots:
        raise ValueError("there must be between one shard and as many as slots")
    at = [_digits(f"offset:{i}") % slots for i in range(shards)]
    skip = [_digits(f"skip:{i}") % (slots - 1) + 1 for i in range(shards)]
    table = [-1] * slots
    for turn in range(slots):
        i = turn % shards
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        table[at[i]] = i
    return table


def lookup_table(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot``, ``shard``: the filled table as ``slots`` rows."""
    listed = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key counts as the empty one."""
    digits = F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 15)
    return (F.conv(digits, 16, 10).cast("bigint") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All columns of ``docs`` and its ``slot`` and ``shard``, which replace columns of these names.

    Rows with one key, repeated rows and rows with a null key always go to one shard, so a key should tell rows apart:
    doc_id does, source would not.  Texts play no part.  An empty table gives an empty one.
    """
    table = lookup_table(docs.sparkSession, shards, slots)
    keyed = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(table), "slot")


def placement(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``slot``, ``shard`` and ``n_bytes``, what the row's text adds to the shard (null: 0)."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return place(sized).select("doc_id", "slot", "shard", "n_bytes")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> None:
    """Writes ``docs`` as Parquet under ``path`` in one folder for each shard."""
    place(docs, key, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)


#: The table is filled one slot a turn by a recursive query; then each document looks its slot up.
ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT list(('0x' || substr(sha256('offset:' || i), 1, 15))::BIGINT % {SLOTS} ORDER BY i) AS firsts,
         list(('0x' || substr(sha256('skip:' || i), 1, 15))::BIGINT % {SLOTS - 1} + 1 ORDER BY i) AS skips
  FROM range({SHARDS}) t(i)
), turns AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, []::BIGINT[] AS taken
  UNION ALL
  SELECT turn + 1, claim, list_append(taken, claim)
  FROM (
    SELECT turn, taken,
           list_filter(list_transform(range({SLOTS}), lambda k: (list_extract(firsts, (turn % {SHARDS}) + 1) + k * list_extract(skips, (turn % {SHARDS}) + 1)) % {SLOTS}),
                       lambda s: NOT list_contains(taken, s))[1] AS claim
    FROM turns, shards WHERE turn < {SLOTS}
  )
), filled AS (
  SELECT slot::INTEGER AS slot, ((turn - 1) % {SHARDS})::INTEGER AS shard FROM turns WHERE turn > 0
), keyed AS (
  SELECT doc_id, (('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot,
         coalesce(strlen(text), 0)::BIGINT AS n_bytes
  FROM documents
)
SELECT doc_id, slot, shard, n_bytes FROM keyed JOIN filled USING (slot)
"""
