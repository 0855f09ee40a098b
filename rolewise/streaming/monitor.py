"""Rules over a stream of facts: each micro-batch is checked, and what violates a rule is appended to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def monitor(stream: DataFrame, check: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Runs ``check`` on each micro-batch and appends its rows, with ``batch_id``, to the Parquet table ``sink``.

    A batch that is run again after a failure replaces its own folder, so no violation is written twice.  Rules that
    compare rows of different batches need the table of all facts inside ``check``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        check(batch).withColumn("checked_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
