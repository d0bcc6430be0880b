"""Read counting on a stream: reads arrive without an order in time, so counts only grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ampliflow.operators.mapper import Mapping, ReadMapper


def count_stream(mapper: ReadMapper, reads: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch's counts by (sample, region, fwd, bwd) to Parquet at ``sink``, under the batch's number.

    The state is the table itself: a batch that is repeated overwrites its own folder, so counts are exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        mapper.read_counts(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def totals(counts: DataFrame) -> DataFrame:
    """Counts over all batches so far."""
    return counts.groupBy("sample", "region", "fwd", "bwd").agg(F.sum("n").alias("n"))


def map_so_far(mapper: ReadMapper, counts: DataFrame, then: Callable[[Mapping], None]) -> None:
    """Finishes the mapping over what has been counted."""
    then(mapper.map_counts(totals(counts)))
