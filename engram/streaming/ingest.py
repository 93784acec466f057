"""Incremental ingest of a stream of facts: each micro-batch is appended as a batch would be, so replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(engine, facts: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that appends facts (a streaming DataFrame of the fact layout); once: all there is, then ends."""

    def append(batch: DataFrame, _: int) -> None:
        engine.ingest(batch, mode="append")

    writer = facts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
