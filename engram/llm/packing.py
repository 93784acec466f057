"""Concatenate and cut: documents' ids end to end, cut into windows of one length, with a record for each piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import binary_rows, encoder, with_end
from .common import materialize, trimmed

ENCODED = "part int, doc_id long, before long, n long, ids binary"


def encode_parts(docs: DataFrame, vocabulary: str, end_id: int, remembered: int = 1_000_000) -> DataFrame:
    """First pass: (part, doc_id, before, n, ids); n counts a row's ids, before those of earlier rows of the same input partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = encoder(vocabulary, remembered), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, sizes = with_end(*bpe.encode_column(batch.column(1)), end_id)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), batch.column(0), pa.array(before + ends - sizes), pa.array(sizes), binary_rows(ids, sizes)], ["part", "doc_id", "before", "n", "ids"]
            )
            before += int(sizes.sum())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(trimmed(encode), ENCODED)


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0, remembered: int = 1_000_000) -> DataFrame:
    """Packs docs (doc_id, text; null text: empty) into sequences of length ids; each document ends with end_id.

    Returns one row per piece: doc_id, start (the document's ids before it), ids (little-endian 4-byte integers),
    doc_tokens, sequence_id, offset (gapless from 0 in each sequence). Every sequence but the last is full. Documents
    stand in the order of the input's partitions, so no text is shuffled; the ids are written once to the shared
    folder. The second pass adds to each row the total of the partitions before its own: one row per partition.
    Repeated doc_ids and rows are packed as they come; an empty text is its end id; an empty table gives no row.
    """
    encoded = materialize(encode_parts(docs, vocabulary, end_id, remembered), "encoded")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # written, so that the planner knows its size and broadcasts it only while it is below the session's threshold
    bases = materialize(totals.select("part", F.coalesce(running, F.lit(0)).alias("base")), "bases")

    at, n = F.col("before") + F.col("base"), F.col("n")
    placed = encoded.join(bases, "part").select("doc_id", at.alias("at"), "ids", "n")
    first, last = F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}")
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    low = F.greatest("at", F.col("sequence_id") * length)
    cut = cut.withColumns({"low": low, "high": F.least(F.col("at") + n, (F.col("sequence_id") + 1) * length)})
    start = F.col("low") - F.col("at")
    ids = F.substring("ids", (4 * start + 1).cast("int"), (4 * (F.col("high") - F.col("low"))).cast("int"))
    return cut.select("doc_id", start.alias("start"), ids.alias("ids"), n.alias("doc_tokens"), "sequence_id", (F.col("low") - F.col("sequence_id") * length).alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed windows; a group holds at most one window's ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.array_join(F.transform(ordered, lambda p: F.hex(p["ids"])), "").alias("ids")).select("sequence_id", F.unhex("ids").alias("ids"))
