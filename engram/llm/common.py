"""Shared helpers: scratch space all executors can reach, packed text exchange, word hashing, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove_path, scratch_path

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# --- scratch space ---------------------------------------------------------------------------------------------


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what materialize wrote, where nothing reads it any more."""
    remove_path(df.sparkSession, df.scratch)


def spread(docs: DataFrame) -> DataFrame:
    """Rows as read from files, dealt evenly over the cores where the files come in fewer partitions than that.

    A row group can't be split, so a table of one would keep one core busy. Where there are partitions for all cores, as
    in any large table, and after any exchange, rows stay where they are; so do those of tables of about a MB.
    """
    plan = docs._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return docs
    megabytes = int(plan.optimizedPlan().stats().sizeInBytes()) >> 20
    tasks = min(docs.sparkSession.sparkContext.defaultParallelism, megabytes)
    return docs.repartition(tasks) if plan.toRdd().getNumPartitions() < tasks else docs


# --- memory of Python workers ----------------------------------------------------------------------------------


def release_memory() -> None:
    """Gives what Arrow and the allocator hold in reserve back to the system; idle workers then stay small."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def bound_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bounds the batches that go to Python by rows and bytes, as long texts make large ones; a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow that releases memory when its partition ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return bounded


# --- packed exchange of documents ------------------------------------------------------------------------------

#: Bytes of raw text that a packed group holds on average.
GROUP_BYTES = 4 << 20


def group_count(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """Number of packed groups for these documents: follows the input, so that a group stays in memory at any scale."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(24, -(-total // group_bytes))


def with_group(docs: DataFrame, groups: int) -> DataFrame:
    """Adds grp, the packed group of a row of docs (doc_id, text): by both, so that rows of one identifier, or of none,
    are dealt like others. Only rows equal in both meet in one group."""
    return docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))


def pack_rows(docs: DataFrame, columns: Sequence[str], flush_bytes: int = 24 << 20, prepare: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """Rows with a grp column to (grp, blob): compressed Arrow streams of the rows of one group.

    Text takes about 0.6 of the space that rows take in a shuffle, and a group is exchanged in large pieces. prepare
    makes the columns that are packed from those given.
    """
    columns = list(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by("grp").combine_chunks()
            ids = table["grp"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            rows = prepare(table.select(columns)) if prepare else table.select(columns)
            keys, blobs = [], []
            for start, end in zip(cuts, np.r_[cuts[1:], len(ids)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_table(rows.slice(start, end - start))
                keys.append(int(ids[start]))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["grp", "blob"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= flush_bytes:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return docs.select("grp", *columns).mapInArrow(trimmed(pack), "grp int, blob binary")


def unpack_blobs(blobs: Sequence[bytes]) -> pa.Table:
    """The rows of packed blobs of one group as one table."""
    release_memory()
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()


# --- words and hashes ------------------------------------------------------------------------------------------


class WordHashes(dict):
    """bytes of a word to its 64-bit hash; forgets all when it holds too many words, so memory stays bounded."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


WORD_HASHES = WordHashes()


def hash_words(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class PolyHash:
    """Hashes of any run of values by prefix sums: sum of v[i + j] * base**j modulo 2**64, then mixed."""

    def __init__(self, values: np.ndarray, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values))[:-1], dtype=np.uint64, out=self.prefix[1:])
        self.back = powers(inverse, len(values))

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.back[start])

    def all_runs(self, length: int) -> np.ndarray:
        """Hashes of the runs of this length that start at 0, 1, ..."""
        n = max(0, len(self.prefix) - length)
        return mix((self.prefix[length:] - self.prefix[:n]) * self.back[:n])


BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- connected components --------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) longs to (node, component): the smallest node reachable. Nodes without an edge are not returned.

    Alternating large-star and small-star steps; each is an aggregation with map-side combine and a join that the
    adaptive planner can split at a hot node. Every round is written to the shared folder; nothing but a count and a
    checksum of the edges reaches the driver. The number of rounds grows as the logarithm of the longest path.
    """

    def near(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def least(n: DataFrame) -> DataFrame:
        return n.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        n = near(e)
        return n.where("v > u").join(least(n), "u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        n = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        low = least(n)
        return n.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        before, edges = edges, materialize(small_star(large_star(edges)), "edges")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, by pointer jumping over links (left, right)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        np.minimum.at(new, root, new)
        if (new == root).all():
            return root
        root = new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by the key columns: tables of whole groups, about so many rows at a time, and the groups' first rows.

    A group's rows meet in memory; the caller bounds its size.
    """
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = t[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)
