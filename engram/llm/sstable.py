"""Token ids of documents in sorted-string-table shards: write, scan in key order, look single keys up.

File layout (little endian, lengths as LEB128 varints)::

    block*   entries (shared key bytes, own key bytes, value bytes, own key, value), then crc32 of the entries
    index    first key of each block, its offset, bytes and entries
    Bloom    bit array over the keys
    footer   offsets of index and filter, counts, bytes per id, number of probes, magic

A key is 0x00 for a null identifier, else 0x01 and the identifier as 8 bytes, big endian with the sign bit turned, so
that keys sort as identifiers do. Within a block a key leaves out the bytes it shares with the one before; the first
key of a block is whole. Ids are kept in 2 bytes if the vocabulary allows it, else in 4.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .common import materialize, scratch_path, trimmed

MAGIC = b"ENGRSST1"
FOOTER = struct.Struct("<QQQQQIBB8s")
BLOCK_BYTES, BITS_PER_KEY, PROBES, SHARD_BYTES = 64 << 10, 10, 7, 32 << 20
#: What a row counts for besides its text: a shard's keys are in memory, so there is a limit to empty texts too.
ROW_BYTES = 64
SHARDS = "shard int, path string, n_docs long, n_tokens long, first long, last long"


#: Schemes that Spark's file systems have and Arrow's know by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "dbfs": "file:///dbfs"}


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system and the path in it, of a folder as Spark names it; hdfs needs libhdfs on the workers."""
    scheme, found, rest = uri.partition(":")
    if found and scheme in SCHEMES:
        known = SCHEMES[scheme]
        uri = f"{known}/{rest.lstrip('/')}" if ":" in known else f"{known}:{rest}"
    return pa.fs.FileSystem.from_uri(uri)


def pack_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def unpack_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    low, step = h & ((1 << 64) - 1), h >> 64 | 1
    return [(low + i * step) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard; holds a block, the sparse index and the key hashes, never the values of more than a block."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.offset = self.entries = self.n_tokens = 0
        self.block, self.block_entries, self.last, self.first = bytearray(), 0, b"", b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = pack_key(doc_id), ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.block_entries = key, self.block_entries + 1
        self.entries, self.n_tokens = self.entries + 1, self.n_tokens + len(ids)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            body = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(body)
            self.index.append(varint(len(self.first)) + self.first + varint(self.offset) + varint(len(body)) + varint(self.block_entries))
            self.offset += len(body)
            self.block, self.block_entries = bytearray(), 0

    def close(self) -> None:
        self._end_block()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bloom.tobytes() + FOOTER.pack(self.offset, self.offset + len(index), bits, self.entries, self.n_tokens, len(self.index), self.width, PROBES, MAGIC))


class Reader:
    """Reads one shard: footer, index and filter at once, blocks as they are asked for."""

    def __init__(self, path: str):
        folder, _, name = path.rpartition("/")
        fs, base = open_folder(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        tail = self.file.read_at(FOOTER.size, size - FOOTER.size)
        at, bloom_at, self.bits, self.entries, self.n_tokens, blocks, self.width, _, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        data = self.file.read_at(size - FOOTER.size - at, at)
        self.bloom, self.index, p = data[bloom_at - at :], [], 0
        for _ in range(blocks):
            n, p = read_varint(data, p)
            key, p = data[p : p + n], p + n
            offset, p = read_varint(data, p)
            length, p = read_varint(data, p)
            count, p = read_varint(data, p)
            self.index.append((key, offset, length, count))

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length, count = self.index[i]
        data = self.file.read_at(length, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        at, key = 0, b""
        for _ in range(count):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + own], at + own
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self.block(i):
                yield unpack_key(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document with this identifier; the filter, then a binary search of the index, then the blocks."""
        key = pack_key(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        firsts = [k for k, *_ in self.index]
        i = max(0, bisect_right(firsts, key) - 1)
        while i and firsts[i] == key:
            i -= 1
        found: list[np.ndarray] = []
        while i < len(firsts) and firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


def write_sstables(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2, shard_bytes: int = SHARD_BYTES, remembered: int = 1_000_000) -> DataFrame:
    """Encodes every whole text of docs (doc_id, text; null text: empty) and appends end_id; writes shards in ascending doc_id order.

    Null identifiers come first; rows with one identifier stay apart, ordered by a hash of the text, then the text.
    Returns one row per shard (shard, path, n_docs, n_tokens, first and last doc_id), of which none is empty; shards
    ascend as their keys do. An empty table gives no shard. Rows are dealt by ranges of (doc_id, hash, place in the input) into shards of about
    shard_bytes of text and ROW_BYTES a row, so that an identifier or a row repeated very often fills several shards. A task streams its
    rows into a file named by its attempt; the returned rows, written by Spark's committer, name the files that count,
    and files of other attempts are never read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sstables")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("n")).first()["n"] or 0
    keyed = rows.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    parted = keyed.repartitionByRange(max(6, -(-total // shard_bytes)), "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard, out = encoder(vocabulary, remembered), TaskContext.get().partitionId(), None
        width = 2 if max(bpe.tokenizer.get_vocab_size(True) - 1, end_id) < 1 << 16 else 4
        fs, base = open_folder(folder)
        name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.sst"
        for batch in batches:
            if batch.num_rows and out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
                writer = Writer(out, width)
            ids, counts = with_end(*bpe.encode_column(batch.column(1)), end_id)
            ids, at = ids.astype(f"<u{width}"), 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                writer.add(doc_id, ids[at : at + n])
                at += n
        if out is not None:
            writer.close()
            out.close()
            about = {"shard": shard, "path": f"{folder}/{name}", "n_docs": writer.entries, "n_tokens": writer.n_tokens, "first": unpack_key(writer.keys[0]), "last": unpack_key(writer.last)}
            yield pa.RecordBatch.from_pylist([about], schema=pa.schema([("shard", pa.int32()), *((c, pa.string() if c == "path" else pa.int64()) for c in list(about)[1:])]))

    return materialize(parted.mapInArrow(trimmed(write), SHARDS), "shards")


def read_sstables(shards: DataFrame, rows_per_batch: int = 512) -> DataFrame:
    """Documents of the shards as (doc_id, start, ids): start counts all ids before, over all shards; ids as 4-byte integers.

    One row per shard passes through the window of running totals.
    """
    placed = shards.withColumn("start", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("path", F.coalesce("start", F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, starts, values = [], [], []
                for doc_id, ids in Reader(path).scan():
                    keys.append(doc_id)
                    starts.append(start)
                    values.append(ids.astype("<u4").tobytes())
                    start += len(ids)
                    if len(keys) == rows_per_batch:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])
                        keys, starts, values = [], [], []
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])

    return placed.repartition(max(1, shards.count())).mapInArrow(trimmed(read), "doc_id long, start long, ids binary")


def lookup_documents(shards: DataFrame, doc_ids: Sequence[int | None]) -> DataFrame:
    """(doc_id, ids) of every document that has one of some identifiers; identifiers that no document has give no row.

    Only shards whose range of keys holds an identifier are opened; of these, only the footer, the index and the filter
    are read, and the blocks that a binary search of the index names. Repeated identifiers are looked up once.
    """
    wanted = sorted(set(doc_ids), key=pack_key)
    numbers = [i for i in wanted if i is not None]
    # null keys come first, so a shard whose first is null reaches down to all identifiers
    holds = F.exists(F.array(*map(F.lit, numbers)).cast("array<long>"), lambda i: (F.col("first").isNull() | (i >= F.col("first"))) & (i <= F.col("last")))
    some = shards.where((F.col("first").isNull() if None in wanted else F.lit(False)) | holds).select("path")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = Reader(path)
                found = [(i, ids.astype("<u4").tobytes()) for i in wanted for ids in reader.lookup(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["doc_id", "ids"])

    return some.repartition(max(1, some.count())).mapInArrow(trimmed(find), "doc_id long, ids binary")
