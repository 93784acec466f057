"""Stupid-backoff scores, computed relationally on packed rows.

Three relations, each row of which holds many n-grams in columns of numbers:

    grams   (bucket, grp, hashes, counts)  the exploded n-grams of a group of documents, with their counts in the group
    counts  (bucket, hashes, totals)       the count table, partitioned by hash: n-grams that several groups hold
    known   (grp, bucket, totals)          grams joined with counts by bucket and hash, sent back to the group; 0 where
                                           the count table has no row

Documents are dealt into groups of bounded size, whose n-grams are summed before anything is exchanged; a group's hashes
are cut into buckets by range. An n-gram that one group holds alone is counted there and needs no row of the count
table. The group then sums the scores of its documents. An n-gram travels once for each group that has it, however often
it occurs, and a row holds one n-gram at least, so rows never exceed the distinct n-grams of the groups.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_1, PolyHash, group_count, hash_words, mix, pack_rows, trimmed, unpack_blobs, with_group

#: Longest n-gram, and the factor for each step back to a shorter one.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a group: the larger, the fewer groups an n-gram travels for. Buckets for each group.
GROUP_BYTES, BUCKETS = 13 << 20, 3


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte position, each position entropy-coded by itself: a hash's difference from the one before takes
    little more than its share of bits, and a count of mostly ones next to nothing."""
    coder = zstandard.ZstdCompressor(level=1)
    parts = [coder.compress(p.tobytes()) for p in x.view(np.uint8).reshape(len(x), x.itemsize).T]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size, coder = np.dtype(kind).itemsize, zstandard.ZstdDecompressor()
    ends = np.cumsum((4 * size, *struct.unpack_from(f"<{size}I", data)))
    parts = [np.frombuffer(coder.decompress(data[a:b]), np.uint8) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.stack(parts, 1).view(kind).ravel()


def rising(x: np.ndarray) -> bytes:
    """Numbers as planes of their differences, which wrap; few bytes where numbers ascend."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unrising(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unplanes(data, kind), dtype=kind)


class Grams:
    """The n-grams of some texts: for each order, the sorted distinct hashes with their counts, the places of n-grams (of
    their last word), and their numbers in the distinct ones."""

    def __init__(self, texts: Sequence[bytes], order: int):
        split = [t.split() for t in texts]
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        values = hash_words([w for s in split for w in s])
        del split
        poly = PolyHash(mix(values), BASE_1)
        self.places, self.distinct, self.numbers, self.counts = [], [], [], []
        for n in range(1, order + 1):
            at = np.arange(max(0, len(values) - n + 1))
            at = at[self.owner[at] == self.owner[at + n - 1]] if len(at) else at
            distinct, numbers, counts = np.unique(mix(poly.all_runs(n)[at] + np.uint64(n)), return_inverse=True, return_counts=True)
            self.places.append(at + n - 1)
            self.distinct.append(distinct)
            self.numbers.append(numbers)
            self.counts.append(counts)

    def own_counts(self, k: int) -> np.ndarray:
        """For each n-gram of an order, how often it occurs in its own text: once, if it does in all texts here."""
        numbers, out = self.numbers[k], np.ones(len(self.numbers[k]))
        some = np.flatnonzero(self.counts[k][numbers] > 1)
        _, back, counts = np.unique(self.owner[self.places[k][some]] * len(self.distinct[k]) + numbers[some], return_inverse=True, return_counts=True)
        out[some] = counts[back]
        return out


def bucket_cuts(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes start, and the end; buckets are equal ranges of hashes."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(distinct, edges), len(distinct)]


def merged(grams: Grams, some: Sequence[slice]) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's hashes of all orders in one ascending run, which codes shorter than one for each, and their order."""
    hashes = np.concatenate([d[s] for d, s in zip(grams.distinct, some, strict=True)])
    by = np.argsort(hashes, kind="stable")
    return hashes[by], by


def score_texts(grams: Grams, totals: Sequence[np.ndarray], words: int, order: int, backoff: float) -> np.ndarray:
    """Sum of the logarithms of each text's scores, by counts (for each order) without the text's own."""
    n = len(grams.owner)
    others = (words - grams.sizes[grams.owner]).astype(np.float64)
    score, found, after = np.zeros(n), np.zeros(n, bool), None
    for k in range(order - 1, -1, -1):
        seen = after if after is not None else rest_counts(grams, totals, k)
        after = rest_counts(grams, totals, k - 1) if k else None
        before = np.r_[0.0, after[:-1]] if k else others
        hit = ~found & (seen > 0)
        score[hit] = np.log(seen[hit] / before[hit]) + (order - 1 - k) * np.log(backoff)
        found |= hit
    score[~found] = np.log(1.0 / (others[~found] + 1)) + (order - 1) * np.log(backoff)
    return np.bincount(grams.owner, score, len(grams.sizes)).astype(np.float64)


def rest_counts(grams: Grams, totals: Sequence[np.ndarray], k: int) -> np.ndarray:
    """For each word, how often the n-gram of an order that ends there occurs in other texts; 0 where there is none."""
    out = np.zeros(len(grams.owner))
    out[grams.places[k]] = totals[k][grams.numbers[k]] - grams.own_counts(k)
    return out


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, log_score, mean_log_score.

    Counts are of the n-grams of up to order words of all documents, less the document's own, so that no text vouches
    for itself. A word scores count(n-gram) / count(its context) for the longest n-gram with a count, times backoff
    for each order stepped back from; a word that no other document has scores as 1 / (other words + 1). A word near
    its text's start has shorter n-grams only, and pays for the step back too. log_score sums natural logarithms;
    mean_log_score is null for a text without words, as a null text is. One row per row of docs; rows that repeat an
    identifier are documents of their own. An empty table gives no row.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    filled = every.where("text <> ''")
    groups = group_count(filled, group_bytes=GROUP_BYTES)
    buckets = BUCKETS * groups
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_group(filled, groups)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.split()) for t in batch.column(0).cast(pa.binary()).to_pylist())], pa.int64())], ["n"])

    words = rows.select("text").mapInArrow(trimmed(count_words), "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    # groups and buckets keep their number of tasks in step with the input
    packed = pack_rows(rows, ["doc_id", "text"]).repartition(max(least, 2 * groups), "grp")

    def group_texts(packed: pa.Table) -> tuple[pa.Table, list[bytes]]:
        table = unpack_blobs(packed["blob"].to_pylist())
        return table, [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]

    def bucket_slices(grams: Grams) -> Iterator[tuple[int, list[slice]]]:
        """Each bucket that the group has n-grams in, with its part of each order's distinct hashes."""
        cuts = [bucket_cuts(d, buckets) for d in grams.distinct]
        for b in range(buckets):
            some = [slice(c[b], c[b + 1]) for c in cuts]
            if any(s.start < s.stop for s in some):
                yield b, some

    def explode(packed: pa.Table) -> pa.Table:
        grams, grp = Grams(group_texts(packed)[1], order), packed["grp"][0].as_py()
        out: list[list] = [[] for _ in range(4)]
        for b, some in bucket_slices(grams):
            hashes, by = merged(grams, some)
            counts = np.concatenate([c[s] for c, s in zip(grams.counts, some, strict=True)])
            for column, value in zip(out, (b, grp, rising(hashes), planes(counts[by].astype(np.uint32))), strict=True):
                column.append(value)
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["bucket", "grp", "hashes", "counts"])

    def bucket_rows(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        return [unrising(h, np.uint64) for h in rows["hashes"].to_pylist()], np.concatenate([unplanes(c, np.uint32) for c in rows["counts"].to_pylist()])

    def add_up(rows: pa.Table) -> pa.Table:
        hashes, counts = bucket_rows(rows)
        hashes = np.concatenate(hashes)
        by = np.argsort(hashes)
        hashes, counts = hashes[by], counts[by].astype(np.int64)
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        several = np.diff(np.r_[first, len(hashes)]) > 1
        totals = np.add.reduceat(counts, first)[several]
        if not len(totals):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], ["bucket", "hashes", "totals"])
        return pa.table([pa.array([rows["bucket"][0].as_py()], pa.int32()), pa.array([rising(hashes[first][several])], pa.binary()), pa.array([planes(totals)], pa.binary())], ["bucket", "hashes", "totals"])

    def join(rows: pa.Table, counted: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(3)]
        if rows.num_rows and counted.num_rows:
            names, totals = unrising(counted["hashes"][0].as_py(), np.uint64), unplanes(counted["totals"][0].as_py(), np.int64)
            for grp, data in zip(rows["grp"].to_pylist(), rows["hashes"].to_pylist(), strict=True):
                hashes = unrising(data, np.uint64)
                at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                for column, value in zip(out, (grp, rows["bucket"][0].as_py(), planes(np.where(names[at] == hashes, totals[at], 0))), strict=True):
                    column.append(value)
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["grp", "bucket", "totals"])

    def score(packed: pa.Table, known: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "log_score", "mean_log_score"]
        if not packed.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        table, texts = group_texts(packed)
        grams = Grams(texts, order)
        del texts
        totals = [c.astype(np.float64) for c in grams.counts]
        known = dict(zip(known["bucket"].to_pylist(), known["totals"].to_pylist(), strict=True))
        for b, some in bucket_slices(grams):
            if b in known:
                _, by = merged(grams, some)
                sums = np.empty(len(by), np.int64)
                sums[by] = unplanes(known[b], np.int64)
                sums = np.split(sums, np.cumsum([s.stop - s.start for s in some])[:-1])
                for k, s in enumerate(some):
                    totals[k][s] = np.where(sums[k] > 0, sums[k], totals[k][s])
        total = score_texts(grams, totals, words, order, backoff)
        means = [s / n if n else None for s, n in zip(total.tolist(), grams.sizes.tolist(), strict=True)]
        return pa.table([table["doc_id"], pa.array(grams.sizes), pa.array(total), pa.array(means, pa.float64())], names)

    grams = packed.groupBy("grp").applyInArrow(explode, "bucket int, grp int, hashes binary, counts binary").repartition(max(least, buckets), "bucket")
    counts = grams.groupBy("bucket").applyInArrow(add_up, "bucket int, hashes binary, totals binary")
    known = grams.groupBy("bucket").cogroup(counts.repartition(max(least, buckets), "bucket").groupBy("bucket")).applyInArrow(join, "grp int, bucket int, totals binary")
    scored = packed.groupBy("grp").cogroup(known.repartition(max(least, 2 * groups), "grp").groupBy("grp")).applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")
    none = every.where("text is null or text = ''").select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"), F.lit(None).cast("double").alias("mean_log_score"))
    return scored.unionByName(none)
