"""Embedding near-duplicates by a pivot-permutation index: ordered nearest pivots, inverted lists, exact verification.

A vector's description is the permutation of its nearest pivots. Each pivot has an inverted list of the descriptions that
hold it. Within a list the pivots that two descriptions share are counted and their ranks compared; pairs that share
enough, at ranks close enough, are candidates. Only then are vectors fetched, for the members that have candidates, and
cosines computed.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_components, materialize, trimmed, whole_groups

#: Pivots: so many times the root of the classes, within bounds; lists then grow as the root too. Rows of the sample for
#: each pivot.
PER_ROOT, FEWEST, MOST, SAMPLE = 4, 64, 16_384, 4
#: Nearest pivots of a vector, pivots that two descriptions must share, the most that ranks may differ by in all.
NEAREST, SHARED, APART_RANKS = 8, 3, 46
#: Members of a block of a list, rows in one step of a worker.
BLOCK_ROWS = 1000
#: A vector of the sample closer to a chosen pivot than this is passed over, so that a crowd of copies gives one pivot;
#: where that leaves too few pivots, the next bound holds.
APART = (0.8, 0.9, 0.95, 0.99)
#: Bytes of the sample of all lengths; the pivots are at most a part of SAMPLE of that.
SAMPLE_BYTES = 64 << 20
#: The longest descriptions.
MOST_NEAREST = 64
#: Vectors of the sample that are moved to the threshold to see how their descriptions change, and the part that may be missed.
TRIED, MISSED = 2000, 0.005


def unit_rows(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Directions of unit vectors as seen from the centre, zero for one that lies there."""
    y = x - centre
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample in its order, each apart from those before; by the widest bound that gives so many."""
    chosen, n, left = np.empty((count, sample.shape[1])), 0, np.arange(len(sample))
    for bound in APART:
        passed = []
        for i in left:
            if n == count:
                break
            if not n or (chosen[:n] @ sample[i]).max() < bound:
                chosen[n] = sample[i]
                n += 1
            else:
                passed.append(i)
        left = passed
    return chosen[:n]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The description of each row: its nearest pivots in order; ties go to the earlier pivot."""
    m = min(nearest, len(pivots))
    far = -(x @ pivots.T)
    some = np.sort(np.argpartition(far, m - 1, axis=1)[:, :m], axis=1)
    order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


class Rule(NamedTuple):
    """How many pivots describe a vector, how many two descriptions must share, how much their ranks may differ in all."""

    nearest: int
    shared: int
    apart: int


def changes(x: np.ndarray, centre: np.ndarray, pivots: np.ndarray, threshold: float, nearest: int) -> tuple[int, int]:
    """Pivots that all but MISSED of the vectors share with another one at the threshold from them, in any direction, and the
    difference of ranks that all but so many keep to."""
    rng = np.random.default_rng(1)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    near = nearest_pivots(centred(x, centre), pivots, nearest)
    moved = nearest_pivots(centred(threshold * x + np.sqrt(1 - threshold**2) * side, centre), pivots, nearest)
    same = near[:, :, None] == moved[:, None, :]
    width = np.arange(near.shape[1])
    behind = (near.shape[1] - width)[None]
    apart = (same * np.abs(width[:, None] - width[None, :])).sum((1, 2)) + (~same.any(2) * behind).sum(1) + (~same.any(1) * behind).sum(1)
    return int(np.quantile(same.sum((1, 2)), MISSED, method="lower")), int(np.quantile(apart, 1 - MISSED, method="higher"))


def settle(x: np.ndarray, centre: np.ndarray, pivots: np.ndarray, threshold: float, rule: Rule) -> Rule:
    """The rule, where vectors at the threshold from those of the sample keep to it; else with longer descriptions.

    Where vectors gather, the threshold is far for their spread, and a few pivots don't tell; more of them do.
    """
    shared, apart = changes(x, centre, pivots, threshold, rule.nearest)
    if shared >= min(rule.shared, len(pivots)):
        return rule._replace(apart=max(rule.apart, apart))
    nearest = rule.nearest
    while shared < rule.shared and nearest < min(MOST_NEAREST, len(pivots)):
        nearest *= 2
        shared, apart = changes(x, centre, pivots, threshold, nearest)
    return Rule(nearest, max(1, shared), apart)


VECTORS = "vec_id long, label long, dims int, h1 long, h2 long, vector binary"


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dims, h1, h2, vector) of the vectors that can link: with identifier and label, finite, not zero.

    vector holds doubles, scaled to a largest component of 1 so that no square over- or underflows.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for vec_id, label, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array([np.nan if v is None else v for v in values], np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                h = xxhash.xxh3_128_intdigest((x + 0.0).tobytes())
                row = (vec_id, label, len(x), (h & ((1 << 64) - 1)) - (1 << 63), (h >> 64) - (1 << 63), (x / np.abs(x).max()).astype("<f8").tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["vec_id", "label", "dims", "h1", "h2", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(trimmed(clean), VECTORS)


def lists_of(array: pa.ChunkedArray) -> np.ndarray:
    """Descriptions as rows of one width, filled up with -1."""
    whole = array.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    size = np.diff(whole.offsets.to_numpy())
    out = np.full((len(size), size.max(initial=1)), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = whole.flatten().to_numpy()
    return out


def candidates(near: np.ndarray, own: int, nearest: int, shared: int, apart: int) -> np.ndarray:
    """Which pairs of a list's descriptions are candidates that this list owns.

    They share enough pivots, or all that the shorter one has; the sum of the differences of ranks, a pivot that one
    lacks standing behind its last, is small enough; and no pivot below the list's own is shared, so that of the lists
    that hold a pair one owns it.
    """
    m = len(near)
    names, place = np.unique(near, return_inverse=True)
    place = place.reshape(near.shape)
    ranks = np.full((m, len(names)), near.shape[1], np.float32)
    ranks[np.arange(m)[:, None], place] = np.arange(near.shape[1], dtype=np.float32)
    has = (ranks < near.shape[1]).astype(np.float32)
    has[:, names < 0] = 0
    common = has @ has.T
    early = has[:, (names >= 0) & (names < own)]
    length = has.sum(1)
    ok = (common >= np.minimum(shared, np.minimum(length[:, None], length[None, :]))) & (early @ early.T == 0)
    # footrule: of each description's pivots, the distance to their ranks in the other
    distance = np.zeros((m, m), np.float32)
    for k in range(near.shape[1]):
        real = near[:, k] >= 0
        distance[real] += np.abs(ranks[:, place[real, k]].T - k)
    both = distance + distance.T  # shared pivots are counted twice, others once
    for p in np.flatnonzero((has.sum(0) > 1) & (names >= 0)):
        some = np.flatnonzero(has[:, p])
        both[np.ix_(some, some)] -= np.abs(ranks[some, p][:, None] - ranks[some, p][None, :])
    ok &= both <= apart
    np.fill_diagonal(ok, False)
    return ok


LIST = ["label", "dims", "pivot", "bi", "bj"]


def pruned(batches: Iterator[pa.RecordBatch], rules: Mapping[int, Rule]) -> Iterator[pa.RecordBatch]:
    """Of inverted lists, or pairs of blocks of one, the members that have a candidate there; no vector is read."""
    for table, at in whole_groups(batches, LIST, rows=BLOCK_ROWS):
        near = lists_of(table["near"])
        block, dims, pivot, bi, bj = (table[c].to_numpy() for c in ("block", "dims", "pivot", "bi", "bj"))
        keep = np.zeros(table.num_rows, bool)
        for s, e in zip(at, np.r_[at[1:], table.num_rows], strict=True):
            if e - s > 1:
                ok = candidates(near[s:e, : rules[int(dims[s])].nearest], int(pivot[s]), *rules[int(dims[s])])
                if bi[s] != bj[s]:
                    ok &= block[s:e, None] != block[None, s:e]
                keep[s:e] = ok.any(1)
        yield from table.filter(pa.array(keep)).to_batches()


FOUND = "node long, other long, links long"


def verify_lists(batches: Iterator[pa.RecordBatch], threshold: float, rules: Mapping[int, Rule]) -> Iterator[pa.RecordBatch]:
    """Members of lists with their vectors to verified links: (node, other, links).

    A row with other null adds linked rows to a class; one with other links the two in the component.
    """
    for table, at in whole_groups(batches, LIST, rows=BLOCK_ROWS):
        near = lists_of(table["near"])
        ids, size, block, dims, pivot, bi, bj = (table[c].to_numpy() for c in ("cid", "size", "block", "dims", "pivot", "bi", "bj"))
        blob, left, right = table["vector"], [], []
        for s, e in zip(at, np.r_[at[1:], table.num_rows], strict=True):
            x = unit_rows(blob.slice(s, e - s), int(dims[s]))
            rule = rules[int(dims[s])]
            ok = candidates(near[s:e, : rule.nearest], int(pivot[s]), *rule) & (x @ x.T >= threshold)
            if bi[s] != bj[s]:
                ok &= block[s:e, None] != block[None, s:e]
            a, b = np.nonzero(np.triu(ok))
            left.append(s + a)
            right.append(s + b)
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
        links = np.bincount(a, size[b], len(ids)) + np.bincount(b, size[a], len(ids))
        linked = np.flatnonzero(links)
        # within one call the links' components are joined, so what leaves is a forest, not the pairs
        names, place = np.unique(ids, return_inverse=True)
        root = local_components(len(names), place[a], place[b])
        joined = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[ids[linked], names[joined]]), pa.array([None] * len(linked) + names[root[joined]].tolist(), pa.int64()), pa.array(np.r_[links[linked].astype(np.int64), np.zeros(len(joined), np.int64)])], ["node", "other", "links"]
        )


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, nearest: int = NEAREST, shared: int = SHARED, apart: int = APART_RANKS) -> DataFrame:
    """One row per row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine, in doubles, is at least threshold. Equal vectors of a
    label are one class, linked among themselves and looked up once, whatever their identifiers. A class enters the
    inverted list of each of its nearest pivots; lists of more than BLOCK_ROWS members are compared in pairs of blocks.
    No pair below the threshold links; pairs that share fewer than ``shared`` of their nearest pivots, or whose ranks
    differ by more than ``apart`` in all, are missed (recall is measured in the tests).

    The number of pivots follows the root of the number of classes, up to MOST and to SAMPLE_BYTES; they come from the
    classes whose names hash lowest, SAMPLE for each pivot, and every class is indexed. Descriptions are of directions as
    seen from the sample's centre, so that vectors which all point much the same way are told apart too. Where these lie so
    close that the threshold is far for them, descriptions grow longer and the rule follows, as vectors of the sample that
    are moved to the threshold show. A length that the sample lacks, so a rare one, has one list.

    Null, zero or non-finite vectors, null labels and null identifiers link with nothing: n_links 0, kept. Rows that
    repeat a vec_id are vectors of their own that share the identifier. An empty table gives no row.
    """
    vectors = materialize(clean_vectors(embeddings), "vectors")
    key = ["label", "dims", "h1", "h2"]
    classes = vectors.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    most, longest = classes.agg(F.count("*"), F.max("dims")).first()
    count = max(2, min(MOST, max(FEWEST, math.ceil(PER_ROOT * math.sqrt(most))), SAMPLE_BYTES // (8 * SAMPLE * (longest or 1))))
    sample = classes.orderBy(F.xxhash64("h1", "h2"), "h1", "h2", "label").limit(SAMPLE * count).select("dims", "vector").collect()
    by_dims, rules = {}, collections.defaultdict(lambda: Rule(nearest, shared, apart))
    for d in {r.dims for r in sample}:
        x = unit_rows(pa.array([bytes(r.vector) for r in sample if r.dims == d]), d)
        centre = x.mean(0)
        by_dims[d] = centre, choose_pivots(centred(x, centre), count)
        rules[d] = settle(x[:TRIED], *by_dims[d], threshold, Rule(nearest, shared, apart))
    held = embeddings.sparkSession.sparkContext.broadcast(by_dims)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            near: list[list[int]] = [[]] * len(dims)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if (p := held.value.get(int(d))) is None:
                    found = np.zeros((len(rows), 1), np.int32)  # no vector of this length in the sample: one list
                else:
                    found = nearest_pivots(centred(unit_rows(batch["vector"].take(pa.array(rows)), int(d)), p[0]), p[1], rules[int(d)].nearest)
                for i, f in zip(rows, found.tolist(), strict=True):
                    near[i] = f
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("label", "dims", "cid")] + [pa.array(near, pa.list_(pa.int32()))], ["label", "dims", "cid", "near"])

    described = materialize(classes.select("label", "dims", "cid", "vector").mapInArrow(trimmed(describe), "label long, dims int, cid long, near array<int>"), "described")
    entries = described.select("label", "dims", "cid", "near", F.explode("near").alias("pivot"))
    lists = ["label", "dims", "pivot"]
    sizes = entries.groupBy(*lists).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).drop("n")
    entries = entries.join(sizes, lists).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # a member of a list of many blocks goes to each pair of blocks with its own
    entries = entries.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.select(*lists, "cid", "near", "block", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"))
    dealt = entries.repartition(*LIST).sortWithinPartitions(*LIST)
    kept = materialize(dealt.mapInArrow(trimmed(lambda b: pruned(b, rules)), dealt.schema), "pruned")
    rows = kept.join(classes.select("cid", "size", "vector"), "cid").repartition(*LIST).sortWithinPartitions(*LIST)
    found = materialize(rows.mapInArrow(trimmed(lambda b: verify_lists(b, threshold, rules)), FOUND), "links")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    about = classes.select(*key, "cid", "rep", "size").join(links.withColumnRenamed("node", "cid"), "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    about = materialize(about.withColumn("component", F.coalesce("component", "cid")), "about")
    about = about.join(about.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    about = about.select(*key, (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = vectors.select("vec_id", *key).join(about, key).select("vec_id", "n_links", "component_id")
    # vectors that cannot link are those that clean_vectors left out
    rest = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    largest = F.array_max(F.transform("embedding", lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), float("inf")).otherwise(F.abs(v))))
    unfit = F.col("vec_id").isNull() | F.col("label").isNull() | F.coalesce(largest, F.lit(0.0)).isin(0.0, float("inf"))
    alone = rest.where(unfit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
