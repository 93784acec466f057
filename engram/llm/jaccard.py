"""N-gram Jaccard join: a MinHash LSH forest proposes pairs, exact set intersection verifies them.

Documents with equal shingle sets are one class. A class has a label in each tree: LEVELS min-hashes of one byte each, in
one long, so that sorted labels are the tree's trie and a prefix of d bytes is a node at depth d. Prefixes are matched at
full length first and shortened level by level. After each level a class knows the exact similarities of the links it
has, and so how many links it must expect to have missed: a link of similarity s shows at depth d with the chance
1 - (1 - s**d)**trees. Classes whose expected share of found links has reached the target are settled; the others, those
without any link among them, go on with shorter prefixes, down to the depth at which even a pair at the threshold is
found with the target's chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE_1, BASE_2, PolyHash, connected_components, hash_words, local_components, materialize, mix, powers, signed, trimmed, whole_groups

#: Words of a shingle, similarity, trees, levels of a tree, recall that a pair at the similarity must reach.
WORDS, SIMILARITY, TREES, LEVELS, RECALL = 5, 0.8, 32, 8, 0.9999
#: A block of a group holds about so many shingles, and about so many classes at most.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 19, 1200


def chance(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """That two sets of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(similarity: float = SIMILARITY, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> int:
    """The longest prefix that a pair at the threshold shares with the target's chance; prefixes are not shortened below."""
    return next((d for d in range(levels, 1, -1) if chance(similarity, d, trees) >= recall), 1)


def shingle_sets(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): the distinct n-word shingles of each text, by text and hash.

    A text of 1 to n - 1 words has one shingle, all its words; a text without words has none.
    """
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    values = hash_words([w for s in split for w in s])
    starts = np.cumsum(sizes) - sizes
    poly = PolyHash(mix(values), BASE_1)
    owner_of_word = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(max(0, len(values) - n + 1))
    at = at[owner_of_word[at] == owner_of_word[at + n - 1]] if len(at) else at
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    hashes = np.concatenate([poly.runs(at, n), poly.runs(starts[short], sizes[short])])
    owner = np.concatenate([owner_of_word[at], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


SIGNED = "doc_id long, th long, h1 long, h2 long, shingles int, labels array<long>"


def signatures(rows: DataFrame, trees: int = TREES, levels: int = LEVELS, n: int = WORDS) -> DataFrame:
    """Rows (doc_id, th, text) with a 128-bit name of the shingle set, its size, and the set's label in each tree.

    A label's first byte is the lowest level. A byte is of the least of the shingles' hashes, permuted by a
    multiplication; equal bytes of different minima make candidates that verification drops.
    """
    multipliers = (mix(powers(BASE_2, trees * levels)[1:]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def sign(texts: list[bytes]) -> tuple[np.ndarray, ...]:
        hashes, owner = shingle_sets(texts, n)
        counts = np.bincount(owner, minlength=len(texts))
        full = np.flatnonzero(counts)
        labels = np.zeros((len(texts), trees), np.uint64)
        h1, h2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        if len(full):
            first = np.searchsorted(owner, full)
            h1[full] = np.add.reduceat(mix(hashes ^ np.uint64(BASE_2)), first)
            h2[full] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(BASE_1)), first)
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            permuted = np.empty_like(short)
            for t in range(trees):
                label = np.zeros(len(full), np.uint64)
                for d in range(levels):
                    np.multiply(short, multipliers[t * levels + d], out=permuted)
                    least = mix(np.minimum.reduceat(permuted, first).astype(np.uint64) + np.uint64(d + 1))
                    label = label << np.uint64(8) | least & np.uint64(255)
                labels[full, t] = label << np.uint64(8 * (8 - levels))
        return h1, h2, counts, labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            start, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size > 1_500_000 or i == len(texts) - 1:
                    h1, h2, counts, labels = sign(texts[start : i + 1])
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(labels) + 1, dtype=np.int32) * trees), pa.array(signed(labels.ravel())))
                    some = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([some["doc_id"], some["th"], pa.array(signed(h1)), pa.array(signed(h2)), pa.array(counts.astype(np.int32)), listed], ["doc_id", "th", "h1", "h2", "shingles", "labels"])
                    start, size = i + 1, 0

    return rows.select("doc_id", "th", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(trimmed(run), SIGNED)


def intersections(hashes: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """m x m counts of shared shingles. Frequent shingles go through a matrix product, rare ones through their pairs."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    df = np.diff(np.r_[cuts, len(hashes)])
    shared = np.zeros((m, m), np.float32)
    heavy = np.flatnonzero(df > 48)
    for c in range(0, len(heavy), 4096):
        some = heavy[c : c + 4096]
        table = np.zeros((m, len(some)), np.float32)
        for j, s in enumerate(some):
            table[owner[cuts[s] : cuts[s] + df[s]], j] = 1
        shared += table @ table.T
    flat, held = [], 0

    def flush() -> None:
        nonlocal flat, held
        if flat:
            both = np.bincount(np.concatenate(flat), minlength=m * m).reshape(m, m).astype(np.float32)
            np.add(shared, both + both.T, out=shared)
        flat, held = [], 0

    for k in np.unique(df[(df > 1) & (df <= 48)]):
        lists = owner[cuts[df == k][:, None] + np.arange(k)]
        for o in range(1, k):
            flat.append((lists[:, :-o].astype(np.int64) * m + lists[:, o:]).ravel())
            held += len(flat[-1])
            if held > 4_000_000:
                flush()
    flush()
    return shared


def listed_rows(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each element of a column of lists of longs."""
    array = lists.combine_chunks()
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    sizes = np.diff(array.offsets.to_numpy())
    return np.repeat(np.arange(len(array)), sizes), array.flatten().to_numpy()


def share_earlier(row: np.ndarray, value: np.ndarray, own: int, m: int) -> np.ndarray | None:
    """Which pairs of m rows have a common value below own; None if no pair can."""
    early = value < own
    if not early.any():
        return None
    names, place = np.unique(value[early], return_inverse=True)
    out = np.zeros((m, m), np.float32)
    for c in range(0, len(names), 4096):
        some = (place >= c) & (place < c + 4096)
        table = np.zeros((m, min(4096, len(names) - c)), np.float32)
        table[row[early][some], place[some] - c] = 1
        out += table @ table.T
    return out > 0


FOUND = "node long, other long, links long, classes long, missed array<double>"


def verify_stars(batches: Iterator[pa.RecordBatch], depth: int, similarity: float, trees: int, later: list[int], n: int) -> Iterator[pa.RecordBatch]:
    """Stars, or pairs of blocks of one, to links: (node, other, links, classes, missed).

    A row with other null adds to a class its linked documents, linked classes and, for each depth of later, the links
    it must be missing for those it has; one with other links the two in the component. Of a pair that several stars
    hold, the star of the smallest common head counts it; one that shares a longer prefix was counted before; one of
    two settled classes is not looked for.
    """
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for table, at in whole_groups(batches, ["head", "bi", "bj"], rows=2000):
        for s, e in zip(at, np.r_[at[1:], table.num_rows], strict=True):
            part = table.slice(s, e - s)
            ids, size, block, active = (part[c].to_numpy() for c in ("cid", "size", "block", "active"))
            hashes, owner = shingle_sets(part["text"].cast(pa.binary()).to_pylist(), n)
            m = len(ids)
            shared = intersections(hashes, owner, m)
            counts = np.bincount(owner, minlength=m).astype(np.float32)
            union = counts[:, None] + counts[None, :] - shared
            linked = (shared >= similarity * union - 1e-6) & (shared > 0)
            if part["bi"][0].as_py() != part["bj"][0].as_py():
                linked &= block[:, None] != block[None, :]
            linked &= active[:, None] | active[None, :]
            np.fill_diagonal(linked, False)
            if (earlier := share_earlier(*listed_rows(part["heads"]), part["head"][0].as_py(), m)) is not None:
                linked &= ~earlier
            if depth < LEVELS and linked.any():
                a, b = np.nonzero(linked)
                labels = (listed_rows(part["labels"])[1].reshape(m, trees).view(np.uint64) >> np.uint64(8 * (LEVELS - depth - 1))).astype(np.uint64)
                for c in range(0, len(a), 100_000):
                    lo, hi = a[c : c + 100_000], b[c : c + 100_000]
                    before = (labels[lo] == labels[hi]).any(1)
                    linked[lo[before], hi[before]] = False
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            degree = np.bincount(a, size[b], m).astype(np.int64)
            some = np.flatnonzero(degree)
            exact = (shared[a, b] / union[a, b]).astype(np.float64)
            missed = np.stack([np.bincount(a, 1 / chance(exact, d, trees) - 1, m) for d in later], 1) if later else np.zeros((m, 0))
            root = local_components(m, a, b)
            low = ids.copy()
            np.minimum.at(low, root, ids)
            joined = np.flatnonzero(ids != low[root])
            out[0] += [ids[some], ids[joined]]
            out[1] += [np.full(len(some), -1), low[root[joined]]]
            out[2] += [degree[some], np.zeros(len(joined), np.int64)]
            out[3] += [np.bincount(a, minlength=m)[some], np.zeros(len(joined), np.int64)]
            out[4] += [missed[some], np.zeros((len(joined), len(later)))]
        if out[0]:
            node, other, links, classes, missed = (np.concatenate(x) for x in out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * len(later)), pa.array(missed.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other, mask=other < 0), pa.array(links), pa.array(classes), lists], ["node", "other", "links", "classes", "missed"])
            out = [[] for _ in range(5)]


def prefix(depth: int) -> Column:
    return F.shiftright("label", 8 * (8 - depth))


def stars(matched: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """(head, cid, heads, bi, bj, block): the stars of the nodes at a depth, in pairs of blocks.

    A node's classes are joined to the smallest of them, not to each other, so a star holds the nodes that one class
    heads, and no node is chained to another. Classes that have a smaller head in common meet in its star. So where most
    of a star have one smaller head, only the others are compared with all: their blocks come first, and a pair of
    blocks holds one of them.
    """
    nodes = matched.groupBy("tree", prefix(depth).alias("node")).agg(F.min("cid").alias("head"), F.count("*").alias("n"), F.max("active").alias("any"))
    nodes = nodes.where("n > 1 and any").drop("n", "any")
    star = materialize(matched.withColumn("node", prefix(depth)).join(nodes, ["tree", "node"]).select("head", "cid").distinct(), "stars")
    heads = star.groupBy("cid").agg(F.sort_array(F.collect_set("head")).alias("heads"))  # at most one a tree
    held = star.join(heads, "cid")
    # the smaller head that most of a star have as their first
    common = held.where(F.col("heads")[0] < F.col("head")).groupBy("head", F.col("heads")[0].alias("h")).agg(F.count("*").alias("n"))
    common = common.groupBy("head").agg(F.max_by("h", F.struct("n", "h")).alias("common"))
    held = held.join(common, "head", "left").join(members.select("cid", "shingles"), "cid")
    held = held.withColumn("apart", ~F.coalesce(F.array_contains("heads", F.col("common")), F.lit(False)))
    held = held.withColumn("side", F.when(F.col("apart"), "own").otherwise("rest"))

    def blocks(side: str) -> Column:
        mine = F.col("side") == side
        return F.ceil(F.greatest(F.sum(F.when(mine, F.col("shingles")).otherwise(0)) / BLOCK_SHINGLES, F.count_if(mine) / BLOCK_DOCS)).cast("int").alias(side)

    sizes = held.groupBy("head").agg(blocks("own"), blocks("rest")).where("own > 0")
    placed = held.drop("common", "shingles", "side").join(sizes, "head")
    spot = F.when(F.col("apart"), F.pmod(F.xxhash64("cid"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("cid", F.lit(1)), F.greatest("rest", F.lit(1))))
    placed = placed.withColumn("block", spot.cast("int"))
    # an apart class meets all blocks, another one those of apart classes
    meets = F.when(F.col("apart"), F.col("own") + F.col("rest")).otherwise(F.col("own"))
    spread = placed.withColumn("with", F.explode(F.sequence(F.lit(0), meets - 1)))
    return spread.select("head", "cid", "heads", "block", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, n_links, component_id, kept.

    Documents link when the Jaccard similarity of their sets of five-word shingles is at least similarity. Those with
    equal sets are one class, and are looked up once; class_id is its smallest doc_id, n_links counts every linked
    row, copies included. component_id is the smallest doc_id that links reach; kept marks it.

    Only classes that share a prefix of least length with another one enter the sorted tries. Each level's nodes make
    stars, and the texts of a star are compared by exact intersection, in blocks of bounded size; links are counted
    there and leave as sums and a forest. Sets too small to have a partner at the similarity but an equal one are not
    looked up. Texts without words link with nothing. Rows that repeat a doc_id are rows of their own, linked by their
    texts, that share the identifier; a null doc_id links with nothing. An empty table gives no row.
    """
    lowest = least_depth(similarity, trees, LEVELS, recall)
    depths = list(range(LEVELS, lowest - 1, -1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    named = materialize(signatures(rows.where("doc_id is not null"), trees, LEVELS, words), "signatures")
    wordy = named.where("shingles > 0")
    grouped = wordy.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("size"), F.first("shingles").alias("shingles"), F.first("labels").alias("labels"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # n / (n + 1) is the greatest similarity below 1 that a set of n has with any other
    paired = classes.where(F.col("shingles") >= (F.col("shingles") + 1) * similarity - 1e-9)
    leaves = paired.select("cid", F.posexplode("labels").alias("tree", "label"))
    roots = leaves.groupBy("tree", prefix(lowest).alias("node")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    tries = leaves.withColumn("node", prefix(lowest)).join(roots, ["tree", "node"]).select("tree", "label", "cid")
    tries = materialize(tries.repartitionByRange("tree", "label", "cid").sortWithinPartitions("tree", "label", "cid"), "tries")
    members = classes.join(tries.select("cid").distinct(), "cid", "left_semi").select("cid", "size", "shingles", "labels", "rep")
    texts = rows.join(members.select("cid", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")), ["doc_id", "th"])
    members = materialize(members.drop("rep").join(texts.groupBy("cid").agg(F.first("text").alias("text")), "cid"), "members")

    found: list[DataFrame] = []
    for i, depth in enumerate(depths):
        if found:
            have = reduce(DataFrame.unionByName, found).where("other is null").groupBy("node").agg(F.sum("classes").alias("n"), F.sum(F.col("missed")[i - 1]).alias("missed"))
            settled = have.where(F.col("n") >= recall * (F.col("n") + F.col("missed"))).select(F.col("node").alias("cid"), F.lit(False).alias("active"))
            state = materialize(members.select("cid").join(settled, "cid", "left").withColumn("active", F.coalesce("active", F.lit(True))), "active")
            about, matched = members.join(state, "cid"), tries.join(state, "cid")
        else:
            about, matched = (x.withColumn("active", F.lit(True)) for x in (members, tries))
        spread = stars(matched, members, depth).join(about.select("cid", "size", "labels", "text", "active"), "cid")
        dealt = spread.repartition("head", "bi", "bj").sortWithinPartitions("head", "bi", "bj")
        check = lambda b, depth=depth: verify_stars(b, depth, similarity, trees, depths[:-1], words)
        found.append(materialize(dealt.mapInArrow(trimmed(check), FOUND), "links"))

    all_found = reduce(DataFrame.unionByName, found)
    links = all_found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(all_found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    about = classes.select("cid", "h1", "h2", "size", F.col("rep.doc_id").alias("class_id"))
    about = about.join(links.withColumnRenamed("node", "cid"), "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    about = materialize(about, "about")
    lowest_id = about.groupBy("component").agg(F.min("class_id").alias("component_id"))
    about = about.join(lowest_id, "component").select("h1", "h2", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = wordy.select("doc_id", "h1", "h2").join(about, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "component_id")
    alone = named.where("shingles = 0").select("doc_id").unionByName(rows.where("doc_id is null").select("doc_id"))
    out = out.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay when one document of each group of near duplicates does, with the columns of docs.

    An identifier is one document: its rows stay if one of them is the first of its group, and rows that repeat a doc_id
    stay or go together. Rows without an identifier stay.
    """
    columns = docs.columns
    gone = materialize(near_duplicates(docs, **options).groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*columns)
