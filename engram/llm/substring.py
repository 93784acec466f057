"""Substring dedup by seeds and extension: documents meet on winnowed anchors, matches are extended both ways.

Every window of MIN_WORDS words has one anchor, the least hash among the runs of SEED_WORDS words in it (the leftmost of
equal ones), which depends on the window's words alone. Neighbouring windows with one anchor make a segment: the words
that the anchor rules, to its left and right. Two documents that share a window share its anchor at the same place in
it, so only segments of one anchor need comparing, and a document whose segment another one has as a whole, further down
the order of identifiers or not, is settled by one comparison of hashes, however many copies there are.

Where an anchor has several different segments, one occurrence of each is fetched, and the anchor is extended word by
word to both sides against all the others at once: the windows around it that an earlier document has too are found, and
each run of them is a match that goes no further on either side. Runs of neighbouring anchors that touch are one
maximal repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import BASE_1, BASE_2, PolyHash, group_count, hash_words, materialize, mix, pack_rows, signed, trimmed, unpack_blobs, whole_groups, with_group

MIN_WORDS, SEED_WORDS = 50, 12
#: Words in memory at once. Positions take the low bits of the winnowing key.
STEP_WORDS, POSITION_BITS = 1 << 20, 23
#: Different segments of an anchor that are extended in one task's memory; beyond that, window by window in rows.
MOST_KINDS = 20_000


class Windows:
    """Word hashes of some texts end to end, with the starts of the windows that lie in one text."""

    def __init__(self, texts: Sequence[bytes], length: int):
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        values = hash_words([w for ws in self.words for w in ws])
        self.one, self.two = PolyHash(mix(values), BASE_1), PolyHash(mix(values ^ np.uint64(BASE_2)), BASE_2)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        n = max(0, len(values) - length + 1)
        self.at = np.flatnonzero(self.owner[:n] == self.owner[length - 1 : length - 1 + n])


def steps(table: pa.Table | pa.RecordBatch, text: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows that hold about STEP_WORDS words; one row at least."""
    texts = table[text].cast(pa.binary())
    first, size, held = 0, 0, []
    for i in range(len(texts)):
        held.append(texts[i].as_py() or b"")
        size += len(held[-1])
        if size > 4 * STEP_WORDS or i == len(texts) - 1:
            yield first, held
            first, size, held = i + 1, 0, []


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


SEEDS = "grp int, key long, doc_id long, start int, windows int, anchor long, segment long"


def seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """One row per segment: the window it starts at, its number of windows, hashes of its anchor and of all its words."""
    names = [c.split()[0] for c in SEEDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << POSITION_BITS) - 1)
        for batch in batches:
            for first, texts in steps(batch, "text"):
                w = Windows(texts, length)
                if not len(w.at):
                    continue
                # a text longer than positions can tell is cut up with an overlap of one window less a word
                total, reach = len(w.owner), 1 << POSITION_BITS
                for begin in range(0, total, reach - length + 1):
                    end = min(total, begin + reach)
                    at = w.at[(w.at >= begin) & (w.at + length <= end)]
                    if len(at):
                        grams = w.one.all_runs(seed)[begin : end - seed + 1]
                        keyed = (mix(grams) & ~low) | np.arange(len(grams), dtype=np.uint64)
                        place = (sliding_min(keyed, length - seed + 1)[at - begin] & low).astype(np.int64) + begin
                        new = np.ones(len(at), bool)
                        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
                        cut = np.flatnonzero(new)
                        count = np.diff(np.r_[cut, len(at)])
                        start, anchor = at[cut], place[cut]
                        whole = mix(w.two.runs(start, count + length - 1) + (count * (1 << 32) + anchor - start).astype(np.uint64))
                        rows = pa.array(first + w.owner[start])
                        places = [pa.array((start - w.starts[w.owner[start]]).astype(np.int32)), pa.array(count.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in ("grp", "key", "doc_id")), *places, pa.array(signed(w.one.runs(anchor, seed))), pa.array(signed(whole))], names)
                    if end == total:
                        break

    return docs.mapInArrow(trimmed(run), SEEDS)


EXCERPT = "anchor long, segment long, first long, words binary"


def excerpts(length: int):
    """A group's texts, and one occurrence of each segment, to the segments' words."""

    def run(packed: pa.Table, wanted: pa.Table) -> pa.Table:
        words: list[bytes] = []
        wanted = wanted.sort_by("key")
        if wanted.num_rows and packed.num_rows:
            table = unpack_blobs(packed["blob"].to_pylist())
            row_of = {k: i for i, k in enumerate(table["key"].to_pylist())}
            texts, last, split = text_column(table), None, []
            for key, start, count in zip(*(wanted[c].to_pylist() for c in ("key", "start", "windows")), strict=True):
                if key != last:
                    last, split = key, texts[row_of[key]].as_py().split()
                words.append(b" ".join(split[start : start + count + length - 1]))
        kept = wanted.slice(0, len(words))
        return pa.table([kept["anchor"], kept["segment"], kept["doc_id"], pa.array(words, pa.binary())], ["anchor", "segment", "first", "words"])

    return run


RUNS = "anchor long, segment long, place int, windows int"


def extend(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments of anchors, whole anchors together, to the runs of windows that an earlier document has.

    A window's words fix its anchor and the anchor's place in it, so equal windows are of one anchor.
    """
    for table, _ in whole_groups(batches, ["anchor"]):
        w = Windows(table["words"].to_pylist(), length)
        at, owner = w.at, w.owner[w.at]
        if not len(at):
            continue
        first = table["first"].to_numpy()[owner]
        h1, h2 = w.one.runs(at, length), w.two.runs(at, length)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        least = np.minimum.reduceat(first[order], np.flatnonzero(new))
        earliest = np.empty_like(first)
        earliest[order] = least[np.cumsum(new) - 1]
        hit = np.flatnonzero(earliest < first)
        if len(hit):
            begin = np.ones(len(hit), bool)
            begin[1:] = (at[hit[1:]] != at[hit[:-1]] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
            cut = np.flatnonzero(begin)
            rows = pa.array(owner[hit[cut]])
            place = (at[hit[cut]] - w.starts[owner[hit[cut]]]).astype(np.int32)
            count = np.diff(np.r_[cut, len(hit)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([table["anchor"].combine_chunks().take(rows), table["segment"].combine_chunks().take(rows), pa.array(place), pa.array(count)], ["anchor", "segment", "place", "windows"])


def extend_in_rows(contexts: DataFrame, length: int) -> DataFrame:
    """What extend gives, for anchors of any number of segments: each window is a row, matched by its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(batch["words"].to_pylist(), length)
            rows = pa.array(w.owner[w.at])
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in ("anchor", "segment", "first")), pa.array((w.at - w.starts[w.owner[w.at]]).astype(np.int32)), pa.array(signed(w.one.runs(w.at, length))), pa.array(signed(w.two.runs(w.at, length)))], ["anchor", "segment", "first", "place", "h1", "h2"])

    windows = materialize(contexts.mapInArrow(trimmed(run), "anchor long, segment long, first long, place int, h1 long, h2 long"), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("first").alias("least"), F.max("first").alias("last")).where("least < last").drop("last")
    return windows.join(least, ["h1", "h2"]).where("first > least").select("anchor", "segment", "place", F.lit(1).alias("windows"))


def text_column(table: pa.Table) -> pa.ChunkedArray:
    return pc.struct_field(table["row"], "text").cast(pa.string()).cast(pa.binary())


def ranges_by_key(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """key to (starts, windows)."""
    if not table.num_rows:
        return {}
    rows = np.unique(np.stack([table[c].to_numpy() for c in ("key", "start", "windows")], 1).astype(np.int64), axis=0)
    at = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    return {int(rows[a, 0]): (rows[a:b, 1], rows[a:b, 2]) for a, b in zip(at, np.r_[at[1:], len(rows)], strict=True)}


def covered_words(n: int, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(start + count + length - 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def _cut(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(row, n_words, n_removed, kept_words): row holds the columns of docs, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumns({"doc_id": F.col("row.doc_id").cast("long"), "text": F.col("row.text").cast("string")})
    filled = rows.where("text <> ''")
    groups = group_count(filled)
    filled = with_group(filled, groups).withColumn("key", F.xxhash64("doc_id", "text"))
    known = filled.where("doc_id is not null").select("grp", "key", "doc_id", "text")
    found = materialize(seeds(known, length, seed), "seeds")
    segments = found.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    anchors = segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("first").alias("low"), F.max("last").alias("high")).where("low < high").select("anchor", "kinds")
    shared = materialize(segments.join(anchors, "anchor").select("anchor", "segment", "first", "kinds"), "segments")
    matched = found.join(shared, ["anchor", "segment"]).withColumn("whole", F.col("doc_id") > F.col("first"))
    matched = materialize(matched.where("whole or kinds > 1").drop("first"), "matched")

    packed = pack_rows(filled, ["key", "row"]).groupBy("grp")
    mixed = matched.where("not whole")  # in the first document that has the segment
    place = F.min(F.struct("grp", "key", "doc_id", "start", "windows", "kinds")).alias("o")
    kinds = mixed.groupBy("anchor", "segment").agg(place).select("o.*", "anchor", "segment")
    contexts = packed.cogroup(kinds.drop("kinds").groupBy("grp")).applyInArrow(excerpts(length), EXCERPT)
    if shared.where(F.col("kinds") > MOST_KINDS).isEmpty():
        usual, crowded = contexts, None
    else:
        contexts = materialize(contexts, "contexts")
        crowds = shared.where(F.col("kinds") > MOST_KINDS).select("anchor").distinct()
        usual, crowded = contexts.join(crowds, "anchor", "left_anti"), contexts.join(crowds, "anchor", "left_semi")
    runs = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(lambda b: extend(b, length)), RUNS)
    if crowded is not None:
        runs = runs.unionByName(extend_in_rows(crowded, length))
    extended = mixed.select("grp", "key", "start", "anchor", "segment").join(runs, ["anchor", "segment"])
    extended = extended.select("grp", "key", (F.col("start") + F.col("place")).alias("start"), "windows")
    ranges = matched.where("whole").select("grp", "key", "start", "windows").unionByName(extended).groupBy("grp")

    out = StructType([StructField("row", docs.select(F.struct(*docs.columns).alias("row")).schema["row"].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_words", StringType())])

    def cut(packed: pa.Table, ranges: pa.Table) -> pa.Table:
        if not packed.num_rows:  # no group has ranges without rows
            raise AssertionError("ranges of a group without texts")
        table, removed = unpack_blobs(packed["blob"].to_pylist()), ranges_by_key(ranges)
        n_words, n_removed, kept = [], [], []
        for key, text in zip(table["key"].to_pylist(), text_column(table).to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            gone = 0
            if key in removed:
                lost = covered_words(len(words), *removed[key], length)
                gone = int(lost.sum())
                words = [words[i] for i in np.flatnonzero(~lost)]
            n_removed.append(gone)
            kept.append(b" ".join(words))
        return pa.table([table["row"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept_words"])

    some = packed.cogroup(ranges).applyInArrow(cut, out)
    none = rows.where("text is null or text = ''").select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_words"))
    return some.unionByName(none)


ADDED = ("n_words", "n_removed", "kept_words")


def remove_repeats(docs: DataFrame, length: int = MIN_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """docs (doc_id, text and any other columns) with n_words, n_removed and kept_words: the words that stay, joined by blanks.

    A word goes if a window of length words that covers it also starts in a document with a smaller doc_id, as the
    input stands. Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage
    return; a null text has none. Windows are equal if two 64-bit hashes of their words are. Rows that repeat a doc_id
    are judged each by its own text and remove nothing from each other; a null doc_id neither removes nor loses words.
    Columns named as the added ones are replaced, others keep their values; an empty table gives no row.

    Texts are exchanged once, compressed in groups of documents of bounded size; seeds and segments are counted with
    map-side combine, and joins on them can be split at a hot key. Only segments of anchors that have several are
    exchanged as words, one occurrence of each.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    out = _cut(docs, length, seed)
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], *ADDED)


def digest_kept(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages taken out of text, and n_chars, if there, counted anew; a text that loses nothing
    stays as it is, line breaks included, and one that loses all is empty. All other columns keep their values, whatever
    their names; null texts stay null, an empty table gives no row."""
    out = _cut(docs, length, SEED_WORDS)
    lost = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            old = F.when(lost, F.col("kept_words")).otherwise(old)
        elif c == "n_chars":
            old = F.when(lost, F.char_length("kept_words").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return out.select(*columns)
