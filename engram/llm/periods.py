"""Periodic runs of words: maximal repetitions from Lyndon arrays over the ordered alphabet of a text's words.

Each run holds a Lyndon word of the length of its period that reaches to the next smaller suffix, under the order of the
words or its reverse. So the Lyndon arrays of both orders, with the length of the match between a suffix and the next
smaller one, give all runs: a Lyndon word whose match goes on far enough to the right, extended to the left.

The arrays are made in one pass from left to right, by comparing words alone: no suffixes are sorted and no stretch of
words has a fingerprint; single words are numbered by a dictionary, which compares them in full. A comparison is settled by an earlier one of the same stack where their matches differ, else by the copy
of it inside the match that reaches furthest, and only where that copy ends, words are read on; so each word is read on
once.

Words that no run can hold are found first, for a whole batch of texts at once: in a run a word comes again at the
distance of the period, which is a small part of the stretch. Stretches between such words are all that is searched;
prose leaves few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import release_memory, trimmed

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Bytes of text whose words are numbered together.
STEP_BYTES = 4 << 20

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


# --- Lyndon arrays and runs --------------------------------------------------------------------------------------


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix of s the start of the next smaller one, len(s) if none, and how many values the two share.

    The end of s is smaller than any value. Suffixes without a smaller one yet stand on a stack, linked by the last
    smaller suffix before each. pair says that s[k] == s[k - pair] for copy <= k < reach: the match that reaches furthest.
    """
    n = len(s)
    after, shared = [n] * n, [0] * n
    before, matched = [-1] * n, [0] * n
    pair = copy = reach = 0
    for r in range(1, n):
        left, known, open_ = r - 1, 0, True
        while left >= 0:
            if open_:
                k = known
                if copy <= left and r < reach:
                    # inside the copy, this comparison has been made before, at pair to the left
                    a, b = left - pair, r - pair
                    old = shared[a] if after[a] == b else matched[b] if before[b] == a else -1
                    if 0 <= old < reach - r:
                        known, open_ = old, False
                    elif old > k:
                        k = reach - r
                if open_:
                    while r + k < n and s[left + k] == s[r + k]:
                        k += 1
                    if r + k > reach:
                        pair, copy, reach = r - left, r, r + k
                    known = k
                if r + known < n and s[left + known] < s[r + known]:
                    break
            # left is greater: r is its next smaller one
            after[left], shared[left] = r, known
            link, left = matched[left], before[left]
            if left < 0:
                break
            if link < known:
                # smaller than the one before it at a place where r is still equal to that
                known = link
                break
            open_ = link == known
        before[r], matched[r] = left, known if left >= 0 else 0
    return after, shared


def runs_of(s: list[int], min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of s with length >= max(min_length, min_exponent * period), in that order; min_exponent is 2 or more."""
    found = set()
    for values in (s, [-x for x in s]):
        after, shared = next_smaller(values)
        n = len(s)
        for left, right in enumerate(after):
            period = right - left
            if right == n or shared[left] + 2 * period <= max(min_length, min_exponent * period):
                continue
            if left >= period and after[left - period] == left and shared[left - period] >= period:
                continue  # a later root of a run that is found from its first one
            back = 0
            while back < left and s[left - back - 1] == s[right - back - 1]:
                back += 1
            length = back + period + shared[left]
            if length >= max(min_length, min_exponent * period):
                found.add((left - back, length, period))
    return sorted(found)


# --- stretches that may hold runs ----------------------------------------------------------------------------------


def number_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, text numbers) of the words of some texts, end to end."""
    joined = b" ".join(texts).translate(_BLANKS)
    edges = np.flatnonzero(np.diff((np.frombuffer(joined, np.uint8) == 0x20).view(np.int8), prepend=1, append=1))
    ends = np.zeros(len(edges) // 2 + 1, np.int64)
    np.cumsum(edges[1::2] - edges[::2], out=ends[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(joined.translate(None, b" "))])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), np.searchsorted(starts, edges[::2], "right") - 1


def stretches(words: np.ndarray, texts: np.ndarray, min_length: int, min_exponent: float) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of one text outside of which no run lies.

    A word of a run comes again within the run, at the distance of the period, which is at most the stretch's length over
    min_exponent. Words that don't, part stretches; shorter stretches part further.
    """
    n = len(words)
    if not n:
        return
    keyed = np.sort((texts * (words.max() + 1) + words) * n + np.arange(n))
    key, at = keyed // n, keyed % n
    gap = np.where(key[1:] == key[:-1], at[1:] - at[:-1], n)
    near = np.empty(n, np.int64)
    near[at] = np.minimum(np.append(gap, n), np.insert(gap, 0, n))
    left = np.flatnonzero(near < n)
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1] + 1) | (texts[left[1:]] != texts[left[:-1]])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(left)))
        stretch = np.repeat(length, length)
        kept = left[(stretch >= min_length) & (near[left] * min_exponent <= stretch)]
        if len(kept) == len(left):
            yield from zip(left[first].tolist(), (left[first] + length).tolist(), strict=True)
            return
        left = kept


def runs_by_text(texts: list[bytes], min_length: int, min_exponent: float) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """Numbers of words of some texts, and the runs of those that have some."""
    words, owner = number_words(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    found: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in stretches(words, owner, min_length, min_exponent):
        text = int(owner[begin])
        shift = begin - int(starts[text])
        runs = runs_of(words[begin:end].tolist(), min_length, min_exponent)
        found.setdefault(text, []).extend((start + shift, length, period) for start, length, period in runs)
    return sizes, {text: sorted(runs) for text, runs in found.items() if runs}


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


# --- the operator --------------------------------------------------------------------------------------------------

ADDED = ("n_words", "runs", "collapsed")
_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> DataFrame:
    """docs (text and any other columns) with n_words, runs [(start, length, period)] and collapsed.

    A run is a stretch of words, numbered from 0, with smallest period p (words p apart are equal) and length of at least
    min_length and min_exponent * p, that no neighbouring word extends; runs come by start, then period. collapsed holds the
    words, joined by blanks, without those that a run holds after its first period. Words are what blank, tab, line feed,
    vertical tab, form feed and carriage return part. Null and empty texts have no words, no runs and an empty collapsed
    text. Each row is judged by its own text, repeated rows alike; columns named as the added ones are replaced, others
    keep their values; an empty table gives no row.

    Rows are judged where they are read: nothing is shuffled, a task holds a batch of texts at a time.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    columns = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*columns).alias("row") if columns else F.struct(F.lit(0).alias("none")).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = StructType([rows.schema["row"], StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN)), StructField("collapsed", StringType())])
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def judge(texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[bytes]]:
        sizes, found = runs_by_text(texts, min_length, min_exponent)
        runs, collapsed = [], []
        for i, text in enumerate(texts):
            mine = found.get(i, [])
            words = text.split()
            runs.append([{"start": a, "length": n, "period": p} for a, n, p in mine])
            collapsed.append(b" ".join(collapse(words, mine) if mine else words))
        return sizes.tolist(), runs, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            column = batch["text"].cast(pa.binary())
            for i in range(batch.num_rows):
                held.append(column[i].as_py())
                size += len(held[-1])
                if size >= STEP_BYTES or i == batch.num_rows - 1:
                    sizes, runs, collapsed = judge(held)
                    texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch["row"].slice(first, len(held)), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(run_type)), texts], ["row", *ADDED])
                    first, held, size = i + 1, [], 0
                    release_memory()

    judged = rows.mapInArrow(trimmed(run), out)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in columns], *ADDED)


def digest_runs(found: DataFrame) -> DataFrame:
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.less")
    return out.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"), F.floor(1000 * length / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where a tenth of the texts, by crc32 of doc_id, ends in a repeated passage of their own."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")

    def tail(ws: Column, n: Column, g: Column) -> Column:
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        repeated = F.transform(F.sequence(a, n - 1), lambda i: F.get(ws, a + (i - a) % p))
        return F.array_join(F.concat(F.slice(ws, 1, a), repeated), " ")

    named = docs.select("doc_id", "text", h.alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").rlike("[^ \\t-\\r]")
    cut = named.withColumn("ws", F.when(chosen, words)).withColumns({"n": F.size("ws"), "g": F.floor(F.col("h") / 10)})
    return cut.select("doc_id", F.when(F.col("ws").isNotNull(), tail(F.col("ws"), F.col("n"), F.col("g"))).otherwise(F.col("text")).alias("text"))
