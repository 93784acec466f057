"""A text index beside each part: posting lists of trigrams, and patterns compiled to the trigrams a match must hold."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from re import _constants as ops
from re import _parser as patterns

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import list_names, remove_path
from .store import BITMAP_ROWS, Snapshot, Store

POSTINGS = "gram string, file string, bucket long, rows array<int>"
#: Strings that a stretch of a pattern may stand for before it is taken apart; trigrams of a pattern that are looked up.
MOST_STRINGS, MOST_GRAMS = 16, 40
#: Trigrams of one literal string that are looked up; few enough to reach the scan of the lists one by one.
MOST_OF_STRING = 8
#: Bytes of text whose trigrams are told apart at once; pairs of a trigram and a row from which lists are made.
PIECE_BYTES, MOST_PAIRS = 1 << 21, 4_000_000
#: Characters that a pattern without case takes for ASCII letters, and these.
ODD, PLAIN = "\u017f\u0131\u0130\u212a", "siik"


# --- what a match must hold ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Need:
    """A condition on the trigrams of a text: one trigram, all or any of some conditions. No conditions under "all": none."""

    kind: str
    gram: str = ""
    parts: tuple[Need, ...] = ()

    def grams(self) -> set[str]:
        return {self.gram} if self.kind == "gram" else {g for p in self.parts for g in p.grams()}

    def holds(self, has: Column) -> Column:
        """Over an array of trigrams."""
        if self.kind == "gram":
            return F.array_contains(has, self.gram)
        join = (lambda a, b: a & b) if self.kind == "all" else (lambda a, b: a | b)
        return reduce(join, [p.holds(has) for p in self.parts])


NOTHING = Need("all")


def all_of(needs: Iterable[Need]) -> Need:
    parts = tuple(dict.fromkeys(q for p in needs for q in (p.parts if p.kind == "all" else (p,))))
    return parts[0] if len(parts) == 1 else Need("all", parts=parts)


def any_of(needs: Iterable[Need]) -> Need:
    parts = tuple(dict.fromkeys(q for p in needs for q in (p.parts if p.kind == "any" else (p,))))
    if not parts or NOTHING in parts:
        return NOTHING
    return parts[0] if len(parts) == 1 else Need("any", parts=parts)


def need_of_string(text: str) -> Need:
    """Trigrams of the stretches of ASCII in a literal string: every third one, and the last; of many, MOST_OF_STRING."""
    found = []
    for run in re.findall(r"[\x20-\x7e]{3,}", text):
        starts = [*range(0, len(run) - 2, 3), len(run) - 3]
        found += [Need("gram", run[i : i + 3]) for i in dict.fromkeys(starts)]
    return all_of(found[:: max(1, -(-len(found) // MOST_OF_STRING))])


def need_of_fragment(fragment: str) -> Need:
    return need_of_string(fragment.lower())


class _Reader:
    """Reads a parsed pattern from left to right: open_ are the strings that the stretch so far may be."""

    def __init__(self) -> None:
        self.needs: list[Need] = []
        self.open_ = {""}

    def close(self) -> None:
        self.needs.append(any_of(need_of_string(s) for s in self.open_))
        self.open_ = {""}

    def follow(self, strings: set[str]) -> None:
        crossed = {a + b for a in self.open_ for b in strings}
        if len(crossed) > MOST_STRINGS:
            self.close()
            crossed = strings
        self.open_ = crossed


def _letters(op: object, value: object) -> set[str] | None:
    """Strings of one character that an element stands for, if they are few and ASCII."""
    if op is ops.LITERAL:
        return {chr(value).lower()} if value < 0x80 else None
    if op is ops.IN and len(value) <= 4 and all(o is ops.LITERAL and v < 0x80 for o, v in value):
        return {chr(v).lower() for _, v in value}
    return None


def _strings(sequence: Sequence[tuple]) -> set[str] | None:
    """All strings of a sequence, if they are few."""
    found = {""}
    for op, value in sequence:
        some = _letters(op, value)
        if op is ops.SUBPATTERN:
            some = _strings(value[3])
        elif op is ops.BRANCH:
            each = [_strings(s) for s in value[1]]
            some = None if None in each else set().union(*each)
        elif op is ops.AT:
            some = {""}
        if some is None:
            return None
        found = {a + b for a in found for b in some}
        if len(found) > MOST_STRINGS:
            return None
    return found


def _read(sequence: Sequence[tuple]) -> Need:
    r = _Reader()
    for op, value in sequence:
        if (some := _strings([(op, value)])) is not None:
            r.follow(some)
        elif op is ops.SUBPATTERN:
            r.close()
            r.needs.append(_read(value[3]))
        elif op is ops.BRANCH:
            r.close()
            r.needs.append(any_of(_read(s) for s in value[1]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low, high, inner = value
            some = _strings(inner)
            if some is not None and high == 1:
                r.follow(some | {""} if low == 0 else some)
            else:
                r.close()
                if low:
                    r.needs.append(_read(inner))
        else:  # any character, large sets, references, looking around: nothing is needed of these
            r.close()
    r.close()
    return all_of(r.needs)


def need_of_pattern(pattern: str) -> Need:
    """What a text that a pattern matches, without case, must hold; NOTHING where that can't be told.

    Read by Python's parser, whose language is the regex engine's but for what is left out here: quoting, sets in sets,
    comments and inline flags.
    """
    if re.search(r"\\[QE0-9]|\[[^\]]*(\[|&&)|\(\?[^:=!<>P]", pattern):
        return NOTHING
    try:
        need = _read(patterns.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError, ValueError):
        return NOTHING
    return need if len(need.grams()) <= MOST_GRAMS else NOTHING


def need_of(fragment: str | None = None, pattern: str | None = None) -> Need:
    return any_of([*([need_of_fragment(fragment)] if fragment else []), *([need_of_pattern(pattern)] if pattern else [])])


# --- the index -----------------------------------------------------------------------------------------------------


def folded(text: Column) -> Column:
    """A text as its trigrams are taken: in lower case, with letters that a pattern takes for ASCII ones as these."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), ODD, PLAIN))


def pairs_of(texts: pa.Array, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Trigrams of texts with the texts' rows, a pair a number: different ones, sorted, of each piece of the texts' bytes."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for start in range(int(bounds[0]), int(bounds[-1]) - 2, PIECE_BYTES):
        piece = data[start : min(start + PIECE_BYTES + 2, int(bounds[-1]))]
        plain = (piece >= 0x20) & (piece <= 0x7E)  # no byte of a character beyond ASCII is
        at = np.flatnonzero(plain[:-2] & plain[1:-1] & plain[2:])
        owner = np.searchsorted(bounds, at + start, side="right") - 1
        whole = at + start + 3 <= bounds[owner + 1]
        at, code = at[whole], piece.astype(np.int64) - 0x20
        yield np.unique(((code[at] * 95 + code[at + 1]) * 95 + code[at + 2]) << 32 | rows[owner[whole]])


def lists_of(file: str, pairs: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Posting lists of the pairs of one file's rows, by trigram."""
    joined = np.unique(np.concatenate(pairs))
    gram, row = joined >> 32, joined & 0xFFFFFFFF
    run = gram << 32 | row // BITMAP_ROWS
    first = np.flatnonzero(np.diff(run, prepend=-1))
    n, gram = len(first), gram[first]
    letters = (np.stack([gram // 9025, gram // 95 % 95, gram % 95], 1) + 0x20).astype(np.uint8)
    grams = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.py_buffer(letters.tobytes()))
    rows = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(row.astype(np.int32)))
    return pa.RecordBatch.from_arrays([grams, pa.array([file]).take(pa.array(np.zeros(n, np.int64))), pa.array(row[first] // BITMAP_ROWS), rows], ["gram", "file", "bucket", "rows"])


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of (text, _file, _row): for each file, of as many rows as have MOST_PAIRS pairs."""
    file, held, n = None, [], 0
    for batch in batches:
        names, rows = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for start, end in pairwise(cuts):
            if start == end:
                continue
            if held and names[start] != file:
                yield lists_of(file, held)
                held, n = [], 0
            file = names[start]
            for pairs in pairs_of(batch.column(0).slice(start, end - start), rows[start:end]):
                held.append(pairs)
                n += len(pairs)
                if n >= MOST_PAIRS:
                    yield lists_of(file, held)
                    held, n = [], 0
    if held:
        yield lists_of(file, held)


class TextIndex:
    """Posting lists of a store's parts, under root/terms by part. A part without them is scanned, so results never differ.

    Lists are made where a stretch of a file is read and stay there, sorted by trigram, so nothing is dealt to make them; a
    trigram has a list for each stretch, and a lookup reads some pages of each file of lists.
    """

    def __init__(self, store: Store):
        self.store, self.spark, self.path = store, store.spark, f"{store.root}/terms"

    def parts(self) -> set[str]:
        """Parts whose posting lists are whole."""
        return {n for n in list_names(self.spark, self.path) if "_SUCCESS" in list_names(self.spark, f"{self.path}/{n}")}

    def build(self, base: Snapshot | None = None) -> int:
        """Indexes the parts that are not indexed yet, each by itself; returns their number."""
        base = base or self.store.snapshot()
        known = self.parts()
        new = [p for p in base.parts if p["part"] not in known]
        for p in new:
            remove_path(self.spark, f"{self.path}/{p['part']}")
            rows = self.store._read([{"part": p["part"], "without": []}], located=True)
            lists = rows.select(folded(F.col("text")).alias("text"), "_file", "_row").mapInArrow(posting_lists, POSTINGS)
            options = {"parquet.page.row.count.limit": "1000", "parquet.bloom.filter.enabled#gram": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
            lists.sortWithinPartitions("gram").write.options(**options).parquet(f"{self.path}/{p['part']}")
        return len(new)

    def places(self, need: Need, parts: Sequence[str]) -> DataFrame:
        """(_file, _row) of the rows of some indexed parts that hold what is needed."""
        lists = self.spark.read.schema(POSTINGS).parquet(*[f"{self.path}/{p}" for p in parts]).where(F.col("gram").isin(sorted(need.grams())))
        single = lists.select("gram", F.col("file").alias("_file"), F.explode("rows").alias("row"))
        held = single.groupBy("_file", F.col("row").cast("long").alias("_row")).agg(F.collect_set("gram").alias("has"))
        return held.where(need.holds(F.col("has"))).select("_file", "_row")

    def located(self, need: Need, base: Snapshot) -> DataFrame:
        """Points of base, with their places, that may match: candidates of indexed parts, all rows of others."""
        known = self.parts() if need != NOTHING else set()
        indexed, others = [p for p in base.parts if p["part"] in known], [p for p in base.parts if p["part"] not in known]
        found = [self.store._read(others, located=True)] if others or not indexed else []
        if indexed:
            found.append(self.store.at(indexed, self.places(need, [p["part"] for p in indexed])))
        return reduce(DataFrame.unionByName, found)
