"""Spelling variants: words one edit apart, found in minimal acyclic automata of the vocabulary, forward and backward.

Of two words one edit apart, one half is spelt alike: either the first half of the asking word starts the other one, or
its second half ends it. So each word is entered under its first halves and, reversed, under its last ones (two lengths
each, as the asking word may be one letter shorter or longer), and asks under its own two halves. A bucket of halves is an
automaton: minimal, acyclic, with the number of words below each step, which gives a word's number among those of the
bucket as it is read. A word is read exactly through its half, then completed with one error. What the backward search
finds of words that start alike, the forward search has found.

The vocabulary stays in partitions throughout: buckets hold about BUCKET_ROWS entries, and a half that more words share
is split into blocks of entries, each of which all its words ask.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, trimmed

MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
#: Letters of words, once A-Z are in lower case.
LETTERS = "[a-zÀ-ÿ]+"
#: Entries of an automaton, on average; entries of one half that stay together; different words that a task counts at once.
BUCKET_ROWS, MOST_ALIKE, MOST_COUNTED = 30_000, 20_000, 200_000

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


# --- counts ------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, letters: str = LETTERS, edit: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """(word, n) over all docs (doc_id, text): runs of letters, A-Z in lower case; a null text has none.

    edit gives, for a doc_id and the different words of that row, the words to count instead. Words are counted by row,
    then by task, before they are exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(letters).findall, Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = Counter(find(text.as_py().translate(_LOWER).decode()))
                if edit:
                    for word, n in zip(edit(doc_id, list(found)), found.values(), strict=True):
                        total[word] += n
                else:
                    total.update(found)
                if len(total) >= MOST_COUNTED:
                    yield counted()
        if total:
            yield counted()

    some = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return some.mapInArrow(trimmed(run), "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


# --- automata ----------------------------------------------------------------------------------------------------


class Automaton:
    """The minimal acyclic automaton of sorted, different words. A step is (next state, words before those it leads to)."""

    def __init__(self, words: Sequence[str]):
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        counts: list[int] = []
        register: dict[tuple, int] = {}
        path: list[dict[str, tuple[int, int]]] = [{}]
        ends, below, last = [False], [0], ""

        def close(depth: int) -> None:
            """Nodes below a depth are complete: each becomes the state that is equal to it, or a new one."""
            while len(path) > depth + 1:
                node, end, count = path.pop(), ends.pop(), below.pop()
                key = (end, *node.items())
                state = register.get(key)
                if state is None:
                    state = register[key] = len(counts)
                    self.steps.append(node)
                    self.final.append(end)
                    counts.append(count)
                path[-1][last[len(path) - 1]] = (state, below[-1])
                below[-1] += count

        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            for _ in range(len(word) - same):
                path.append({})
                ends.append(False)
                below.append(0)
            ends[-1] = True
            below[-1] += 1
            last = word
        close(0)
        self.steps.append(path[0])
        self.final.append(ends[0])
        self.start = len(self.final) - 1

    def read(self, word: str, at: int = 0, state: int | None = None, number: int = 0) -> tuple[int, int]:
        """(state, number) after the letters of word from at on; state -1 if the automaton has no such word."""
        state, steps = self.start if state is None else state, self.steps
        for i in range(at, len(word)):
            step = steps[state].get(word[i])
            if step is None:
                return -1, 0
            state = step[0]
            number += step[1]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that start with the first exact letters of word and go on with its rest but for one
        letter, put in, left out or replaced."""
        state, number = self.read(word[:exact])
        found: set[int] = set()
        if state < 0:
            return found
        steps, final, n = self.steps, self.final, len(word)

        def complete(at: int, state: int, number: int) -> None:
            for i in range(at, n):
                step = steps[state].get(word[i])
                if step is None:
                    return
                state = step[0]
                number += step[1]
            if final[state]:
                found.add(number)

        for i in range(exact, n + 1):
            letter = word[i] if i < n else None
            if i < n:
                complete(i + 1, state, number)
            for other, (target, skip) in steps[state].items():
                complete(i, target, number + skip)
                if i < n and other != letter:
                    complete(i + 1, target, number + skip)
            step = steps[state].get(letter)
            if step is None:
                break
            state = step[0]
            number += step[1]
        return found


NEAR = "word string, n long, near array<struct<n:bigint,word:string>>"
_NEAR = pa.list_(pa.struct([("n", pa.int64()), ("word", pa.string())]))


def search_bucket(table: pa.Table) -> pa.Table:
    """The asking words of a bucket of one direction with the entries near them."""
    backward = table["backward"][0].as_py()
    words, counts = table["word"].to_pylist(), table["n"].to_pylist()
    entry = dict(zip(words, counts, strict=True))
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    keys = sorted({turn(w) for w, enters in zip(words, table["enters"].to_pylist(), strict=True) if enters})
    automaton, by_number = Automaton(keys), [turn(k) for k in keys]
    # a word asks twice where two blocks of its half are in one bucket
    asking = list({words[i]: i for i, a in enumerate(table["asks"].to_pylist()) if a}.values())
    near = []
    for i in asking:
        word = words[i]
        first = len(word) // 2
        found = [by_number[x] for x in automaton.near(turn(word), len(word) - first if backward else first)]
        near.append([{"n": entry[w], "word": w} for w in found if not (backward and w.startswith(word[:first]))])
    out = pa.table([pa.array([words[i] for i in asking], pa.string()), pa.array([counts[i] for i in asking], pa.int64()), pa.array(near, _NEAR)], ["word", "n", "near"])
    release_memory()
    return out


def near_words(vocabulary: DataFrame, bucket_rows: int = BUCKET_ROWS, most_alike: int = MOST_ALIKE) -> DataFrame:
    """vocabulary (word, n; words differ) with near: [(n, word)] of its words that differ from word by exactly one letter
    put in, left out or replaced. A word has no more of them than its length and the alphabet allow. Null words go; an
    empty vocabulary gives no row."""
    words = vocabulary.where("word is not null").select("word", F.col("n").cast("long").alias("n"))
    size = F.char_length("word")
    short, own, long_ = F.expr("(size - 1) div 2"), F.expr("size div 2"), F.expr("(size + 1) div 2")
    forward = F.transform(F.array_distinct(F.array(short, own, long_)), lambda k: F.struct(F.lit(False).alias("backward"), F.expr("word").substr(F.lit(1), k.cast("int")).alias("half"), (k == own).alias("asks")))
    halves = F.array_distinct(F.array(*[F.expr(f"(size + {i}) div 2") for i in (0, 1, 2)]))
    backward = F.transform(halves, lambda k: F.struct(F.lit(True).alias("backward"), F.right(F.col("word"), k.cast("int")).alias("half"), (k == F.expr("(size + 1) div 2")).alias("asks")))
    rows = words.withColumn("size", size).select("word", "n", F.explode(F.concat(forward, backward)).alias("e")).select("word", "n", "e.*")
    rows = materialize(rows.withColumns({"enters": F.lit(True), "block": F.lit(0)}), "entries")
    buckets = max(1, -(-rows.count() // bucket_rows))
    key = ["backward", "half"]
    alike = rows.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > most_alike)
    # written, so that the planner knows its size: it has fewer rows than there are entries by most_alike
    alike = materialize(alike.select(*key, F.ceil(F.col("rows") / most_alike).cast("int").alias("blocks")), "alike")
    crowded = not alike.isEmpty()
    if crowded:
        split = rows.join(alike, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        # every block is asked, one is entered
        asked = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))
        split = split.withColumn("mine", mine).withColumn("block", F.explode(asked))
        rows = split.select("word", "n", *key, "asks", (F.col("block") == F.col("mine")).alias("enters"), "block")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("half", "block"), F.lit(buckets)))
    found = dealt.groupBy("backward", "bucket").applyInArrow(search_bucket, NEAR)
    near = F.flatten(F.collect_list("near"))
    # a word that asks several buckets can meet an entry of its half in one and the same word by its other half in another
    return found.groupBy("word", "n").agg((F.array_distinct(near) if crowded else near).alias("near"))


# --- forms -------------------------------------------------------------------------------------------------------


def follow(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last. Every round doubles the way that is done."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def spelling_variants(counts: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: float = RATIO, bucket_rows: int = BUCKET_ROWS, most_alike: int = MOST_ALIKE) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of counts (word, n; words differ) with min_letters code points and
    min_count occurrences or more.

    n_near counts the words one letter apart. form is the most frequent of them, by code points the first of equal ones,
    if it is ratio times as frequent as the word or more, which is above 1; else null, as form_n, its n. root is where
    forms lead to in the end, the word itself without a form. Null words go; an empty table gives no row.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words")
    vocabulary = materialize(counts.where((F.char_length("word") >= min_letters) & (F.col("n") >= min_count)).select("word", "n"), "vocabulary")
    best = F.array_min(F.transform("near", lambda w: F.struct((-w["n"]).alias("less"), w["word"].alias("form"))))
    named = near_words(vocabulary, bucket_rows, most_alike).select("word", "n", F.size("near").cast("long").alias("n_near"), best.alias("b"))
    wins = -F.col("b.less") >= ratio * F.col("n")
    forms = materialize(named.select("word", "n", "n_near", F.when(wins, F.col("b.form")).alias("form"), F.when(wins, -F.col("b.less")).alias("form_n")), "forms")
    roots = follow(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_slips(doc_id: int | None, words: list[str]) -> list[str]:
    """One in 97 of a document's words, by crc32 of its doc_id and the word, loses a letter; rows without doc_id lose none."""
    if doc_id is None:
        return words
    start, out = crc32(b"%d:" % doc_id), []
    for w in words:
        h = crc32(w.encode(), start)
        at = h % len(w)
        out.append(w if h % 97 else w[:at] + w[at + 1 :])
    return out
