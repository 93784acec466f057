"""Operators 11 to 13 against plain Python on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from engram.llm import fmindex, periods, spelling

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLDED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# 11


def folded(text):
    return FOLDED.findall((text or "").translate(LOWER))


def leaks(docs, items, window=10):
    phrases = collections.defaultdict(set)
    for name, text in items:
        w = folded(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[i : i + window])].add("" if name is None else str(name))
    out = []
    for doc_id, text in docs:
        w, hit, names = folded(text), set(), set()
        for i in range(len(w)):
            for k in {len(p) for p in phrases}:
                if i + k <= len(w) and (found := phrases.get(tuple(w[i : i + k]))):
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((doc_id, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=repr)


def benchmark_tables(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É9", "x"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, prose(rng.randint(10, 30))) for i in range(8)] + [(8, "Two, words"), (9, "x"), (10, ""), (11, None), (2, prose(12)), (None, prose(11))]
    docs = [(0, None), (1, ""), (1, "  \n"), (None, items[0][1]), (None, items[0][1]), (2, "a two WORDS b"), (3, "y" * 400)]
    docs += [(10 + i, prose(40) + " -- " + (items[i % 14][1] or "").upper().replace(" ", ", ") + "\n" + prose(20)) for i in range(20)]
    docs += [(90, prose(400) + " " + items[1][1] + " " + prose(500) + " " + items[3][1]), (91, "x " * 300), (91, "x " * 300)]
    return docs, items


@pytest.mark.parametrize(("shard_bytes", "phrase_bytes"), [(1 << 20, 1 << 20), (300, 1 << 20), (300, 200)])
def test_fm_index(spark, shard_bytes, phrase_bytes):
    """One shard a partition; texts cut over several shards; phrases in several blocks."""
    docs, items = benchmark_tables()
    table = spark.createDataFrame([(*d, "s", "i") for d in docs], "doc_id long, text string, start string, items string").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    found = fmindex.contaminated_spans(table, bench, shard_bytes=shard_bytes, phrase_bytes=phrase_bytes)
    rows = [(r.doc_id, r.n_words, [w for s in r.spans for w in range(s.start, s.end)], r["items"]) for r in found.collect()]
    assert all(a.end < b.start for r in found.collect() for a, b in zip(r.spans, r.spans[1:]))
    assert sorted(rows, key=repr) == leaks(docs, items)
    digest = {(r.doc_id, r.n_words): r for r in fmindex.digest_hits(found).collect()}
    for doc_id, n, hit, names in leaks(docs, items):
        r = digest[doc_id, n]
        assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(hit), len(names), sha(",".join(names)), bool(hit))


def test_fm_index_empty(spark):
    docs, items = "doc_id long, text string", "item_id string, text string"
    some = spark.createDataFrame([(1, "a b"), (2, None)], docs)
    found = fmindex.contaminated_spans(some, spark.createDataFrame([], items)).collect()
    assert sorted((r.doc_id, r.n_words, r.spans, r["items"]) for r in found) == [(1, 2, [], []), (2, 0, [], [])]
    assert fmindex.contaminated_spans(spark.createDataFrame([], docs), spark.createDataFrame([("q", "a")], items)).collect() == []


def test_cut_text_keeps_text_outside_spans(spark):
    text = "Keep, this. TWO words; and é9!\nend"
    rows = spark.createDataFrame([(1, text, [(2, 4), (5, 6)]), (2, None, []), (3, text, None)], "doc_id long, text string, spans array<struct<start:bigint,end:bigint>>")
    assert {r.doc_id: r.text for r in fmindex.cut_spans(rows).collect()} == {1: "Keep, this. ; and !\nend", 2: None, 3: text}


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(2)
    for symbols, size in ((2, 60), (3, 200), (40, 300), (3, 1)):
        s = np.append(rng.integers(1, symbols, size), 0)
        if size == 200:
            s[50:120] = s[100:170]
        order = fmindex.suffix_order(s, symbols)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        parts = fmindex.FMIndex.parts(s, symbols, 4)
        index = fmindex.FMIndex(len(s), symbols, parts["planes"], parts["marks"], parts["samples"])
        assert index.locate(np.arange(len(s))).tolist() == order.tolist()
        for _ in range(30):
            p = rng.integers(1, symbols, rng.integers(1, 5))
            low, high = index.search(p[None, ::-1], np.array([len(p)]))
            places = [i for i in range(len(s)) if s[i : i + len(p)].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist()) == places


# 12


def all_runs(s, min_length=6, min_exponent=4):
    """Maximal runs with their smallest periods, by trying each period."""
    out = set()
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(min_length, min_exponent * p):
                w = s[i : j + p]
                if next(q for q in range(1, p + 1) if w[q:] == w[: len(w) - q]) == p:
                    out.add((i, length, p))
            i = j + 1 if j > i else i + 1
    return sorted(out)


def periodic_texts(rng, n=60):
    texts = [None, "", " \n\t", "one", "a " * 6, "a " * 5, "é " * 7 + "\x00 \x00"]
    for _ in range(n):
        words = [f"w{i}" for i in range(rng.choice([1, 2, 3, 50]))]
        s = rng.choices(words, k=rng.randint(1, 60))
        for _ in range(rng.randint(0, 3)):
            at, unit = rng.randint(0, len(s)), rng.choices(words, k=rng.randint(1, 6))
            s[at:at] = (unit * 12)[: rng.randint(4, 40)]
        texts.append(rng.choice([" ", "\n ", "\t"]).join(s))
    return texts


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (1, 2), (4, 2.5)])
def test_runs_by_brute_force(min_length, min_exponent):
    rng = random.Random(7)
    for _ in range(400):
        s = rng.choices(range(rng.choice([1, 2, 3])), k=rng.randint(0, 40))
        if s and rng.random() < 0.5:
            s = (s[: rng.randint(1, len(s))] * 9)[: rng.randint(1, 50)]
        assert periods.runs_of(s, min_length, min_exponent) == all_runs(s, min_length, min_exponent)


def test_next_smaller_suffix_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        s = rng.choices(range(rng.choice([1, 2, 3])), k=rng.randint(0, 30)) * rng.choice([1, 1, 3])
        after, shared = periods.next_smaller(s)
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
            k = 0
            while j + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            assert (after[i], shared[i]) == (j, k)


def test_runs_are_found_in_linear_time():
    """Words read, counted: a few for each word, whatever repeats."""

    class Word(int):
        read = 0

        def __eq__(self, other):
            Word.read += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = [0], [0, 1]
    for _ in range(15):
        a, b = b, b + a
    for s in ([0] * 2000, [0, 1] * 1000, b[:2000], [0] * 1000 + [1] + [0] * 1000, ([0] * 30 + [1]) * 60):
        Word.read = 0
        periods.next_smaller([Word(x) for x in s])
        assert Word.read <= 3 * len(s)


def test_periodic_runs(spark):
    texts = periodic_texts(random.Random(9))
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(4, texts[4], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, row int").repartition(3)
    got = sorted(((r.doc_id, r.text, r.row, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()), key=repr)
    want = []
    for doc_id, text, _, row in rows:
        w = WORD.findall(text or "")
        runs = all_runs(w)
        gone = {i for a, n, p in runs for i in range(a + p, a + n)}
        want.append((doc_id, text, row, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=repr)
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_digest_of_planted_tails(spark):
    texts = [t for t in periodic_texts(random.Random(10), 200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 9), (-3, "b c " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in periods.digest_runs(periods.periodic_runs(periods.with_planted_tails(docs))).collect()}
    assert len(got) == len(rows)
    changed = 0
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = all_runs(w)
        gone = {i for a, k, p in runs for i in range(a + p, a + k)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{a},{k},{p}\n" for a, k, p in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert changed > 5


# 13


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return out - {word}


def variants(n, ratio=2):
    """word to (form, root, n, n_near, form_n)."""
    alphabet, form, near = set("".join(n)), {}, {}
    for w in n:
        near[w] = [v for v in edits(w, alphabet) if v in n]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def small_vocabulary(rng, alphabet="ab\u00e9", size=300):
    n = {}
    for _ in range(size):
        n["".join(rng.choices(alphabet, k=rng.randint(5, 9)))] = rng.choice([3, 4, 6, 7, 12, 50, 100])
    return n


@pytest.mark.parametrize(("bucket_rows", "most_alike"), [(30_000, 20_000), (50, 20_000), (200, 10)])
def test_spelling_variants(spark, bucket_rows, most_alike):
    """One automaton a direction; many; halves that many words share, in blocks."""
    n = small_vocabulary(random.Random(4)) | {"aaaaa": 9, "aaaaaa": 9, "aaaaaaa": 18, "x" * 300: 5, "x" * 299: 11}
    rows = [(w, k, 0) for w, k in n.items()] + [("abc", 50, 0), ("rarer", 2, 0), (None, 9, 0)]
    counts = spark.createDataFrame(rows, "word string, n long, root int").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(counts, bucket_rows=bucket_rows, most_alike=most_alike).collect()}
    assert got == variants(n)


def test_spelling_long_chains_and_empty(spark):
    chain = ["abcdefghijklmnopqrst"[:i] for i in range(5, 20)]
    counts = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(chain)], "word string, n long")
    assert {r.root for r in spelling.spelling_variants(counts).collect()} == {chain[-1]}
    assert spelling.spelling_variants(counts.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(counts, ratio=1)


def test_word_counts_with_slips(spark):
    rng = random.Random(5)
    words = ["Abcde", "\u00c9t\u00e9s", "na\u00efve", "stra\u00dfe", "x\u00d7y", "\u0141\u00f3d\u017a", "don't", "b\u00c0\u00c0b"]
    rows = [(i % 300 if i % 50 else None, " ".join(rng.choices(words, k=12)) + ",\n1x2") for i in range(400)] + [(1, None), (2, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int").repartition(3)
    want, slips = collections.Counter(), 0
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                w, slips = w[: h % len(w)] + w[h % len(w) + 1 :], slips + 1
            if w:
                want[w] += 1
    assert slips > 10
    got = [(r.word, r.n) for r in spelling.word_counts(docs, edit=spelling.with_slips).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(6)
    words = sorted(small_vocabulary(rng, "ab", 60))
    automaton = spelling.Automaton(words)
    for i, w in enumerate(words):
        state, number = automaton.read(w)
        assert number == i and automaton.final[state]
        for exact in range(len(w) + 1):
            assert {words[x] for x in automaton.near(w, exact)} == {v for v in edits(w, "ab") if v in words and v[:exact] == w[:exact]}
    # as many states as there are different sets of endings
    endings = {w[:i]: frozenset(v[i:] for v in words if v.startswith(w[:i])) for w in words for i in range(len(w) + 1)}
    assert len(automaton.final) == len(set(endings.values()))
