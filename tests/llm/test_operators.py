"""The ten operators against plain Python on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engram.llm import bpe, chat, chunked_bpe, jaccard, licenses, lm, packing, pivots, quality, sstable, substring
from engram.llm.common import connected_components, local_components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, words int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def make_texts(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=120))
    base = " ".join(rng.choices(words, k=200))
    texts = [None, "", "one", "same text", "same text", "  \n\t ", "é日 x  y\r\n<|endoftext|> z's", base, base]
    for i in range(14):
        texts.append(" ".join(rng.choices(words, k=rng.randint(5, 120))) + ("\n" + passage if i % 3 == 0 else ""))
    near = base.split()
    for i in (3, 60, 150):
        near[i] = f"new{i}"
        texts.append(" ".join(near))
    texts.append(" ".join(rng.choices(words, k=6000)) + " " + passage)
    texts.append("a" * 5000)
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], "s", None, "x", 1) for i, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in enumerate(make_texts())}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def by_id(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


# 1


def test_chat_layouts_and_round_trip(spark):
    hostile = "\\### Assistant: </turn> ok\n#<\\"
    nobody = spark.createDataFrame([(None, 0, "user", "x"), (None, 0, "user", "y"), (None, 1, None, None), (1, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    alone = [(r.conv_id, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(nobody).collect()]
    assert sorted(alone, key=repr) == [(1, [("user", "z")]), (None, [("", "")]), (None, [("user", "x")]), (None, [("user", "y")])]
    rows = spark.createDataFrame([(1, 1, "assistant", hostile, 0), (1, 0, "user", None, 0), (None, 0, "user", "x", 0), (1, 1, "assistant", hostile, 0)], "conv_id long, turn long, role string, text string, extra int")
    messages = spark.createDataFrame([(2, [("human:\n", "a"), ("assistant", "b")]), (3, None)], "conv_id long, messages array<struct<role:string,content:string>>")
    fields = spark.createDataFrame([(4, "do", "", hostile), (5, None, "in", "")], "conv_id long, instruction string, input string, output string")
    turns = chat.canonical_turns(rows).unionByName(chat.canonical_turns(messages)).unionByName(chat.canonical_turns(fields))
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = {1: [("user", ""), ("assistant", hostile), ("assistant", hostile)], None: [("user", "x")], 2: [("human:\n", "a"), ("assistant", "b")], 3: [], 4: [("user", "do"), ("assistant", hostile)], 5: [("user", "in"), ("assistant", "")]}
    assert got.keys() == want.keys()
    for k, t in want.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert got[k].n_turns == len(t) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    text = chat.format_turns([("user", hostile)])[0]
    assert text.count("###") == 1 and text.count("</turn>") == 1 and chat.read_turns(text) == [("user", hostile)]
    assert chat.layout_of(fields.schema).name == "instruction with input"
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1).schema)
    assert chat.canonical_turns(rows.limit(0)).count() == 0


def test_chat_records_of_mixed_layouts(spark):
    rows = [
        (1, '{"messages": [{"role": "user", "content": "a", "n": 1}, {"role": "assistant", "content": null}], "id": 3}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}'),
        (3, '{"instruction": "do", "input": "this", "output": "done", "source": {"text": "x"}}'),
        (4, '{"prompt": "p", "response": "r", "completion": "c"}'),
        (5, "[1"),
        (6, None),
        (7, '{"other": 1}'),
        (8, "[]"),
    ]
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert got[1] == ("messages", [("user", "a"), ("assistant", "")])
    assert got[2] == ("conversations", [("user", "q"), ("assistant", "r")])
    assert got[3] == ("instruction with input", [("user", "do\n\nthis"), ("assistant", "done")])
    assert got[4][0] in ("prompt and completion", "prompt and response")
    assert all(got[i] == (None, None) for i in (5, 6, 7, 8))
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.canonical_records(spark.createDataFrame(rows, "conv_id long, record string")))).collect()}
    assert back[2].n_turns == 2 and all(back[i].n_turns is None and back[i].turns_sha256 is None for i in (5, 6, 7, 8))
    holes = spark.createDataFrame([(1, [("user", "a"), None, (None, None)]), (2, None)], "conv_id long, messages array<struct<role:string,content:string>>")
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical_turns(holes).collect()} == {1: [("user", "a"), ("", "")], 2: []}
    assert chat.read_back(chat.format_conversations(chat.canonical_turns(holes.limit(0)))).count() == 0


# 2


def removed_by_force(texts, length):
    first, out = {}, {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first.setdefault(tuple(w[k : k + length]), i) < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize(("length", "seed", "most"), [(50, 12, 20_000), (7, 3, 20_000), (7, 3, 1)])
def test_substring_dedup(docs, texts, length, seed, most, monkeypatch):
    monkeypatch.setattr(substring, "MOST_KINDS", most)  # 1: anchors with several segments go window by window
    got = by_id(substring.remove_repeats(docs, length, seed))
    want = removed_by_force(texts, length)
    assert {i: (r.n_words, r.n_removed, r.kept_words) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 100
    assert got[0].lang == "en" and got[0].n_words == 0


def test_substring_dedup_random_small_alphabet(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choices("ab", k=rng.randint(0, 60))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(substring.remove_repeats(df, 9, 3))
    assert {i: (r.n_words, r.n_removed, r.kept_words) for i, r in got.items()} == removed_by_force(texts, 9)


def test_substring_dedup_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"z{i}" for i in range(70))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + " z"), (2, other), (2, "x " + long + " y"), (3, other), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect())
    assert got == [(-1, 0, 0), (-1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 61, 60), (2, 62, 60), (2, 70, 0), (3, 70, 70)]
    assert substring.remove_repeats(df.limit(0)).count() == 0
    kept = substring.without_repeats(df.withColumn("n_chars", F.length("text")))
    assert kept.columns == ["doc_id", "text", "n_chars"] and {r.text for r in kept.where("doc_id = 2").collect()} == {"z", other, "x y"}


def test_substring_dedup_keeps_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    names = ["grp", "n_words", "kept_words", "n_removed", "key", "row", "start", "anchor", "doc"]
    df = spark.createDataFrame([(1, long), (2, long), (3, None)], "doc_id long, text string").select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    kept = {r.doc_id: r for r in substring.without_repeats(df).collect()}
    assert all(kept[i][n] == f"{n}{i}" for i in kept for n in names) and (kept[1].text, kept[2].text, kept[3].text) == (long, "", None)
    assert substring.remove_repeats(df).where("doc_id = 2").first().grp == "grp2"
    # a third of all rows under no identifier, and many rows of one
    many = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit(long + " "), F.col("id").cast("string")).alias("text"))
    got = substring.remove_repeats(many).groupBy("n_removed").count().collect()
    assert {r.n_removed: r["count"] for r in got} == {0: 100 + 1, 60: 100 + 99}


# 3, 8, 10


def test_sstables(spark, docs, texts, library, tmp_path):
    extra = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    shards = sstable.write_sstables(extra, VOCABULARY, f"file://{tmp_path}/sst", end_id=2, shard_bytes=8000)
    rows = sstable.read_sstables(shards).orderBy("start").collect()
    ids = [library.encode(t, add_special_tokens=False).ids + [2] for t in [texts[3], *texts.values()]]
    assert [r.doc_id for r in rows] == [None, *texts]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == ids
    assert [r.start for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    readers = [sstable.Reader(r.path) for r in shards.collect()]
    assert len(readers) > 1
    for i, want in zip([None, *texts], ids, strict=True):
        assert [x.tolist() for r in readers for x in r.lookup(i)] == [want]
    assert not [x for r in readers for x in r.lookup(10**9)]
    wanted = [None, 3, 7, 10**9, 3]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in sstable.lookup_documents(shards, wanted).collect()}
    assert got == {i: x for i, x in zip([None, *texts], ids, strict=True) if i in wanted}
    # one identifier, and none, under very many rows: several shards, in order
    many = spark.range(900).select(F.when(F.col("id") % 2 == 0, 5).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    crowded = sstable.write_sstables(many, VOCABULARY, f"file://{tmp_path}/many", shard_bytes=2000)
    assert crowded.where("first is null").count() > 2 and crowded.where("first = 5").count() > 2
    assert sstable.lookup_documents(crowded, [5]).count() == sstable.lookup_documents(crowded, [None]).count() == 450
    assert [r.doc_id for r in sstable.read_sstables(crowded).orderBy("start").collect()] == [None] * 450 + [5] * 450
    assert sstable.read_sstables(sstable.write_sstables(docs.limit(0), VOCABULARY)).count() == 0


def test_sstable_blocks_and_damage(tmp_path):
    path = tmp_path / "x.sst"
    with path.open("wb") as out:
        w = sstable.Writer(out, 2)
        for i in range(-500, 5000):
            w.add(i // 2, np.arange(i % 90, dtype=np.uint32))
        w.close()
    r = sstable.Reader(f"file://{path}")
    assert len(r.index) > 3 and [len(x) for x in r.lookup(7)] == [14, 15]
    assert [k for k, _ in r.scan()] == [i // 2 for i in range(-500, 5000)]
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        list(sstable.Reader(f"file://{path}").scan())


def test_packing(docs, texts, library):
    pieces = packing.pack_documents(docs, VOCABULARY, length=64, end_id=0)
    rows = pieces.collect()
    ids = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    for i, want in ids.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == want and {r.doc_tokens for r in own} == {len(want)}
    fill = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += len(r.ids) // 4
    assert all(n == 64 for s, n in fill.items() if s != max(fill)) and sorted(fill) == list(range(len(fill)))
    assert packing.sequences(pieces).count() == len(fill)
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_chunked_bpe(docs, texts, library):
    got = by_id(chunked_bpe.encode_chunked(docs, VOCABULARY))
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].text == library.decode(ids, skip_special_tokens=False)
    assert chunked_bpe.encode_chunked(docs.limit(0), VOCABULARY).count() == 0


def test_encoders_on_hostile_texts(library, monkeypatch):
    rng = random.Random(2)
    atoms = [" ", "  ", "\n", "a", "b", "'s", "'", "<|endoftext|>", "\x1c", "\u3000", "9", ".", "é", "日", "\t", "\r", "\n\n", " \n", "word", " the", "\u00a0", "\u0301", "'re", "'l", "l", "²", "\x00"]
    texts = ["".join(rng.choices(atoms, k=rng.randint(0, 200))) for _ in range(1500)]
    texts += ["".join(rng.choices(atoms[:7] + atoms[10:13] + atoms[14:20] + atoms[22:], k=rng.randint(0, 200))) for _ in range(1500)]
    texts += [a + b for a, b in zip(texts[:300], texts[300:600], strict=True)]
    texts += ["supercalifragilistic" * 9, "".join(texts[:40]), "x" * 700 + " 's" * 300]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    small = bpe.WordBpe(VOCABULARY, limit=200)
    assert [x for i in range(0, len(texts), 50) for x in small.encode_batch(texts[i : i + 50])] == want
    monkeypatch.setattr(bpe, "STEP_BYTES", 300)  # texts cut at safe blanks
    assert bpe.WordBpe(VOCABULARY).encode_batch(texts) == want
    monkeypatch.undo()
    assert chunked_bpe.encode_texts(texts, {}, VOCABULARY) == want
    monkeypatch.setattr(chunked_bpe, "CUT_BITS", 2)  # many joins
    monkeypatch.setattr(chunked_bpe, "LEAST", 32)
    assert chunked_bpe.encode_texts(texts, {}, VOCABULARY) == want
    ids = np.frombuffer(b"".join(want), "<u4")
    assert bpe.decode_flat(ids, np.array([len(w) // 4 for w in want]), VOCABULARY) == [library.decode(np.frombuffer(w, "<u4").tolist(), skip_special_tokens=False) for w in want]


def test_joins_of_chunks_are_repaired(library, monkeypatch):
    # chunks encoded apart give other ids than the whole text; windows around the joins mend them
    monkeypatch.setattr(chunked_bpe, "CUT_BITS", 3)
    text = " ".join(f"word{i} isn't" for i in range(3000))
    data, offsets, ends, _ = chunked_bpe.chunks_of(chunked_bpe.cut_table(pa.table({"doc_id": [1], "text": [text]})))
    begins = np.r_[0, ends[:-1]]
    whole = library.encode(text, add_special_tokens=False).ids
    raw = text.encode()
    apart = [i for a, b in zip(begins, ends, strict=True) for i in library.encode(raw[a:b].decode(), add_special_tokens=False).ids]
    assert len(ends) > 100 and apart != whole
    starts, until, _ = chunked_bpe.repair(data, begins, ends, begins == 0, VOCABULARY)
    assert all(any(s < b < u for s, u in zip(starts, until, strict=True)) for b in begins[1:]) and (until[:-1] <= starts[1:]).all()
    assert (until - starts).sum() < len(raw)


def test_given_chunks_are_used(library):
    text = " ".join(f"word{i}" for i in range(300))
    data, _, ends, names = chunked_bpe.chunks_of(chunked_bpe.cut_table(pa.table({"doc_id": [1], "text": [text]})))
    part = data[ends[0] : ends[1]].tobytes().decode()
    ids = np.array(library.encode(part, add_special_tokens=False).ids, "<u4")
    ids[len(ids) // 2] = library.encode("#").ids[0] if len(library.decode([int(ids[len(ids) // 2])])) == 1 else ids[len(ids) // 2]
    got = chunked_bpe.encode_texts([text], {names[1]: ids.tobytes()}, VOCABULARY)[0]
    middle = ids[len(ids) // 3 : 2 * len(ids) // 3].tobytes()
    assert middle in got


# 4


def statistics_by_force(t):
    w = WORD.findall(t)
    counts = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if counts[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_statistics(spark):
    texts = [*make_texts(), "a b c d e f g h " * 5 + "\nx\nx\n \n\nx y\x0bz\x0c #|<", "p q r s t u v w x p q r s t u v w x y z " * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    got = by_id(quality.quality(df))
    for i, t in enumerate(texts):
        want = statistics_by_force(t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality.quality(df.limit(0)).count() == 0


def quantile_by_force(v, share):
    return np.exp((np.floor(np.log(np.sort(v)[math.ceil(len(v) * share) - 1] + quality.FLOOR) * quality.BINS) + 1) / quality.BINS) - quality.FLOOR


def mcd_by_force(x, floors):
    """(n, centre, covariance) of one group: three starts, steps until nothing changes, the least determinant."""
    p = x.shape[1]
    centre = np.array([quantile_by_force(x[:, i], 0.5) for i in range(p)])
    scale = np.maximum([1.4826 * quantile_by_force(abs(x[:, i] - centre[i]), 0.5) for i in range(p)], floors)
    z = (x - centre) / scale
    factor = quality.SUBSET / quality.gamma_p(p / 2 + 1, quality.chi_square_quantile(quality.SUBSET, p) / 2)
    best = None
    for y in (None, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), quality.FLOOR), np.tanh(z)):
        r = np.eye(p)
        if y is not None:
            s = y.T @ y / len(y)
            both = np.sqrt(np.outer(np.diag(s), np.diag(s)))
            r = np.where(np.eye(p) > 0, 1, np.where(both > 0, 0.9 * s / np.where(both > 0, both, 1), 0))
        m, c = centre, r * np.outer(scale, scale)
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[d <= quantile_by_force(d, quality.SUBSET)]
            m, c = near.mean(0), factor * np.cov(near.T, bias=True) + np.diag(np.square(floors))
        det = round(np.linalg.slogdet(c)[1], 6)
        if best is None or det < best[0]:
            best = det, m, c
    return len(x), best[1], best[2]


def mixed_by_force(estimates):
    """Of (n, centre, covariance) from the group's to all documents': each shrunk towards the next."""
    _, m, c = estimates[-1]
    for n, own_m, own_c in estimates[-2::-1]:
        w = n / (n + quality.HALF_WEIGHT)
        m, c = w * own_m + (1 - w) * m, w * own_c + (1 - w) * c
    return m, c


def test_quality_distances(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(int(rng.lognormvariate(4, 0.5)) + 25)]
        if i % 12 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s"))
    got = by_id(quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert {i for i, r in got.items() if not r.kept} == set(range(0, 240, 12))
    x = {}
    for i in got:
        n, chars, symbols, dup, rep = statistics_by_force(rows[i][1])
        x[i] = [math.log1p(n), math.log1p(chars / n), math.sqrt(symbols / n), math.sqrt(dup), math.sqrt(rep / n)]
    floors = np.array([f for _, f in quality.FEATURES])
    every = mcd_by_force(np.array(list(x.values())), floors)
    for lang in (0, 1):
        own = [i for i in got if i % 2 == lang]
        one = mcd_by_force(np.array([x[i] for i in own]), floors)
        m, c = mixed_by_force([one, one, every])  # one source, so the language's estimate is the group's
        gap = np.array([x[i] for i in own]) - m
        assert np.allclose([got[i].distance for i in own], np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap)), rtol=1e-6)


def test_quality_starts_reach_the_least_determinant(spark):
    # two thirds clean in a narrow band, one third junk far off: the estimates are of the clean ones
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" + ("#" if i % 5 == 0 else "") for _ in range(60 + rng.randint(0, 9))), "en", "s") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    vectors = quality.with_vector(quality.with_statistics(df))
    model = quality.fit(vectors)
    assert model.count() == 3 and abs(model.where("_level = 0").first().m2) < 1e-9
    assert {r.doc_id for r in quality.quality(df).where("not kept").collect()} == set(range(0, 150, 5))


def test_quality_judges_small_groups(spark):
    # 6 documents a source; source "none" has junk alone
    rng = random.Random(8)
    rows, junk = [], set()
    for i in range(270):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(int(rng.lognormvariate(4, 0.5)) + 25)]
        if i % 15 == 0:
            words = [w + "###" for w in words]
            junk.add(i)
        rows.append((i, " ".join(words), "fr" if i >= 240 else "en" if i % 2 else None, "none" if i == 30 else f"s{i // 12 if i < 240 else i // 6}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = by_id(quality.quality(df))
    assert len(got) == len(rows) and {i for i, r in got.items() if not r.kept} == junk
    # a table of few documents as a whole
    few = by_id(quality.quality(df.where("doc_id >= 240")))
    assert {i for i, r in few.items() if not r.kept} == {i for i in junk if i >= 240}


def test_quality_keeps_rows_by_their_own_verdict(spark):
    rng = random.Random(9)
    rows = []
    for i in range(80):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(int(rng.lognormvariate(4, 0.5)) + 25)]
        rows.append((None if i % 2 else i, " ".join(w + "###" for w in words) if i < 4 else "too few words" if i < 8 else " ".join(words), "en", "s", i))
    rows.append((0, rows[20][1], "en", "s", 80))  # a clean row under a rejected row's identifier
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.n_words for r in kept.collect()} == set(range(8, 81))


def test_quality_is_native(spark, docs):
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString() + quality.with_statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_duplicate_lines_alone_can_reject():
    # two thirds of the lines are duplicates, in a group in which no other document has any
    assert 2 / 3 / dict(quality.FEATURES)["dup_line_share"] ** 2 > quality.CUT


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3


# 5


def test_license_scan(spark):
    texts = ["under the MIT license, or Apache-License and apache license 2.0", "GNU General Public License GNU general public License v3", "CC BY-SA 4.0", "mitt licenses", None, "", "SPDX-License-Identifier: Apache-2.0; Permission is hereby granted, free of charge, to any person obtaining a copy", "mit license " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("x"))
    got = by_id(licenses.scan_licenses(df))
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (12, 3, 2, 8, "apache,mit")
    assert got[1].n_base == 2 and got[1].labels == "gpl" and got[1].last_word == 4
    assert got[2].base_labels == "cc-by" and got[2].labels == "cc-by,cc-by-sa"
    assert got[3].n_base == 0 and got[3].labels == "" and got[3].score == 0 and got[3].first_word is None
    assert got[4].n_words == got[5].n_words == 0 and "mit" in got[6].labels and got[7].n_base == 3000
    assert all(0 <= r.score <= 1 for r in got.values()) and len(licenses.make_rules()) > 300
    assert scan_empty(df) == 0


def firing(pattern):
    """Texts that a pattern over words matches: one for each choice of an alternative or of an optional part."""
    from re import _parser

    def spell(parts):
        out = [""]
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                some = [chr(arg)]
            elif name == "IN":
                some = [chr(c) for _, c in arg]
            elif name == "ANY":
                some = ["x"]
            elif name == "CATEGORY" or name == "ASSERT":
                some = [""]
            elif name == "BRANCH":
                some = [t for branch in arg[1] for t in spell(branch)]
            elif name == "SUBPATTERN":
                some = spell(arg[3])
            else:
                assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
                some = [t * k for k in sorted({arg[0], max(1, arg[0])}) for t in spell(arg[2])]
            out = [a + b for a in out for b in some]
        return out

    return spell(_parser.parse(pattern.replace(r"\d", "7")))


def test_license_rules_all_fire():
    rules = licenses.make_rules()
    for rule in rules:
        texts = firing(rule.pattern.pattern)
        assert texts
        for text in texts:
            assert rule.pattern.search(f" {text} ") and f" {rule.keyword}" in f" {text}", (rule, text)


def test_license_identifiers():
    scan = licenses.Scanner().scan
    for label, names in licenses.SPDX.items():
        for name in names.split():
            *_, labels, score = scan(f"// SPDX-License-Identifier: {name}\n".encode())
            assert label in labels and score > 0, name
    assert scan(b"SPDX-License-Identifier: GPL-2.0-or-later")[5] == ["gpl"]
    assert scan(b"under the PSF License")[5] == ["python"]
    assert "boost" in scan(b"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation")[5]


def scan_empty(df):
    return licenses.scan_licenses(df.limit(0)).count()


def rules_of(*priorities):
    return [licenses.Rule("x", "x", re.compile("x"), p, 0.5) for p in priorities]


def test_license_settling():
    same = rules_of(*[5] * 10)
    assert licenses.settle([(0, 5, 3), (0, 5, 1), (1, 4, 0), (4, 9, 2), (20, 22, 9)], same) == [(0, 5, 1), (20, 22, 9)]
    # a chain: the middle one loses to the right one and so takes nothing from the left one
    assert licenses.settle([(0, 10, 2), (8, 20, 1), (18, 30, 0)], rules_of(9, 8, 7)) == [(0, 10, 2), (18, 30, 0)]
    # a higher priority wins over the longer match around it
    assert licenses.settle([(0, 30, 1), (8, 20, 0)], rules_of(9, 8)) == [(8, 20, 0)]


def scan_by_force(scanner, text):
    """Base columns and labels without gate and without sorting: every rule on every text, settling by definition."""
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line = f" {' '.join(words)} ".encode().decode("latin-1")
    found = [(m.start(), m.end(), i) for i, rule in enumerate(scanner.rules) for m in rule.pattern.finditer(line)]
    kept = []
    for priority in sorted({r.priority for r in scanner.rules}, reverse=True):
        level = [m for m in found if scanner.rules[m[2]].priority == priority and not any(m[0] < k[1] and k[0] < m[1] for k in kept)]
        level = [m for m in level if not any(o != m and o[0] <= m[0] and m[1] <= o[1] and ((o[0], o[1]) != (m[0], m[1]) or o[2] < m[2]) for o in level)]
        end = -1
        for m in sorted(level):
            if m[0] >= end:
                kept.append(m)
                end = m[1]
    labels = {label for _, label in places} | {scanner.rules[i].label for *_, i in kept}
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


def test_license_scan_by_force(spark):
    rng = random.Random(4)
    scanner = licenses.Scanner()
    spelled = [t for r in scanner.rules for t in firing(r.pattern.pattern)[:2]]
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for i in range(150):  # rules' words run into one another, cut and joined at random
        words = " ".join(rng.choice(spelled) for _ in range(rng.randint(1, 8))).split()
        docs[10_000 + i] = "\n".join(w.title() if rng.random() < 0.3 else w + rng.choice([" ", ", ", "-", ""]) for w in words if rng.random() < 0.97)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = by_id(licenses.scan_licenses(df))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    for i, t in docs.items():
        assert tuple(got[i][n] for n in names) == scan_by_force(scanner, t or ""), i
    assert sum(bool(r.labels) for r in got.values()) > 100


def test_license_rules_are_hand_written():
    written = licenses.hand_written()
    assert len(written) > 200 and len({p for *_, p in written}) > 200 and {k for _, k, _, _ in written} < set(licenses.KINDS)
    scan = licenses.Scanner().scan
    expected = {
        "Copyright 2020 X. All rights reserved.": [],
        "asl is a sign language": [],
        "Redistribution and use in source and binary forms, with or without modification, are permitted. All rights reserved.": ["bsd"],
        "Released under GPLv3 or Apache-2.0": ["apache", "gpl"],
        "BSD 3-Clause License": ["bsd"],
        "Creative Commons Attribution 4.0 International": ["cc-by"],
        "SPDX-License-Identifier: MIT": ["mit"],
        "https://www.apache.org/licenses/LICENSE-2.0": ["apache"],
        "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential": ["proprietary"],
    }
    for text, labels in expected.items():
        assert scan(text.encode())[5] == labels, text


# 6


def cosine_by_force(rows, threshold):
    links = collections.defaultdict(set)
    fit = [(n, i, label, np.array(v, float)) for n, (i, v, label) in enumerate(rows) if label is not None and i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for a, _, la, va in fit:
        for b, _, lb, vb in fit:
            if a < b and la == lb and len(va) == len(vb) and va @ vb / math.sqrt(va @ va) / math.sqrt(vb @ vb) >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def test_pivot_index(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    rows = []
    for i in range(900):
        v = base[i % 300] + rng.normal(size=16) * 0.06 * (i // 300) if i < 800 else base[0]
        rows.append((i, [float(x) for x in v], [1, 1, 2, None][i % 4] if i < 800 else 1))
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [], 1), (None, rows[0][1], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [float("inf")] * 16, 1), (2008, [1e300] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("size", F.lit(3))
    got = {r.vec_id: r for r in pivots.near_duplicates(df, 0.98).collect()}
    links = cosine_by_force(rows, 0.98)
    want = sum(map(len, links.values()))
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and want > 10_000 and 0.9 * want <= found <= want
    assert all(got[rows[n][0]].n_links <= len(x) for n, x in links.items())
    assert got[2005].n_links == 1 and got[2006].component_id == 2005 and not got[2006].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2007))
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_pivot_index_of_repeated_ids(spark):
    v, z, u = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1.0, 0.0, 0.1]
    df = spark.createDataFrame([(1, v, 1), (1, z, 1), (2, u, 1), (2, u, 2)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 0, 2), (2, 1, 1)]


def test_pivot_recall(spark):
    """Recall against brute force on the given table, per label."""
    embeddings = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = sum(r.n_links for r in pivots.near_duplicates(embeddings).collect())
    rows = embeddings.collect()
    x, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((x[label == k] @ x[label == k].T >= 0.98).sum()) - int((label == k).sum()) for k in set(label.tolist()))
    assert 0.99 * want <= found <= want


def test_pivots_of_concentrated_vectors(spark):
    """A common component of mean cosine 0.9: recall of 0.99, and few pairs of all are candidates."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    common = np.random.default_rng(2).normal(size=x.shape[1])
    x += 3 * common / np.linalg.norm(common)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert 0.88 < (x @ x.T).mean() < 0.92
    side = np.random.default_rng(6).normal(size=(400, x.shape[1]))
    side -= (side * x[:400]).sum(1, keepdims=True) * x[:400]
    x = np.vstack([x, 0.982 * x[:400] + np.sqrt(1 - 0.982**2) * side / np.linalg.norm(side, axis=1, keepdims=True)])
    df = spark.createDataFrame([(i, [float(v) for v in y], 1) for i, y in enumerate(x)], "vec_id long, embedding array<double>, label long").repartition(3)
    links = (x @ x.T >= 0.98).sum() - len(x)
    assert sum(r.n_links for r in pivots.near_duplicates(df).collect()) >= 0.99 * links > 100
    centre = x.mean(0)
    y = pivots.centred(x, centre)
    chosen = pivots.choose_pivots(y, 180)
    rule = pivots.settle(x, centre, chosen, 0.98, pivots.Rule(pivots.NEAREST, pivots.SHARED, pivots.APART_RANKS))
    near = pivots.nearest_pivots(y, chosen, rule.nearest)
    met = sum(pivots.candidates(near[some], p, *rule).sum() for p in range(len(chosen)) if len(some := np.flatnonzero((near == p).any(1))))
    assert len(chosen) == 180 and met < 0.05 * len(x) ** 2


def test_pivots_fall_back_to_nearer_ones():
    crowd = np.random.default_rng(3).normal(size=(200, 8)) * 0.15 + np.eye(8)[0]
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    assert len(pivots.choose_pivots(crowd, 20)) == 20 and len(pivots.choose_pivots(np.ones((50, 4)) / 2, 20)) == 1
    x = np.random.default_rng(4).normal(size=(50, 8))
    assert (pivots.nearest_pivots(x, crowd[:30], 5) == np.argsort(-(x @ crowd[:30].T), axis=1, kind="stable")[:, :5]).all()


def test_pivot_lists_in_blocks_and_mixed_lengths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 12))
    x = [*base, *(base[:30] + 0.01 * rng.normal(size=(30, 12))), *(rng.normal(size=(1, 5)) + 0.01 * rng.normal(size=(6, 5))), rng.normal(size=3)]
    df = spark.createDataFrame([(i, [float(a) for a in v], 7) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label long").repartition(3)
    unit = [v / np.linalg.norm(v) for v in x]
    want = {i: sum(i != j and len(x[j]) == len(v) and unit[j] @ unit[i] >= 0.98 for j in range(len(x))) for i, v in enumerate(x)}
    assert {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()} == want
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 4)
    assert {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()} == want


def test_candidates_count_shared_pivots():
    near = np.array([[1, 2, 3, 4], [2, 1, 4, 3], [1, 9, 8, 7], [0, 1, 2, 3], [1, -1, -1, -1]])
    ok = pivots.candidates(near, 1, 4, 3, 6)
    assert ok[0, 1] and not ok[0, 2] and not ok[0, 0] and (ok == ok.T).all()
    assert not pivots.candidates(near, 2, 4, 3, 6)[0, 1]  # the list of pivot 1 owns the pair
    assert ok[0, 3] == (4 + 3 + 1 <= 6)  # ranks: 1 to 4 of the first, 0 to 3 of the last


# 7


def jaccard_by_force(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {i: {j for j in sets if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    return sets, links


def reach(links, i):
    seen, stack = {i}, [i]
    while stack:
        for j in links[stack.pop()] - seen:
            seen.add(j)
            stack.append(j)
    return min(seen)


def test_jaccard_join(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 4)  # groups in several blocks
    rng = random.Random(8)
    long = [f"v{i}" for i in range(150)]
    more = dict(texts)
    for i in range(100, 130):
        w = list(long)
        w[rng.randint(0, 149)] = f"y{i}"
        more[i] = " ".join(w)
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string").withColumn("keys", F.lit(1))
    got = by_id(jaccard.near_duplicates(df))
    sets, links = jaccard_by_force(more)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), reach(links, i), reach(links, i) == i)
        assert r.class_id == min([j for j in sets if sets[j] == sets[i] and sets[i]], default=i)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {7, 8} & {r.doc_id for r in kept.collect()} == {7}
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_links) for r in jaccard.near_duplicates(odd).collect()) == [(-1, 0), (1, 1), (1, 1), (2, 0)]


def test_jaccard_join_of_repeated_ids(spark):
    a = " ".join(f"w{i}" for i in range(100))
    b, other = a + " more", " ".join(f"z{i}" for i in range(80))
    df = spark.createDataFrame([(5, a), (5, a), (6, b), (5, other), (9, other + " x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5), (9, 1, 5)]


def test_jaccard_prefixes_are_shortened(spark, monkeypatch):
    """Pairs at the threshold need short prefixes; classes that have close links only are settled before."""
    rng = random.Random(3)
    rows, n = [], 0
    for g in range(60):
        base = [f"w{g}x{i}" for i in range(104)]
        rows.append((n, " ".join(base)))
        for k in range(3):
            w = list(base)
            for i in rng.sample(range(104), 2 if g % 2 else 1):
                w[i] = f"y{n}x{i}"
            rows.append((n + 1 + k, " ".join(w)))
        n += 4
    seen = []
    monkeypatch.setattr(jaccard, "materialize", lambda df, name, f=jaccard.materialize: (lambda out: (seen.append((name, out.count())) if name == "stars" else None, out)[1])(f(df, name)))
    got = by_id(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    sets, links = jaccard_by_force(dict(rows))
    assert all(got[i].n_links == len(links[i]) and got[i].component_id == reach(links, i) for i in sets)
    # half the groups have links at 0.8 to 0.9, which whole prefixes miss at times; the others are settled at once, so the
    # stars of the shortest prefixes, which are wider, hold fewer classes
    sizes = [n for _, n in seen]
    assert len(sizes) == jaccard.LEVELS - jaccard.least_depth() + 1 and sizes[-1] < sizes[0]


def test_prefix_reaches_recall():
    d = jaccard.least_depth()
    assert jaccard.chance(0.8, d) >= jaccard.RECALL > jaccard.chance(0.8, d + 1)


def test_intersections():
    rng = np.random.default_rng(1)
    owner = np.repeat(np.arange(60), 40)
    hashes = rng.integers(0, 90, len(owner)).astype(np.uint64)
    keep = np.unique(np.stack([owner, hashes.astype(int)], 1), axis=0)
    got = jaccard.intersections(keep[:, 1].astype(np.uint64), keep[:, 0], 60)
    sets = [set(keep[keep[:, 0] == i, 1]) for i in range(60)]
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(60) for j in range(60) if i != j)


# 9


def test_stupid_backoff(docs, texts):
    got = by_id(lm.stupid_backoff(docs))
    words = {i: t.encode().split() for i, t in texts.items()}
    grams = {i: collections.Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)) for i, w in words.items()}
    total, n_all = sum(grams.values(), collections.Counter()), sum(map(len, words.values()))
    for i, w in words.items():
        score = 0.0
        for k in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[k - n + 1 : k + 1]) if k >= n - 1 else None
                if g and total[g] > grams[i][g]:
                    below = total[g[:-1]] - grams[i][g[:-1]] if n > 1 else n_all - len(w)
                    score += math.log((total[g] - grams[i][g]) / below) + (3 - n) * math.log(0.4)
                    break
            else:
                score += math.log(1 / (n_all - len(w) + 1)) + 2 * math.log(0.4)
        assert got[i].n_words == len(w) and abs(got[i].log_score - score) <= 1e-9 * max(1, abs(score))
        assert (got[i].mean_log_score is None) == (not w)
    assert lm.stupid_backoff(docs.limit(0)).count() == 0


# shared


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    assert got == {i: reach(links, i) for i in links}
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    root = local_components(241, a, b)
    assert all(root[i] == c for i, c in got.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crc_of_ids_is_unsigned(spark):
    data = np.array([1, 50256], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(data)
