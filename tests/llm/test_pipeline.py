"""The pipeline's stages on the smallest tables, and its guard in the driver contract."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from engram.llm import oracles

DIR = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, DIR), name)
        assert at.columns == docs.columns
    left = {r.doc_id: r for r in at.collect()}
    assert set(left) < set(before) and all(r.n_chars == len(r.text) for r in left.values())
    pieces = corpus_pipeline.packing(spark, at, DIR).collect()
    assert {p.doc_id for p in pieces} == set(left)
    assert corpus_pipeline.STAGES[-1][0] == "packing"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_stages_take_clashing_columns(spark):
    """Extra columns, named like those that operators add, go through every stage with their values."""
    names = ["grp", "n_words", "kept_words", "key", "labels", "cid", "kept", "x0", "_lang", "distance", "size", "th"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, DIR), name)
        assert at.columns == docs.columns
    rows = at.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smallest documents with near copies, copies and shared passages of longer ones."""
    rows = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    rng, long = random.Random(1), [r for r in rows if len(WORD.findall(r.text)) > 150]
    extra = []
    for i, r in enumerate(long[:12]):
        words = WORD.findall(r.text)
        for at in rng.sample(range(len(words)), 1 + len(words) // 400):
            words[at] = f"changed{at}"
        other = WORD.findall(long[-1 - i].text)[:100]
        at = rng.randrange(len(words) - 90)
        extra += [" ".join(words), r.text, " ".join([*other, *words[at : at + 80], *other[::-1]])]
    made = [(10_000 + i, t, rows[0].lang, rows[0].source, len(t)) for i, t in enumerate(extra)]
    docs = spark.createDataFrame([tuple(r) for r in rows] + made, spark.read.parquet(f"{DIR}/documents.parquet").schema).repartition(3)
    path = str(tmp_path_factory.mktemp("planted") / "documents.parquet")
    docs.write.parquet(f"file://{path}")
    return spark.read.parquet(f"file://{path}"), path


def stage(spark, name, docs):
    return corpus_pipeline.materialize(dict(corpus_pipeline.STAGES)[name](spark, docs, DIR), name)


def test_quality_stage_by_sql(spark, planted):
    docs, path = planted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.quality_sql()}) WHERE kept").fetchall()}
    got = {r.doc_id: r for r in stage(spark, "quality_rules", docs).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert set(got) == kept and 0 < len(kept) < len(before) and all(r == before[i] for i, r in got.items())


def test_near_duplicate_stage_by_brute_force(spark, planted):
    docs, _ = planted
    rows = {r.doc_id: r for r in docs.collect()}
    sets = {}
    for i, r in rows.items():
        w = WORD.findall(r.text or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 10 * (both := len(sets[a] & sets[b])) >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: r for r in stage(spark, "near_duplicates", docs).collect()}
    assert set(got) == {i for i in ids if top(i) == i} and len(got) <= len(ids) - 24 and all(r == rows[i] for i, r in got.items())


def test_repeated_passage_stage_by_brute_force(spark, planted):
    docs, _ = planted
    rows = {r.doc_id: r for r in docs.collect()}
    words = {i: WORD.findall(r.text or "") for i, r in rows.items()}
    first = {}
    for i in sorted(rows):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    lost = 0
    got = {r.doc_id: r for r in stage(spark, "repeated_passages", docs).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        w, gone = words[i], set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r.text
        lost += len(gone)
        assert (got[i].text, got[i].n_chars, got[i].lang, got[i].source) == (text, len(text) if gone else r.n_chars, r.lang, r.source)
    assert lost > 2000


def test_packing_stage_by_the_library(spark, planted):
    docs, _ = planted
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    pieces, room = collections.defaultdict(list), collections.defaultdict(list)
    for r in stage(spark, "packing", docs).collect():
        pieces[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert set(pieces) == {r.doc_id for r in rows}
    for r in rows:
        ids, at = [*library.encode(r.text, add_special_tokens=False).ids, 0], 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            some = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.start == at and len(some) == p.length and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(some.tobytes())
            at += p.length
        assert at == len(ids)
    full = sorted(room)
    for s in full:
        at = 0
        for offset, length in sorted(room[s]):
            assert offset == at
            at += length
        assert at == 1024 or s == full[-1]


def test_run_is_its_stages(spark, planted):
    docs, path = planted
    at = docs
    for name, _ in corpus_pipeline.STAGES:
        at = stage(spark, name, at)
    whole = corpus_pipeline.run(spark, path.rsplit("/", 1)[0])
    count = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect())
    assert count(at) == count(whole) and whole.columns == at.columns
