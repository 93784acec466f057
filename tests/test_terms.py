"""The text index: what patterns need, and deletions that look at candidates alone."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_store import engine_at, many, rows_read

from engram.operators import terms
from engram.operators.terms import NOTHING, need_of, need_of_fragment, need_of_pattern

CASES = [
    r"licen[cs]e|\bthe and\b", "colou?r", "abc", "ab", "a.c", "abcdef", "(abc|xyz)+q", "(abc|x)yz", "x*abcd", "(?:abc){2,}", "abc{2}", r"foo\s+bar", r"foo\bbar", "[^a]bcd", "[a-z]bcd", "(a)bc\\1", "(?=abc)abcd", "(?<!x)abc",
    "abc$", "^abc", r"\d\d\d", "", "a|b", "abc|", "ABC", "stra\u00dfe", "\u017fabc", "k\u00e9bab", r"\.conf", r"1\.2\.3", "(abc)?def", "(ab|cd)(ef|gh)", "abc.*?def", "a{0}bcd", "(x|abc)def",
    "[kK]elvin", "[ab][ab][ab][ab][ab][ab]", r"[[a]b]cd", r"[a&&b]cd", r"\Qa.b\Ecd", "(?i)abc", "(?s:abc)",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["abc", "ABCD", "bcd", "def", "xyz", "q", "foo", "bar", " ", "  ", "license", "Licence", "the and", "colour", "color", "\u017f", "\u212aelvin", "stra\u00dfe", "k\u00e9bab", ".conf", "1.2.3", "ef", "gh", "cd", "a", "b", "c", "\n", "\u0130", "\u0131", "a.b", "123"]
    return [None, ""] + bits + ["".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(600)]


def grams_of(spark, texts):
    from engram.operators.terms import folded

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", F.regexp_extract_all(folded(F.col("text")), F.lit(r"(?=([\x20-\x7e]{3}))"), F.lit(1)).alias("g")).collect()
    return {r.i: set(r.g) for r in got}


def met(need, grams):
    if need.kind == "gram":
        return need.gram in grams
    return (all if need.kind == "all" else any)(met(p, grams) for p in need.parts)


def test_a_match_holds_what_its_pattern_needs(spark, texts):
    from engram.functions.scalars import contains_text, matches

    grams = grams_of(spark, texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    conditions = {f"r{k}": matches(F.col("text"), p) for k, p in enumerate(CASES)} | {f"f{k}": contains_text(F.col("text"), p) for k, p in enumerate(CASES) if p}
    for r in rows.select("i", *[c.alias(n) for n, c in conditions.items()]).collect():
        for k, p in enumerate(CASES):
            assert not r[f"r{k}"] or met(need_of_pattern(p), grams[r.i]), (p, texts[r.i])
            assert not p or not r[f"f{k}"] or met(need_of_fragment(p), grams[r.i]), (p, texts[r.i])


def test_needs():
    assert need_of_pattern("licen[cs]e").grams() == {"lic", "enc", "ens", "nce", "nse"} and need_of_pattern("licen[cs]e").kind == "any"
    for p in ("ab", "a.c", "a|b", "abc|", "", r"\d\d\d", r"[[a]b]cde", r"\Qabc\E", "(", "(?i)abc"):
        assert need_of_pattern(p) == NOTHING
    assert need_of_pattern("colou?r").grams() == {"col", "our", "lor"}
    assert need_of("to", "abc") == NOTHING and need_of("tok", "abc").grams() == {"tok", "abc"}
    assert need_of_pattern("|".join(f"{i:03d}" for i in range(60))) == NOTHING  # too many to look up


def test_deletions_look_at_candidates_alone(spark, tmp_path, texts):
    engine = engine_at(spark, tmp_path)
    rows = [(f"t{i}", None, t, f"s{i % 3}", "", "", "", i, None, None) for i, t in enumerate(texts)]
    some = spark.createDataFrame(rows, engine.points.schema).repartition(4)
    engine.store_.append(some.where("ts_epoch % 5 <> 0"))
    assert engine.texts.build() == 1 and engine.texts.build() == 0
    engine.store_.append(some.where("ts_epoch % 5 = 0"))
    plain = engine_at(spark, tmp_path / "plain")
    plain.store_.append(some)
    for fragment, regex, source in (("token", r"licen[cs]e|\bthe and\b", None), (None, "colou?r", "s1"), ("1.2", None, None), ("ab", None, "s2"), (None, r"abc.*def", None)):
        both = [e.delete_fragment(fragment, regex, source) for e in (engine, plain)]
        assert {r.id for r in both[0].affected.collect()} == {r.id for r in both[1].affected.collect()}
        assert both[0].commit() == both[1].commit() > 0
        assert {r.id for r in engine.points.collect()} == {r.id for r in plain.points.collect()}
    assert engine.texts.build() == 1
    assert engine.delete_text("xyz").count() == plain.delete_text("xyz").count()


def test_files_without_a_candidate_are_not_opened(spark, tmp_path):
    engine = engine_at(spark, tmp_path)
    for i in range(4):
        engine.store_.append(many(spark, 1000).withColumns({"id": F.concat(F.lit(f"{i}"), "id"), "text": F.concat(F.lit("part number seven " if i == 2 else "others "), "text")}))
    engine.texts.build()
    change = engine.delete_fragment("number seven text 77")
    assert rows_read(change.located) <= 1000
    assert change.count() == 11
    assert engine.delete_text("number eight").count() == 0
    assert change.commit() == 11 and engine.points.count() == 3989
    assert engine.delete_text("seven").count() == 989


@pytest.mark.parametrize("piece,most", [(1 << 21, 4_000_000), (7, 5), (64, 200)])
def test_posting_lists_hold_every_trigram(monkeypatch, texts, piece, most):
    """However pieces, lists, batches and files are cut."""
    monkeypatch.setattr(terms, "PIECE_BYTES", piece)
    monkeypatch.setattr(terms, "MOST_PAIRS", most)
    given = ["", "ab", "abc", "zażółć abc", "a\u20acbcd\U0001f600efg", "\x1f~~~ \x7f   ", "", *texts[1:60], "x" * 300, ""]
    rows = [(t, "one" if i < 20 else "two", i + 32_768 * (i % 3) + (1 << 30)) for i, t in enumerate(given)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a:b], strict=True)], ["text", "_file", "_row"]) for a, b in ((0, 9), (9, 40), (40, len(rows)))]
    batches = [batches[0], batches[0].slice(0, 0), batches[1], batches[2].slice(0)]
    found = [(r["gram"], r["file"], row) for b in terms.posting_lists(iter(batches)) for r in b.to_pylist() for row in r["rows"] if row // 32_768 == r["bucket"]]
    wanted = {(t[i : i + 3], file, row) for t, file, row in rows for i in range(len(t) - 2) if all(" " <= c <= "~" for c in t[i : i + 3])}
    assert set(found) == wanted and (most < 4_000_000 or len(found) == len(wanted))
