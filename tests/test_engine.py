"""Operations on a published collection: reads, changes, backups, ingest."""

import pytest
from pyspark.sql import functions as F

from engram.cli import run
from engram.config import Config
from engram.engine import MemoryEngine
from engram.functions import scalars
from engram.functions.embed import hashed
from engram.functions.scrub import redact, scrub
from engram.operators import search
from engram.schema import FACT
from engram.sources import parsers
from engram.sources.registry import Source, ingest_all

NOW = 1_786_000_000


@pytest.fixture
def engine(spark, tmp_path):
    e = MemoryEngine(spark, f"file://{tmp_path}/memory", Config("memory-v2", base_dim=16))
    assert e.setup() and not e.setup()
    return e


def facts(spark, *rows):
    return spark.createDataFrame([(i, text, source, "s", f"/f{i}", "t", date) for i, (text, source, date) in enumerate(rows)], FACT)


def test_store_search_edit(engine):
    a = engine.store("the web server uses port 80 token=abc", "web", now_ts=NOW)
    b = engine.store("backups run at night", "ops", now_ts=NOW)
    hits = engine.search("web server port", now_ts=NOW).collect()
    assert [h.id for h in hits] == [a, b] and hits[0].text.endswith("token=[REDACTED]")
    assert engine.points.where(F.col("id") == a).first().ts_epoch == NOW
    assert len(engine.points.first().vector) == 24
    preview = engine.edit(a)
    assert preview.count() == 0
    change = engine.edit(a, "password: x", now_ts=NOW + 5)
    assert engine.points.where("text like '%port%'").count() == 1  # nothing changes before commit
    assert change.commit() == 1
    row = engine.points.where(F.col("id") == a).first()
    assert row.text == "password: [REDACTED]" and row.ts_epoch == NOW + 5
    with pytest.raises(LookupError):
        engine.edit("none", "x")


def test_payload_and_vector(engine):
    a = engine.store("one", now_ts=NOW)
    engine.edit_payload(a, {"owner": " me ", "section": "x", "ts_epoch": "12a"}).commit()
    engine.edit_payload(a, {"owner": "you", "more": "1"}).commit()
    row = engine.points.first()
    assert row.extra == {"owner": "you", "more": "1"} and row.section == "x" and row.ts_epoch is None
    assert {r.key for r in engine.show(a).collect()} >= {"text", "owner", "id_type", "dim"}
    engine.update_vector(a, now_ts=NOW).commit()
    assert engine.points.first().ts_epoch is None


def test_ingest_modes_and_deletes(engine, spark, tmp_path):
    first = facts(spark, ("a", "x", "2024-01-02"), ("b", "x", None), ("a", "x", "2024-01-03"), ("c", "y", None))
    assert engine.ingest(first) == 3
    assert engine.ingest(first.limit(0)) == 0 and engine.points.count() == 3
    a = engine.points.where("text = 'a'").first()
    assert a.file_path == "/f2" and a.id == str(a.id_num)  # the last of equal facts
    assert a.ts_epoch == 1704240000
    engine.ingest(first, mode="append")
    assert engine.points.count() == 3
    engine.ingest(facts(spark, ("d", "x", None), ("c", "y", None)), mode="append")
    assert engine.points.count() == 4
    engine.ingest(facts(spark, ("z", "x", None)))
    assert {(r.source, r.text) for r in engine.points.collect()} == {("x", "z"), ("y", "c")}
    gone = engine.delete_source("y")
    assert gone.count() == 1 and gone.commit() == 1 and engine.delete_source("y").count() == 0
    backups = list((tmp_path / "memory/backups").iterdir())
    assert any("delete-source" in b.name for b in backups)
    with pytest.raises(ValueError):
        engine.delete_fragment()
    with pytest.raises(ValueError, match="pattern"):
        engine.delete_fragment(regex="(")
    assert engine.delete_fragment(regex="^Z$").commit() == 1


def test_dedupe_keeps_newest(engine, spark):
    engine.ingest(facts(spark, ("same", "a", "2001-01-01"), ("same", "b", "2026-01-01"), ("same", "c", "2026-01-01"), ("other", "a", None)))
    assert engine.find_dupes().count() == 3
    assert engine.dedupe().commit() == 2
    kept = engine.points.where("text = 'same'").collect()
    assert len(kept) == 1 and kept[0].source in "bc"
    assert engine.dedupe().count() == 0


def test_reindex_freshens(engine, spark):
    engine.ingest(facts(spark, ("a", "x", "2024-01-02"), ("b", "y", "2024-01-02")))
    engine.reindex_source("x", now_ts=NOW).commit()
    assert {r.source: r.ts_epoch for r in engine.points.collect()} == {"x": NOW, "y": 1704153600}


def test_cli_previews(engine, spark):
    engine.store("gone soon", now_ts=NOW)
    arguments = ["--root", engine.store_.root, "--collection", "memory-v2", "delete-text", "GONE"]
    assert run(spark, arguments).startswith("1 points would")
    assert run(spark, [*arguments, "--yes"]) == "1 points changed"
    assert run(spark, [*arguments[:4], "stats"]) == ""


def test_sources_from_files(engine, spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u/web.service").write_text("Description=W\nExecStart=/bin/w\n")
    (tmp_path / "u/bad.service").write_bytes(b"ExecStart=\xff\xfe")
    (tmp_path / "u/note.txt").write_text("ExecStart=/no")
    units = Source(f"file://{tmp_path}/u", parsers.service_facts, pattern="*.service")
    done = ingest_all(engine, {"units": units, "none": Source(f"file://{tmp_path}/missing", parsers.service_facts)})
    assert done["units"] == 1 and "none" in done and isinstance(done["none"], str)
    row = engine.points.first()
    assert row.text == "systemd service web: /bin/w (W)" and row.file_path.endswith("/u/web.service")


def test_project_paragraphs(spark):
    text = "# heading that is longer than thirty characters\n\n" + "x" * 30 + "\n\n" + "y" * 31 + " \n\n```\n" + "z" * 40
    got = parsers.project_facts(spark.createDataFrame([("/var/www/p1/README.md", text), ("/other/README.md", text)], "path string, value string")).collect()
    assert [(r.text, r.source) for r in got] == [(f"[p1] {'y' * 31}", "project-p1")]


def column(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "date"), [("on 2026-02-30 and 2025-01-01", "2026-02-30"), ("2026-08-10 x 2026-08-09", "2026-08-10"), ("9920261-2020-01-0199", "2020-01-01"), ("none", None), ("", None), (None, None)])
def test_extract_date(spark, text, date):
    assert column(spark, text, scalars.extract_date) == date


def test_point_ts_and_decay(spark):
    assert column(spark, "2026-02-30 ... 2025-01-01", lambda c: scalars.point_ts(F.lit(None).cast("long"), c)) is None
    assert column(spark, "2026-08-10", lambda c: scalars.point_ts(F.lit(0).cast("long"), c)) == 1786320000
    assert [column(spark, a, scalars.decay, "double") for a in (0.0, 100.0, -50.0, -100.0)] == [1.0, 0.5, 2.0, None]


def test_fragments_are_literal(spark):
    rows = spark.createDataFrame([("100% sure",), ("100 sure",), ("a_b",), ("axb",), ("ÄB",), (None,)], "text string")
    assert [rows.where(scalars.contains_text(F.col("text"), f)).count() for f in ("100%", "a_b", "äb")] == [1, 1, 1]
    assert [rows.where(scalars.matches(F.col("text"), p)).count() for p in ("äb", r"^a.b$")] == [1, 2]


def test_scrub_is_idempotent(spark):
    text = 'Bearer abcdefgh12 API_TOKEN=zz password = "a b" sk-0123456789abcdefXY $2b$12$' + "a" * 30
    once = column(spark, text, scrub)
    assert once == 'Bearer [REDACTED] API_TOKEN=[REDACTED] password = [REDACTED] [REDACTED] [REDACTED]'
    assert column(spark, "my-value x", lambda c: scrub(c, ["my-value"])) == "[REDACTED] x"


@pytest.mark.parametrize("n", [3, 40, 10_000])
def test_known_values_are_redacted(spark, n):
    """Few or many values: one node of the plan, from the left, the longest of those that start at one place."""
    import random

    rng = random.Random(n)
    values = ["".join(rng.choices("ab.*$\\({é ", k=rng.randint(3, 9))) for _ in range(n)] + ["", "aaa", "aaab"]
    texts = [None, ""] + ["".join(rng.choices(["ab", "a", ".*$", " ", *values[:50]], k=20)) for _ in range(60)]
    known, longest = set(filter(None, values)), max(map(len, values))

    def plain(text):
        out, at = "", 0
        while at < len(text):
            found = next((k for k in range(longest, 0, -1) if text[at : at + k] in known), 0)
            out, at = out + ("[REDACTED]" if found else text[at]), at + max(1, found)
        return out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = rows.select("i", redact(F.col("text"), values).alias("t"))
    assert {r.i: r.t for r in got.collect()} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("regexp_replace") == 1


def test_search_candidates_and_time_filter(spark):
    rows = [(str(i), "x", "s", 1_000_000 * i if i else None, [float(i == j) + 0.1 for j in range(4)]) for i in range(4)]
    points = spark.createDataFrame(rows, "id string, text string, source string, ts_epoch long, vector array<float>")
    assert search.time_filter(points, 3_000_000, window_days=0).count() == 4
    assert search.time_filter(points, 3_000_000, since="1970-01-20").count() == 2
    with pytest.raises(ValueError):
        search.time_filter(points, 0, since="soon")
    best = search.search(points, [1.0, 0, 0, 0], now_ts=3_000_000, limit=1).collect()
    assert best[0].id == "0" and best[0].age_days is None


def test_hashed_vectors():
    assert abs((hashed("a b c", 16) ** 2).sum() - 1) < 1e-6 and not hashed(None, 16).any()


def test_stream_ingest_is_idempotent(engine, spark, tmp_path):
    from engram.streaming.ingest import ingest_stream

    rows = facts(spark, ("a", "x", None), ("b", "x", None))
    for _ in range(2):
        rows.write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
        ingest_stream(engine, stream, f"file://{tmp_path}/check").awaitTermination()
    assert engine.points.count() == 2


def test_search_batch_scans_once(spark):
    import numpy as np

    from engram.operators.search import search_batch

    vectors = np.random.default_rng(2).normal(size=(200, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    points = spark.createDataFrame([*rows, (200, None), (201, [0.0] * 8), (202, [1.0])], "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([*rows[::4], (500, None), (501, [0.0] * 8)], "query_id long, query array<double>")
    found = search_batch(points, queries, limit=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("WindowGroupLimit") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # pairs are not rows: what is sorted is a limit a query and task
    got = {(r.query_id, r["rank"]): (r.id, r.raw_score) for r in found.collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ unit.T
    assert set(got) == {(q, k) for q in range(0, 200, 4) for k in range(1, 8)}
    for (q, k), (i, score) in got.items():
        assert i == np.argsort(-scores[q])[k - 1] and abs(score - scores[q, i]) < 1e-12
    blocks = search_batch(points, queries, limit=7, block_bytes=1000)
    assert {(r.query_id, r["rank"]): (r.id, r.raw_score) for r in blocks.collect()} == got


def test_search_batch_ties(spark):
    """Equal vectors by id; rows of one query_id are queries of their own; lengths that no point has; no rows at all."""
    from engram.operators.search import search_batch

    rows = [(f"p{i:03d}", [[0.3, 0.7, 0.1], [1.0, 0.0, 0.2], [1.0, 2.0]][i % 3]) for i in range(300)]
    points = spark.createDataFrame(rows, "id string, vector array<float>").repartition(4)
    queries = spark.createDataFrame([("a", [0.3, 0.7, 0.1]), ("a", [1.0, 0.0, 0.2]), ("b", [1.0] * 5), (None, [2.0, 4.0])], "query_id string, query array<double>")
    got = sorted(((r.query_id or "", r.id, r["rank"]) for r in search_batch(points, queries, limit=3).collect()))
    assert got == sorted([("a", f"p{3 * i:03d}", i + 1) for i in range(3)] + [("a", f"p{3 * i + 1:03d}", i + 1) for i in range(3)] + [("", f"p{3 * i + 2:03d}", i + 1) for i in range(3)])
    assert search_batch(points, queries.limit(0)).count() == search_batch(points.limit(0), queries).count() == 0


def test_versions_are_created_once(engine, spark):
    store = engine.store_
    engine.ingest(facts(spark, ("a", "x", None), ("b", "y", None), ("c", None, None)))
    version, parts = store._state()
    engine.store("d", "z", now_ts=NOW)  # adds a part, leaves the others
    assert store._state()[1][: len(parts)] == parts and store.version() == version + 1
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(version, parts)
    before = engine.points
    engine.delete_source("x").commit()  # only that source's rows go
    assert all(p["without"] == ["x"] for p in store._state()[1][:-1])
    assert {r.text for r in engine.points.collect()} == {"b", "c", "d"} and before.count() == 4
    engine.delete_text("c").commit()
    assert {r.text for r in engine.points.collect()} == {"b", "d"}
    # a version file that is being written doesn't count
    from engram.shared import create_file

    create_file(spark, store._version_path(store.version() + 1), b"[{")
    assert {r.text for r in engine.points.collect()} == {"b", "d"}


def test_parts_are_put_together(engine, spark, monkeypatch):
    from engram.operators import store

    monkeypatch.setattr(store, "MOST_PARTS", 3)
    for i in range(6):
        engine.store(f"text {i}", "s", now_ts=NOW)
    assert engine.points.count() == 6 and len(engine.store_._state()[1]) <= 3
    assert engine.store_.vacuum(1) > 0 and engine.points.count() == 6


def test_identifiers_are_normalized(engine, spark):
    assert [scalars.normalize_id(x) for x in ("007", 7, " 7", "7a", "-1")] == ["7", "7", "7", "7a", "-1"]
    engine.ingest(facts(spark, ("a", "x", None)))
    row = engine.points.first()
    assert engine.show(f"0{row.id}").count() > 3 and engine.delete_ids([f"0{row.id}"]).commit() == 1


def test_settings(spark):
    spark.conf.set("spark.engram.collection", "notes-v2")
    try:
        assert Config.from_settings(spark, {"ENGRAM_LIMIT": "3", "ENGRAM_COLLECTION": "other"}) == Config("notes-v2", limit=3)
        assert Config.from_settings(spark, {}, collection="given").collection == "given"
    finally:
        spark.conf.unset("spark.engram.collection")
    given = Config.from_settings(spark, {"ENGRAM_BLACKLIST": "one\ntwo words\n", "ENGRAM_PATH_MAP": '{"/a": "/b"}', "ENGRAM_SPECIAL_PATHS": '{"x": "/y"}', "ENGRAM_EMBEDDER": "tests_model:load"})
    assert (given.blacklist, given.path_map, given.special_paths, given.embedder) == (("one", "two words"), {"/a": "/b"}, {"x": "/y"}, "tests_model:load")
    assert Config.from_settings(spark, {"COLLECTION_NAME": "c"}).collection == "c" and Config.from_settings(spark, {}).collection == "memory"


def test_cli_ingests_and_prints(engine, spark, tmp_path):
    (tmp_path / "www/p1").mkdir(parents=True)
    (tmp_path / "www/p1/README.md").write_text("a paragraph that is longer than thirty characters")
    (tmp_path / "units").mkdir()
    (tmp_path / "units/bad.service").write_bytes(b"ExecStart=\xff")
    (tmp_path / "units/web.service").write_text("ExecStart=/bin/w")
    (tmp_path / "log.md").write_text("## 2026-08-10 \u2014 title\n- detail\n")
    root = ["--root", engine.store_.root, "--collection", "memory-v2"]
    paths = ["--www-root", f"{tmp_path}/www", "--unit-dir", f"{tmp_path}/units", "--changelog", f"{tmp_path}/log.md", "--docs", f"{tmp_path}/none.md", "--proxy-dir", f"{tmp_path}/none"]
    said = run(spark, [*root, "ingest", *paths])
    assert "skipped" in said and "bad.service" in said and "systemd: 1 facts" in said and "instructions: 1 facts" in said and "vps-docs: failed" in said and "4 of 6 sources ready" in said
    assert run(spark, [*root, "ingest", "changelog", "--replace", *paths]).startswith("changelog: 2 facts")
    with pytest.raises(KeyError):
        run(spark, [*root, "ingest", "nothing", *paths])
    hits = run(spark, [*root, "search", "paragraph longer characters", "1"]).split("\n")
    assert len(hits) == 2 and hits[0].startswith("score=") and "src=project-p1" in hits[0] and hits[1].strip().startswith("text: [p1]")
    one = engine.points.where("source = 'changelog'").first().id
    told = run(spark, [*root, "edit-payload", one, "section=x", "nonsense", "--yes"])
    assert "nonsense" in told and told.endswith("1 points changed")
    assert "section: x" in run(spark, [*root, "show", one])


def test_an_embedder_is_named_by_a_setting(spark, tmp_path, monkeypatch):
    import sys

    (tmp_path / "tests_model.py").write_text("def load():\n    return lambda texts: [[float(len(t)), 1.0] for t in texts]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "tests_model.py"))
    e = MemoryEngine(spark, f"file://{tmp_path}/memory", Config("memory", base_dim=2, embedder="tests_model:load"))
    e.setup()
    e.store("four")
    assert e.points.first().vector == [4.0, 1.0] and e.search("four").first().raw_score > 0.999
    for wrong in ("tests_model", "tests_model:none", "no_such_module:load"):
        with pytest.raises((ValueError, AttributeError, ModuleNotFoundError)):
            MemoryEngine(spark, "file:///tmp/none", Config("memory", embedder=wrong))
    sys.modules.pop("tests_model", None)


def test_files_that_cannot_be_read_are_named(spark, tmp_path):
    from engram.sources.files import read_files, skipped_files

    for name in ("good", "torn", "bytes"):
        (tmp_path / name).write_bytes(b"\xff\xfe" if name == "bytes" else b"text")
    (tmp_path / ".torn.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x01\x02\x03\x04")  # a checksum that doesn't fit
    assert [r.path.split("/")[-1] for r in read_files(spark, f"file://{tmp_path}").collect()] == ["good"]
    found = {r.path.split("/")[-1]: r.reason for r in skipped_files(spark, f"file://{tmp_path}").collect()}
    assert found == {"torn": "can't be read", "bytes": "no UTF-8 text"}


def test_reports_on_the_command_line(engine, spark):
    engine.ingest(facts(spark, ("same", "a", "2026-01-05"), ("same", "b", "2026-01-06"), ("other", "a", "2026-01-07")))
    root = ["--root", engine.store_.root, "--collection", "memory-v2"]
    say = lambda *a: run(spark, [*root, *a]).split("\n")
    assert say("stats") == ["Total points: 3", "source                 count  ts_epoch    no_ts", "a                          2         2        0", "b                          1         1        0"]
    listed = say("list-source", "a", "--limit", "1")
    assert listed[0] == "Source 'a': 2 points" and listed[1].startswith("  ID=") and "date=2026-01-0" in listed[1] and listed[2] == "  ... (+1 more, use --limit)"
    dupes = say("find-dupes")
    assert dupes[:2] == ["Found 1 duplicate groups (2 points total):", "  Group (2 points):"] and len(dupes) == 4 and all(x.startswith("    [2026-01-0") and x.endswith(" same") for x in dupes[2:])
    files = say("find-by-file", "/f2")
    assert files[0] == "File '/f2': 1 points" and files[1].startswith("  [2026-01-07] ID=")
    one = engine.points.where("text = 'other'").first().id
    shown = say("show", one)
    assert shown[0] == f"ID: {one} (int)" and "  text: other" in shown and shown[-1] == "  vector dim: 24"
    assert say("index") == ["1 parts got a text index, 1 codes of vectors"]
    spark.conf.set("spark.engram.base_dim", 16)
    try:
        assert say("search", "other", "1", "--indexed")[1].strip() == "text: other"
    finally:
        spark.conf.unset("spark.engram.base_dim")
    engine.delete_text("same").commit()
    assert say("find-dupes") == ["  No duplicates"]
