"""Versions, parts and rows of a collection: writers that meet, torn files, changes by row, lookups, vectors by content."""

import glob
import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engram.config import Config
from engram.engine import MemoryEngine
from engram.functions import scalars
from engram.functions.embed import HashingEmbedder, hashed
from engram.operators import store as stores
from engram.operators.search import since_epoch
from engram.schema import FACT, POINT

NOW = 1_786_000_000


def engine_at(spark, path, provider=None, **settings):
    e = MemoryEngine(spark, f"file://{path}/memory", Config(settings.pop("collection", "memory-v2"), base_dim=16, **settings), provider)
    e.setup()
    return e


@pytest.fixture
def engine(spark, tmp_path):
    return engine_at(spark, tmp_path)


def facts(spark, *rows):
    return spark.createDataFrame([(i, text, source, "s", "", "t", date) for i, (text, source, date) in enumerate(rows)], FACT)


def many(spark, n, sources=1, step=1):
    """n points p0, p1, ... in scattered order."""
    rows = spark.range(n).select(F.col("id").cast("string").alias("name"), F.col("id").alias("at"))
    return rows.select(
        F.concat(F.lit("p"), "name").alias("id"), F.lit(None).cast("long").alias("id_num"), F.concat(F.lit("text "), "name").alias("text"), F.concat(F.lit("s"), F.col("at") % sources).alias("source"),
        *[F.lit("").alias(c) for c in ("section", "file_path", "type")], (F.col("at") * step).alias("ts_epoch"), F.lit(None).cast("map<string,string>").alias("extra"), F.lit(None).cast("array<float>").alias("vector"),
    ).orderBy(F.xxhash64("id"))


def rows_read(df):
    """Points that the scans of a DataFrame give, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if name.startswith("Scan parquet") and "/points/" in node.relation().location().rootPaths().mkString():
                found += node.metrics().get("numOutputRows").get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def moved(spark, work):
    """Bytes dealt out and bytes written by the stages of some work."""
    bus, store, gateway = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {s.stageId(): (s.shuffleWriteBytes(), s.outputBytes()) for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    work()
    new = [v for k, v in stages().items() if k not in before]
    return tuple(sum(x) for x in zip(*new, strict=True)) if new else (0, 0)


def long_texts(spark, n):
    """n texts of 1,280 characters that don't compress well."""
    return spark.range(n).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(f"|{i}")), 256) for i in range(20)]).alias("text"))


def texts(engine):
    return sorted(r.text or "" for r in engine.points.select("text").collect())


# versions


def test_writes_go_on_after_a_torn_version_file(engine, tmp_path):
    engine.store("one", now_ts=NOW)
    torn = tmp_path / f"memory/versions/v{engine.store_.version() + 1:08d}.json"
    torn.write_bytes(b"")
    engine.store("two", now_ts=NOW)
    assert texts(engine) == ["one", "two"]
    torn.with_name(f"v{engine.store_.version() + 1:08d}.json").write_bytes(b'[{"part": "')
    assert engine.delete_text("one").commit() == 1
    assert texts(engine) == ["two"] and engine.store_.vacuum(1) >= 0 and texts(engine) == ["two"]
    assert not [n for n in os.listdir(tmp_path / "memory/versions") if n.endswith(".json") and n.startswith(".v")]


def test_vacuum_leaves_parts_in_the_making(engine, spark, monkeypatch):
    engine.store("one", now_ts=NOW)
    store = engine.store_
    base = store.snapshot()
    part = store._write(many(spark, 5))
    assert store.vacuum(1) == 0
    store._commit(base.version, [*base.parts, part])
    assert engine.points.count() == 6
    store._write(many(spark, 5))  # of a writer that crashes
    assert store.vacuum(1) == 0
    monkeypatch.setattr(stores, "STALE_SECONDS", -1)
    assert store.vacuum(1) == 1 and engine.points.count() == 6


def test_of_two_writers_from_one_version_one_wins(engine, spark):
    engine.ingest(facts(spark, ("a", "x", None), ("b", "y", None)))
    first, second, third = engine.delete_text("a"), engine.edit(engine.points.where("text = 'b'").first().id, "c"), engine.delete_source("y")
    assert first.commit() == 1
    for late in (second, third):
        with pytest.raises(RuntimeError, match="another writer"):
            late.commit()
    assert texts(engine) == ["b"]
    assert engine.store_.vacuum(1) >= 1  # what the losers wrote is no longer in the making
    assert texts(engine) == ["b"]


def test_an_ingest_on_an_old_version_is_refused(engine, spark, monkeypatch):
    engine.ingest(facts(spark, ("a", "x", None)))
    inner = engine.points_of

    def meanwhile(*arguments):
        points = inner(*arguments)
        MemoryEngine(spark, engine.store_.root, engine.config).store("b", "x", now_ts=NOW)
        return points

    monkeypatch.setattr(engine, "points_of", meanwhile)
    with pytest.raises(RuntimeError, match="another writer"):
        engine.ingest(facts(spark, ("b", "x", None)), mode="append")
    assert texts(engine) == ["a", "b"]


# rows


def test_an_edit_writes_one_row(engine, spark, tmp_path):
    engine.store_.publish(many(spark, 3000))
    before = engine.store_.snapshot()
    engine.edit_payload("p1234", {"section": "new"}).commit()
    parts = engine.store_.snapshot().parts
    assert [p["part"] for p in parts[:-1]] == [p["part"] for p in before.parts] and parts[-1]["rows"] == 1
    rows = engine.points
    assert rows.count() == 3000 and rows.where("section = 'new'").select("id").collect() == [("p1234",)]
    assert engine.store_.points(before).where("section = 'new'").isEmpty()  # versions before stay as they are
    engine.edit_payload("p1234", {"section": "newer"}).commit()
    assert engine.points.count() == 3000 and engine.points.where("section <> ''").count() == 1


def test_dead_rows_of_any_number(engine, spark, monkeypatch):
    """Rows on both sides of a bitmap's end; sets put together; rows that move to another part."""
    monkeypatch.setattr(stores, "MOST_DEAD", 2)
    monkeypatch.setattr(stores, "BITMAP_ROWS", 64)
    engine.store_.publish(many(spark, 700).coalesce(1))
    left = {f"p{i}" for i in range(700)}
    for digit in "1357":
        assert engine.delete_text(f"{digit}4").commit() == len([x for x in left if f"{digit}4" in x])
        left = {x for x in left if f"{digit}4" not in x}
        assert {r.id for r in engine.points.select("id").collect()} == left
    assert all(len(p.get("dead", [])) <= 2 for p in engine.store_.snapshot().parts)
    ids = sorted(left)[:300]
    assert engine.delete_ids([*ids, "none"]).commit() == 300
    assert {r.id for r in engine.points.select("id").collect()} == left - set(ids)


def test_small_parts_are_put_together_not_large_ones(engine, spark, monkeypatch):
    monkeypatch.setattr(stores, "MOST_PARTS", 4)
    engine.store_.publish(many(spark, 500))
    large = engine.store_.snapshot().parts[0]["part"]
    for i in range(7):
        engine.store(f"one {i}", "z", now_ts=NOW)
        engine.edit_payload(f"p{i}", {"section": "x"}).commit()
    parts = engine.store_.snapshot().parts
    assert len(parts) <= 4 and large in {p["part"] for p in parts}
    assert engine.points.count() == 507 and engine.points.where("section = 'x'").count() == 7


def test_sources_left_out_and_dead_rows_in_one_part(engine, spark):
    engine.store_.publish(many(spark, 40, sources=4))
    engine.delete_source("s1").commit()
    engine.delete_ids(["p0"]).commit()
    engine.store_.append(many(spark, 4, sources=4).withColumn("id", F.concat(F.lit("q"), "id")))
    engine.store_.replace([None, "s2"], None)
    assert {r.id for r in engine.points.collect()} == {f"p{i}" for i in range(1, 40) if i % 4 in (0, 3)} | {"qp0", "qp1", "qp3"}


# lookups


def test_lookups_by_id_skip_rows(engine, spark):
    engine.store_.publish(many(spark, 60_000, sources=3))
    assert rows_read(engine.points.where("id = 'p4711'")) <= 6000
    assert rows_read(engine.points.where("id = 'absent'")) == 0
    change = engine.delete_ids(["p17", "p59999"])
    assert rows_read(change.located) <= 12_000 and change.commit() == 2
    assert engine.delete_ids([f"p{i}" for i in range(5000)] + ["x"]).commit() == 4999
    assert engine.points.count() == 60_000 - 5001 + 0
    assert engine.delete_ids([]).count() == 0


def test_a_bound_on_time_leaves_parts_closed(spark, tmp_path):
    engine = engine_at(spark, tmp_path)
    for start in range(3):
        engine.store_.append(many(spark, 100, step=10).withColumns({"id": F.concat(F.lit(f"{start}"), "id"), "ts_epoch": F.col("ts_epoch") + 100_000 * start, "vector": F.array(*[F.rand(3).cast("float")] * 24)}))
    engine.store_.append(many(spark, 10).withColumns({"id": F.concat(F.lit("u"), "id"), "ts_epoch": F.lit(None).cast("long")}))
    assert len(engine.points.inputFiles()) > len(engine.store_.points(since=100_500).inputFiles()) > len(engine.store_.points(since=200_500).inputFiles())
    assert engine.store_.points(since=100_500).where("ts_epoch >= 100500").count() == engine.points.where("ts_epoch >= 100500").count() == 150
    found = engine.search("text", limit=500, window_days=1, now_ts=200_500 + 86400)
    assert found.count() == 50 and engine.store_.points(since=999_999).count() == 0


def test_parts_put_together_lie_along_source_and_time(spark, tmp_path, monkeypatch):
    """A bound on time or on the source reads a part of the rows, once parts of any order are put together."""
    monkeypatch.setattr(stores, "MOST_PARTS", 3)
    engine = engine_at(spark, tmp_path)
    for i in range(4):
        engine.store_.append(many(spark, 8000, sources=5, step=10).where(F.col("ts_epoch") / 10 % 4 == i))
    engine.store_.append(many(spark, 10).withColumns({"id": F.concat(F.lit("u"), "id"), "ts_epoch": F.lit(None).cast("long"), "source": F.lit(None).cast("string")}))
    assert len(engine.store_.snapshot().parts) <= 3 and engine.points.count() == 8010
    late = engine.points.where("ts_epoch >= 70000 and ts_epoch < 70010")
    assert late.count() == 1 and rows_read(late) < 8010 * 0.7
    places = engine.points.select(stores.curve(engine.points).alias("at"), "ts_epoch", "source").collect()
    assert all((p.at & 0b010101010101 == 0) for p in places if p.ts_epoch is None)
    by_source = {}
    for p in places:
        by_source.setdefault(p.source, set()).add(p.at >> 1 & 0b010101010101)
    assert all(len(x) == 1 for x in by_source.values())


def test_midnight_is_where_the_time_zone_is(spark, tmp_path):
    zone = "America/New_York"
    assert since_epoch("2026-01-05") - since_epoch("2026-01-05", zone) == -5 * 3600 and since_epoch("2026-07-05", zone) - since_epoch("2026-07-05") == 4 * 3600
    try:
        engine = engine_at(spark, tmp_path, time_zone=zone, fallback_date="2026-07-05")
        engine.ingest(facts(spark, ("no day", "x", None), ("a day", "x", "2026-01-05")))
        found = {r.text: r.ts_epoch for r in engine.points.collect()}
        assert found == {"no day": since_epoch("2026-07-05", zone), "a day": since_epoch("2026-01-05", zone)}
        assert engine.search("day", since="2026-01-05", now_ts=NOW).count() == 2
        assert engine.search("day", since="2026-01-06", now_ts=NOW).count() == 1
        day = spark.createDataFrame([(None, None)], "date string, text string").select(scalars.content_ts(F.col("date"), F.col("text"), F.lit(None), "2026-07-05", zone))
        assert day.first()[0] == since_epoch("2026-07-05", zone)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# vectors


class Counting(HashingEmbedder):
    """Writes down each text it is given."""

    def __init__(self, folder, dim=16):
        super().__init__(dim)
        self.folder = str(folder)

    def column(self, text):
        folder, dim = self.folder, self.dim

        @F.pandas_udf("array<float>")
        def made(texts: pd.Series) -> pd.Series:
            with open(f"{folder}/{os.getpid()}", "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return pd.Series([hashed(t, dim) for t in texts])

        return made(text)

    def seen(self):
        return Counter(line.rstrip("\n") for f in glob.glob(f"{self.folder}/*") for line in open(f))


def check_vectors(engine):
    for r in engine.points.collect():
        assert np.allclose(r.vector[:16], hashed(r.text, 16), atol=1e-6)
        time_part = engine.spark.range(1).select(scalars.time_features(F.lit(r.ts_epoch))).first()[0]
        assert len(r.vector) == 24 and np.allclose(r.vector[16:], time_part, atol=1e-6)


def test_each_text_is_embedded_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    counting = Counting(tmp_path / "seen")
    engine = engine_at(spark, tmp_path, counting)
    some = facts(spark, *[(f"fact {i % 40}", f"s{i % 3}", "2026-01-05") for i in range(200)])
    assert engine.ingest(some) == 120  # 40 texts in three sources
    assert counting.seen() == {f"fact {i}": 1 for i in range(40)}
    engine.ingest(some, mode="append")
    engine.ingest(some)
    engine.reindex_source("s1", now_ts=NOW).commit()
    engine.store("fact 7", now_ts=NOW)
    assert counting.seen() == {f"fact {i}": 1 for i in range(40)}
    new = engine.store("a new one", now_ts=NOW)
    engine.edit(new, "another", now_ts=NOW).commit()
    engine.update_vector(new, now_ts=NOW).commit()
    engine.edit_payload(new, {"text": "by payload"}).commit()
    engine.update_vector(new, now_ts=NOW).commit()
    assert counting.seen() == {f"fact {i}": 1 for i in range(40)} | {"a new one": 1, "another": 1, "by payload": 1}
    assert {r.source for r in engine.points.where(F.col("ts_epoch") == NOW).collect()} == {"s1", "manual"}
    check_vectors(engine)


def test_a_vector_that_two_writers_add_serves_once(spark, tmp_path):
    engine = engine_at(spark, tmp_path)
    engine.store("same", now_ts=NOW)
    kept = glob.glob(f"{tmp_path}/memory/vectors/*")
    assert len(kept) == 1
    engine.vectors.known().write.parquet(f"file://{tmp_path}/memory/vectors/twin")
    engine.store("same", now_ts=NOW)
    engine.ingest(facts(spark, ("same", "x", "2026-01-05"), (None, "x", "2026-01-05"), ("", "x", "2026-01-05")))
    assert texts(engine).count("same") == 3
    check_vectors(engine)


def test_vectors_of_other_models_are_not_taken(spark, tmp_path):
    engine_at(spark, tmp_path).store("same", now_ts=NOW)

    class Ones(HashingEmbedder):
        def column(self, text):
            return F.transform(F.sequence(F.lit(1), F.lit(self.dim)), lambda _: F.lit(1.0).cast("float"))

    other = engine_at(spark, tmp_path, Ones(16))
    other.store("same", "ones", now_ts=NOW)
    assert other.points.where("source = 'ones'").first().vector[:16] == [1.0] * 16


def test_an_empty_collection_is_read(engine):
    assert engine.points.schema == engine.spark.createDataFrame([], POINT).schema and engine.points.count() == 0
    assert engine.delete_source("x").count() == 0 and engine.dedupe().commit() == 0 and engine.reindex_source("x").commit() == 0


# what moves


def test_facts_move_no_more_often_than_needed(spark, tmp_path):
    """Texts move where a part is laid out, and where they don't fit beside their vectors once more."""
    engine, n = engine_at(spark, tmp_path), 3000
    rows = long_texts(spark, n)
    some = rows.unionByName(rows.where("id % 3 = 0")).select(F.monotonically_increasing_id().alias("ord"), "text", F.concat(F.lit("s"), F.col("id") % 4).alias("source"), *[F.lit("").alias(c) for c in ("section", "file_path", "type")], F.lit(None).cast("string").alias("date"))
    size = n * 1280
    assert moved(spark, lambda: engine.ingest(some, "append"))[0] < 2.5 * size
    assert engine.points.count() == n
    version = engine.store_.version()
    dealt, written = moved(spark, lambda: engine.ingest(some, "append"))
    assert dealt < 0.5 * size and written < 2 * size  # facts are put to rest; nothing is new
    assert engine.points.count() == n and len(engine.store_.snapshot().parts) == 1 and engine.store_.version() > version


def test_the_last_of_equal_facts_is_picked(spark, tmp_path):
    """By order, also where facts are in many runs of rows or have no order."""
    engine = engine_at(spark, tmp_path)
    rows = spark.range(200_000, numPartitions=3).select((F.col("id") * 7919 % 200_000).alias("ord"))
    some = rows.select("ord", F.concat(F.lit("t"), F.col("ord") % 1500).alias("text"), F.lit("s").alias("source"), F.col("ord").cast("string").alias("section"), *[F.lit("").alias(c) for c in ("file_path", "type")], F.lit(None).cast("string").alias("date"))
    assert engine.ingest(some, "append") == 1500
    assert all(int(r.section) == 200_000 - 1500 + (int(r.text[1:]) - 200_000) % 1500 for r in engine.points.select("text", "section").collect())
    assert engine.ingest(some.limit(1400).withColumns({"ord": F.lit(None).cast("long"), "source": F.lit("none")}), "append") > 0
    assert engine.points.where("text is null or source is null").count() == 0


def test_a_text_index_deals_nothing_out(spark, tmp_path):
    """Nor does a deletion write texts besides its backup."""
    engine, n = engine_at(spark, tmp_path), 2000
    points = many(spark, n).drop("text").join(long_texts(spark, n).withColumnRenamed("id", "ts_epoch"), "ts_epoch").withColumn("text", F.when(F.col("ts_epoch") % 2 == 0, F.concat(F.lit("a needle "), "text")).otherwise(F.col("text")))
    engine.store_.append(points)
    assert moved(spark, engine.texts.build)[0] == 0
    change = engine.delete_text("needle")
    dealt, written = moved(spark, change.commit)
    backup = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/memory/backups/*/part-*"))
    assert n / 2 * 1280 < backup <= written < 1.3 * backup and dealt < 0.2 * backup
    assert engine.points.count() == n / 2 and engine.delete_text("needle").count() == 0
