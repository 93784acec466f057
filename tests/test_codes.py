"""The vector index: recall against exact search, filters before candidates, parts coded as they come."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_store import engine_at

from engram.operators import search
from engram.operators.codes import CODE_WIDTH, Quantizer

NOW = 1_786_000_000
DATA = "/root/testdata/sf0.1"


def points_of(spark, vectors, prefix="v"):
    rows = [(f"{prefix}{i}", None, f"t{i}", f"s{i % 3}", "", "", "", None if i % 11 == 0 else NOW - 86400 * (i % 50), None, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    from engram.schema import POINT

    return spark.createDataFrame(rows, POINT).repartition(4)


def found(points, query, limit, **bounds):
    return [r.id for r in search.search(points, query, NOW, limit, fresh=False, overshoot=1, **bounds).collect()]


def test_codes_stand_for_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 30)) + 2 * rng.normal(size=30)
    model = Quantizer.load(Quantizer.fit(x).dump().decode())
    cells, codes = model.encode(x)
    assert codes.shape == (3000, -(-30 // CODE_WIDTH))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, tables = model.tables(unit[7])
    guess = near[cells] + tables[np.arange(codes.shape[1]), codes].sum(1)
    assert np.abs(guess - unit @ unit[7]).max() < 0.1 and np.corrcoef(guess, unit @ unit[7])[0, 1] > 0.85


def test_recall_on_the_given_vectors(spark, tmp_path):
    """At least 0.95 of the thirty best, over the queries of every row whose id is divisible by 50."""
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    engine = engine_at(spark, tmp_path)
    engine.store_.append(points_of(spark, [r.embedding for r in given]))
    assert engine.codes.build() == 1
    x = np.array([r.embedding for r in given], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    base, right, looked = engine.store_.snapshot(), 0, []
    asked = [i for i, r in enumerate(given) if r.vec_id % 50 == 0]
    for i in asked:
        some = {int(r.id[1:]) for r in engine.codes.candidates(x[i], 30, base).select("id").collect()}
        looked.append(len(some))
        scores = unit @ unit[i]
        best = np.argsort(-scores, kind="stable")[:30]
        right += len(some & set(best.tolist()))
    assert right / (30 * len(asked)) >= 0.95 and max(looked) <= 300 < len(given)


def test_filters_hold_before_candidates(spark, tmp_path):
    rng = np.random.default_rng(3)
    base_vector = rng.normal(size=24)
    x = [base_vector + 0.05 * rng.normal(size=24) for _ in range(600)]
    engine = engine_at(spark, tmp_path)
    engine.store_.append(points_of(spark, x))
    engine.codes.build()
    base, bound = engine.store_.snapshot(), NOW - 5 * 86400
    near = engine.codes.candidates(base_vector, 1, base, since=bound, probed=1.0)
    assert near.count() == 10 and near.where(F.col("ts_epoch") < bound).isEmpty()
    exact = found(engine.points, base_vector, 20, window_days=5)
    assert found(engine.codes.candidates(base_vector, 20, base, since=bound, probed=1.0), base_vector, 20, window_days=5) == exact
    only = engine.codes.candidates(base_vector, 2, base, source="s1", probed=1.0)
    assert only.count() == 20 and {r.source for r in only.collect()} == {"s1"}


def test_new_parts_and_changes(spark, tmp_path):
    """Parts without codes are searched by row; codes of dead rows and of sources left out don't count; old codes stay."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24))
    engine = engine_at(spark, tmp_path)
    assert engine.codes.build() == 0  # nothing to fit a model to
    assert engine.codes.candidates(x[0], 5, engine.store_.snapshot()).count() == 0
    engine.store_.append(points_of(spark, [*x[:200], None, np.zeros(24), np.ones(5)]))
    assert engine.codes.build() == 1 and engine.codes.build() == 0
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "memory/codes").rglob("*.parquet")}
    engine.store_.append(points_of(spark, x[200:], "w"))
    ask = lambda i, n=5: found(engine.codes.candidates(x[i], n, engine.store_.snapshot(), probed=1.0), x[i], n)
    assert ask(3)[0] == "v3" and ask(250)[0] == "w50"
    assert ask(3, 20) == found(engine.points, x[3], 20)
    assert engine.codes.build() == 1
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())
    assert ask(3, 20) == found(engine.points, x[3], 20)
    engine.delete_ids(["v3"]).commit()
    engine.delete_source("s2").commit()
    assert "v3" not in ask(3, 20) and "w50" not in ask(250, 20)
    assert ask(3, 20) == found(engine.points, x[3], 20)
    assert engine.codes.candidates(np.zeros(24), 5, engine.store_.snapshot()).count() == engine.points.count()
    assert engine.codes.candidates(np.ones(3), 5, engine.store_.snapshot()).count() == engine.points.count()


def test_search_through_the_index(spark, tmp_path):
    engine = engine_at(spark, tmp_path)
    from engram.schema import FACT

    rows = [(i, f"server number {i} in hall {i % 7}", "x", "", "", "", "2026-01-05") for i in range(120)]
    engine.ingest(spark.createDataFrame(rows, FACT))
    engine.codes.build()
    plain = engine.search("server number 17", 5, now_ts=NOW).collect()
    assert engine.search("server number 17", 5, now_ts=NOW, indexed=True).collect() == plain and len(plain) == 5


def test_few_cells_are_read_where_vectors_gather():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 60, 0) + 0.2 * rng.normal(size=(2400, 32))
    model = Quantizer.fit(x)
    assert model.probed <= 0.3
    cells, _ = model.encode(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    right = 0
    for i in range(0, 2400, 48):
        read = np.argsort(-model.tables(unit[i])[0])[: int(np.ceil(model.probed * len(model.cells)))]
        right += np.isin(cells[np.argsort(-(unit @ unit[i]))[:30]], read).sum()
    assert right / (50 * 30) >= 0.95


@pytest.mark.parametrize("n", [1, 2, 300])
def test_models_of_few_or_equal_vectors(n):
    model = Quantizer.fit(np.ones((n, 6)))
    cells, codes = model.encode(np.ones((4, 6)))
    near, tables = model.tables(np.full(6, 6**-0.5))
    assert np.allclose(near[cells] + tables[np.arange(2), codes].sum(1), 1)
