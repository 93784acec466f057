"""Each registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from engram.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(wanted, key=key)


def test_search_reads_few_columns_and_orders_twice(spark):
    plan = catalogue.queries()["search_since"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2
    assert "n_chars" not in plan


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n.startswith("search_") and n != "search_batch"])
def test_searches_keep_a_top_k_by_task(spark, name):
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2 and "rangepartitioning" not in plan
