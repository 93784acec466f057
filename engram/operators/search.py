"""Time-aware similarity search: filter, exact cosine, oversampled candidates, decay, final order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import age_days, decay, dot, norm, point_ts
from ..shared import scratch_path


def since_epoch(day: str, time_zone: str = "UTC") -> int:
    """Midnight of a day YYYY-MM-DD where the time zone is; ValueError for anything else."""
    return int(datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=ZoneInfo(time_zone)).timestamp())


def time_bound(now_ts: float, since: str | None = None, window_days: float | None = None, time_zone: str = "UTC") -> float | None:
    """The least ts_epoch that counts: a window overrides since; 0 is no window."""
    return now_ts - window_days * 86400 if window_days else since_epoch(since, time_zone) if since else None


def time_filter(points: DataFrame, now_ts: float, since: str | None = None, window_days: float | None = None, time_zone: str = "UTC") -> DataFrame:
    """Points at or after a bound. Points without ts_epoch don't match a bound."""
    bound = time_bound(now_ts, since, window_days, time_zone)
    return points if bound is None else points.where(F.expr("try_cast(ts_epoch AS bigint)") >= F.lit(bound))


def _cosine(query: Sequence[float], vector: str) -> Column:
    """Cosine of a column with a literal vector; null without direction, or where the lengths differ."""
    own, size = F.col(vector), float(sum(x * x for x in query)) ** 0.5
    return F.when(F.size(own) == len(query), F.try_divide(dot(own, F.array(*[F.lit(float(x)) for x in query])), norm(own) * F.lit(size)))


def cosine_scores(points: DataFrame, query: Sequence[float], vector: str = "vector") -> DataFrame:
    """Adds raw_score; points without a vector, or with one of another length or without direction, go.

    The query is a literal of one vector, so the scan is one stage without an exchange. The score is generated, not
    projected, so that the filter on it doesn't evaluate it a second time.
    """
    some = F.filter(F.array(_cosine(query, vector)), lambda x: x.isNotNull())
    return points.where(F.col(vector).isNotNull()).select("*", F.explode(some).alias("raw_score"))


def search(points: DataFrame, query: Sequence[float], now_ts: float, limit: int = 10, fresh: bool = True, since: str | None = None, window_days: float | None = None, rate: float = 0.01, overshoot: int = 3, vector: str = "vector", time_zone: str = "UTC") -> DataFrame:
    """rank, id, final_score, raw_score, age_days, source, text of the best points.

    The limit * overshoot best by cosine are candidates; these alone are decayed by age and ordered anew. A point
    without a time, in ts_epoch or its text, is not decayed; nor is one whose decay divides by zero. Ties by id.

    Both orders are a top-k kept by each task, without an exchange of points. For that, points without a score are
    ordered last and dropped behind the first limit, and age and final score are one projection.
    """
    chosen = time_filter(points, now_ts, since, window_days, time_zone).where(F.col(vector).isNotNull()).withColumn("raw_score", _cosine(query, vector))
    candidates = chosen.orderBy(F.desc_nulls_last("raw_score"), "id").limit(limit * overshoot)
    age = age_days(point_ts(F.expr("try_cast(ts_epoch AS bigint)"), F.col("text")), now_ts)
    final = F.coalesce(F.col("raw_score") * decay(age, rate), F.col("raw_score")) if fresh else F.col("raw_score")
    scored = candidates.select("id", final.alias("final_score"), "raw_score", age.alias("age_days"), "source", "text").where(F.col("raw_score").isNotNull())
    best = scored.orderBy(F.desc("final_score"), F.desc("raw_score"), "id").limit(limit)
    # limit rows are numbered, so one task is enough
    rank = F.row_number().over(Window.orderBy(F.desc("final_score"), F.desc("raw_score"), "id"))
    return best.select(rank.alias("rank"), "id", "final_score", "raw_score", "age_days", "source", "text")


#: Bytes of queries that are sent to the tasks at once; scores that are in memory at once; what a product's last digits may
#: be off by.
BLOCK_BYTES, MOST_SCORES, SLACK = 16 << 20, 1 << 22, 1e-9


def search_batch(points: DataFrame, queries: DataFrame, limit: int = 10, vector: str = "vector", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, id, raw_score: the best points for each row of queries (query_id, query), however many.

    Queries go to the tasks in blocks of about block_bytes, each scored against one scan of the points; where there are
    several, each block's result is written before the next block is fetched. A task multiplies batches of points with the
    block and keeps each query's best, so pairs are neither sorted nor exchanged, but for a limit a query and task. Points
    and queries without a vector or direction, and pairs of different lengths, go; rows of one query_id are queries of
    their own. Ties by id.
    """
    spark, own = points.sparkSession, F.col(vector)
    given = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query is not null")
    rows, longest = given.agg(F.count("*"), F.max(F.size("query"))).first()
    blocks = max(1, -(-rows * 8 * (longest or 1) // block_bytes))
    place = F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks))
    sized = points.where(own.isNotNull()).select("id", own.cast("array<double>").alias("vector"))
    kinds = {"id": points.schema["id"].dataType.simpleString(), "query_id": queries.schema["query_id"].dataType.simpleString()}
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("raw_score"), "id"))

    def best(asked: pa.Table) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)
        scored = sized.mapInArrow(lambda batches: score_batches(batches, sent.value, limit), f"_query int, query_id {kinds['query_id']}, id {kinds['id']}, raw_score double")
        return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "id", "raw_score")

    if blocks == 1:
        return best(given.toArrow())
    found = []
    for i in range(blocks):
        path, part = scratch_path(spark, "batch"), best(given.where(place == i).toArrow())
        part.write.parquet(path)
        found.append(spark.read.schema(part.schema).parquet(path))
    return reduce(DataFrame.unionByName, found)


def unit_rows(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length to (row numbers, unit vectors) of the lists that have a direction."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    found = {}
    for n in np.unique(lengths[lengths > 0]).astype(int):
        at = np.flatnonzero(lengths == n)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        fit = np.isfinite(size) & (size > 0)
        found[n] = at[fit], x[fit] / size[fit, None]
    return found


def score_batches(batches: Iterator[pa.RecordBatch], asked: pa.Table, limit: int) -> Iterator[pa.RecordBatch]:
    """(_query, query_id, id, raw_score): of a task's points the best for each query, ties by id."""
    queries, best, waiting = unit_rows(asked["query"]), None, []

    def cut(some: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(some).sort_by([("_query", "ascending"), ("raw_score", "descending"), ("id", "ascending")])
        q = rows["_query"].to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return rows.filter(pa.array(place < limit))

    for batch in batches:
        for n, (at, x) in unit_rows(batch["vector"]).items():
            if n not in queries or not len(at) or not len(queries[n][0]):
                continue
            numbers, y = queries[n]
            step = max(1, MOST_SCORES // len(numbers))
            for i in range(0, len(at), step):
                part = x[i : i + step]
                scores = part @ y.T
                k = min(limit, len(part))
                least = np.partition(scores, len(part) - k, axis=0)[len(part) - k]
                p, q = np.nonzero(scores >= least - SLACK)
                # equal vectors get equal scores here, which a product of matrices doesn't promise
                exact = np.einsum("ij,ij->i", part[p], y[q])
                waiting.append(pa.table({"_query": pa.array(numbers[q].astype(np.int32)), "id": batch["id"].take(pa.array(at[i + p])), "raw_score": pa.array(exact)}))
                if sum(t.num_rows for t in waiting) > max(1 << 16, 4 * limit * len(numbers)):
                    waiting = [cut(waiting)]
    if waiting:
        best = cut(waiting)
        named = asked["query_id"].take(best["_query"])
        yield from pa.table([best["_query"], named, best["id"], best["raw_score"]], ["_query", "query_id", "id", "raw_score"]).combine_chunks().to_batches(max_chunksize=100_000)
