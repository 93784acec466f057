"""The points view that the registered queries run on, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_TS, SINCE, WINDOW_DAYS, QUERY_ID = 1706745600, "2024-01-04", 25, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Documents as points, with times from events; every fifth has none. Without vectors no embedding is read."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    times = events.select((F.col("event_id") / 5).cast("long").alias("doc_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts")).where("event_id % 5 = 0")
    out = docs.join(times, "doc_id", "left")
    if vectors:
        out = out.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    else:
        out = out.withColumn("vector", F.lit(None).cast("array<float>"))
    return out.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("id_num"), "text", "source", F.col("lang").alias("section"), F.lit("").alias("file_path"), F.lit("document").alias("type"),
        F.when(F.col("doc_id") % 5 != 0, F.col("ts")).alias("ts_epoch"), F.lit(None).cast("map<string,string>").alias("extra"), "vector",
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_ID) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


#: SQL for the same view.
POINTS = """points AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS id_num, d.text, d.source, d.lang AS section, 'document' AS type,
         CASE WHEN d.doc_id % 5 <> 0 THEN CAST(floor(epoch(v.ts)) AS BIGINT) END AS ts_epoch, e.embedding AS vector
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN events v ON v.event_id = d.doc_id * 5)"""
DATE_IN = "list_aggregate(regexp_extract_all({0}, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}'), 'max')"
DAY_OF = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%d')"
EPOCH_OF = "CAST(epoch(try_strptime({0}, '{1}')) AS BIGINT)"


def point_date_sql(ts: str = "ts_epoch", text: str = "text") -> str:
    return f"coalesce({DAY_OF.format(f'nullif({ts}, 0)')}, {DATE_IN.format(text)})"


def cosine_sql(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def search_sql(fresh: bool = True, bound: float | None = None, rate: float = 0.01, limit: int = 10, overshoot: int = 3) -> str:
    where = f"AND ts_epoch >= {bound}" if bound is not None else ""
    final = f"CASE WHEN ts IS NOT NULL THEN raw * (1 / (1 + {rate} * ({NOW_TS}/86400.0 - ts/86400.0))) ELSE raw END" if fresh else "raw"
    return f"""WITH {POINTS},
c AS (SELECT p.*, {cosine_sql("p.vector", "q.embedding")} AS raw, coalesce(nullif(ts_epoch, 0), {EPOCH_OF.format(DATE_IN.format("text"), "%Y-%m-%d")}) AS ts
  FROM points p, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}) q WHERE vector IS NOT NULL {where}
  ORDER BY raw DESC, id LIMIT {limit * overshoot}),
s AS (SELECT *, {final} AS final FROM c)
SELECT CAST(row_number() OVER (ORDER BY final DESC, raw DESC, id) AS BIGINT) AS rank, id, round(final, 6) AS final_score, round(raw, 6) AS raw_score,
  round({NOW_TS}/86400.0 - ts/86400.0, 6) AS age_days, source, text FROM s ORDER BY final DESC, raw DESC, id LIMIT {limit}"""
