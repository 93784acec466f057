"""Registered queries of the memory engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..engine import MemoryEngine
from ..functions import scalars
from ..functions.scrub import scrub
from ..operators import audit, store
from ..operators import search as searching
from ..shared import scratch_path, write_files
from ..sources import parsers
from ..sources.files import read_files, skipped_files
from ..sources.registry import STATIC, default_sources, ingest_all
from .points import DATE_IN, DAY_OF, EPOCH_OF, NOW_TS, POINTS, QUERY_ID, SINCE, WINDOW_DAYS, cosine_sql, point_date_sql, points, query_vector, search_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- search ------------------------------------------------------------------------------------------------------


def _search(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = searching.search(points(spark, sf_dir), query_vector(spark, sf_dir), NOW_TS, **options)
        return rounded(longs(found, "rank"), "final_score", "raw_score", "age_days")

    return run


SINCE_TS = searching.since_epoch(SINCE)
for _name, _options, _sql in (
    ("search_decay", {}, search_sql()),
    ("search_all", {"fresh": False}, search_sql(fresh=False)),
    ("search_since", {"since": SINCE}, search_sql(bound=SINCE_TS)),
    ("search_window", {"window_days": WINDOW_DAYS}, search_sql(bound=NOW_TS - WINDOW_DAYS * 86400)),
    ("search_since_and_window", {"since": "2024-01-10", "window_days": WINDOW_DAYS}, search_sql(bound=NOW_TS - WINDOW_DAYS * 86400)),
    ("search_steep_decay", {"rate": 1.0}, search_sql(rate=1.0)),
    ("search_wide_candidates", {"rate": 1.0, "overshoot": 50}, search_sql(rate=1.0, overshoot=50)),
):
    register(_name, _sql)(_search(**_options))


@register(
    "search_batch",
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {cosine_sql("e.embedding", "q.embedding")} AS raw
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS BIGINT) AS rank, id, round(raw, 6) AS raw_score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) <= 10""",
)
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(longs(searching.search_batch(e.withColumnRenamed("vec_id", "id"), asked, vector="embedding"), "rank"), "raw_score")


@register("search_indexed", search_sql())
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search among the candidates of a vector index; a second part comes after the index is made, a third without codes."""
    engine = MemoryEngine(spark, scratch_path(spark, "memory"), Config("memory", base_dim=64))
    engine.setup()
    p = points(spark, sf_dir)
    for part in (p.where("id_num % 10 < 6"), p.where("id_num % 10 in (6, 7)"), p.where("id_num % 10 > 7")):
        engine.codes.build()
        engine.store_.append(part)
    query = query_vector(spark, sf_dir)
    found = searching.search(engine.codes.candidates(query, 30, engine.store_.snapshot()), query, NOW_TS)
    return rounded(longs(found, "rank"), "final_score", "raw_score", "age_days")


@register("cosine_scores", f"SELECT e.vec_id AS id, round({cosine_sql('e.embedding', 'q.embedding')}, 6) AS raw_score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}) q")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return rounded(searching.cosine_scores(e, query_vector(spark, sf_dir), "embedding").select("id", "raw_score"), "raw_score")


# --- reports -----------------------------------------------------------------------------------------------------

register("stats", f"WITH {POINTS} SELECT coalesce(source, '?') AS source, count(*) AS count, count(nullif(ts_epoch, 0)) AS with_ts, count(*) - count(nullif(ts_epoch, 0)) AS no_ts FROM points GROUP BY 1")(lambda s, d: audit.stats(points(s, d, False)))
register("stats_total", f"WITH {POINTS} SELECT count(*) AS total, count(nullif(ts_epoch, 0)) AS with_ts FROM points")(lambda s, d: audit.stats_total(points(s, d, False)))
register("sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")(lambda s, d: audit.sources(table(s, d, "documents")))
register(
    "list_source",
    f"WITH {POINTS} SELECT id, source, coalesce(text, '') AS text, coalesce(strftime(make_timestamp(nullif(ts_epoch, 0) * 1000000), '%Y-%m-%d %H:%M'), '-') AS time FROM points WHERE source = 'src3' ORDER BY id_num LIMIT 20",
)(lambda s, d: audit.list_source(points(s, d, False), "src3", 20))
register("list_source_remaining", "SELECT count(*) AS total, greatest(count(*) - 20, 0) AS more FROM documents WHERE source = 'src3'")(lambda s, d: audit.source_remaining(table(s, d, "documents"), "src3", 20))
register("existing_ids", "SELECT DISTINCT doc_id AS id FROM documents WHERE source = 'src5'")(lambda s, d: table(s, d, "documents").where("source = 'src5'").select(F.col("doc_id").alias("id")).distinct())


@register(
    "find_by_file",
    "SELECT page_id AS id, url AS file_path, coalesce(CASE WHEN page_id % 3 <> 0 THEN strftime(make_timestamp((1704067200 + page_id * 7200) * 1000000), '%Y-%m-%d') END, 'no-date') AS date FROM pages WHERE url = (SELECT min(url) FROM pages)",
)
def find_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = pages.agg(F.min("url")).first()[0]
    ts = F.when(F.col("page_id") % 3 != 0, F.lit(1704067200) + F.col("page_id") * 7200)
    rows = pages.select(F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("id_num"), F.col("url").alias("file_path"), F.lit("").alias("text"), ts.alias("ts_epoch"))
    return audit.find_by_file(rows, path).select(F.col("id_num").alias("id"), "file_path", "date")


@register(
    "show_point",
    f"""WITH {POINTS}, p AS (SELECT * FROM points WHERE id = '6')
SELECT key, substr(value, 1, 200) AS value FROM (SELECT 'text' AS key, text AS value FROM p UNION ALL SELECT 'source', source FROM p UNION ALL SELECT 'section', section FROM p
UNION ALL SELECT 'file_path', '' FROM p UNION ALL SELECT 'type', type FROM p UNION ALL SELECT 'ts_epoch', CAST(ts_epoch AS VARCHAR) FROM p
UNION ALL SELECT 'id', id FROM p UNION ALL SELECT 'id_type', 'int' FROM p UNION ALL SELECT 'dim', CAST(coalesce(len(vector), 0) AS VARCHAR) FROM p) WHERE value IS NOT NULL""",
)
def show_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.show(points(spark, sf_dir), "6")


# --- duplicates --------------------------------------------------------------------------------------------------

DUPES = f"""{POINTS},
d AS (SELECT *, md5(coalesce(text, '')) AS grp, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS n, {point_date_sql()} AS pdate FROM points),
r AS (SELECT *, CASE WHEN regexp_matches(pdate, '20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]') THEN pdate ELSE '0000-00-00' END AS k FROM d WHERE n > 1),
w AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k DESC, id_num) AS rn FROM r)"""
register("find_dupes", f"WITH {DUPES} SELECT grp AS \"group\", n AS group_size, coalesce(pdate, 'no-date') AS date, id, coalesce(source, '?') AS source, substr(coalesce(text, ''), 1, 60) AS head FROM r")(lambda s, d: audit.find_dupes(points(s, d, False)))
register("dedupe_keep", f"WITH {DUPES} SELECT grp AS \"group\", id FROM w WHERE rn = 1")(lambda s, d: audit.dedupe_ranked(points(s, d, False)).where("keep").select("group", "id"))
register("dedupe_delete", f"WITH {DUPES} SELECT grp AS \"group\", id FROM w WHERE rn > 1")(lambda s, d: audit.dedupe_ranked(points(s, d, False)).where("not keep").select("group", "id"))


@register("dedupe_survivors", f"WITH {DUPES} SELECT id, source FROM points WHERE id NOT IN (SELECT id FROM w WHERE rn > 1)")
def dedupe_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir, False)
    return p.join(audit.dedupe_ranked(p).where("not keep").select("id"), "id", "left_anti").select("id", "source")


# --- deletions: what is left ---------------------------------------------------------------------------------------

FRAGMENT, REGEX, IN_SOURCE = "token", r"licen[cs]e|\bthe and\b", "src2"
FRAG_SQL = "contains(lower(coalesce(text, '')), 'token')"
RE_SQL = r"regexp_matches(coalesce(text, ''), '(?i)licen[cs]e|\bthe and\b')"


def _left(condition: Callable[[], Column]) -> Query:
    return lambda s, d: points(s, d, False).where(~F.coalesce(condition(), F.lit(False))).select("id", "source")


register("delete_ids", f"WITH {POINTS} SELECT id, source FROM points WHERE id NOT IN ('1', '5', '17', 'none')")(lambda s, d: store.delete_ids(points(s, d, False), ["1", "5", "17", "none"]).select("id", "source"))
register("delete_source", f"WITH {POINTS} SELECT id, source FROM points WHERE source IS DISTINCT FROM 'src4'")(lambda s, d: store.delete_source(points(s, d, False), "src4").select("id", "source"))
for _name, _args, _sql in (
    ("delete_text", (FRAGMENT,), FRAG_SQL),
    ("delete_text_percent", ("100%",), "contains(lower(coalesce(text, '')), '100%')"),
    ("delete_fragment_frag", (FRAGMENT,), FRAG_SQL),
    ("delete_fragment_regex", (None, REGEX), RE_SQL),
    ("delete_fragment_either", (FRAGMENT, REGEX), f"({FRAG_SQL} OR {RE_SQL})"),
    ("delete_fragment_in_source", (FRAGMENT, REGEX, IN_SOURCE), f"(({FRAG_SQL} OR {RE_SQL}) AND source = '{IN_SOURCE}')"),
):
    register(_name, f"WITH {POINTS} SELECT id, source FROM points WHERE NOT coalesce({_sql}, false)")(_left(lambda a=_args: audit.fragment_match(*a)))
register(
    "delete_fragment_counts",
    f"SELECT count(*) FILTER ({FRAG_SQL}) AS by_fragment, count(*) FILTER ({RE_SQL}) AS by_regex, count(*) FILTER ({FRAG_SQL} OR {RE_SQL}) AS matched FROM documents",
)(lambda s, d: audit.fragment_counts(table(s, d, "documents"), FRAGMENT, REGEX))

# --- scalars -------------------------------------------------------------------------------------------------------

POINT_ID_SQL = "CAST(CAST('0x' || substr(sha256({0} || '|' || {1}), 1, 16) AS UBIGINT) & 9223372036854775807::UBIGINT AS BIGINT)"
register("point_id", f"SELECT doc_id, {POINT_ID_SQL.format('source', 'text')} AS point_id FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", scalars.point_id(F.col("source"), F.col("text")).alias("point_id")))

DATED = "'order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ' due ' || CASE WHEN o_orderkey % 7 = 0 THEN '2026-02-30' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') ELSE 'soon' END"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their dates in a text; some hold two, some one that no calendar has."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    o = table(spark, sf_dir, "orders")
    day, later = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 9 DAY"), "yyyy-MM-dd")
    due = F.when(F.col("o_orderkey") % 7 == 0, "2026-02-30").when(F.col("o_orderkey") % 3 == 0, later).otherwise("soon")
    ts = F.when(F.col("o_orderkey") % 11 == 0, F.lit(0)).when(F.col("o_orderkey") % 2 == 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 3661)
    return o.select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), day, F.lit(" due "), due).alias("text"), ts.cast("long").alias("ts_epoch"))


DATED_SQL = f"o AS (SELECT o_orderkey, {DATED} AS text, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN epoch(o_orderdate) + 3661 END AS BIGINT) AS ts_epoch FROM orders)"
register("extract_date", f"WITH {DATED_SQL} SELECT o_orderkey, {DATE_IN.format('text')} AS date FROM o")(lambda s, d: dated(s, d).select("o_orderkey", scalars.extract_date(F.col("text")).alias("date")))
register("point_date", f"WITH {DATED_SQL} SELECT o_orderkey, {point_date_sql()} AS date FROM o")(lambda s, d: dated(s, d).select("o_orderkey", scalars.point_date(F.col("ts_epoch"), F.col("text")).alias("date")))
register("point_ts", f"WITH {DATED_SQL} SELECT o_orderkey, coalesce(nullif(ts_epoch, 0), {EPOCH_OF.format(DATE_IN.format('text'), '%Y-%m-%d')}) AS ts FROM o")(lambda s, d: dated(s, d).select("o_orderkey", scalars.point_ts(F.col("ts_epoch"), F.col("text")).alias("ts")))
register("format_ts", f"WITH {DATED_SQL} SELECT o_orderkey, coalesce(strftime(make_timestamp(nullif(ts_epoch, 0) * 1000000), '%Y-%m-%d %H:%M'), '-') AS time FROM o")(lambda s, d: dated(s, d).select("o_orderkey", scalars.format_ts(F.col("ts_epoch")).alias("time")))

FACT_SQL = """f AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') WHEN 2 THEN 'x' WHEN 3 THEN '2026-02-30' END AS date,
  CASE WHEN o_orderkey % 4 < 3 THEN 'seen ' || strftime(o_orderdate, '%Y-%m-%d') || ' and 2001-01-01' ELSE 'never' END AS text, CASE WHEN o_orderkey % 8 = 3 THEN 1700000000 + o_orderkey END AS mtime FROM orders)"""


@register(
    "content_ts",
    f"""WITH {FACT_SQL} SELECT o_orderkey, coalesce({EPOCH_OF.format("nullif(regexp_extract(date, '20[0-9]{2}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}'), '')", "%Y-%m-%d %H:%M")},
{EPOCH_OF.format("nullif(regexp_extract(date, '20[0-9]{2}-[0-9]{2}-[0-9]{2}'), '')", "%Y-%m-%d")}, {EPOCH_OF.format(DATE_IN.format("text"), "%Y-%m-%d")}, mtime, 1777593600) AS ts FROM f""",
)
def content_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    minute = F.date_format(when, "yyyy-MM-dd HH:mm")
    date = F.when(key % 5 == 0, minute).when(key % 5 == 1, F.replace(minute, F.lit(" "), F.lit("T"))).when(key % 5 == 2, "x").when(key % 5 == 3, "2026-02-30")
    text = F.when(key % 4 < 3, F.concat(F.lit("seen "), F.date_format(when, "yyyy-MM-dd"), F.lit(" and 2001-01-01"))).otherwise("never")
    mtime = F.when(key % 8 == 3, F.lit(1700000000) + key)
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.content_ts(date, text, mtime).alias("ts"))


_FEATURES = ("year(t)/2100", "month(t)/12", "day(t)/31", "hour(t)/24", "sin(2*pi()*dayofyear(t)/365)", "cos(2*pi()*dayofyear(t)/365)", "sin(2*pi()*hour(t)/24)", "cos(2*pi()*hour(t)/24)")
FEATURES_SQL = ", ".join(f"round(0.3 * ({f}), 9) AS f{i}" for i, f in enumerate(_FEATURES))


@register("time_features", f"SELECT event_id, {FEATURES_SQL} FROM (SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS t FROM events)")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = table(spark, sf_dir, "events").select("event_id", scalars.time_features(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("f"))
    return rows.select("event_id", *[F.round(F.col("f")[i], 9).alias(f"f{i}") for i in range(8)])


@register(
    "vector_with_time",
    f"""SELECT e.vec_id, CAST(len(e.embedding) + 8 AS BIGINT) AS dim, round(list_sum(CAST(e.embedding AS DOUBLE[])) + 0.3 * ({" + ".join(f"({f})" for f in _FEATURES)}), 4) AS total
FROM embeddings e JOIN (SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS t FROM events) v ON v.event_id = e.vec_id""",
)
def vector_with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    v = table(spark, sf_dir, "embeddings").join(events, "vec_id").select("vec_id", scalars.with_time(F.col("embedding"), F.col("ts")).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@register("decay_curve", f"SELECT event_id, round({NOW_TS}/86400.0 - floor(epoch(ts))/86400.0, 6) AS age, round(1 / (1 + 0.01 * ({NOW_TS}/86400.0 - floor(epoch(ts))/86400.0)), 9) AS decay FROM events")
def decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    age = scalars.age_days(F.unix_timestamp(F.col("ts").cast("timestamp")), NOW_TS)
    return table(spark, sf_dir, "events").select("event_id", F.round(age, 6).alias("age"), F.round(scalars.decay(age), 9).alias("decay"))


register(
    "resolve_path",
    "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'secure' || substr(url, 7) WHEN url LIKE 'http://%' THEN 'plain' || substr(url, 6) ELSE url END AS path FROM pages",
)(lambda s, d: table(s, d, "pages").select("page_id", scalars.resolve_path(F.col("url"), {}, {"https:": "secure", "http:": "plain"}).alias("path")))

SCRUB_SQL = "text"
for _pattern, _into in (
    (r"\$argon2[a-z]*\$\S+", "[REDACTED]"), (r"\$2[abxy]?\$\d{2}\$[./A-Za-z0-9]{20,}", "[REDACTED]"), (r"\bsk-[A-Za-z0-9_-]{16,}", "[REDACTED]"), (r"\bgsk_[A-Za-z0-9]{16,}", "[REDACTED]"), (r"\bcsk-[A-Za-z0-9]{16,}", "[REDACTED]"),
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]{8,}", r"\1 [REDACTED]"), (r"\b([A-Z0-9_]*_TOKEN)=\S+", r"\1=[REDACTED]"), (r"(?i)\b(password|passwd|secret|token)\b(\s*[:=]\s*)(\"[^\"]*\"|\S+)", r"\1\2[REDACTED]"),
):
    SCRUB_SQL = f"regexp_replace({SCRUB_SQL}, '{_pattern}', '{_into}', 'g')"
register("scrub_documents", f"SELECT doc_id, md5({SCRUB_SQL}) AS text_md5, contains({SCRUB_SQL}, '[REDACTED]') AS redacted FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", scrub(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.contains("t", F.lit("[REDACTED]")).alias("redacted"))
)

# --- writes: the rows a version would hold ---------------------------------------------------------------------------


def _facts(docs: DataFrame) -> DataFrame:
    return docs.select(scalars.point_id(F.col("source"), F.col("text")).cast("string").alias("id"), F.col("doc_id").alias("ord"), "source", F.col("lang").alias("section"))


ID_SQL = f"CAST({POINT_ID_SQL.format('source', 'text')} AS VARCHAR)"
NEW_SQL = f"WITH f AS (SELECT {ID_SQL} AS id, doc_id, source, lang FROM documents), l AS (SELECT * FROM f WHERE doc_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1) SELECT id, doc_id AS ord, source, lang AS section FROM l WHERE id NOT IN (SELECT id FROM f WHERE doc_id % 2 = 0)"


@register("append_new_facts", NEW_SQL)
def append_new_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(table(spark, sf_dir, "documents"))
    return store.append_new(f.where("ord % 2 = 0"), store.last_wins(f.where("ord % 2 = 1"))).select("id", "ord", "source", "section")


def memory(spark: SparkSession, sf_dir: str) -> MemoryEngine:
    """A time-aware collection in scratch space that holds the points of the tables, without vectors."""
    engine = MemoryEngine(spark, scratch_path(spark, "memory"), Config("memory-v2", base_dim=64))
    engine.setup()
    engine.store_.publish(points(spark, sf_dir, False))
    return engine


@register("append_idempotent", f"SELECT (SELECT count(DISTINCT source || '|' || {SCRUB_SQL}) FROM documents) AS stored, CAST(0 AS BIGINT) AS added, (SELECT count(DISTINCT source) FROM documents) AS sources")
def append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts ingested twice, the second time without effect."""
    engine = MemoryEngine(spark, scratch_path(spark, "memory"), Config("memory", base_dim=16))
    engine.setup()
    docs = table(spark, sf_dir, "documents")
    none = F.lit("").alias
    facts = docs.select(F.col("doc_id").alias("ord"), "text", "source", F.col("lang").alias("section"), none("file_path"), none("type"), F.lit(None).cast("string").alias("date"))
    engine.ingest(facts, "append")
    first = engine.points
    engine.ingest(facts, "append")
    second = engine.points
    stored = first.agg(F.count("*").alias("stored"))
    return stored.crossJoin(second.agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))).select("stored", (F.col("n") - F.col("stored")).alias("added"), "sources")


@register(
    "upsert_last_wins",
    f"WITH f AS (SELECT {ID_SQL} AS id, doc_id AS ord, source, lang AS section FROM documents) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord % 3, ord DESC) = 1",
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(table(spark, sf_dir, "documents"))
    parts = [store.last_wins(f.where(F.col("ord") % 3 == i)) for i in (2, 1, 0)]
    return store.upsert(store.upsert(parts[0], parts[1]), parts[2]).select("id", "ord", "source", "section")


@register(
    "replace_source",
    f"WITH f AS (SELECT {ID_SQL} AS id, doc_id AS ord, source FROM documents WHERE source <> 'src1' UNION ALL SELECT {POINT_ID_SQL.format(chr(39) + 'src1' + chr(39), 'text')}::VARCHAR, item_id, 'src1' FROM benchmark) SELECT id, max(ord) AS ord, source FROM f GROUP BY id, source",
)
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.delete_source(_facts(table(spark, sf_dir, "documents")), "src1").select("id", "ord", "source")
    new = table(spark, sf_dir, "benchmark").select(scalars.point_id(F.lit("src1"), F.col("text")).cast("string").alias("id"), F.col("item_id").alias("ord"), F.lit("src1").alias("source"))
    return store.upsert(store.last_wins(kept), store.last_wins(new)).select("id", "ord", "source")


@register("edit_payload", f"WITH {POINTS} SELECT id, CASE WHEN id = '9' THEN 'moved' ELSE source END AS source, CASE WHEN id = '9' THEN 'x' END AS note FROM points")
def edit_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = memory(spark, sf_dir)
    engine.edit_payload("009", {"source": "moved", "note": " x "}).commit()
    return engine.points.select("id", "source", F.col("extra")["note"].alias("note"))


@register("edit_text", f"WITH {POINTS} SELECT id, md5(CASE WHEN id = '9' THEN 'new text token=[REDACTED]' ELSE text END) AS text_md5, CASE WHEN id = '9' THEN {NOW_TS} ELSE ts_epoch END AS ts_epoch FROM points")
def edit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = memory(spark, sf_dir)
    engine.edit("9", "new text token=abc", now_ts=NOW_TS).commit()
    return engine.points.select("id", F.md5("text").alias("text_md5"), "ts_epoch")



def _time_part() -> list[Column]:
    """The vector's last eight numbers, which the time gives."""
    return [F.round(F.element_at("vector", i - 8).cast("double"), 5).alias(f"f{i}") for i in range(8)]


@register(
    "reindex_source",
    f"""WITH {POINTS} SELECT id, CASE WHEN source = 'src6' THEN {NOW_TS}::BIGINT ELSE ts_epoch END AS ts_epoch, CAST(CASE WHEN source = 'src6' THEN 72 ELSE 0 END AS BIGINT) AS dim,
{", ".join(f"CASE WHEN source = 'src6' THEN round(0.3 * ({f}), 5) END AS f{i}" for i, f in enumerate(_FEATURES))} FROM points, (SELECT make_timestamp({NOW_TS}::BIGINT * 1000000) AS t)""",
)
def reindex_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = memory(spark, sf_dir)
    engine.reindex_source("src6", now_ts=NOW_TS).commit()
    return engine.points.select("id", "ts_epoch", F.coalesce(F.size("vector"), F.lit(0)).cast("long").alias("dim"), *_time_part())


@register("update_vector", f"WITH {POINTS} SELECT id, CAST(CASE WHEN id = '8' THEN 72 ELSE 0 END AS BIGINT) AS dim, ts_epoch FROM points")
def update_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of its own; time and payload stay."""
    engine = memory(spark, sf_dir)
    engine.update_vector("8", now_ts=NOW_TS).commit()
    return engine.points.select("id", F.coalesce(F.size("vector"), F.lit(0)).cast("long").alias("dim"), "ts_epoch")


@register("store_one", f"WITH {POINTS} SELECT source, count(*) AS n, CAST(max(CASE WHEN source = 'web' THEN 72 ELSE 0 END) AS BIGINT) AS dim FROM (SELECT source FROM points UNION ALL SELECT 'web') GROUP BY 1")
def store_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = memory(spark, sf_dir)
    engine.store("the web server listens on port 80", "web", now_ts=NOW_TS)
    return engine.points.groupBy("source").agg(F.count("*").alias("n"), F.max(F.coalesce(F.size("vector"), F.lit(0)).cast("long")).alias("dim"))


@register("dedupe_commit", f"WITH {DUPES} SELECT id, source FROM points WHERE id NOT IN (SELECT id FROM w WHERE rn > 1)")
def dedupe_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = memory(spark, sf_dir)
    engine.dedupe().commit()
    return engine.points.select("id", "source")


@register("delete_commit", f"WITH {POINTS} SELECT id, source FROM points WHERE NOT coalesce({FRAG_SQL} OR {RE_SQL}, false) AND source IS DISTINCT FROM 'src4' AND id <> '17'")
def delete_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deletions one after the other: by identifier, by source, by text."""
    engine = memory(spark, sf_dir)
    engine.delete_ids(["17", "none"]).commit()
    engine.delete_source("src4").commit()
    engine.delete_fragment(FRAGMENT, REGEX).commit()
    return engine.points.select("id", "source")


@register("delete_fragment_indexed", f"WITH {POINTS} SELECT id, source FROM points WHERE NOT coalesce({FRAG_SQL} OR {RE_SQL}, false) AND NOT contains(lower(coalesce(text, '')), 'password')")
def delete_fragment_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions by text over a collection with a text index; the points of a second part come without one."""
    engine = MemoryEngine(spark, scratch_path(spark, "memory"), Config("memory-v2", base_dim=64))
    engine.setup()
    p = points(spark, sf_dir, False)
    engine.store_.append(p.where("id_num % 10 <> 3"))
    engine.texts.build()
    engine.store_.append(p.where("id_num % 10 = 3"))
    engine.delete_text("password").commit()
    engine.delete_fragment(FRAGMENT, REGEX).commit()
    return engine.points.select("id", "source")


BACKUP_SQL = f"""WITH {POINTS} SELECT '{{"id":' || to_json(id) || ',"payload":{{' || concat_ws(',', '"text":' || to_json(text), '"source":' || to_json(source), '"section":' || to_json(section), '"file_path":""', '"type":' || to_json(type), '"ts_epoch":' || ts_epoch) || '}}}}' AS value FROM points"""


@register("backup_export", BACKUP_SQL)
def backup_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a backup, read back from its files."""
    return spark.read.text(memory(spark, sf_dir).backup())


register("setup_dims", "SELECT * FROM (VALUES ('memory', CAST(384 AS BIGINT), false), ('memory-v2', CAST(392 AS BIGINT), true)) t(collection, dim, time_aware)")(lambda s, d: _dims(s))


def _dims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.collection, c.dim, c.time_aware) for c in (Config("memory"), Config("memory-v2"))], "collection string, dim long, time_aware boolean")


# --- parsers ---------------------------------------------------------------------------------------------------------

MARKDOWN = "# A title line that is certainly longer than forty characters\n## Services\n| **web** | 8080 | nginx | active |\n| **short** | 1 |\n- **bold** item\n    indented line is skipped\nProse that is longer than forty characters is documentation.\nshort prose\n"
CHANGELOG = "- bullet before any header is dropped\n## 2026-08-10 06:20 — title\n- - detail\n## not a dated header\n- still dated by the previous header\n"
PROXY = "server {\n listen 80;\n listen 443 ssl;\n server_name a.example b.example;\n limit_req_zone x rate=10r/s;\n location / { proxy_pass http://127.0.0.1:3000; }\n location /b { proxy_pass https://127.0.0.1:4000/b; }\n}\n"
UNIT = "[Unit]\nDescription=Web server\n[Service]\nExecStartPre=/bin/true\nExecStart=/usr/bin/web --port 80\n"


README = "# heading that is longer than thirty characters\n\na paragraph that is longer than thirty characters,\non two lines\n\nshort\n\n```\ncode that is longer than thirty characters\n"
TREE: dict[str, str | bytes] = {
    "docs.md": MARKDOWN, "dos.md": MARKDOWN.replace("\n", "\r\n"), "CHANGELOG.md": CHANGELOG,
    "www/p1/README.md": README, "www/p1/node_modules/x/README.md": README, "www/p2/sub/INSTRUKCJA-a.md": README, "www/p2/notes.md": README, "www/README.md": README,
    "proxy/a.conf": PROXY, "proxy/none.conf": "server { server_name x; }", "proxy/default": PROXY, "proxy/bad": b"listen 1; proxy_pass http://x;\xff\xfe",
    "units/web.service": UNIT, "units/pre.service": "[Service]\nExecStartPre=/bin/true\n", "units/bad.service": b"ExecStart=\xff\xfe", "units/note.txt": UNIT,
}


def tree(spark: SparkSession, docs: str = "docs.md") -> tuple[str, Config]:
    """Files written to scratch space, and the configuration that points to them."""
    root = write_files(spark, scratch_path(spark, "tree") + "/tree", TREE)
    plain = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
    return root, Config("memory", base_dim=16, docs=f"{root}/{docs}", changelog=f"{root}/CHANGELOG.md", www_root=f"{plain}/www", proxy_dir=f"{root}/proxy", unit_dir=f"{root}/units")


def _values(rows: list[tuple[str, ...]], names: str) -> str:
    cells = ", ".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {cells}) t({names})"


def _read(name: str, kinds: tuple[str, ...], docs: str = "docs.md") -> Query:
    """A source's facts of some kinds, from its files through the registry."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = default_sources(spark, tree(spark, docs)[1])[name]
        facts = source.parser(source.files(spark))
        return facts.where(F.col("type").isin(*kinds)).select("text", "type", "section", "source", F.substring_index("file_path", "/tree/", -1).alias("file"))

    return run


_TITLE, _PROSE, _NAMES = "# A title line that is certainly longer than forty characters", "Prose that is longer than forty characters is documentation.", "text, type, section, source, file"
for _name, _source, _docs, _rows in (
    ("md_table_rows", "vps-docs", "docs.md", [("Services: web — 8080 | nginx | active", "service", "Services", "vps-docs", "docs.md")]),
    ("md_bullets", "vps-docs", "docs.md", [("Services: bold** item", "config", "Services", "vps-docs", "docs.md")]),
    ("md_sections", "vps-docs", "dos.md", [(f": {_TITLE}", "documentation", "", "vps-docs", "dos.md"), (f"Services: {_PROSE}", "documentation", "Services", "vps-docs", "dos.md")]),
    ("changelog_facts", "changelog", "docs.md", [(f"2026-08-10 06:20: {t}", k, "changelog", "changelog", "CHANGELOG.md") for t, k in (("title", "changelog-entry"), ("detail", "changelog-detail"), ("still dated by the previous header", "changelog-detail"))]),
    ("project_files", "instructions", "docs.md", [(f"[{p}] a paragraph that is longer than thirty characters, on two lines", "project-doc", p, f"project-{p}", f) for p, f in (("p1", "www/p1/README.md"), ("p2", "www/p2/sub/INSTRUKCJA-a.md"))]),
    ("proxy_routes", "nginx", "docs.md", [(f"nginx: a.example b.example → {t} (port {p}) | rate limit: 10r/s", "nginx-route", "nginx-routes", "nginx-routes", "proxy/a.conf") for p in ("80", "443 ssl") for t in ("http://127.0.0.1:3000", "https://127.0.0.1:4000/b")]),
    ("service_units", "systemd", "docs.md", [("systemd service web: /usr/bin/web --port 80 (Web server)", "systemd", "systemd-services", "systemd-services", "units/web.service")]),
):
    register(_name, _values(_rows, _NAMES))(_read(_source, tuple({r[1] for r in _rows}), _docs))
register("static_facts", _values([(t, "infrastructure", s, "infrastructure", "rules") for s, t in STATIC], _NAMES))(
    lambda s, d: parsers.static_facts(s, list(STATIC)).select("text", "type", "section", "source", F.col("file_path").alias("file"))
)
register("skipped_files", _values([("proxy/bad", "no UTF-8 text"), ("units/bad.service", "no UTF-8 text")], "file, reason"))(
    lambda s, d: skipped_files(s, tree(s)[0], recursive=True).select(F.substring_index("path", "/tree/", -1).alias("file"), "reason")
)


@register(
    "ingest_sources",
    "SELECT * FROM (VALUES ('vps-docs', 4), ('changelog', 3), ('project-p1', 1), ('project-p2', 1), ('nginx-routes', 4), ('systemd-services', 1), ('infrastructure', 2)) t(source, points)",
)
def ingest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources from files into a collection, twice, and one of them replaced."""
    engine = MemoryEngine(spark, scratch_path(spark, "memory"), tree(spark)[1])
    engine.setup()
    sources = default_sources(spark, engine.config)
    for only, replace in ((None, False), (None, False), ("changelog", True)):
        done = ingest_all(engine, sources, only, replace)
        if failed := [n for n in done.values() if not isinstance(n, int)]:
            raise RuntimeError(failed[0])
    return engine.points.groupBy("source").agg(F.count("*").cast("int").alias("points"))


@register(
    "markdown_files",
    r"""WITH l AS (SELECT source, rtrim(unnest(regexp_split_to_array(text, '\r\n|\r|\n')), ' ' || chr(9) || chr(11) || chr(12)) AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT source, line, CASE WHEN starts_with(line, '## ') OR starts_with(line, '### ') THEN NULL WHEN starts_with(line, '| **') THEN NULL WHEN starts_with(line, '```') OR starts_with(line, '    ') THEN NULL
  WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'config' WHEN length(line) > 40 AND NOT starts_with(line, '|') THEN 'documentation' END AS type FROM l WHERE line <> '')
SELECT source AS folder, type, count(*) AS n FROM k WHERE type IS NOT NULL GROUP BY ALL""",
)
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as text files, a folder a source, read back as files and parsed line by line."""
    root = scratch_path(spark, "files")
    table(spark, sf_dir, "documents").where("text is not null").select("text", "source").write.partitionBy("source").text(root)
    facts = parsers.markdown_facts(read_files(spark, root, "*.txt", recursive=True))
    return facts.groupBy(F.regexp_extract("file_path", "source=([^/]*)/", 1).alias("folder"), "type").agg(F.count("*").alias("n"))


@register(
    "project_paragraphs",
    """WITH p AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS p FROM documents)
SELECT doc_id, md5(substr('[p' || doc_id || '] ' || p, 1, 800)) AS text_md5 FROM p WHERE length(p) > 30 AND NOT starts_with(p, '#') AND NOT starts_with(p, '```')""",
)
def project_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("/var/www/p"), F.col("doc_id"), F.lit("/README.md")).alias("path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("value"))
    return parsers.project_facts(files).select(F.substring("section", 2, 20).cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


register("facts_per_source", f"SELECT source, count(*) AS facts, count(DISTINCT {POINT_ID_SQL.format('source', 'text')}) AS stored FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("facts"), F.countDistinct(scalars.point_id(F.col("source"), F.col("text"))).alias("stored"))
)
register("day_of_points", f"WITH {POINTS} SELECT {DAY_OF.format('ts_epoch')} AS day, count(*) AS n FROM points WHERE ts_epoch >= {SINCE_TS} GROUP BY 1")(
    lambda s, d: searching.time_filter(points(s, d, False), NOW_TS, SINCE).groupBy(F.date_format(F.timestamp_seconds("ts_epoch"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
)
