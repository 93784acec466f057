"""Read-only reports over points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_text, format_ts, matches, point_date, real_ts, text_hash
from ..schema import scroll_order


def has_ts():
    return real_ts(F.expr("try_cast(ts_epoch AS bigint)")).isNotNull()


def stats(points: DataFrame) -> DataFrame:
    """source, count, with_ts, no_ts; a missing source is '?'."""
    return points.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("count"), F.count_if(has_ts()).alias("with_ts"), F.count_if(~has_ts()).alias("no_ts"))


def stats_total(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("total"), F.count_if(has_ts()).alias("with_ts"))


def sources(points: DataFrame) -> DataFrame:
    return points.where("source is not null and source <> ''").select("source").distinct()


def list_source(points: DataFrame, source: str, limit: int = 50) -> DataFrame:
    """The first points of a source in scroll order."""
    return points.where(F.col("source") == source).orderBy(*scroll_order()).limit(limit).select("id", "source", F.coalesce("text", F.lit("")).alias("text"), format_ts(F.col("ts_epoch")).alias("time"))


def source_remaining(points: DataFrame, source: str, limit: int = 50) -> DataFrame:
    return points.where(F.col("source") == source).agg(F.count("*").alias("total")).select("total", F.greatest(F.col("total") - limit, F.lit(0).cast("long")).alias("more"))


def find_by_file(points: DataFrame, path: str) -> DataFrame:
    """Points of a file with their date, newest first; undated ones come before all, as 'no-date' sorts above digits."""
    dated = points.where(F.col("file_path") == path).withColumn("date", F.coalesce(point_date(F.col("ts_epoch"), F.col("text")), F.lit("no-date")))
    return dated.orderBy(F.desc("date"), *scroll_order())


def show(points: DataFrame, point_id: str) -> DataFrame:
    """key, value pairs of one point: core keys that are set, extra keys, the kind of id and the vector's length."""
    core = F.create_map(*[x for k in ("text", "source", "section", "file_path", "type", "ts_epoch") for x in (F.lit(k), F.col(k).cast("string"))])
    about = F.create_map(F.lit("id"), F.col("id"), F.lit("id_type"), F.when(F.col("id_num").isNotNull(), "int").otherwise("str"), F.lit("dim"), F.coalesce(F.size("vector"), F.lit(0)).cast("string"))
    extra = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    pairs = F.concat(F.map_entries(core), F.map_entries(extra), F.map_entries(about))
    return points.where(F.col("id") == point_id).select(F.explode(pairs).alias("e")).where("e.value is not null").select("e.key", F.substring("e.value", 1, 200).alias("value"))


def duplicates(points: DataFrame, by_source: bool = False) -> DataFrame:
    """Points of groups of equal texts, with group and group_size. Counted before the join, so one text may hold any
    share of the rows."""
    keyed = points.withColumn("group", text_hash(F.col("text")))
    if by_source:
        keyed = keyed.withColumn("group", F.md5(F.concat_ws("|", "source", "group")))
    counts = keyed.groupBy("group").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return keyed.join(counts, "group")


def find_dupes(points: DataFrame, by_source: bool = False) -> DataFrame:
    found = duplicates(points, by_source)
    return found.select("group", "group_size", F.coalesce(point_date(F.col("ts_epoch"), F.col("text")), F.lit("no-date")).alias("date"), "id", F.coalesce("source", F.lit("?")).alias("source"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("head"))


def rank_key():
    date = point_date(F.expr("try_cast(ts_epoch AS bigint)"), F.col("text"))
    return F.when(date.rlike(r"20\d{2}-\d{2}-\d{2}"), date).otherwise("0000-00-00")


def dedupe_ranked(points: DataFrame, by_source: bool = False) -> DataFrame:
    """Duplicates with keep: the newest of each group stays; undated ones are oldest; ties go to the first in scroll order.

    The winner is a min over a struct, combined before the shuffle; nothing orders a group's rows in one task.
    """
    found = duplicates(points, by_source).withColumn("rank_key", rank_key())
    # the greatest date first, then the least (id_num with nulls last, id)
    newest = found.groupBy("group").agg(F.max("rank_key").alias("newest"))
    tied = found.join(newest, "group").where(F.col("rank_key") == F.col("newest"))
    first = tied.groupBy("group").agg(F.min(F.struct(F.col("id_num").isNull().alias("n"), F.col("id_num").alias("v"), F.col("id").alias("i"))).alias("w")).select("group", F.col("w.i").alias("winner"))
    return found.join(first, "group").withColumn("keep", F.col("id") == F.col("winner")).drop("winner")


def fragment_match(fragment: str | None = None, regex: str | None = None, source: str | None = None):
    """Rows whose text holds the fragment or matches the pattern, within a source; neither given: ValueError."""
    if not fragment and not regex:
        raise ValueError("a fragment or a pattern is needed")
    hit = F.lit(False)
    if fragment:
        hit = hit | contains_text(F.col("text"), fragment)
    if regex:
        hit = hit | matches(F.col("text"), regex)
    return hit & (F.col("source") == source) if source else hit


def fragment_counts(points: DataFrame, fragment: str, regex: str, source: str | None = None) -> DataFrame:
    chosen = points.where(F.col("source") == source) if source else points
    a, b = contains_text(F.col("text"), fragment), matches(F.col("text"), regex)
    return chosen.agg(F.count_if(a).alias("by_fragment"), F.count_if(b).alias("by_regex"), F.count_if(a | b).alias("matched"))
