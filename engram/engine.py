"""One method for each operation on a collection. Reads return DataFrames; changes return a Change to look at and commit."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.embed import Provider, provider_of
from .functions.scalars import content_ts, contains_text, normalize_id, point_date, point_id, resolve_path, time_features, with_time
from .functions.scrub import scrub
from .operators import audit
from .operators import search as searching
from .operators.codes import VectorIndex
from .operators.store import COLUMNS, MOST_SOURCES, PLACE, Snapshot, Store, at_rest, last_numbers, picked, touched, with_ids
from .operators.terms import Need, TextIndex, need_of
from .operators.vectors import VectorTable
from .schema import CORE_KEYS, scroll_order
from .shared import remove_path, scratch_path

#: Points that are written in one task, without an exchange.
FEW = 1000


@dataclass
class Change:
    """A plan over the version it was made on: located, the points it touches, with their places. Nothing changes before
    commit(), which backs them up first and is refused if another writer has published meanwhile.

    renew gives what takes their place; without it they go. A source that goes as a whole is left out by name.
    """

    located: DataFrame
    store: Store
    base: Snapshot
    name: str
    renew: Callable[[DataFrame], DataFrame] | None = None
    source: str | None = None

    @property
    def affected(self) -> DataFrame:
        return self.located.select(*COLUMNS)

    def count(self) -> int:
        return self.located.count()

    def commit(self) -> int:
        """Backs up, marks the rows dead, writes those in their place and returns the number of points touched.

        Rows that get others in their place are read several times, so they are put to rest first; of those that only go,
        the places are, and the backup reads them where they are.
        """
        path, seen = scratch_path(self.store.spark, "change"), Observation()
        rows = at_rest((self.located if self.renew else self.located.select(*PLACE)).observe(seen, F.count(F.lit(1)).alias("n")), path)
        n = seen.get["n"]
        if n:
            self.store.backup(rows if self.renew else self.store.at(self.base.parts, rows), self.name)
            if self.source is not None:
                self.store.replace([self.source], None, self.base)
            else:
                self.store.change(rows, self.renew(rows.drop(*PLACE)) if self.renew else None, self.base, few=n <= FEW)
        remove_path(self.store.spark, path)
        return n


class MemoryEngine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, provider: Provider | None = None):
        self.spark, self.config = spark, config or Config.from_settings(spark)
        spark.conf.set("spark.sql.session.timeZone", self.config.time_zone)
        self.store_ = Store(spark, root, self.config)
        self.provider = provider or provider_of(self.config.embedder, self.config.base_dim)
        self.vectors = VectorTable(spark, root, self.provider)
        self.texts, self.codes = TextIndex(self.store_), VectorIndex(self.store_)

    # reads

    @property
    def points(self) -> DataFrame:
        return self.store_.points()

    def setup(self) -> bool:
        return self.store_.setup()

    def search(self, text: str, limit: int | None = None, fresh: bool = True, since: str | None = None, window_days: float | None = None, rate: float | None = None, now_ts: float | None = None, indexed: bool = False) -> DataFrame:
        """The best points for a text; indexed: among the candidates of the vector index, instead of all."""
        now = time.time() if now_ts is None else now_ts
        query = self.provider.vector(text)
        if self.config.time_aware:
            query = query + list(self.spark.range(1).select(time_features(F.lit(int(now)))).first()[0])
        limit, bound = limit or self.config.limit, searching.time_bound(now, since, window_days, self.config.time_zone)
        if indexed:
            points = self.codes.candidates(query, limit * self.config.overshoot, self.store_.snapshot(), bound)
        else:
            points = self.store_.points(since=bound)
        return searching.search(points, query, now, limit, fresh, since, window_days, self.config.decay if rate is None else rate, self.config.overshoot, time_zone=self.config.time_zone)

    def stats(self) -> DataFrame:
        return audit.stats(self.points).orderBy("source")

    def sources(self) -> DataFrame:
        return audit.sources(self.points).orderBy("source")

    def list_source(self, source: str, limit: int = 50) -> DataFrame:
        return audit.list_source(self.points, source, limit)

    def list_source_dated(self, source: str, limit: int = 50) -> tuple[Row, DataFrame]:
        """(total, more), and the first points of a source with their dates."""
        points = self.points
        rows = points.where(F.col("source") == source).orderBy(*scroll_order()).limit(limit)
        dated = rows.select("id", point_date(F.col("ts_epoch"), F.col("text")).alias("date"), F.coalesce("text", F.lit("")).alias("text"))
        return audit.source_remaining(points, source, limit).first(), dated

    def find_by_file(self, path: str) -> DataFrame:
        return audit.find_by_file(self.points, path)

    def find_dupes(self, by_source: bool = False) -> DataFrame:
        return audit.find_dupes(self.points, by_source)

    def show(self, point_id: str) -> DataFrame:
        self._one(point_id)
        return audit.show(self.points, normalize_id(point_id))

    def backup(self, path: str | None = None) -> str:
        return self.store_.backup(self.points, "backup", path)

    def index(self) -> tuple[int, int]:
        """Brings the text and the vector index up to date; returns the numbers of parts that each gained."""
        base = self.store_.snapshot()
        return self.texts.build(base), self.codes.build(base)

    def _one(self, point_id: str) -> DataFrame:
        found = self.points.where(F.col("id") == normalize_id(point_id))
        if found.isEmpty():
            raise LookupError(f"no point {point_id}")
        return found

    # changes

    def _embedded(self, rows: DataFrame, ts: Column, few: bool = False) -> DataFrame:
        """rows with the vectors of their texts in place of vector."""
        made = self.vectors.embed(rows.withColumn("_ts", ts), few)
        vector = with_time(F.col("made"), F.col("_ts")) if self.config.time_aware else F.col("made")
        return made.withColumn("vector", vector).select(*COLUMNS)

    def _now(self, now_ts: float | None) -> Column:
        return F.lit(int(time.time() if now_ts is None else now_ts)).cast("long")

    def _change(self, condition: Column, name: str, renew: Callable[[DataFrame], DataFrame] | None = None) -> Change:
        base = self.store_.snapshot()
        return Change(self.store_.located(base).where(condition), self.store_, base, name, renew)

    def store(self, text: str, source: str = "manual", now_ts: float | None = None) -> str:
        """Adds one point under a new identifier; equal texts are not merged."""
        new_id = str(uuid.uuid4())
        row = self.spark.createDataFrame([(text, source, new_id)], "text string, source string, id string").withColumn("text", scrub(F.col("text"), self.config.blacklist))
        ts = self._now(now_ts)
        point = row.select(
            "id", F.lit(None).cast("long").alias("id_num"), "text", "source", *[F.lit("").alias(c) for c in ("section", "file_path", "type")],
            (ts if self.config.time_aware else F.lit(None).cast("long")).alias("ts_epoch"), F.create_map().cast("map<string,string>").alias("extra"),
        )
        self.store_.append(self._embedded(point, ts, few=True), few=True)
        return new_id

    def edit(self, point_id: str, text: str | None = None, now_ts: float | None = None) -> Change:
        """A new text, scrubbed and embedded again; without one, a preview that changes nothing."""
        self._one(point_id)
        if not text:
            return self._change(F.lit(False), "edit")
        new, now = scrub(F.lit(text), self.config.blacklist), self._now(now_ts)
        columns = {"text": new} | ({"ts_epoch": now} if self.config.time_aware else {})
        return self._change(F.col("id") == normalize_id(point_id), "edit", lambda rows: self._embedded(rows.withColumns(columns), now, few=True))

    def edit_payload(self, point_id: str, pairs: Mapping[str, str]) -> Change:
        """Sets keys of one point; its vector stays. Texts are scrubbed; a ts_epoch that is no number becomes null."""
        self._one(point_id)
        columns: dict[str, Column] = {}
        extra = {k.strip(): v.strip() for k, v in pairs.items() if k.strip() not in CORE_KEYS}
        for k, v in ((k.strip(), v.strip()) for k, v in pairs.items()):
            if k in CORE_KEYS:
                columns[k] = F.lit(v).try_cast("bigint") if k == "ts_epoch" else scrub(F.lit(v), self.config.blacklist) if k == "text" else F.lit(v)
        if extra:
            new = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), F.lit(v))])
            old = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(extra)))
            columns["extra"] = F.map_concat(old, new)
        return self._change(F.col("id") == normalize_id(point_id), "edit-payload", lambda rows: rows.withColumns(columns))

    def update_vector(self, point_id: str, time_mode: str = "now", now_ts: float | None = None) -> Change:
        self._one(point_id)
        ts = self._now(now_ts) if time_mode == "now" else F.coalesce("ts_epoch", self._now(now_ts))
        return self._change(F.col("id") == normalize_id(point_id), "update-vector", lambda rows: self._embedded(rows, ts, few=True))

    def reindex_source(self, source: str, preserve_ts: bool = False, now_ts: float | None = None) -> Change:
        """Embeds a source's texts again; a time-aware collection's points become fresh unless preserve_ts."""
        now = F.coalesce("ts_epoch", self._now(now_ts)) if preserve_ts else self._now(now_ts)

        def renew(rows: DataFrame) -> DataFrame:
            return self._embedded(rows.withColumn("ts_epoch", now) if self.config.time_aware else rows, now)

        return self._change(F.col("source") == source, "reindex", renew)

    def delete_ids(self, ids: list[str]) -> Change:
        base = self.store_.snapshot()
        return Change(with_ids(self.store_.located(base), [normalize_id(i) for i in ids]), self.store_, base, "delete-id")

    def delete_source(self, source: str) -> Change:
        base = self.store_.snapshot()
        return Change(self.store_.located(base).where(F.col("source") == source), self.store_, base, "delete-source", source=source)

    def delete_text(self, fragment: str) -> Change:
        return self._matching(contains_text(F.col("text"), fragment), need_of(fragment), "delete-text")

    def delete_fragment(self, fragment: str | None = None, regex: str | None = None, source: str | None = None) -> Change:
        if regex:
            # an invalid pattern is refused here, by the regex engine that will run it
            try:
                self.spark._jvm.java.util.regex.Pattern.compile(f"(?iuU){regex}")
            except Exception as e:
                raise ValueError(f"no valid pattern: {regex}") from e
        return self._matching(audit.fragment_match(fragment, regex, source), need_of(fragment, regex), "delete-fragment")

    def _matching(self, condition: Column, need: Need, name: str) -> Change:
        """A deletion by text: what the text index finds is looked at, and every row of parts that have none."""
        base = self.store_.snapshot()
        return Change(self.texts.located(need, base).where(condition), self.store_, base, name)

    def dedupe(self, by_source: bool = False) -> Change:
        base = self.store_.snapshot()
        points = self.store_.located(base)
        gone = audit.dedupe_ranked(points.select(*COLUMNS), by_source).where(~F.col("keep"))
        return Change(points.join(gone.select("id"), "id", "left_semi"), self.store_, base, "dedupe")

    # ingest

    def named(self, facts: DataFrame) -> DataFrame:
        """Facts scrubbed and named by content; equal ones have one name."""
        named = facts.withColumn("text", scrub(F.col("text"), self.config.blacklist)).withColumn("id_num", point_id(F.col("source"), F.col("text")))
        return named.withColumn("id", F.col("id_num").cast("string"))

    def points_of(self, named: DataFrame, mtimes: DataFrame | None = None, few: bool = False) -> DataFrame:
        """Points of named facts, with the times of their content and their vectors."""
        named = named.withColumn("_path", resolve_path(F.col("file_path"), self.config.special_paths, self.config.path_map))
        if mtimes is not None:
            named = named.join(mtimes.select(F.col("path").alias("_path"), F.unix_timestamp("mtime").alias("_mtime")), "_path", "left")
        else:
            named = named.withColumn("_mtime", F.lit(None).cast("long"))
        ts = content_ts(F.col("date"), F.col("text"), F.col("_mtime"), self.config.fallback_date, self.config.time_zone)
        dated = named.withColumns({"_at": ts, "extra": F.create_map().cast("map<string,string>")})
        return self._embedded(dated.withColumn("ts_epoch", F.col("_at") if self.config.time_aware else F.lit(None).cast("long")), F.col("_at"), few)

    def ingest(self, facts: DataFrame, mode: str = "replace", mtimes: DataFrame | None = None) -> int:
        """Stores facts: replace clears the facts' sources first, append adds those that are new. No facts: no change.

        Returns the number of different facts, of equal ones the last. All are written to the shared folder once, and all
        that follows reads them there and picks them by number, so texts move only where vectors meet them and where a
        part is laid out. It ends in a commit on the version that stood when it began, or in none.
        """
        base, path, names, seen = self.store_.snapshot(), scratch_path(self.spark, "facts"), scratch_path(self.spark, "names"), Observation()
        named = at_rest(self.named(facts), path)
        known = self.store_.points(base).select("id").distinct().withColumn("_known", F.lit(True))
        last = last_numbers(named).join(known, "id", "left") if mode == "append" else last_numbers(named).withColumn("_known", F.lit(None).cast("boolean"))
        fresh = F.col("_known").isNull()
        last.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("fresh")).write.parquet(names)
        n, new = seen.get["n"], seen.get["fresh"]
        if n:
            few = new <= FEW
            named = picked(named, self.spark.read.schema(last.schema).parquet(names).where(fresh))
            if mode == "append":
                self.store_.append(self.points_of(named, mtimes, few) if new else None, base, few)
            else:
                sources = touched(named)
                points = self.points_of(named, mtimes, few)
                if len(sources) > MOST_SOURCES:
                    gone = named.select("source").distinct().withColumnRenamed("source", "_s")
                    self.store_.publish(self.store_.points(base).join(gone, F.col("source").eqNullSafe(F.col("_s")), "left_anti").unionByName(points), base)
                else:
                    self.store_.replace(sources, points, base, few)
        remove_path(self.spark, path)
        remove_path(self.spark, names)
        return n
