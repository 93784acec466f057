"""A collection as Parquet parts and versions: a version is a small file that is created once and names its parts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..schema import POINT
from ..shared import age_seconds, create_file, list_names, read_file, remove_path, scratch_path

#: Parts of a version beyond which the next write puts the smaller ones together; sources that a write replaces by name;
#: sets of dead rows of a part beyond which the next change puts them into one.
MOST_PARTS, MOST_SOURCES, MOST_DEAD = 64, 1000, 64
#: Identifiers that are looked up as literals, which reach the scan; more are joined.
MOST_LITERALS = 10
#: How long a part may be in the making before vacuum takes it for a crashed writer's.
STALE_SECONDS = 86_400
#: Rows of a set of dead rows that share a bitmap.
BITMAP_ROWS = 32_768

COLUMNS = [f.split()[0] for f in POINT.split(", ")]
PLACE = ("_part", "_file", "_row")
#: The number of a row that is at rest in scratch space.
NUMBER = "_number"
DEAD = "file string, bucket long, bits binary"


@dataclass(frozen=True)
class Snapshot:
    """A version and its parts; a plan that is made on one is committed on it or not at all."""

    version: int
    parts: list[dict]


class Store:
    """Points under root, on any file system Spark reaches.

    A version lists parts, each with the sources whose rows in it no longer count, and with sets of dead rows: bitmaps by
    file and run of rows. Adding points writes a part of them alone. Changing points marks their rows dead and writes the
    new rows, so one point of a source with many costs one row. Version files are created whole and never replaced, so a
    reader always finds the last whole version, a crash leaves the version before, and of two writers that start from one
    version the second gets a RuntimeError.

    Rows of a part are in ranges of source and identifier, with Bloom filters on the identifier and short pages: a lookup
    by identifier or source skips files, row groups and pages. A part's bounds of ts_epoch are in the version, so a search
    with a bound on time doesn't open parts beyond it.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    def setup(self) -> bool:
        """Makes an empty collection; False if there is one."""
        about = {"collection": self.config.collection, "dim": self.config.dim, "metric": self.config.metric, "time_aware": self.config.time_aware}
        create_file(self.spark, f"{self.root}/config.json", json.dumps(about).encode())
        return create_file(self.spark, self._version_path(0), b"[]")

    # versions

    def _version_path(self, version: int) -> str:
        return f"{self.root}/versions/v{version:08d}.json"

    def _versions(self) -> list[int]:
        """Numbers of all version files, torn ones too."""
        names = list_names(self.spark, f"{self.root}/versions")
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def _parts_of(self, version: int) -> list[dict] | None:
        """None for a torn file."""
        try:
            return json.loads(read_file(self.spark, self._version_path(version)) or "")
        except ValueError:
            return None

    def _state(self) -> tuple[int, list[dict]]:
        """The last whole version and its parts; torn version files don't count."""
        for version in reversed(self._versions()):
            parts = self._parts_of(version)
            if parts is not None:
                return version, parts
        return -1, []

    def version(self) -> int:
        return self._state()[0]

    def snapshot(self) -> Snapshot:
        found = Snapshot(*self._state())
        if found.version < 0:
            raise LookupError("the collection is not set up")
        return found

    def _commit(self, version: int, parts: list[dict]) -> int:
        """The version after this one, past the names of torn files; the parts are no longer in the making."""
        later = [v for v in self._versions() if v > version]
        target = max([version, *later]) + 1
        try:
            if any(self._parts_of(v) is not None for v in later) or not create_file(self.spark, self._version_path(target), json.dumps(parts).encode()):
                raise RuntimeError("another writer published first; nothing has changed")
        finally:
            for name in {n for p in parts for n in (p["part"], *p.get("dead", []))} & set(list_names(self.spark, f"{self.root}/writing")):
                remove_path(self.spark, f"{self.root}/writing/{name}")
        return target

    def _new(self) -> str:
        """A name for a part or set in the making, which vacuum leaves alone."""
        name = uuid.uuid4().hex
        create_file(self.spark, f"{self.root}/writing/{name}", b"")
        return name

    # reading

    def points(self, base: Snapshot | None = None, since: float | None = None) -> DataFrame:
        """All points; with since those of parts that may hold a ts_epoch at or after it."""
        return self._read((base or self.snapshot()).parts, since=since).select(*COLUMNS)

    def located(self, base: Snapshot | None = None) -> DataFrame:
        """Points with the part, file and row they are in."""
        return self._read((base or self.snapshot()).parts, located=True)

    def _read(self, parts: Sequence[dict], located: bool = False, since: float | None = None, files: Collection[str] | None = None) -> DataFrame:
        """One scan of the parts without dead rows and one of those with some; of some of their files, if named."""
        if since is not None:
            parts = [p for p in parts if "ts" not in p or (p["ts"] and p["ts"][1] >= since)]
        if files is not None:
            held = {p["part"]: [n for n in list_names(self.spark, f"{self.root}/points/{p['part']}") if n in files] for p in parts}
            parts = [p | {"files": held[p["part"]]} for p in parts if held[p["part"]]]
        found = [self._scan(some, located) for some in ([p for p in parts if not p.get("dead")], [p for p in parts if p.get("dead")]) if some]
        if not found:
            return self.spark.createDataFrame([], POINT + ", _part string, _file string, _row long" if located else POINT)
        return reduce(DataFrame.unionByName, found)

    def _scan(self, parts: Sequence[dict], located: bool) -> DataFrame:
        paths = [f"{self.root}/points/{p['part']}{'/' if f else ''}{f}" for p in parts for f in p.get("files", [""])]
        rows = self.spark.read.schema(POINT).parquet(*paths)
        if located or any(p.get("dead") for p in parts):
            rows = rows.select(*COLUMNS, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        rows = self.counting(rows, parts)
        return rows.select(*COLUMNS, *PLACE) if located else rows.select(*COLUMNS)

    def counting(self, rows: DataFrame, parts: Sequence[dict]) -> DataFrame:
        """Rows of parts (with source; with _file and _row where rows are dead) that count."""
        part = F.col("_part") if "_part" in rows.columns else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        alike: dict[tuple, list[str]] = {}
        for p in parts:
            alike.setdefault(tuple(p["without"]), []).append(p["part"])
        for without, names in alike.items():
            gone = F.lit(False)
            if named := [s for s in without if s is not None]:
                gone = F.coalesce(F.col("source").isin(named), F.lit(False))
            if None in without:
                gone = gone | F.col("source").isNull()
            if without:
                rows = rows.where(~(gone if len(alike) == 1 else part.isin(names) & gone))
        dead = sorted({d for p in parts for d in p.get("dead", [])})
        return self._alive(rows, dead) if dead else rows

    def _dead(self, names: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(DEAD).parquet(*[f"{self.root}/dead/{n}" for n in names])

    def _alive(self, rows: DataFrame, names: Sequence[str]) -> DataFrame:
        """Rows whose bit is not set; a bitmap is small beside the rows it stands for, the planner sees to the join."""
        bits = self._dead(names).groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("_bits"))
        keyed = bits.withColumnsRenamed({"file": "_dead_file", "bucket": "_dead_bucket"})
        joined = rows.join(keyed, (F.col("_file") == F.col("_dead_file")) & (bucket_of("_row") == F.col("_dead_bucket")), "left")
        return joined.where(F.col("_bits").isNull() | ~is_set("_bits", "_row"))

    def at(self, parts: Sequence[dict], places: DataFrame) -> DataFrame:
        """Points of parts, with their places, that are at some places (_file, _row).

        The places are written as bitmaps first: small beside the rows, so these needn't be dealt anew, and files without
        a place, known by their names, a few for each part, aren't opened.
        """
        path = scratch_path(self.spark, "places")
        bitmaps(places).write.parquet(path)
        bits = self.spark.read.schema(DEAD).parquet(path)
        rows = self._read(parts, located=True, files={r[0] for r in bits.select("file").distinct().collect()})
        keyed = bits.withColumnsRenamed({"file": "_at_file", "bucket": "_at_bucket", "bits": "_at_bits"})
        joined = rows.join(keyed, (F.col("_file") == F.col("_at_file")) & (bucket_of("_row") == F.col("_at_bucket")))
        return joined.where(is_set("_at_bits", "_row")).select(*COLUMNS, *PLACE)

    # writing

    def _write(self, points: DataFrame, few: bool = False, along: Sequence[Column] = ("source", "id")) -> dict:
        """A new part with its number of rows and bounds of time, taken as it is written."""
        name, seen = self._new(), Observation()
        rows = points.select(*COLUMNS)
        # so that a source of any size is spread; a few rows need no exchange by samples
        rows = rows.coalesce(1) if few else rows.repartitionByRange(*along)
        counted = rows.sortWithinPartitions("source", "id").observe(seen, F.count(F.lit(1)).alias("rows"), F.min("ts_epoch").alias("low"), F.max("ts_epoch").alias("high"))
        options = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.page.row.count.limit": "2000", "parquet.block.size": str(16 << 20)}
        counted.write.options(**options).parquet(f"{self.root}/points/{name}")
        got = seen.get
        return {"part": name, "without": [], "rows": got["rows"], "ts": None if got["low"] is None else [got["low"], got["high"]]}

    def _add(self, parts: list[dict], points: DataFrame | None, few: bool = False) -> list[dict]:
        """parts and points; where there are too many, the smaller half of the parts is written together with the points."""
        if points is None:
            return parts
        if len(parts) < MOST_PARTS:
            part = self._write(points, few)
            return [*parts, part] if part["rows"] else parts
        small = sorted(parts, key=lambda p: p.get("rows", 0))[: max(2, len(parts) // 2)]
        kept = [p for p in parts if p not in small]
        together = self._read(small).unionByName(points.select(*COLUMNS))
        return [*kept, self._write(together, along=[curve(together), F.col("id")])]

    def publish(self, points: DataFrame, base: Snapshot | None = None) -> int:
        """A version of these points alone."""
        base = base or Snapshot(*self._state())
        return self._commit(base.version, [self._write(points)])

    def append(self, points: DataFrame | None, base: Snapshot | None = None, few: bool = False) -> int:
        """A version with points added."""
        base = base or self.snapshot()
        return self._commit(base.version, self._add(base.parts, points, few))

    def replace(self, sources: Sequence[str | None], points: DataFrame | None, base: Snapshot | None = None, few: bool = False) -> int:
        """A version with points in place of all rows of some sources."""
        base = base or self.snapshot()
        if len(sources) > MOST_SOURCES:
            raise ValueError("too many sources to replace at once; publish all points")
        left = [p | {"without": sorted({*p["without"], *sources}, key=lambda s: (s is not None, s or ""))} for p in base.parts]
        return self._commit(base.version, self._add(left, points, few))

    def change(self, gone: DataFrame, points: DataFrame | None, base: Snapshot, few: bool = False) -> int:
        """A version without the rows of gone (located in base) and with points added."""
        touched = {r[0] for r in gone.select("_part").distinct().collect()}  # parts of a version are few
        name = self._new()
        dead = bitmaps(gone)
        old = {p["part"]: p.get("dead", []) for p in base.parts if p["part"] in touched}
        together = any(len(d) >= MOST_DEAD for d in old.values())
        if together:
            before = sorted({d for ds in old.values() for d in ds})
            dead = dead.unionByName(self._dead(before)).groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        dead.write.parquet(f"{self.root}/dead/{name}")
        parts = [p | {"dead": [name] if together else [*p.get("dead", []), name]} if p["part"] in touched else p for p in base.parts]
        return self._commit(base.version, self._add(parts, points, few))

    def vacuum(self, keep: int = 2) -> int:
        """Removes parts and sets of dead rows that none of the last whole versions names; returns the number of parts.

        What a writer has in the making stays; if it hasn't published within STALE_SECONDS, it is taken for dead.
        """
        whole = [p for v in reversed(self._versions()) if (p := self._parts_of(v)) is not None][:keep]
        used = {n for parts in whole for p in parts for n in (p["part"], *p.get("dead", []))}
        for name in list_names(self.spark, f"{self.root}/writing"):
            if age_seconds(self.spark, f"{self.root}/writing/{name}") < STALE_SECONDS:
                used.add(name)
            else:
                remove_path(self.spark, f"{self.root}/writing/{name}")
        gone = [p for p in list_names(self.spark, f"{self.root}/points") if p not in used]
        for part in gone:
            for kept in ("points", "terms", "codes"):
                remove_path(self.spark, f"{self.root}/{kept}/{part}")
        for name in set(list_names(self.spark, f"{self.root}/dead")) - used:
            remove_path(self.spark, f"{self.root}/dead/{name}")
        return len(gone)

    def backup(self, points: DataFrame, name: str, path: str | None = None) -> str:
        """Identifiers and payloads, without vectors, as JSON lines; returns the folder."""
        target = path or f"{self.root}/backups/{datetime.now(UTC):%Y%m%d_%H%M%S_%f}-{name}"
        backup_rows(points).write.text(target)
        return target


def bucket_of(row: str) -> Column:
    return F.expr(f"{row} div {BITMAP_ROWS}")


def is_set(bits: str, row: str) -> Column:
    """Whether the bit of a row is set in its bucket's bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (F.expr(f"({row} % {BITMAP_ROWS}) div 8") + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("long"), (F.col(row) % 8).cast("int")) == 1


def bitmaps(places: DataFrame) -> DataFrame:
    """Places (_file, _row) as bitmaps by file and run of rows."""
    return places.groupBy(F.col("_file").alias("file"), bucket_of("_row").alias("bucket")).agg(F.bitmap_construct_agg(F.col("_row") % BITMAP_ROWS).alias("bits"))


def at_rest(rows: DataFrame, path: str) -> DataFrame:
    """rows, written to scratch space and read there, numbered in NUMBER so that some can be picked."""
    rows.withColumn(NUMBER, F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.schema(rows.withColumn(NUMBER, F.lit(0).cast("long")).schema).parquet(path)


def picked(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Those rows that are numbered so.

    Of the numbers bitmaps are written, which are small beside the rows: the planner sends them to the rows, and the rows,
    which may be wide, aren't dealt anew. numbers is read once, then.
    """
    path = scratch_path(rows.sparkSession, "picked")
    numbers.groupBy(bucket_of(NUMBER).alias("_bucket")).agg(F.bitmap_construct_agg(F.col(NUMBER) % BITMAP_ROWS).alias("_bits")).write.parquet(path)
    bits = rows.sparkSession.read.schema("_bucket long, _bits binary").parquet(path)
    return rows.join(bits, bucket_of(NUMBER) == F.col("_bucket")).where(is_set("_bits", NUMBER)).select(*rows.columns)


def last_numbers(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """(key, NUMBER) of the last of the rows with one key; of those that no order tells apart, any. Only numbers are dealt."""
    return rows.groupBy(key).agg(F.max_by(NUMBER, F.coalesce(order, F.lit(-(2**63)))).alias(NUMBER))


def curve(points: DataFrame, bits: int = 6) -> Column:
    """A place on a space-filling curve over source and time, so that files and row groups of neighbouring places have narrow
    bounds of both: the bits of a hash of the source and of the time's quantile in turn. A point without time comes first."""
    edges = sorted(set(points.approxQuantile("ts_epoch", [i / 2**bits for i in range(1, 2**bits)], 0.5 / 2**bits)))
    edge = F.array(*[F.lit(int(e)) for e in edges]).cast("array<bigint>")
    at = F.coalesce(F.size(F.filter(edge, lambda e: e <= F.col("ts_epoch"))), F.lit(0))
    at = F.when(F.col("ts_epoch").isNull(), 0).otherwise(at).cast("long")
    by = F.pmod(F.xxhash64("source"), F.lit(2**bits))
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long"))
    return reduce(lambda a, b: a + b, [F.shiftleft(bit(by, i), 2 * i + 1) + F.shiftleft(bit(at, i), 2 * i) for i in range(bits)])


def with_ids(points: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows with one of these identifiers: literals that reach the scan if they are few, a join with a table if many."""
    if len(ids) <= MOST_LITERALS:
        return points.where(F.col("id").isin(list(ids)))
    return points.join(id_table(points.sparkSession, ids), "id", "left_semi")


def id_table(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"id": pa.array(sorted(set(ids)), pa.string())}))


def touched(points: DataFrame) -> list[str | None]:
    """Sources of points, one more than MOST_SOURCES at most."""
    return [r.source for r in points.select("source").distinct().limit(MOST_SOURCES + 1).collect()]


def payload(points: DataFrame):
    return F.struct("text", "source", "section", "file_path", "type", "ts_epoch", "extra")


def backup_rows(points: DataFrame) -> DataFrame:
    return points.select(F.to_json(F.struct("id", payload(points).alias("payload"))).alias("value"))


def last_wins(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Of rows with one key the last; a max over a struct, combined before the shuffle."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"), F.max(order).alias(order))
    return best.select(key, order, "r.*").select(*rows.columns)


def upsert(base: DataFrame, new: DataFrame) -> DataFrame:
    """base with rows of new in place of those that share an id, and added."""
    return base.join(new.select("id"), "id", "left_anti").unionByName(new)


def append_new(base: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose id base lacks; the anti-join stands before any embedding."""
    return new.join(base.select("id").distinct(), "id", "left_anti")


def delete_ids(points: DataFrame, ids: list[str]) -> DataFrame:
    """Rows without these identifiers, however many."""
    return points.join(id_table(points.sparkSession, ids), "id", "left_anti")


def delete_source(points: DataFrame, source: str) -> DataFrame:
    return points.where(~F.col("source").eqNullSafe(source))
