"""Scalar functions as Column expressions; no UDF among them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates that count, the scale of time features.
DATE = r"(?U)20\d{2}-\d{2}-\d{2}"
DATE_TIME = r"(?U)20\d{2}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
TIME_SCALE = 0.3
LINE_BREAK = r"\r\n|\r|\n"


def point_id(source: Column, text: Column) -> Column:
    """63 bits of the SHA-256 of source, a bar and text: equal facts get equal identifiers."""
    head = F.substring(F.sha2(F.concat(source, F.lit("|"), text), 256), 1, 16)
    return F.conv(head, 16, -10).cast("long").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def normalize_id(point_id: object) -> str:
    """An identifier as points carry it: what reads as a whole number is that number, so "007" and 7 are one."""
    text = str(point_id)
    try:
        return str(int(text))
    except ValueError:
        return text


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def extract_date(text: Column) -> Column:
    """The greatest date-like string of a text, not validated; null if there is none."""
    return F.array_max(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)))


def real_ts(ts_epoch: Column) -> Column:
    """0 counts as missing."""
    return F.nullif(ts_epoch, F.lit(0))


def point_date(ts_epoch: Column, text: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(real_ts(ts_epoch)), "yyyy-MM-dd"), extract_date(text))


def _midnight(date: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))


def point_ts(ts_epoch: Column, text: Column) -> Column:
    """Epoch of a point, else of the greatest date in its text; null if that is no date."""
    return F.coalesce(real_ts(ts_epoch), _midnight(extract_date(text)))


def format_ts(ts_epoch: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(real_ts(ts_epoch)), "yyyy-MM-dd HH:mm"), F.lit("-"))


def age_days(ts: Column, now_ts: Column | float) -> Column:
    return (F.lit(now_ts) if not isinstance(now_ts, Column) else now_ts) / F.lit(86400.0) - ts / F.lit(86400.0)


def decay(age: Column, rate: float = 0.01) -> Column:
    """Hyperbolic decay; null where the divisor is 0."""
    return F.try_divide(F.lit(1.0), F.lit(1.0) + F.lit(float(rate)) * age)


def time_features(ts: Column) -> Column:
    """Eight doubles: year, month, day and hour scaled, and the day of year and the hour on circles."""
    t = F.timestamp_seconds(ts)
    hour, day = F.hour(t), F.dayofyear(t)
    turn = 2 * F.pi()
    plain = [F.year(t) / 2100, F.month(t) / 12, F.day(t) / 31, hour / 24]
    round_ = [F.sin(turn * day / 365), F.cos(turn * day / 365), F.sin(turn * hour / 24), F.cos(turn * hour / 24)]
    return F.array(*[x * TIME_SCALE for x in plain + round_])


def with_time(vector: Column, ts: Column) -> Column:
    return F.concat(vector.cast("array<float>"), time_features(ts).cast("array<float>"))


def resolve_path(path: Column, special: Mapping[str, str], prefixes: Mapping[str, str]) -> Column:
    """A special path's target, else the path with the first fitting prefix replaced, else the path; empty: null."""
    out = path
    for old, new in reversed(prefixes.items()):
        fits = (path == old) | path.startswith(old + "/")
        out = F.when(fits, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
    for old, new in reversed(special.items()):
        out = F.when(path == old, F.lit(new)).otherwise(out)
    return F.when(F.coalesce(path, F.lit("")) != "", out)


def content_ts(date: Column, text: Column, mtime: Column, fallback_date: str = "2026-05-01", time_zone: str = "UTC") -> Column:
    """Epoch of a fact's content: its date with the minute, its date, the greatest date in its text, the file's time,
    then midnight of a fixed day in a time zone. A step that does not parse falls to the next."""
    minute = F.regexp_extract(date, DATE_TIME, 0)
    day = F.regexp_extract(date, DATE, 0)
    steps = [F.unix_timestamp(F.try_to_timestamp(minute, F.lit("yyyy-MM-dd HH:mm"))), _midnight(day), _midnight(extract_date(text)), mtime.cast("long")]
    fixed = int(datetime.strptime(fallback_date, "%Y-%m-%d").replace(tzinfo=ZoneInfo(time_zone)).timestamp())
    return F.coalesce(*steps, F.lit(fixed).cast("long"))


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lstrip_set(c: Column, characters: str) -> Column:
    """Any of these characters off the start."""
    return F.ltrim(c, F.lit(characters))


def cells(line: Column) -> Column:
    """Cells of a table row, stripped, without empty ones."""
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def contains_text(text: Column, fragment: str) -> Column:
    """Case-insensitive literal substring; a null text is empty."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(fragment.lower()))


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode classes."""
    return F.coalesce(text, F.lit("")).rlike(f"(?iuU){pattern}")
