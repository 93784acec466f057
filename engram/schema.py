"""Row layouts of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "id string, id_num long, text string, source string, section string, file_path string, type string, ts_epoch long, extra map<string,string>, vector array<float>"
FACT = "ord long, text string, source string, section string, file_path string, type string, date string"
CORE_KEYS = ("text", "source", "section", "file_path", "type", "ts_epoch")


def scroll_order() -> list[Column]:
    """The order of a scan: numeric identifiers first, by value, then the others as strings."""
    return [F.col("id_num").asc_nulls_last(), F.col("id").asc()]
