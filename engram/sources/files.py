"""Files as rows: path, whole text, modification time. Unreadable bytes drop the file, not the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import LINE_BREAK

FILES = "path string, value string, mtime timestamp"


def _files(spark: SparkSession, path: str, pattern: str | None, recursive: bool, exclude: Sequence[str], whole: bool = True) -> DataFrame:
    # a file that goes away or can't be read while the scan runs is left out by Spark; skipped_files names it
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    plain = F.regexp_replace("path", "^file:/*", "/")
    text = [F.try_validate_utf8(F.col("content").cast("string")).alias("value"), F.col("modificationTime").alias("mtime")] if whole else []
    files = reader.load(path).select(plain.alias("path"), *text)
    for part in exclude:
        files = files.where(~F.contains("path", F.lit(part)))
    return files


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, value, mtime) of the files under a path whose name fits a glob and whose path holds no excluded string.

    Paths lose their file scheme; line ends become line feeds; text that is not UTF-8 is left out, see skipped_files.
    """
    files = _files(spark, path, pattern, recursive, exclude)
    return files.where("value is not null").withColumn("value", F.regexp_replace("value", LINE_BREAK, "\n"))


def skipped_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, reason) of the files that read_files leaves out: those that can't be read, and those that hold no text."""
    files = _files(spark, path, pattern, recursive, exclude).select("path", F.col("value").isNotNull().alias("text"))
    listed = _files(spark, path, pattern, recursive, exclude, whole=False)  # names alone: no file is opened
    found = listed.join(files, "path", "left").where("text is null or not text")
    return found.select("path", F.when(F.col("text").isNull(), "can't be read").otherwise("no UTF-8 text").alias("reason"))


def lines(files: DataFrame) -> DataFrame:
    """(path, n, line): lines in order, white space off their ends, blank ones left out."""
    split = files.select("path", F.posexplode(F.split("value", LINE_BREAK)).alias("n", "raw"))
    return split.select("path", "n", F.regexp_replace("raw", r"(?U)\s+$", "").alias("line")).where("line <> ''")
