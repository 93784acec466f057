"""Scratch space that driver and executors share, and small files written through Spark's file systems."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; then a temporary folder of this machine is used.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext.getCheckpointDir()
    if set_to:
        if not found:
            spark.sparkContext.setCheckpointDir(set_to)
        return set_to.rstrip("/")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="engram-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/engram-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder if the session still lives."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def create_file(spark: SparkSession, path: str, data: bytes) -> bool:
    """Writes a small file that must not be there yet; False if it is.

    The bytes are written under another name first, so a crash leaves no half of a file under its own. Then that name is
    taken: by a hard link on a local file system and by a rename that doesn't overwrite elsewhere, of which one of two
    writers alone succeeds where the file system's rename is atomic, as HDFS has it. On an object store the rename checks
    first and copies then: there, one writer at a time must be seen to.
    """
    fs, where = file_system(spark, path)
    if fs.exists(where):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getScheme() == "file":
            files, plain = spark._jvm.java.nio.file.Files, lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            files.createLink(plain(where), plain(draft))
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(draft, where, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder last changed; 0 if there is none."""
    fs, where = file_system(spark, path)
    return max(0.0, time.time() - fs.getFileStatus(where).getModificationTime() / 1000) if fs.exists(where) else 0.0


def read_file(spark: SparkSession, path: str) -> str | None:
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, sorted, without hidden ones; none if there is no folder."""
    fs, where = file_system(spark, folder)
    return sorted(n for f in fs.listStatus(where) if not (n := f.getPath().getName()).startswith(".")) if fs.exists(where) else []


def write_files(spark: SparkSession, root: str, files: Mapping[str, str | bytes]) -> str:
    """Small files under a root, by relative path; returns the root."""
    for name, text in files.items():
        create_file(spark, f"{root}/{name}", text if isinstance(text, bytes) else text.encode())
    return root
