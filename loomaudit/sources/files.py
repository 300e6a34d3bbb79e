"""Path tests and small files by Hadoop's file systems, so that any store will do."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from ..errors import InputError


def _open(path: str):
    spark = SparkSession.getActiveSession()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise InputError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="loomaudit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def exists(path: str) -> bool:
    fs, target = _open(path)
    return fs.exists(target)


def is_folder(path: str) -> bool:
    fs, target = _open(path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def listing(path: str, pattern: str) -> list[str]:
    """Files of a glob below a path, sorted."""
    fs, target = _open(f"{str(path).rstrip('/')}/{pattern}")
    return sorted(s.getPath().toString() for s in (fs.globStatus(target) or []))


def walk(path: str, suffix: str) -> list[str]:
    fs, target = _open(path)
    if not fs.exists(target):
        return []
    found, files = [], fs.listFiles(target, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(suffix) and not name.rpartition("/")[2].startswith((".", "_")):
            found.append(name)
    return sorted(found)


def read_text(path: str) -> str:
    spark = SparkSession.getActiveSession()
    return "\n".join(r.value for r in spark.read.text(str(path), wholetext=True).collect())


def write_text(path: str, text: str) -> None:
    fs, target = _open(path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
