"""Small files and listings on whatever file system a path names (local disk, HDFS, object stores)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of change of every file below a folder (or of the file itself), in order of the names."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return []
    found, files, base = [], system.listFiles(where, True), system.makeQualified(where).toString()
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString().removeprefix(base)}:{f.getLen()}:{f.getModificationTime()}")
    return sorted(found)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none where it doesn't exist."""
    where, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole or not at all: written beside its place and renamed."""
    where, system = _at(spark, path)
    beside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(beside, where):  # some systems don't replace
        system.delete(where, False)
        if not system.rename(beside, where):
            raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    where, system = _at(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))


def read_json(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)
