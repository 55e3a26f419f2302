"""Written intermediate tables and small session helpers.

A stage is a Parquet table in the folder that the session names in ``spark.checkpoint.dir``.  Every executor can read
it, so the loss of an executor costs no more than the tasks it was running, and lineage ends there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="fathomline-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    _made.append((spark, own))
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder is left to its owner
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        _remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/fathomline/{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def together(run: Callable, items: list) -> list:
    """``run`` of each item at once: jobs that are too small to keep all cores busy."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(run, items))


def drop_stage(df: DataFrame) -> None:
    """Delete a stage that nothing will read any more (a frame that is no stage is left alone)."""
    path = getattr(df, "_stage_path", None)
    if path is not None:
        _remove(df.sparkSession, path)


def width(spark: SparkSession) -> int:
    """Partitions for the range and hash exchanges that are laid out by hand."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
