"""Lineage cuts in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Only in local mode
(unit tests, notebooks) a folder of our own is used where it is unset.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths made and not yet removed.
_live: dict[str, SparkSession] = {}
#: The paths of each open ``temporary`` block of a thread.
_thread = threading.local()


def _blocks() -> list[list[str]]:
    return _thread.__dict__.setdefault("blocks", [])


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's, or our own in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="driftset-")
        named = _own[app]
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder; removed with its ``temporary`` block, or at exit."""
    path = f"{shared_dir(spark)}/driftset-{label}-{uuid.uuid4().hex}"
    _live[path] = spark
    if _blocks():
        _blocks()[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    _live.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the interpreter exits
        if os.path.isdir(path):
            import shutil

            shutil.rmtree(path, ignore_errors=True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_live.items()):
        discard(spark, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; write what has to stay to a path from outside."""
    _blocks().append([])
    try:
        yield
    finally:
        for path in _blocks().pop():
            discard(spark, path)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (at ``path`` if given) and read it back.

    Cuts the lineage, survives lost executors, and gives the planner true
    sizes, so it broadcasts a side only below its own threshold.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
