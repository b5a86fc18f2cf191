"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be sent to all tasks.
BROADCAST_ROWS = 200_000

#: Paths that the innermost scope of a thread has to delete.
_OPEN = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/vectide/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: its lineage ends there, and its rows keep what they were given."""
    path = shared_path(df.sparkSession, name)
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """What :func:`written` makes in this thread is deleted at the end, also after an error: results have to be stored elsewhere by then.

    A scope inside another one deletes its own tables only. Without a scope tables stay, as plans that read them may run at any time.
    """
    outer, _OPEN.paths = getattr(_OPEN, "paths", None), []
    mine = _OPEN.paths
    try:
        yield mine
    finally:
        _OPEN.paths = outer
        for path in mine:
            dropped(spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what :func:`written` made at ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def handed(path: str) -> None:
    """A table that a scope doesn't delete at its end is left to the scope around it, if there is one."""
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcasting if it is counted to have at most ``limit`` rows; else leave its join to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
