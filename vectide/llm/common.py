"""What the operators of this subpackage share: places in the shared folder, written tables, batch bounds.

An operator cuts its lineage by writing a table below the folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs the tasks it ran and nothing before the cut.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The C library of this process, for malloc_trim; where there is none, memory is simply kept.
_LIBC = ctypes.CDLL(None)
#: Most rows and bytes that go to a Python worker at once; long texts are bounded by the bytes.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: A table is broadcast only if it has been counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: Tables of a few numbers a row are written by one task for so many shuffle partitions, twice the cores or so many tasks at least.
NARROW, NARROW_LEAST = 8, 12


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set (tests on one machine) one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vectide-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that this process has given out and not removed.
MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used."""
    MADE.append(f"{shared_dir(spark)}/vectide/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name, with more underscores before it while the input has a column of that name in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so helper columns beside it clash with nothing."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def save(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.vectide_path = path
    return out


def save_narrow(df: DataFrame, name: str) -> DataFrame:
    """:func:`save` for rows of a few numbers: fewer and larger files than the plan has partitions, without a shuffle.

    For plans whose last stage reads narrow rows too: with fewer tasks, each reads more.
    """
    spark = df.sparkSession
    most = max(NARROW_LEAST, 2 * spark.sparkContext.defaultParallelism, partitions(spark) // NARROW)
    return save(df.coalesce(most), name)


def discard(*saved: DataFrame) -> None:
    """Delete tables made by :func:`save`; nothing lazy may still read them."""
    for df in saved:
        path = getattr(df, "vectide_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in MADE:
        MADE.remove(path)


def file_row(df: DataFrame) -> Column | None:
    """A name of each row that a repeated task gives again: its file and its place there; None if rows do not come straight from files."""
    place = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit(":"), F.col("_metadata.row_index").cast("string"))
    try:
        df.select(place)
    except AnalysisException:
        return None
    return place


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what a Python worker holds at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcasting if its counted rows are within ``limit``; else leave the join to a shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def release() -> None:
    """Give memory that numpy and pyarrow have freed back to the system: idle workers stay, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases memory when its partition is done."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def trimmed_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that releases memory after each."""

    def inner(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            release()

    return inner


def text_of(column: Column | str = "text") -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the width that its owner chose for the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
