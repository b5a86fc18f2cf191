"""Sources: tables, metadata, JSON, id manifests, shards, synthetic windows. Paths are any that Spark's file systems reach."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.schema import METADATA, SOURCE
from vectide.sources.scratch import small


def _status(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, where


def read_table(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet file or a folder of them; only ``columns`` reach the scan."""
    files, where = _status(spark, path)
    if not files.exists(where):
        raise ContractError(f"no table at {path}")
    if files.getFileStatus(where).isDirectory():
        if not any(s.getPath().getName().endswith(".parquet") for s in files.listStatus(where)):
            raise ContractError(f"no Parquet files in {path}")
    elif not path.endswith(".parquet"):
        raise ContractError(f"{path} is no Parquet file")
    df = spark.read.parquet(path)
    return df if columns is None else select_columns(df, columns)


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a source of windows; run operators.validate.require_source for its full contract."""
    return read_table(spark, path, SOURCE.fieldNames())


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Recording metadata, CSV (inferred) or Parquet, checked."""
    df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else read_table(spark, path)
    return require_metadata(select_columns(df, METADATA.fieldNames()))


def require_metadata(df: DataFrame) -> DataFrame:
    key = METADATA.fieldNames()[0]
    nulls = df.where(" or ".join(f"{c} is null" for c in df.columns)).limit(1).count()
    if nulls:
        raise ContractError("metadata has nulls")
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(12).collect()]
    if twice:
        raise ContractError(f"metadata has duplicate keys: {twice}")
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """One id a line: none empty, no white space, strictly ascending, as many as expected. Returns row_id."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    problems = manifest_problems(lines, "value", "at").first()
    if problems["empty"] or problems["spaced"] or problems["unsorted"]:
        raise ContractError(f"manifest: {problems.asDict()}")
    if expected is not None and problems["total"] != expected:
        raise ContractError(f"manifest has {problems['total']} ids, not {expected}")
    return lines.select(F.col("value").alias("row_id"))


def manifest_problems(lines: DataFrame, value: str, at: str) -> DataFrame:
    """total, empty, spaced, unsorted. Neighbours are compared inside ranges of ``at`` and across their borders, so no task sorts all."""
    v = F.col(value)
    spark = lines.sparkSession
    part = lines.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), at).withColumn("__part", F.spark_partition_id())
    w = Window.partitionBy("__part").orderBy(at)
    inside = part.select(v.alias("v"), "__part", F.col(at).alias("at"), F.lag(v).over(w).alias("before"))
    ends = inside.groupBy("__part").agg(F.min_by("v", "at").alias("first"), F.max_by("v", "at").alias("last"))
    borders = ends.select(F.col("first").alias("v"), F.lag("last").over(Window.orderBy("__part")).alias("before"))
    across = borders.agg(F.count_if(F.col("v") <= F.col("before")).alias("across"))
    return inside.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("v") == "").alias("empty"), F.count_if(F.col("v").rlike(r"\s")).alias("spaced"), F.count_if(F.col("v") <= F.col("before")).alias("inside")).join(F.broadcast(across)).select("total", "empty", "spaced", (F.col("inside") + F.col("across")).alias("unsorted"))


def read_report(text: str, manifest: bytes, source_rows: int | None = None) -> dict:
    """A sidecar report, checked against its manifest: quota and SHA-256."""
    report = json.loads(text)
    config = report["config"]
    quota = report["source_rows"] * config["keep_per_group"] // config["group_size"]
    if report["manifest_rows"] != quota:
        raise ContractError(f"report: {report['manifest_rows']} rows, quota {quota}")
    if hashlib.sha256(manifest).hexdigest() != report["manifest_sha256"]:
        raise ContractError("report: checksum of the manifest differs")
    if source_rows is not None and report["source_rows"] != source_rows:
        raise ContractError("report: another source")
    return report


def read_shards(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """Rows of a table partitioned by ``key`` for the listed keys: a join whose side prunes partitions at run time."""
    return spark.read.parquet(path).join(small(keys.select(key).distinct()), key, "left_semi")


def synthetic_windows(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """Deterministic windows: 120 in a recording, 40 in a session, five data sets; loss and coordinates jittered by ``seed``."""
    if rows <= 0:
        raise ContractError("rows has to be positive")
    i = F.col("row_id")
    recording, session, offset = F.floor(i / 120).cast("long"), (F.floor(i / 40) % 3).cast("long"), (i % 40) * 2000
    names = F.array(*[F.lit(f"dataset_{k}") for k in "abcde"])
    kind = (recording % 5).cast("int")
    return spark.range(rows).withColumnRenamed("id", "row_id").select(
        "row_id", F.concat_ws("_-_", recording.cast("string"), session.cast("string"), offset.cast("string")).alias("window_id"),
        (kind * 3 + F.randn(seed) * 0.7 + session * 0.4).cast("float").alias("projection_x"), (kind * -2 + F.randn(seed + 1) * 0.7).cast("float").alias("projection_y"),
        F.greatest(F.lit(0.001), 0.2 + kind * 0.1 + F.randn(seed + 2) * 0.045).cast("float").alias("recon_loss"), recording.alias("big_recording_index"), session.alias("session_index"), offset.cast("long").alias("offset"),
        F.element_at(names, kind + 1).alias("dataset"), F.when(kind < 3, "EEG").otherwise("MEG").alias("modality"), F.when(kind % 2 == 0, 200.0).otherwise(400.0).cast("float").alias("sampling_rate"),
        F.element_at(F.array(*[F.lit(c) for c in (21, 23, 64, 4, 102)]), kind + 1).cast("long").alias("n_channels"),
    )


def describe(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, type) of a table; nothing is read."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "ordinal int, column_name string, type string")


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of names, sizes, times and schema of a file or folder."""
    files, where = _status(spark, path)
    found = [files.getFileStatus(where)] if files.getFileStatus(where).isFile() else sorted(files.listStatus(where), key=lambda s: s.getPath().getName())
    digest = hashlib.sha256()
    for s in found:
        digest.update(f"{s.getPath().getName()}|{s.getLen()}|{s.getModificationTime()}\n".encode())
    digest.update(spark.read.parquet(path).schema.json().encode())
    return digest.hexdigest()
