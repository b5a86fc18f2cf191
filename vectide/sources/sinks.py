"""Sinks: tables through Spark's commit protocol, several tables as one, exports, JSON documents, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.sources.readers import _status


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = True) -> str:
    """zstd Parquet. A new table is there whole or not at all; overwriting one deletes it first, so tables that are being read go through
    :mod:`vectide.sources.publish`. ``overwrite=False`` refuses an existing path."""
    w = df.write.option("compression", "zstd").mode("overwrite" if overwrite else "error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def write_tables(tables: dict[str, DataFrame]) -> None:
    """All tables beside their places first, then all renames: nothing is replaced while a table can still fail to be written. For readers
    that must never see two versions, see :mod:`vectide.sources.publish`."""
    drafts = {path: f"{path}.draft-{uuid.uuid4().hex}" for path in tables}
    for path, df in tables.items():
        write_table(df, drafts[path], overwrite=False)
    for path, df in tables.items():
        files, where = _status(df.sparkSession, path)
        files.delete(where, True)
        if not files.rename(_status(df.sparkSession, drafts[path])[1], where):
            raise OSError(f"{drafts[path]} can't be moved to {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document, written beside its place and moved there."""
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    files, where = _status(spark, draft)
    out = files.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(_status(spark, path)[1], False)
    if not files.rename(where, _status(spark, path)[1]):
        raise OSError(f"{draft} can't be moved to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str))


def merge_manifest(spark: SparkSession, path: str, changes: dict) -> dict:
    """Read, merge and write a JSON document."""
    files, where = _status(spark, path)
    merged = (json.loads(read_text(spark, path)) if files.exists(where) else {}) | changes
    write_json(spark, path, merged)
    return merged


def export(df: DataFrame, path: str, kind: str, predicate: Column | None = None) -> str:
    """The view that a predicate leaves, as jsonl, json (lines in arrays), csv with header, or parquet."""
    df = df if predicate is None else df.where(predicate)
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    if kind == "parquet":
        df.write.mode("error").parquet(path)
    elif kind == "csv":
        flat.write.mode("error").option("header", True).csv(path)
    elif kind == "jsonl":
        df.write.mode("error").json(path)
    elif kind == "json":
        # one array for each part: an array over all rows would be one task's
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).groupBy(F.spark_partition_id()).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value").write.mode("error").text(path)
    else:
        raise ContractError(f"unknown export format {kind}")
    return path
