"""Scans in bounded batches: a file stream that takes all that is there and stops, with a checkpoint to go on from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A table's files as a stream, at most ``files`` in a batch. ``path`` may name one file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each batch to a Parquet table, exactly once, until all that is there is taken."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def running_totals(spark: SparkSession, path: str, key: str, value: str, work: str) -> DataFrame:
    """(key, n, total): batch aggregates are appended to a table, and summed."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).write.mode("overwrite").parquet(f"{work}/parts/batch={number}")

    stream_table(spark, path).select(key, value).writeStream.foreachBatch(fold).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{work}/parts")
    return parts.groupBy(key).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
