"""What the jobs' command lines share: a configuration file read through Spark, a log, a session that is made and stopped here only."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectide.errors import ContractError
from vectide.plans.jobs import load_config
from vectide.sources.sinks import read_text


def settings(given: dict, defaults: dict) -> dict:
    """``defaults`` with what is given; a name that no default has is an error."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ContractError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def overwrite(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of; other partitions stay. Rows of a partition lie together, in files that the engine sizes."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def command_line(about: str, work: Callable[[SparkSession, str, str, dict], dict]) -> None:
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--tables", required=True, help="folder of the input tables; any path that Spark reads")
    parser.add_argument("--out", required=True, help="folder of the output; any path that Spark writes")
    parser.add_argument("--config", help="JSON file of settings; those left out keep their defaults")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(about.split(":")[0]).getOrCreate()
    try:
        print(json.dumps(work(spark, args.tables.rstrip("/"), args.out.rstrip("/"), load_config(read_text(spark, args.config)) if args.config else {})))
    finally:
        spark.stop()
