"""Registration of queries with their SQL, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.sources.scratch import shared_path

__all__ = ["ORACLES", "QUERIES", "both", "load", "query", "shared_path", "windows", "with_windows"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def both(name: str, sql: str, tables: str = "windows", spark_sql: str | None = None) -> None:
    """A query that is one SQL text in both engines, or two."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: windows(spark, sf_dir) if t == "windows" else load(spark, sf_dir, t) for t in tables.split()}
        return spark.sql((spark_sql or sql).replace("«", "{").replace("»", "}"), **frames)

    query(name, with_windows(sql.replace("«", "").replace("»", "")) if "windows" in tables else sql.replace("«", "").replace("»", ""))(run)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's windows from the driver's tables: embeddings with an event's value as loss, nation and region as metadata."""
    v, e = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "events")
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    k = F.from_json("props", "k bigint")["k"]
    recording, session, offset = F.col("label").cast("long"), F.col("vec_id") % 3, F.col("vec_id") * 2000
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return (
        v.join(e.select("event_id", "value", "props"), F.col("event_id") == F.col("vec_id"))
        .join(F.broadcast(places), F.col("label") == F.col("n_nationkey"))
        .select(
            "vec_id", F.concat_ws("_-_", recording.cast("string"), session.cast("string"), offset.cast("string")).alias("window_id"), recording.alias("big_recording_index"), session.alias("session_index"), offset.alias("offset"),
            F.col("value").alias("recon_loss"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("n_name").alias("dataset"), F.col("r_name").alias("modality"), (k + F.when(k >= 64, 45).otherwise(0)).alias("n_channels"),
        )
    )


WINDOWS_SQL = """windows AS (
  SELECT v.vec_id, concat_ws('_-_', CAST(v.label AS VARCHAR), CAST(v.vec_id % 3 AS VARCHAR), CAST(v.vec_id * 2000 AS VARCHAR)) AS window_id,
    CAST(v.label AS BIGINT) AS big_recording_index, CAST(v.vec_id % 3 AS BIGINT) AS session_index, CAST(v.vec_id * 2000 AS BIGINT) AS "offset", e.value AS recon_loss, CAST(v.embedding AS DOUBLE[]) AS embedding,
    n.n_name AS dataset, r.r_name AS modality, CAST(json_extract_string(e.props, '$.k') AS BIGINT) + CASE WHEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) >= 64 THEN 45 ELSE 0 END AS n_channels
  FROM embeddings v JOIN events e ON e.event_id = v.vec_id JOIN nation n ON n.n_nationkey = v.label JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def with_windows(sql: str) -> str:
    """SQL with the windows table in front; sql may begin with WITH [RECURSIVE]."""
    s = sql.strip()
    if s.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {WINDOWS_SQL}, {s[14:]}"
    if s.upper().startswith("WITH"):
        return f"WITH {WINDOWS_SQL}, {s[4:]}"
    return f"WITH {WINDOWS_SQL} {s}"
