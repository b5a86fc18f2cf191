"""A build's runs beside a published one's: which sets are identical, and what the others differ in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.operators.metrics import jaccard_counts

#: Runs of two builds are the same run if these are equal, null to null.
RUN_KEY = ("config_id", "group_id", "kernel_method", "w_interaction")


def method_label(method: Column, kernel: Column, w: Column) -> Column:
    """The method; for diverse runs with its kernel, and whether its weight is 0."""
    return F.when(method == "dpp", F.concat(F.lit("dpp:"), kernel, F.when(w == 0, ":w0").otherwise(":w>0"))).otherwise(method)


def compare_runs(members: DataFrame, runs: DataFrame, published_members: DataFrame, published_runs: DataFrame) -> DataFrame:
    """A row for each run of a build: whether it is published, has the same id, the same members, and how many members only one side has.

    Members (run_id, row_id) of both sides meet in one shuffle by run and row; a set has no order, and a row counts once.
    Runs that are not published have null in place of a comparison.
    """
    theirs = published_runs.select(F.col("run_id").alias("published_id"), *[F.col(c).alias(f"__{c}") for c in RUN_KEY])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in RUN_KEY]
    matched = runs.join(theirs, same, "left").drop(*[f"__{c}" for c in RUN_KEY])
    mine = matched.where(F.col("published_id").isNotNull()).select("run_id", "published_id")
    ours = members.join(mine.select("run_id"), "run_id", "left_semi").select("run_id", "row_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    other = published_members.withColumnRenamed("run_id", "published_id").join(mine, "published_id").select("run_id", "row_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    met = ours.unionAll(other).groupBy("run_id", "row_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = met.groupBy("run_id").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("nab"))
    found = F.col("published_id").isNotNull()
    n = {c: F.when(found, F.coalesce(F.col(c), F.lit(0))) for c in ("na", "nb", "nab")}
    return matched.join(counts, "run_id", "left").select(
        "run_id", "method", *RUN_KEY, method_label(F.col("method"), F.col("kernel_method"), F.col("w_interaction")).alias("label"), found.alias("is_published"), F.when(found, F.col("run_id") == F.col("published_id")).alias("same_run_id"),
        ((n["na"] == n["nab"]) & (n["nb"] == n["nab"])).alias("identical"), (n["na"] - n["nab"]).alias("only_here"), (n["nb"] - n["nab"]).alias("only_published"), jaccard_counts(n["na"], n["nb"], n["nab"]).alias("jaccard"),
    )


def summary(compared: DataFrame) -> DataFrame:
    """By label: runs that are published, those identical, those with the same id, and runs that are not published."""
    return compared.groupBy("label").agg(F.count_if("is_published").alias("runs"), F.count_if("identical").alias("identical"), F.count_if("same_run_id").alias("same_run_id"), F.count_if(~F.col("is_published")).alias("missing"))


def identical_groups(compared: DataFrame, method: str = "dpp") -> DataFrame:
    """(group_id, all_identical): whether all published runs of a method are identical in a group."""
    return compared.where((F.col("method") == method) & F.col("is_published")).groupBy("group_id").agg(F.bool_and("identical").alias("all_identical"))
