"""How many rows each group may keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators.ranking import quota


def proportional(sizes: DataFrame, eta: float, n: str = "n") -> DataFrame:
    return sizes.withColumn("k", quota(F.col(n), eta))


def flat(sizes: DataFrame, eta: float, group: str = "group_id", n: str = "n") -> DataFrame:
    """Equal shares: the largest level t with sum(min(n, t)) within round-half-even(eta * N); the rest, one each, to the smallest open ids.

    The level comes in closed form from cumulative counts of distinct sizes, a table as long as there are sizes.
    """
    by_size = sizes.groupBy(F.col(n).cast("long").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    steps = by_size.select("s", F.sum(F.col("s") * F.col("c")).over(w).alias("below"), F.sum("c").over(w).alias("done"), F.sum("c").over(every).alias("groups"), F.sum(F.col("s") * F.col("c")).over(every).alias("total"))
    steps = steps.withColumn("target", F.bround(F.lit(float(eta)) * F.col("total").cast("double")).cast("long"))
    # with all groups up to size s saturated, the others share what is left
    fill = F.floor((F.col("target") - F.col("below")) / (F.col("groups") - F.col("done")))
    start = steps.agg(F.max("target").alias("target"), F.max("groups").alias("groups"), F.max("total").alias("total"), F.max(F.when(F.col("below") + F.col("s") * (F.col("groups") - F.col("done")) <= F.col("target"), F.col("s"))).alias("from")).first()
    if start["groups"] is None or not start["groups"] <= start["target"] <= start["total"]:
        raise ContractError("flat allocation: target and number of groups do not fit")
    base = steps.where(F.col("s") == F.lit(start["from"])).select(F.when(F.col("groups") > F.col("done"), F.greatest(F.lit(start["from"]), fill)).otherwise(F.col("s")).alias("level")).first() if start["from"] is not None else None
    level = int(base["level"]) if base else start["target"] // start["groups"]
    used = sizes.agg(F.sum(F.least(F.col(n).cast("long"), F.lit(level)))).first()[0]
    rest = start["target"] - used
    open_ = sizes.where(F.col(n) > level).select(group).orderBy(group).limit(int(rest)).withColumn("__one", F.lit(1))
    return sizes.join(open_, group, "left").withColumn("k", (F.least(F.col(n).cast("long"), F.lit(level)) + F.coalesce("__one", F.lit(0))).cast("long")).drop("__one")
