"""Display tables: required rows, samples, labels, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import sampling, text
from vectide.sources.scratch import small

#: Most points of a display, and of its sample.
POINT_CAP, SAMPLE_CAP = 2_000_000, 1_760_000


def clamp_group(group: int, groups: int) -> int:
    return max(0, min(groups - 1, round(group)))


def step_group(group: int | None, delta: int, groups: int) -> int:
    return 0 if group is None else (group + delta + groups) % groups


def stride_sample(df: DataFrame, required: Column, order: str, stride: int, cap: int = SAMPLE_CAP) -> DataFrame:
    """Required rows, and every ``stride``-th row in ``order`` that is not required, up to ``cap`` in all; ``required`` tells them apart.

    Places come from ranges of ``order``: each range is numbered by itself and moved by the rows of the ranges before it.
    """
    from pyspark.sql import Window

    marked = df.withColumn("required", F.coalesce(required, F.lit(False)))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # range borders are sampled anew by each action, so they are fixed first
    low, high = marked.agg(F.min(order), F.max(order)).first()
    if low is None:
        return marked
    part = F.floor((F.col(order) - low) * F.lit(parts) / F.lit(high - low + 1))
    dealt = marked.withColumn("__part", part)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1 + F.col("__before")
    numbered = dealt.join(F.broadcast(before), "__part").withColumn("__at", at)
    taken = numbered.where(F.col("required") | (F.col("__at") % stride == 0))
    some = taken.where(~F.col("required"))
    if some.count() + taken.where("required").count() > cap:
        some = some.orderBy("__at").limit(max(0, cap - taken.where("required").count()))
    return taken.where("required").unionByName(some).drop("__part", "__before", "__at")


def labelled(df: DataFrame, lookup: DataFrame | None = None, group: bool = False) -> DataFrame:
    """Adds a lookup's columns, point_label and channel_group."""
    out = df if lookup is None else df.join(small(lookup), "dataset", "left")
    cols = [F.col(c) for c in ("dataset", "modality", "n_channels", "big_recording_index")]
    return out.withColumn("point_label", text.point_label(*cols, F.col("group_id") if group else None)).withColumn("channel_group", text.channel_bucket(F.col("n_channels")))


def _capped(df: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows, by hash; a smaller table isn't sorted."""
    return df if df.limit(cap + 1).count() <= cap else df.orderBy(sampling.hash_bucket(F.col("row_id")), "row_id").limit(cap)


def demo_view(atlas: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    return labelled(_capped(atlas.where(sampling.hash_sample(F.col("row_id"))), POINT_CAP), lookup)


def display_points(atlas: DataFrame, required: DataFrame, lookup: DataFrame | None = None, cap: int = SAMPLE_CAP) -> DataFrame:
    """Rows that a list requires, and a hash sample of the others."""
    ids = required.select("row_id").distinct()
    sample = atlas.where(sampling.hash_sample(F.col("row_id"))).join(ids, "row_id", "left_anti")
    return labelled(atlas.join(ids, "row_id", "left_semi").unionAll(_capped(sample, cap)), lookup)


def published_view(atlas: DataFrame, members: DataFrame, runs: DataFrame, clustered: DataFrame, filters: list[tuple[str, float, str]], lookup: DataFrame | None = None) -> DataFrame:
    """Display points with one array of weights for each filter, empty where none, and clustered_selected."""
    from vectide.operators.overlay import published_weights

    points = display_points(atlas, members.select("row_id").union(clustered.select("row_id")), lookup)
    weights = published_weights(members, runs, filters)
    out = points.join(weights, "row_id", "left").join(clustered.select("row_id", F.lit(True).alias("__c")).distinct(), "row_id", "left")
    names = [text.mask_name(*f) for f in filters]
    empty = F.array().cast("array<double>")
    return out.select(*points.columns, *[F.coalesce(F.col(n), empty).alias(n) for n in names], F.col("__c").isNotNull().alias("clustered_selected"))


def set_view(atlas: DataFrame, overlay: DataFrame, masks: list[str], clustered: DataFrame, lookup: DataFrame | None = None, cap: int = SAMPLE_CAP) -> DataFrame:
    """A group set's points: rows with any mask or in the clustered list, and a hash sample of the others."""
    source = atlas.join(overlay, "row_id")
    marked = source.join(clustered.select("row_id", F.lit(True).alias("__c")).distinct(), "row_id", "left").withColumn("clustered_selected", F.col("__c").isNotNull()).drop("__c")
    needed = sampling.any_mask([F.col(m) for m in masks]) | F.col("clustered_selected")
    sample = marked.where(sampling.hash_sample(F.col("row_id")) & ~needed)
    return labelled(marked.where(needed).unionAll(_capped(sample, cap)), lookup, group=True)


def synthetic_runs(spark, name: str, directions: list[str], etas: list[float], grid: dict[str, list[float]]) -> DataFrame:
    """The runs that a sweep's grid implies."""
    one = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in directions])).alias("direction"))
    one = one.select("direction", F.explode(F.array(*[F.lit(float(e)) for e in etas])).alias("selection_eta"))
    points = F.array(*[F.struct(F.lit(k).alias("kernel_method"), F.lit(float(w)).alias("w_interaction")) for k, ws in grid.items() for w in ws])
    out = one.select("*", F.explode(points).alias("p")).select("direction", "selection_eta", "p.*")
    return out.select(F.concat_ws(":", F.lit(name), "direction", "selection_eta", "kernel_method", "w_interaction").alias("run_id"), F.lit("dpp").alias("method"), F.lit("per_group").alias("scope"), *out.columns)
