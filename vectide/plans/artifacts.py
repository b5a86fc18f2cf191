"""Artifacts made of several operators: atlas, sets, imports, index metrics, probes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import dpp, knn, metrics, project, quantiles, validate
from vectide.sources.scratch import small, written

#: Quality thresholds of coverage and percents of losses that index metrics report.
TAUS, PERCENTS = (0.8, 0.9), (5, 25, 50, 75, 95)


def atlas(windows: DataFrame, method: str = "pca", sample: int = 20_000, seed: int = 7) -> DataFrame:
    """Public columns of all windows with their projection; vectors stay behind."""
    places = project.project(windows, method, sample, seed)
    public = windows.select(F.col("window_id").alias("row_id"), "window_id", F.col("recon_loss").cast("float").alias("recon_loss"), "big_recording_index", "session_index", "offset", "dataset", "modality", "n_channels")
    return public.join(places, "window_id")


def realign(old: DataFrame, new: DataFrame, key: str = "window_id") -> DataFrame:
    """``old`` with the coordinates of ``new``, which has to hold the same keys."""
    return validate.require_aligned(old.drop("projection_x", "projection_y"), new.select(key, "projection_x", "projection_y"), key)


def display_vectors(source: DataFrame, display: DataFrame, key: str = "window_id") -> DataFrame:
    """Rows of the source for the listed ids, all of which have to be there."""
    ids = display.select(key).distinct()
    lost = ids.join(source.select(key), key, "left_anti").limit(3).collect()
    if lost:
        raise ContractError(f"no source row for {[r[0] for r in lost]}")
    return source.join(ids, key, "left_semi")


def finalise(groups: DataFrame, rows: DataFrame, n_min: int, n_max: int) -> DataFrame:
    """A group table that covers ``rows`` exactly and keeps its limits."""
    out = validate.require_aligned(rows.select("row_id"), groups, "row_id")
    bad = validate.partition_violations(out, n_min, n_max).first().asDict()
    wrong = {k: v for k, v in bad.items() if k in ("repeated", "small", "large", "size_differs") and v}
    if wrong:
        raise ContractError(f"groups: {wrong}")
    return out


def import_clustered(manifest: DataFrame, atlas_ids: DataFrame, display: DataFrame) -> DataFrame:
    """Listed ids that are displayed; every listed id and every displayed one has to hit the atlas exactly once."""
    for name, ids in (("manifest", manifest), ("display", display)):
        found = validate.hit_counts(ids, atlas_ids).first()
        if found["missing"] or found["several"] or found["repeated"]:
            raise ContractError(f"{name}: {found.asDict()}")
    return manifest.join(display.select("row_id"), "row_id", "left_semi")


def index_metrics(windows: DataFrame, members: DataFrame, keys: list[str], sample: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """One row for each union of memberships: diversity, coverage, shares, loss percentiles, represented groups, overlap."""
    rows = written(members.select(*keys, "window_id").join(windows, "window_id"), "unions")  # read by six aggregates
    twice = rows.groupBy(*keys, "window_id").count().where("count > 1").limit(1).count()
    if twice:
        raise ContractError("a union lists a row twice")
    vendi = metrics.union_vendi(rows, keys).withColumn("vendi_union_normalized", F.col("vendi") / F.col("n")).withColumnRenamed("vendi", "vendi_union").withColumnRenamed("n", "k")
    cosine = metrics.mean_cosine(rows, keys).select(*keys, F.col("mean_cosine").alias("mean_pairwise_cosine_union"))
    sizes = windows.groupBy("big_recording_index").agg(F.count(F.lit(1)).alias("size"))
    cut = sizes.agg(F.percentile("size", F.lit(0.9)).alias("cut"))
    large = sizes.join(F.broadcast(cut)).where(F.col("size") >= F.col("cut")).select("big_recording_index", F.lit(1.0).alias("large"))
    flagged = rows.join(small(large), "big_recording_index", "left")
    means = [F.avg(F.coalesce("large", F.lit(0.0))).alias("top_decile_group_share"), F.avg(F.col("recon_loss").cast("double")).alias("recon_loss_mean"), F.countDistinct("big_recording_index").alias("recordings_represented")]
    at = {f"recon_loss_q{q}": ("recon_loss", q / 100, "linear") for q in PERCENTS}
    plain = quantiles.summarise(flagged.select(*keys, "large", "recon_loss", "big_recording_index"), keys, means, at)
    plain = plain.select(*keys, "top_decile_group_share", "recon_loss_mean", *at, "recordings_represented")
    counts = rows.groupBy(*keys, "dataset").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    top = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).withColumn("p", F.row_number().over(w.orderBy(F.desc("n"), "dataset"))).where("p <= 5")
    shares = top.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("p", "dataset", "share"))), lambda x: F.struct(x.dataset, x.share)))).alias("top5_datasets"))
    # a sample meets each union's rows as targets of its own: the key is part of the id
    best = _union_coverage(rows, keys, sample)
    out = vendi
    for other in (cosine, plain, shares, best):
        out = metrics.null_safe_join(out, other, keys)
    if published is not None:
        out = metrics.null_safe_join(out, metrics.jaccard(members, published, keys, "window_id").withColumnRenamed("jaccard", "jaccard_vs_published"), keys, "left")
    return out


def _union_coverage(rows: DataFrame, keys: list[str], sample: DataFrame) -> DataFrame:
    """Coverage of each union: every union is a part, and the sample is a query of each."""
    spark = rows.sparkSession
    unions = rows.select(*keys).distinct().collect()  # a row for each union
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    numbered_ = F.broadcast(spark.createDataFrame([(*u, i) for i, u in enumerate(unions)], f"{kinds}, __union long"))
    targets = metrics.null_safe_join(rows.select(*keys, "window_id", "embedding"), numbered_, keys).withColumn("__id", F.concat_ws(":", "__union", "window_id"))
    queries = sample.select("window_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(unions) - 1).cast("long"))).alias("__union")).withColumn("__id", F.concat_ws(":", "__union", "window_id"))
    best = knn.nearest(queries if unions else queries.limit(0), targets, 1, "__id", part="__union").select(F.split("query", ":", 2)[0].cast("long").alias("__union"), "score")
    shares = best.groupBy("__union").agg(*[F.avg((F.col("score") >= t).cast("double")).alias(f"coverage_{int(100 * t):03d}") for t in TAUS])
    return shares.join(numbered_, "__union").drop("__union")


def pivot_probe(windows: DataFrame, seeds: int = 64, seed: int = 20260922, sizes: tuple[int, ...] = (256, 512, 1024), steps: int = 600, threshold: float = 1e-4) -> DataFrame:
    """(seed_row, size, r_op, first_below, participation_ratio, kth_cosine) of balls of nearest rows around seeded rows."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "window_id").cast("binary"))
    near = knn.nearest(windows.orderBy(order, "window_id").limit(seeds), windows, max(sizes), "window_id")
    balls = near.join(windows.select(F.col("window_id").alias("target"), "embedding"), "target")
    each = balls.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col("place") <= F.col("size"))

    def probe(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        v = np.array(part["embedding"].to_pylist(), np.float64)
        g = dpp.gram(v)
        k = min(len(g), steps)
        p = np.exp(dpp.choose(g, np.ones(len(g)), [dpp.Point(dpp.MULTIPLICATIVE, 0.0)], k, tie=0.0).gains[0])
        below = np.flatnonzero(p <= threshold)
        u = v / np.linalg.norm(v, axis=1)[:, None]
        e = np.clip(np.linalg.eigvalsh(u @ u.T), 0, None)
        return pa.table({"seed_row": [key[0].as_py()], "size": pa.array([key[1].as_py()], pa.int32()), "r_op": pa.array([int((p > threshold).sum())], pa.int32()), "first_below": pa.array([int(below[0]) if len(below) else k], pa.int32()), "participation_ratio": [float(e.sum() ** 2 / (e**2).sum())], "kth_cosine": [float(part["score"][len(g) - 1].as_py())]})

    return each.select("query", "size", "place", "score", "embedding").groupBy("query", "size").applyInArrow(probe, "seed_row string, size int, r_op int, first_below int, participation_ratio double, kth_cosine double")


def probe_summary(probe: DataFrame, eta: float = 0.1) -> DataFrame:
    """Percentiles over seeds for each size, and whether the request stays within nine tenths of the fifth percentile."""
    r = F.col("r_op").cast("double")
    out = probe.groupBy("size").agg(F.percentile(r, F.lit(0.05)).alias("r_op_p5"), F.percentile(r, F.lit(0.5)).alias("r_op_median"), F.min("r_op").alias("r_op_min"), F.max("r_op").alias("r_op_max"), F.percentile("participation_ratio", F.lit(0.5)).alias("participation_median"), F.percentile("participation_ratio", F.lit(0.05)).alias("participation_p5"), F.percentile("kth_cosine", F.lit(0.5)).alias("kth_cosine_median"))
    request = F.ceil(F.lit(float(eta)) * F.col("size").cast("double"))
    return out.withColumn("request_k", request).withColumn("passes_rule", request <= 0.9 * F.col("r_op_p5"))


def least_rows(eta: float, k: int) -> int:
    """Rows a group needs for k selected ones."""
    return math.floor((k - 1) / eta) + 1
