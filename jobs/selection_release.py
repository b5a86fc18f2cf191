"""Selection release: the windows that rankings keep, a drawn baseline of the same sizes, their runs, and a table for the explorer.

    python -m jobs.selection_release --tables DIR --out DIR [--config jobs/selection_release.json]

Reads embeddings, events, nation and region, refuses a source that breaks its contract, and writes below ``out``

* members  by direction and share: every selected window with its rank and utility ("random" is the baseline)
* runs     by direction and share: a row for each group with its size, loss summary and overlap with the baseline
* view     by data set: every window with a label, a channel bucket, the display sample and one mask of bits for each direction
* manifest one row: settings, counts, and whether masks and memberships agree

A rerun replaces the partitions it makes with the same rows. Other directions and shares of the same ``out`` stay as they are, and
the view's masks hold the shares of the present settings.
"""

from __future__ import annotations

import json
import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, overwrite, settings
from vectide.errors import ContractError
from vectide.functions.sampling import bit_of, hash_sample
from vectide.functions.text import channel_bucket, point_label
from vectide.operators import metrics, overlay, ranking, validate
from vectide.plans.jobs import fingerprint
from vectide.queries.registry import windows
from vectide.sources.scratch import scope

DEFAULTS = {"group": "big_recording_index", "directions": ["top", "bottom"], "shares": [0.01, 0.03, 0.1], "baseline_seed": 29, "vector_width": 64, "sample_percent": 8}
RANDOM = "random"
MEMBERS = "group_id long, window_id string, rank int, utility double, recon_loss double, direction string, share double"
RUNS = "group_id long, actual_size int, mean_recon_loss double, median_recon_loss double, recon_loss_q5 double, recon_loss_q95 double, mean_utility double, baseline_jaccard double, direction string, share double"
log = logging.getLogger("selection_release")


def members_of(rows: DataFrame, directions: list[str], shares: list[float], seed: int) -> DataFrame:
    """Rankings of all directions and shares in one shuffle by group, and the baseline in another, in the columns of MEMBERS."""
    swept = ranking.rank_sweep(rows, "group_id", tuple(directions), tuple(shares)).withColumnRenamed("eta", "share")
    swept = swept.withColumn("__oriented", F.when(F.col("direction") == "bottom", -F.col("recon_loss")).otherwise(F.col("recon_loss")))
    swept = ranking.with_utility(swept, ["direction", "share", "group_id"], "top", loss="__oriented")
    drawn = ranking.stratified(rows, "group_id", max(shares), seed)  # a smaller share has the first rows of the same draw
    kept = F.filter(F.array(*[F.lit(float(s)) for s in shares]), lambda s: F.col("rank") < F.greatest(F.lit(1), F.least(F.col("group_rows"), F.ceil(s * F.col("group_rows").cast("double")))))
    drawn = drawn.withColumn("share", F.explode(kept)).withColumn("direction", F.lit(RANDOM))
    columns = ["group_id", "window_id", F.col("rank").cast("int").alias("rank"), "utility", "recon_loss", "direction", "share"]
    return swept.select(*columns).unionByName(drawn.select(*columns))


def runs_of(members: DataFrame, directions: list[str]) -> DataFrame:
    """A row for each group, direction and share, in the columns of RUNS."""
    keys = ["direction", "share", "group_id"]
    summary = ranking.loss_summary(members, keys)
    size = members.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("actual_size"))
    ranked, drawn = members.where(F.col("direction") != RANDOM), members.where(F.col("direction") == RANDOM)
    beside = drawn.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in directions])))
    overlap = metrics.jaccard(ranked, beside, keys, "window_id").withColumnRenamed("jaccard", "baseline_jaccard")
    out = summary.join(size, keys).join(overlap, keys, "left")
    return out.select("group_id", "actual_size", "mean_recon_loss", "median_recon_loss", "recon_loss_q5", "recon_loss_q95", "mean_utility", "baseline_jaccard", "direction", "share")


def view_of(rows: DataFrame, members: DataFrame, directions: list[str], shares: list[float], percent: int) -> DataFrame:
    """Every window with a mask for each direction: bit i is set where the i-th share selects it."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(shares) for x in (float(s), i)])
    bit = bit_of(place[F.col("share")])
    masks = members.groupBy("window_id").agg(*[F.coalesce(F.bit_or(F.when(F.col("direction") == d, bit)), F.lit(0).cast("long")).alias(f"mask_{d}") for d in (*directions, RANDOM)])
    named = rows.select(
        "window_id", "group_id", "recon_loss", "modality", "n_channels", channel_bucket(F.col("n_channels")).alias("channels"), point_label(F.col("dataset"), F.col("modality"), F.col("n_channels"), F.col("group_id")).alias("label"),
        hash_sample(F.col("window_id"), percent).alias("in_sample"), "dataset",
    )
    return overlay.overlay(named, masks, "window_id")


def release(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict:
    """Write the release of the tables in ``tables`` to ``out``; what was read and written."""
    c = settings(config or {}, DEFAULTS)
    directions, shares = list(c["directions"]), [float(s) for s in c["shares"]]
    if not shares or not all(0 < s <= 1 for s in shares) or len(set(shares)) < len(shares) or len(shares) > overlay.MOST_BITS:
        raise ContractError(f"shares {shares}")
    if not directions or not set(directions) <= {"top", "bottom"}:
        raise ContractError(f"directions {directions}")
    source = windows(spark, tables)
    found = validate.source_violations(source, int(c["vector_width"])).first().asDict()
    log.info("read %s windows of %s: %s", found["rows"], tables, found)
    bad = {k: v for k, v in found.items() if k not in ("rows", "unparsed") and v}
    if bad or not found["rows"]:
        raise ContractError(f"source: {bad or 'no rows'}")
    rows = source.drop("embedding").withColumn("group_id", F.col(str(c["group"])).cast("long"))
    overwrite(members_of(rows, directions, shares, int(c["baseline_seed"])), f"{out}/members", ["direction", "share"])
    mine = reduce(lambda a, b: a | b, [(F.col("direction") == d) & F.col("share").isin(shares) for d in (*directions, RANDOM)])
    members = spark.read.schema(MEMBERS).parquet(f"{out}/members").where(mine)
    with scope(spark):
        overwrite(runs_of(members, directions), f"{out}/runs", ["direction", "share"])
    view = view_of(rows, members, directions, shares, int(c["sample_percent"]))
    overwrite(view, f"{out}/view", ["dataset"])
    stored = spark.read.schema(view.schema).parquet(f"{out}/view")
    bits = overlay.conserved(stored.select("window_id", *[f"mask_{d}" for d in (*directions, RANDOM)]), members, "window_id").first()
    if bits["bits"] != bits["memberships"]:
        raise ContractError(f"masks hold {bits['bits']} bits, memberships are {bits['memberships']}")
    about = {"windows": found["rows"], "memberships": bits["memberships"], "runs": spark.read.schema(RUNS).parquet(f"{out}/runs").where(mine).count(), "settings": json.dumps(c, sort_keys=True), "fingerprint": fingerprint(c)}
    spark.createDataFrame([tuple(about.values())], "windows long, memberships long, runs long, settings string, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    log.info("wrote %s memberships, %s runs and a view of %s windows to %s", about["memberships"], about["runs"], about["windows"], out)
    return about


if __name__ == "__main__":
    command_line("Selection release: rankings, baseline, runs and the explorer's view", release)
