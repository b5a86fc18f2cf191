"""Rankings by loss, utilities, loss summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import quantiles

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def oriented(loss: Column, direction: str) -> Column:
    if direction not in ("top", "bottom"):
        raise ContractError(f"unknown direction {direction}")
    return loss.cast("double") if direction == "top" else -loss.cast("double")


def order_of(direction: str, loss: str = "recon_loss", key: str = "window_id") -> list[Column]:
    """Highest loss first (top) or lowest (bottom); equal losses by key."""
    return [oriented(F.col(loss), direction).desc(), F.col(key).asc()]


def quota(n: Column, eta: float) -> Column:
    """max(1, min(n, ceil(eta * n))), in doubles throughout."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(float(eta)) * n.cast("double")))).cast("long")


def rank(df: DataFrame, group: str | None, direction: str, eta: float | None = None, candidate_k: int | None = None, key: str = "window_id") -> DataFrame:
    """The selected rows with zero-based ``rank`` and ``group_rows``.

    ``eta``: a share of each group; ``candidate_k``: as many rows of each. With ``group`` None the whole table is one
    group: its first rows come from a distributed top-k, and only those are numbered.
    """
    if (eta is None) == (candidate_k is None):
        raise ContractError("either eta or candidate_k")
    if group is None:
        total = df.count()
        k = min(total, candidate_k) if candidate_k is not None else max(1, min(total, _ceil(eta * total)))
        first = df.orderBy(*order_of(direction, key=key)).limit(k)
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*order_of(direction, key=key))) - 1).withColumn("group_rows", F.lit(total).cast("long"))
    w = Window.partitionBy(group).orderBy(*order_of(direction, key=key))
    place = F.row_number().over(w)
    if candidate_k is not None:
        kept = df.withColumn("rank", place).where(F.col("rank") <= candidate_k)  # WindowGroupLimit: partial before the shuffle
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows"))
        return kept.join(sizes, group).withColumn("rank", F.col("rank") - 1)
    # the order of a group needs one shuffle by group; its size comes along in the same window
    sized = df.withColumn("group_rows", F.count(F.lit(1)).over(Window.partitionBy(group))).withColumn("rank", place)
    return sized.where(F.col("rank") <= quota(F.col("group_rows"), eta)).withColumn("rank", F.col("rank") - 1)


def rank_sweep(df: DataFrame, group: str, directions: tuple[str, ...], etas: tuple[float, ...], key: str = "window_id") -> DataFrame:
    """Rankings of all directions and shares in one shuffle by group: a row for each that selects it, with direction, eta and rank."""
    w = Window.partitionBy(group)
    sized = df.withColumn("__n", F.count(F.lit(1)).over(w))
    for d in directions:
        sized = sized.withColumn(f"__{d}", F.row_number().over(w.orderBy(*order_of(d, key=key))))
    some = [F.when(F.col(f"__{d}") <= quota(F.col("__n"), e), F.struct(F.lit(d).alias("direction"), F.lit(float(e)).alias("eta"), (F.col(f"__{d}") - 1).alias("rank"))) for d in directions for e in etas]
    out = sized.withColumn("__s", F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())))
    return out.select(*df.columns, "__s.direction", "__s.eta", "__s.rank")


def _ceil(x: float) -> int:
    import math

    return math.ceil(x)


def rank_given(df: DataFrame, group: str, direction: str, given: DataFrame, key: str = "window_id") -> DataFrame:
    """The first ``k`` rows of each group of ``given`` (group, k), with zero-based ``rank``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order_of(direction, key=key))) - 1
    return df.join(given.select(group, "k"), group).withColumn("rank", place).where(F.col("rank") < F.col("k")).drop("k")


def with_utility(df: DataFrame, group: list[str], direction: str, loss: str = "recon_loss", name: str = "utility") -> DataFrame:
    """Min-max of the oriented loss inside ``group``; 1 where all are equal. After a ranking by the same group it shuffles nothing more."""
    v = oriented(F.col(loss), direction)
    w = Window.partitionBy(*group)
    bounded = df.withColumns({"__low": F.min(v).over(w), "__high": F.max(v).over(w)})
    return bounded.withColumn(name, F.when(F.col("__low") == F.col("__high"), 1.0).otherwise((v - F.col("__low")) / (F.col("__high") - F.col("__low")))).drop("__low", "__high")


def loss_summary(df: DataFrame, group: list[str], loss: str = "recon_loss", utility: str | None = "utility") -> DataFrame:
    """Mean, median, bounds, mean utility and interpolated percentiles of each group."""
    v = F.col(loss).cast("double")
    aggs = [F.avg(v).alias("mean_recon_loss"), F.min(v).alias("min_recon_loss"), F.max(v).alias("max_recon_loss")]
    if utility:
        aggs.append(F.avg(utility).alias("mean_utility"))
    at = {"median_recon_loss": 0.5, **{f"recon_loss_q{q}": q / 100 for q in PERCENTS}}
    out = quantiles.summarise(df.select(*group, loss, *([utility] if utility else [])), group, aggs, {name: (loss, q, "linear") for name, q in at.items()})
    return out.select(*group, "mean_recon_loss", "median_recon_loss", "min_recon_loss", "max_recon_loss", *(["mean_utility"] if utility else []), *[f"recon_loss_q{q}" for q in PERCENTS])


def stratified(df: DataFrame, group: str, eta: float, seed: int, key: str = "window_id") -> DataFrame:
    """A seeded baseline: the rows of smallest seeded hash, as many of each group as a ranking has; ``rank`` is the draw's order."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary"))
    w = Window.partitionBy(group).orderBy(draw, F.col(key))
    sized = df.withColumn("group_rows", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return sized.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < quota(F.col("group_rows"), eta)).withColumn("utility", F.lit(1.0))


def numpy_stratified(df: DataFrame, group: str, eta: float, seed: int, key: str = "window_id", given: DataFrame | None = None) -> DataFrame:
    """The baseline as numpy draws it: default_rng(seed + group).choice without replacement over rows in key order; (group, key, rank).

    ``given`` (group, k) says how many rows each group keeps; without it ``eta`` does.
    """
    import pyarrow as pa

    fixed = given is not None
    group_type, key_type = (df.schema[c].dataType.simpleString() for c in (group, key))

    def draw(part: pa.Table) -> pa.Table:
        import math

        import numpy as np

        part = part.sort_by(key)
        n, g = part.num_rows, part[group][0].as_py()
        k = part["k"][0].as_py() if fixed else max(1, min(n, math.ceil(eta * n)))
        picked = np.random.default_rng(seed + g).choice(n, k, replace=False)
        return pa.table({group: part[group].take(pa.array(picked)), key: part[key].take(pa.array(picked)), "rank": pa.array(np.arange(k), pa.int32())})

    rows = df.select(group, key) if given is None else df.select(group, key).join(given.select(group, "k"), group)
    return rows.groupBy(group).applyInArrow(draw, f"{group} {group_type}, {key} {key_type}, rank int")
