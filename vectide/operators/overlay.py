"""Memberships packed into bit masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.functions.sampling import bit_of
from vectide.functions.text import mask_name

MOST_BITS = 32


def masks(members: DataFrame, grid: dict[str, list[float]], directions: list[str], etas: list[float], key: str = "row_id") -> DataFrame:
    """(key, one mask for each direction, eta and kernel): bit i is set if the row is selected at the kernel's i-th weight."""
    if any(len(ws) > MOST_BITS for ws in grid.values()):
        raise ContractError(f"a mask has {MOST_BITS} bits")
    place = F.create_map(*[F.lit(x) for k, ws in grid.items() for i, w in enumerate(ws) for x in (f"{k}:{float(w)}", i)])
    marked = members.withColumn("__bit", place[F.concat_ws(":", "kernel", F.col("w").cast("double").cast("string"))])
    bit = bit_of(F.col("__bit"))
    aggs = []
    for d in directions:
        for e in etas:
            for k in grid:
                mine = (F.col("direction") == d) & (F.col("eta") == e) & (F.col("kernel") == k)
                aggs.append(F.coalesce(F.bit_or(F.when(mine, bit)), F.lit(0).cast("long")).alias(mask_name(d, e, k)))
    return marked.groupBy(key).agg(*aggs)


def overlay(rows: DataFrame, masked: DataFrame, key: str = "row_id") -> DataFrame:
    """All rows with their masks, 0 where nothing selected them."""
    out = rows.join(masked, key, "left")
    return out.fillna(0, [c for c in masked.columns if c != key])


def conserved(masked: DataFrame, members: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: set bits and memberships, which have to agree."""
    bits = F.sum(sum((F.bit_count(c) for c in masked.columns if c != key), F.lit(0)).cast("long")).alias("bits")
    return masked.agg(bits).join(F.broadcast(members.agg(F.count(F.lit(1)).alias("memberships"))))


def published_weights(members: DataFrame, runs: DataFrame, filters: list[tuple[str, float, str]]) -> DataFrame:
    """(row_id, one sorted array of weights for each direction, eta and kernel) of DPP memberships."""
    joined = members.join(runs.where(F.col("method") == "dpp"), "run_id")
    aggs = [F.sort_array(F.collect_set(F.when((F.col("direction") == d) & (F.col("selection_eta") == e) & (F.col("kernel_method") == k), F.col("w_interaction")))).alias(mask_name(d, e, k)) for d, e, k in filters]
    return joined.groupBy("row_id").agg(*aggs)
