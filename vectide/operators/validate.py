"""Contracts of sources, artifacts and imports, each as one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.functions.text import parse_window_id
from vectide.functions.vectors import norm


def source_violations(df: DataFrame, width: int) -> DataFrame:
    """One row of counts: rows, bad widths, non-finite numbers, zero vectors, repeated ids, unparsed ids, ids that disagree.

    If any id does not parse, ids are not compared with their columns: ``id_mismatch`` is null then.
    """
    e = F.col("embedding")
    number = F.col("recon_loss").cast("double")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    parsed = parse_window_id(F.col("window_id"))
    agree = (parsed["recording"] == F.col("big_recording_index")) & (parsed["session"] == F.col("session_index")) & (parsed["offset"] == F.col("offset"))
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(e.isNull() | (F.size(e) != width)).alias("bad_width"), F.count_if(odd(number)).alias("bad_loss"),
        F.count_if(F.exists(e.cast("array<double>"), odd)).alias("bad_vector"), F.count_if(norm(e.cast("array<double>")) <= 0).alias("zero_vector"), F.count_if(parsed.isNull()).alias("unparsed"), F.count_if(~agree).alias("differ"),
    )
    twice = df.groupBy("window_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_ids"))
    return one.join(F.broadcast(twice)).withColumn("id_mismatch", F.when(F.col("unparsed") == 0, F.col("differ"))).drop("differ")


def require_source(df: DataFrame, width: int) -> DataFrame:
    found = source_violations(df, width).first().asDict()
    bad = {k: v for k, v in found.items() if k not in ("rows", "unparsed") and v}
    if not found["rows"] or bad:
        raise ContractError(f"source: {bad or 'no rows'}")
    return df


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, count) of repeated keys."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)


def artifact_violations(df: DataFrame) -> DataFrame:
    """Public tables hold no vectors, and only finite floats where not null."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = [F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"bad_{c}") for c in floats]
    return df.agg(F.lit(int("embedding" in df.columns)).alias("has_vectors"), F.count(F.lit(1)).alias("rows"), *bad)


def run_violations(members: DataFrame, runs: DataFrame, atlas: DataFrame) -> DataFrame:
    """Counts: members outside the atlas, runs whose size differs from their members, Vendi scores outside 1 to size."""
    outside = members.join(atlas.select("row_id"), "row_id", "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    sizes = members.groupBy("run_id").agg(F.count(F.lit(1)).alias("members"))
    checked = runs.join(sizes, "run_id", "left").agg(
        F.count_if(F.coalesce("members", F.lit(0)) != F.col("actual_size")).alias("size_differs"), F.count_if((F.col("vendi_score") < 1 - 1e-9) | (F.col("vendi_score") > F.col("actual_size") + 1e-9)).alias("vendi_outside"))
    return outside.join(F.broadcast(checked))


def hit_counts(ids: DataFrame, atlas: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: ids, those that hit no row of the atlas, those that hit several, repeated ids."""
    listed = ids.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    hits = atlas.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    return listed.join(hits, key, "left").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("ids"), F.count_if(F.col("hits").isNull()).alias("missing"), F.count_if(F.col("hits") > 1).alias("several"), F.count_if(F.col("times") > 1).alias("repeated"))


def population_check(overlay: DataFrame, atlas: DataFrame, key: str = "row_id") -> DataFrame:
    """total, unique ids, null ids, rows of the atlas, ids missing there."""
    one = overlay.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(key).alias("unique_ids"), F.count_if(F.col(key).isNull()).alias("null_ids"))
    missing = overlay.join(atlas.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return one.join(F.broadcast(missing)).join(F.broadcast(atlas.agg(F.count(F.lit(1)).alias("atlas_rows"))))


def require_joined(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Strict N:1 join: every key has to be in the lookup, and there once."""
    missing = [r[0] for r in df.select(key).distinct().join(lookup, key, "left_anti").orderBy(key).limit(12).collect()]
    if missing:
        raise ContractError(f"no metadata for {missing}")
    if not duplicates(lookup, key).isEmpty():
        raise ContractError(f"lookup repeats {key}")
    return df.join(lookup, key)


def require_aligned(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """1:1 join: both sides have the same keys, each once."""
    out = rows.join(other, key)
    counts = rows.agg(F.count(F.lit(1)).alias("a"), F.countDistinct(key).alias("da")).join(F.broadcast(other.agg(F.count(F.lit(1)).alias("b"), F.countDistinct(key).alias("db")))).first()
    if len({*counts}) != 1 or out.count() != counts["a"]:
        raise ContractError(f"rows do not align: {counts.asDict()}")
    return out


def partition_violations(groups: DataFrame, n_min: int, n_max: int) -> DataFrame:
    """Counts: rows, rows in several groups, groups, groups too small or too large, sizes that differ from their column."""
    per = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("group_size").alias("low"), F.max("group_size").alias("high"))
    sizes = per.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") < n_min).alias("small"), F.count_if(F.col("n") > n_max).alias("large"), F.count_if((F.col("n") != F.col("low")) | (F.col("n") != F.col("high"))).alias("size_differs"))
    rows = groups.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct("row_id")).alias("repeated"))
    return rows.join(F.broadcast(sizes))
