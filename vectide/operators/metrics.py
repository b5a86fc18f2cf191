"""Diversity and overlap of selections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.functions.vectors import unit
from vectide.operators import quantiles


def entropy_rank(values: np.ndarray) -> float:
    """exp of the entropy of non-negative values as shares."""
    p = values[values > 0] / values[values > 0].sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def vendi(cosines: np.ndarray, tolerance: float = 1e-7) -> float:
    """Effective number of distinct rows of a cosine matrix, within 1 and its size."""
    values = np.linalg.eigvalsh((cosines + cosines.T) / 2)
    if values.min() < -tolerance:
        raise ContractError("a cosine matrix has a negative eigenvalue")
    return min(float(len(cosines)), max(1.0, entropy_rank(np.clip(values, 0, None))))


def mean_offdiagonal(cosines: np.ndarray) -> float:
    n = len(cosines)
    return 1.0 if n == 1 else float((cosines.sum() - np.trace(cosines)) / (n * (n - 1)))


def unit_rows(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("unit", unit(F.col(vector).cast("array<double>")))


def unit_sums(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """(group, n, s): number and sum of the unit vectors of each group, added up in tasks before the shuffle: one array a task and group."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    total = Summarizer.sum(array_to_vector(F.col("unit"))).alias("s")
    sums = unit_rows(df, vector).groupBy(*group).agg(total, F.count(F.lit(1)).alias("n"))
    return sums.withColumn("s", vector_to_array("s"))


def mean_cosine(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """Mean cosine over all pairs of each group, from its sum vector: (|sum u|^2 - n) / (n (n - 1)); 1 for one row. No pair is made."""
    n = F.col("n").cast("double")
    square = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    return unit_sums(df, group, vector).select(*group, "n", F.when(F.col("n") == 1, 1.0).otherwise((square - n) / (n * (n - 1))).alias("mean_cosine"))


#: Bytes of matrices that a task holds before it sends them.
GRAM_BYTES = 64 << 20


def _partial_gram(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def sent() -> pa.RecordBatch:
            keys = list(zip(*held, strict=True)) if groups else []
            counts, grams = zip(*held.values(), strict=True)
            return pa.RecordBatch.from_arrays([*[pa.array(k, t) for k, t in zip(keys, kinds, strict=True)], pa.array(counts, pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], [*[f"k{i}" for i in range(groups)], "n", "g"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(i).type for i in range(groups)]
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(groups)], strict=True)) if groups else [()] * batch.num_rows
            x = batch.column(groups).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            where: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                where.setdefault(k, []).append(i)
            for k, rows in where.items():
                n, g = held.get(k, (0, 0.0))
                held[k] = [n + len(rows), g + x[rows].T @ x[rows]]
                if len(held) * x.shape[1] ** 2 * 8 > GRAM_BYTES:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    return run


def _scored(score, names: list[str]):
    """Adds up a group's matrices as they come, one held at a time, and gives what ``score`` makes of the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, keys = 0, 0.0, None
        for batch in batches:
            for many, raw in zip(batch.column("n").to_pylist(), batch.column("g"), strict=True):
                n, total = n + many, total + np.frombuffer(raw.as_buffer(), np.float64)
            keys = keys or [(name, batch.column(i).slice(0, 1)) for i, name in enumerate(batch.schema.names) if name not in ("n", "g")]
        d = int(round(len(total) ** 0.5))
        made = score(total.reshape(d, d), n)
        yield pa.RecordBatch.from_arrays([*[v for _, v in keys], pa.array([n], pa.int64()), *[pa.array([x], pa.float64()) for x in made]], [*[k for k, _ in keys], "n", *names])

    return run


def _of_dual(df: DataFrame, group: list[str], vector: str, score, names: list[str]) -> DataFrame:
    """(group, n, numbers that ``score`` makes of each group's sum of u u^T, d x d, and size): partial sums in tasks, sent as bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = ", ".join(f"k{i} {kinds[g]}" for i, g in enumerate(group))
    parts = unit_rows(df, vector).select(*group, "unit").mapInArrow(_partial_gram(len(group)), f"{keys}, n long, g binary")
    names_of = {f"k{i}": g for i, g in enumerate(group)}
    return parts.groupBy(*names_of).applyInArrow(_scored(score, names), f"{keys}, n long, " + ", ".join(f"{x} double" for x in names)).withColumnsRenamed(names_of)


def union_vendi(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """Vendi score of sets of any size by the d x d dual; no jitter, no clamp."""
    return _of_dual(df, group, vector, lambda g, n: (entropy_rank(np.clip(np.linalg.eigvalsh(g / n), 0, None)),), ["vendi"])


def group_vendi(df: DataFrame, group: str, vector: str = "embedding", epsilon: float = 1e-6) -> DataFrame:
    """(group, n, vendi, vendi_normalized) of whole groups by their duals.

    The n cosine eigenvalues are the dual's and n - d zeros, each with epsilon added, so a group of any size needs d x d numbers.
    """

    def score(g: np.ndarray, n: int) -> tuple[float, float]:
        values = np.sort(np.clip(np.linalg.eigvalsh(g), 0, None))[::-1][: min(n, len(g))] + epsilon
        rest = max(0, n - len(values))
        total = values.sum() + rest * epsilon
        h = -(values / total * np.log(values / total)).sum() - rest * (epsilon / total * np.log(epsilon / total))
        v = min(float(n), max(1.0, float(np.exp(h))))
        return v, v / n

    return _of_dual(df, [group], vector, score, ["vendi", "vendi_normalized"])


def participation(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """(sum of eigenvalues)^2 / sum of their squares, from the trace and the entries of the dual. Unit rows: the trace is their number."""
    return _of_dual(df, group, vector, lambda g, n: (n * n / float((g * g).sum()),), ["participation"])


def jaccard_counts(left: Column, right: Column, both: Column) -> Column:
    """From sizes and the size of the intersection; 1 for two empty sets."""
    union = left + right - both
    return F.when(union == 0, 1.0).otherwise(both.cast("double") / union.cast("double"))


def jaccard(a: DataFrame, b: DataFrame, keys: list[str], member: str = "row_id") -> DataFrame:
    """Jaccard index of the sets of ``a`` and ``b`` with equal (null-safe) keys, where both have the key.

    Each side is read once; sides meet in one shuffle by key and member, and counts of sides in one by key.
    """
    side = lambda df, x, y: df.select(*keys, member, F.lit(x).alias("a"), F.lit(y).alias("b"))
    met = side(a, 1, 0).union(side(b, 0, 1)).groupBy(*keys, member).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = met.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("nab")).where((F.col("na") > 0) & (F.col("nb") > 0))
    return out.select(*keys, jaccard_counts(F.col("na"), F.col("nb"), F.col("nab")).alias("jaccard"))


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null equals null."""
    renamed = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def adjacent_jaccard(members: DataFrame, sets: list[str], w: str = "w", member: str = "row_id") -> DataFrame:
    """For each set and weight, the mean Jaccard index with the previous and the next weight of its sweep.

    A member's weights are gathered once (as many as a sweep has); each says whether the next weight has the member too.
    """
    grid = members.groupBy(*sets).agg(F.sort_array(F.collect_set(w)).alias("grid"))
    held = members.groupBy(*sets, member).agg(F.collect_set(w).alias("held"))
    placed = null_safe_join(held, grid, sets).select(*sets, "grid", "held", F.explode(F.transform("held", lambda x: F.array_position("grid", x))).alias("at"))
    nxt = F.get("grid", F.col("at").cast("int"))
    counts = placed.groupBy(*sets, "at").agg(F.element_at(F.any_value("grid"), F.col("at").cast("int")).alias(w), F.count(F.lit(1)).alias("size"), F.count_if(F.array_contains("held", nxt)).alias("shared"))
    order = Window.partitionBy(*sets).orderBy("at")
    after = F.lead("size").over(order)
    pair = counts.withColumn("next", F.when(after.isNotNull(), jaccard_counts(F.col("size"), after, F.col("shared"))))
    before = F.lag("next").over(order)
    n = F.col("next").isNotNull().cast("int") + before.isNotNull().cast("int")
    mean = F.when(n > 0, (F.coalesce("next", F.lit(0.0)) + F.coalesce(before, F.lit(0.0))) / n)
    return pair.withColumn("adjacent_jaccard", mean).select(*sets, w, "adjacent_jaccard")


def curve_summary(runs: DataFrame, keys: list[str], metrics: list[str], size: str = "actual_size") -> DataFrame:
    """Mean, median (mid average) and order-statistic quartiles (at floor(q (n - 1))) of metrics over the groups of each point; null keys are keys."""
    wanted = {f"{m}_{name}": (m, q, how) for m in metrics for name, q, how in (("median", 0.5, "linear"), ("q25", 0.25, "lower"), ("q75", 0.75, "lower"))}
    aggs = [F.count(F.lit(1)).cast("int").alias("recording_count"), *[F.avg(F.col(m).cast("double")).alias(f"{m}_mean") for m in metrics], F.avg(size).alias("actual_size_mean")]
    out = quantiles.summarise(runs.select(*dict.fromkeys([*keys, *metrics, size])), keys, aggs, wanted)
    return out.select(*keys, "recording_count", *[f"{m}_{x}" for m in metrics for x in ("mean", "median", "q25", "q75")], "actual_size_mean")
