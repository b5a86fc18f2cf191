"""The interactive surface: cross-filters, charts, tags, curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.text import TAG_SEPARATOR, canonical_tags


class CrossFilter:
    """Named predicate sources over one table, combined with AND; a null predicate filters nothing."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.sources = df, {}

    def set(self, source: str, predicate: Column | None) -> CrossFilter:
        self.sources[source] = predicate
        return self

    def predicate(self, but: str | None = None) -> Column:
        return reduce(lambda a, b: a & b, [p for s, p in self.sources.items() if p is not None and s != but], F.lit(True))

    def rows(self, but: str | None = None) -> DataFrame:
        """What the predicates leave; a chart leaves out its own source (``but``)."""
        return self.df.where(self.predicate(but))


class Cube:
    """Charts that filter one another, answered from counts: the table is read once, and brushes only read the counts.

    ``bins`` names the bin of each chart's dimension. Counts of all combinations that occur are a table of at most as many rows as there
    are combinations, whatever the table has; ``where`` is a folder for it.
    """

    def __init__(self, df: DataFrame, bins: dict[str, Column], where: str) -> None:
        counts = df.select(*[b.alias(n) for n, b in bins.items()]).groupBy(*bins).agg(F.count(F.lit(1)).alias("count"))
        counts.write.mode("error").parquet(where)
        self.counts, self.names, self.brushes = df.sparkSession.read.schema(counts.schema).parquet(where), list(bins), {}

    def brush(self, name: str, low: object = None, high: object = None, values: list | None = None) -> Cube:
        """Keep bins from ``low`` to ``high``, or the listed ones (null may be one); without any of them the chart's brush is lifted."""
        if name not in self.names:
            raise KeyError(name)
        c, parts = F.col(name), []
        if low is not None:
            parts.append(c >= F.lit(low))
        if high is not None:
            parts.append(c <= F.lit(high))
        if values is not None:
            parts.append(reduce(lambda a, b: a | b, [c.eqNullSafe(F.lit(v)) for v in values], F.lit(False)))
        self.brushes[name] = reduce(lambda a, b: a & b, parts) if parts else None
        return self

    def chart(self, name: str) -> DataFrame:
        """(bin, count) of a chart under the brushes of all others."""
        kept = reduce(lambda a, b: a & b, [p for n, p in self.brushes.items() if p is not None and n != name], F.lit(True))
        return self.counts.where(kept).groupBy(F.col(name).alias("bin")).agg(F.sum("count").alias("count"))

    def total(self) -> DataFrame:
        """(count): rows under all brushes."""
        kept = reduce(lambda a, b: a & b, [p for p in self.brushes.values() if p is not None], F.lit(True))
        return self.counts.where(kept).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))


def bin_of(column: str, low: float, high: float, bins: int) -> Column:
    """The number of an equal bin over [low, high], the last one closed; null outside."""
    v = F.col(column).cast("double")
    return F.when((v >= low) & (v <= high), F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count): equal bins over [low, high), the last one closed."""
    v = F.col(column).cast("double")
    at = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def top_categories(df: DataFrame, column: str, most: int = 10, other: str = "(other)") -> DataFrame:
    """(category, count): the ``most`` frequent ones, ties by name, and all the rest."""
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), "category").limit(most).select(F.col("category").alias("__c"), F.lit(True).alias("__first"))
    named = counts.join(F.broadcast(first), F.col("category").eqNullSafe(F.col("__c")), "left")
    return named.groupBy(F.when(F.col("__first"), F.col("category")).otherwise(other).alias("category")).agg(F.sum("n").alias("count"))


def predicate_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(name, count) of named predicates, one pass."""
    one = df.agg(*[F.count_if(p).alias(str(i)) for i, p in enumerate(predicates.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(str(i)).alias("count")) for i, n in enumerate(predicates)])).alias("x")).select("x.*")


def label_columns(lookup: DataFrame, atlas: DataFrame, key: str = "dataset") -> list[str]:
    """Columns of a lookup that do not shadow the atlas."""
    return [c for c in lookup.columns if c != key and c not in atlas.columns]


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """(tag, tag_count): every tag, with the largest number of tags beside it."""
    tags = F.split(canonical_tags(F.col(column)), TAG_SEPARATOR)
    some = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.explode(tags).alias("tag"), F.size(tags).alias("n"))
    return some.groupBy("tag").agg(F.max("n").alias("tag_count"))


def is_multi_tag(df: DataFrame, column: str) -> bool:
    return (tag_counts(df, column).agg(F.max("tag_count")).first()[0] or 0) > 1


def curve(summary: DataFrame, method: str, direction: str, eta: float, kernel: str | None, metric: str) -> DataFrame:
    """Points of an operating curve: w, mean and quartiles with the mean in their place if null."""
    rows = summary.where((F.col("method") == method) & (F.col("direction") == direction) & (F.col("selection_eta") == eta) & F.col("kernel_method").eqNullSafe(F.lit(kernel)))
    mean = F.col(f"{metric}_mean")
    return rows.select("w_interaction", mean.alias("mean"), F.coalesce(F.col(f"{metric}_q25"), mean).alias("low"), F.coalesce(F.col(f"{metric}_q75"), mean).alias("high"))


def axis(points: DataFrame) -> DataFrame:
    """(low, high) of an axis, at least 1e-9 apart."""
    out = points.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return out.withColumn("high", F.greatest(F.col("high"), F.col("low") + 1e-9))
