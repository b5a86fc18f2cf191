"""Exact order statistics of groups of any size.

A group of at most ``held`` rows is sorted where its aggregate is made. Larger groups are never gathered: a rank is searched
digit by digit. Each pass counts the values of the intervals in search by a digit that grows with the value, keeps the digit
that holds the rank, and goes on with its real bounds, until an interval is one value or small enough to be numbered.

* Pass 0 takes 64 intervals for each power of two; every later one cuts an interval into ``DIGITS`` equal parts. As such an
  interval has at most 2^46 doubles, there are at most five passes, whatever the values are.
* A pass is a scan of (group, value), counted in tasks before the shuffle; a hot group meets at its digits only.
* Nulls are left out; NaN is the largest value; a group without values has null statistics. Null keys are keys.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vectide.sources.scratch import small, written

#: Rows of a group that one task may sort, and parts of an interval in a pass.
HELD, DIGITS = 100_000, 4096
#: First digits of infinity and of NaN, beyond those of all numbers.
INFINITE, NOT_A_NUMBER = 1 << 20, 1 << 21

#: name -> (column, fraction, "linear" or "lower"): interpolated at q (n - 1), or the value at its floor
Wanted = dict[str, tuple[str, float, str]]


def summarise(df: DataFrame, keys: list[str], aggs: list[Column], wanted: Wanted, held: int | None = None) -> DataFrame:
    """One row a group: its keys, ``aggs`` and the ``wanted`` order statistics. ``df`` is computed once; ``held`` is HELD if not given."""
    held = HELD if held is None else held
    if not keys:
        raise ValueError("order statistics need at least one key")
    seen = Observation()
    rows = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), "order-rows")
    if seen.get["rows"] <= held:
        return rows.groupBy(*keys).agg(*aggs, *_gathered(wanted))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > held)
    large = written(sizes.select(*keys, F.monotonically_increasing_id().alias("__group")), "order-large")
    if large.isEmpty():
        return rows.groupBy(*keys).agg(*aggs, *_gathered(wanted))
    known = small(large.select("__group", *[F.col(k).alias(f"__{k}") for k in keys]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    rest = rows.join(known, same, "left_anti").groupBy(*keys).agg(*aggs, *_gathered(wanted))
    hot = written(rows.join(known, same).drop(*[f"__{k}" for k in keys]), "order-hot")
    out = hot.groupBy("__group").agg(*aggs).join(large, "__group")
    for value in dict.fromkeys(v for v, _, _ in wanted.values()):
        mine = {name: (q, how) for name, (v, q, how) in wanted.items() if v == value}
        found = _searched(hot.select("__group", F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), mine, held)
        out = out.join(found, "__group", "left")
    return rest.unionByName(out.select(*rest.columns))


def _gathered(wanted: Wanted) -> list[Column]:
    """Order statistics of groups that fit a task."""
    out = []
    for name, (value, q, how) in wanted.items():
        v = F.col(value).cast("double")
        if how == "linear":
            out.append(F.percentile(v, F.lit(float(q))).alias(name))
        else:
            out.append(F.get(F.sort_array(F.collect_list(v)), F.floor(F.lit(float(q)) * (F.count(v) - 1)).cast("int")).alias(name))
    return out


def first_digit(v: Column) -> Column:
    """An integer that never falls as the value grows: 64 for each power of two."""
    size = F.abs(v)
    level = F.floor(F.log2(size) * 64).cast("int") + 64 * 1100
    signed = F.when(v > 0, F.lit(1)).otherwise(F.lit(-1))
    return F.when(F.isnan(v), NOT_A_NUMBER).when(v == 0, 0).when(size == float("inf"), signed * INFINITE).otherwise(signed * level)


def next_digit(v: Column, low: Column, high: Column) -> Column:
    """The part of low .. high, which differ, that holds the value: the ends never share one."""
    return F.least(F.floor((v - low) / (high - low) * DIGITS).cast("int"), F.lit(DIGITS - 1))


def _inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """(group, v, low, high) of the values that lie in an interval of their group; intervals of a group don't overlap."""
    of_group = intervals.groupBy("__group").agg(F.collect_list(F.struct("low", "high")).alias("held"))
    at = F.get(F.filter("held", lambda x: (x.low <= F.col("v")) & (F.col("v") <= x.high)), F.lit(0))
    met = values.join(small(of_group), "__group").withColumn("at", at).where("at IS NOT NULL")
    return met.select("__group", "v", "at.low", "at.high")


def _placed(counted: DataFrame, ranks: DataFrame, part: list[str]) -> DataFrame:
    """Where the ranks of each part are: (group, rank, left, n, low, high), ``left`` being the rank inside the digit's values."""
    order = Window.partitionBy(*part).orderBy("digit")
    upto = counted.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    met = upto.join(ranks.withColumnsRenamed({"left": "was"}), part).where((F.col("was") < F.col("upto")) & (F.col("was") >= F.col("upto") - F.col("n")))
    return met.select("__group", "rank", (F.col("was") - F.col("upto") + F.col("n")).alias("left"), "n", F.col("least").alias("low"), F.col("most").alias("high"))


def _searched(values: DataFrame, wanted: dict[str, tuple[float, str]], held: int) -> DataFrame:
    """(group, statistics) of (group, v) by counting digits."""
    bounds = [F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")]
    counted = written(values.groupBy("__group", first_digit(F.col("v")).alias("digit")).agg(*bounds), "order-digits")
    sizes = counted.groupBy("__group").agg(F.sum("n").alias("n"))
    at = {name: F.lit(float(q)) * (F.col("n") - 1) for name, (q, _) in wanted.items()}
    ends = {name: (F.floor(p), F.ceil(p) if wanted[name][1] == "linear" else F.floor(p)) for name, p in at.items()}
    ranks = sizes.select("__group", F.explode(F.array_distinct(F.array(*[e for pair in ends.values() for e in pair]))).alias("rank")).withColumn("left", F.col("rank"))
    state = written(_placed(counted, ranks, ["__group"]), "order-ranks")
    one, numbered = F.col("low") == F.col("high"), F.col("n") <= held
    done = [state.where(one).select("__group", "rank", F.col("low").alias("v"))]
    while True:
        last = state.where(~one & numbered)
        order = Window.partitionBy("__group", "low", "high").orderBy("v")
        found = _inside(values, last.select("__group", "low", "high").distinct()).withColumn("left", (F.row_number().over(order) - 1).cast("long"))
        done.append(found.join(last.select("__group", "low", "high", "left", "rank"), ["__group", "low", "high", "left"]).select("__group", "rank", "v"))
        state = state.where(~one & ~numbered)
        if state.isEmpty():
            break
        rows = _inside(values, state.select("__group", "low", "high").distinct())
        counted = rows.groupBy("__group", "low", "high", next_digit(F.col("v"), F.col("low"), F.col("high")).alias("digit")).agg(*bounds)
        state = written(_placed(counted, state.select("__group", "low", "high", "rank", "left"), ["__group", "low", "high"]), "order-ranks")
        done.append(state.where(one).select("__group", "rank", F.col("low").alias("v")))
    found = reduce(DataFrame.unionByName, done).groupBy("__group").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values"))
    named = {}
    for name, (low, high) in ends.items():
        a, b = F.element_at("values", low), F.element_at("values", high)
        between = (high - at[name]) * a + (at[name] - low) * b
        named[name] = F.when((low == high) | (a == b), a).otherwise(between)
    return found.join(sizes, "__group").select("__group", *[v.alias(k) for k, v in named.items()])
