"""Numbers of rows in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.sources.scratch import written

#: Counted rows up to which one task numbers them.
TASK_ROWS = 20_000


def numbered(df: DataFrame, *by: str, within: str | None = None, name: str = "number") -> DataFrame:
    """``df`` with its rows' numbers from 0 in the order of the columns ``by``, of the whole table or of each value of ``within``.

    Rows are written, so that ranges are drawn from what is there; few ones are numbered by a window. More are sorted by ranges and
    written with their place in the range; what stands before a range is a sum over one row for each range (and value).
    """
    keys = [*([within] if within else []), *by]
    df = written(df, "unnumbered")
    if df.count() <= TASK_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*([within] if within else [])).orderBy(*by)) - 1).cast("long"))
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    # the first place of a value in its range; ranges are as many as shuffle partitions, and a value lies in neighbouring ones
    ranges = placed.groupBy(part.alias("__part"), *([within] if within else [])).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")).collect()
    before, seen = [], {}
    for r in sorted(ranges, key=lambda r: r["__first"]):
        value = r[within] if within else None
        before.append((*([value] if within else []), r["__part"], seen.get(value, 0) - r["__first"]))
        seen[value] = seen.get(value, 0) + r["__n"]
    kinds = ", ".join([*([f"`{within}` {df.schema[within].dataType.simpleString()}"] if within else []), "__part long, __shift long"])
    shifts = df.sparkSession.createDataFrame(before, kinds)
    out = placed.withColumn("__part", part).join(F.broadcast(shifts), ["__part", *([within] if within else [])])
    return out.withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
