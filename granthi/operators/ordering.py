"""Running values over possibly huge groups, computed block by block.

A plain window would sort a hot group in one task. Here a group is cut into blocks of its
order column; only one summary row per block meets in the window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def running_sum(df: DataFrame, key: str, order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over the rows of the same key that come strictly before this one."""
    blocked = df.withColumn("_b", F.floor(F.col(order) / block))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        blocked.groupBy(key, "_b").agg(F.sum(value).alias("_t"))
        .select(key, "_b", F.coalesce(F.sum("_t").over(whole), F.lit(0)).alias("_before"))
    )
    return (
        blocked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [key, "_b"])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_b", "_in", "_before")
    )


def last_before(df: DataFrame, key: str, order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Latest non-null ``value`` of the same key strictly before this row."""
    blocked = df.withColumn("_b", F.floor(F.col(order) / block))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tails = (
        blocked.groupBy(key, "_b")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_v"))
        .select(key, "_b", F.last("_v", ignorenulls=True).over(whole).alias("_carried"))
    )
    return (
        blocked.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
        .join(tails, [key, "_b"])
        .withColumn(out, F.coalesce("_in", "_carried"))
        .drop("_b", "_in", "_carried")
    )
