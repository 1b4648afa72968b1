"""Ranks and running sums in groups of any size.

A window over a group puts the group into one task. Here rows are range-partitioned by
group and order, so that a large group spans many tasks, and each task's part of a
group is continued from the totals of the parts before it. Those totals are one row
per group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.session import Scratch, shuffle_partitions


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, scratch: Scratch) -> DataFrame:
    """df with `name`: the sum of value over the group's rows up to and including this one.

    order must make rows of a group distinct for the result to be the same on every run;
    null values count as 0.
    """
    parts = max(shuffle_partitions(df.sparkSession), 1)
    v = F.coalesce(value, F.lit(0))
    spread = scratch.cut(df.withColumn("_v", v).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "spread")
    totals = spread.groupBy(*group, "_part").agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inside = F.sum("_v").over(W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    keys = [*group, "_part"]
    left = spread.withColumn("_inside", inside)
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(before[k])
        cond = c if cond is None else cond & c
    joined = left.join(before.select(*keys, "_before"), cond).select(*[left[c] for c in left.columns], before["_before"])
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_v", "_part", "_inside", "_before")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """df with `name`: the row's place in its group, from 1."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), name, scratch)
