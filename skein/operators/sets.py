"""Semi, anti and reconciling joins on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids; a null key is not."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the ids; rows with a null key stay."""
    return df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both, and of either alone."""
    x = _presence(a, b, key)
    return x.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))


def _presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    both = a.select(F.col(key).alias("k"), F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(b.select(F.col(key).alias("k"), F.lit(False).alias("a"), F.lit(True).alias("b")))
    return both.where(F.col("k").isNotNull()).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def reconcile(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Observed against expected keys: repeated, missing and unexpected ones."""
    both = expected.select(F.col(key).alias("k"), F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(observed.select(F.col(key).alias("k"), F.lit(0).alias("e"), F.lit(1).alias("o")))
    n = both.where(F.col("k").isNotNull()).groupBy("k").agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
    return n.agg(F.count_if(F.col("o") > 1).alias("repeated"), F.count_if(F.col("o") == 0).alias("missing"), F.count_if(F.col("e") == 0).alias("unexpected"))


def subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of a are not in b, and whether there are none."""
    return overlap(a, b, key).select(F.col("only_a").alias("n_outside"), (F.col("only_a") == 0).alias("is_subset"))


def first_per_group(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first row of each group by a total order, without sorting groups in one task."""
    rest = [c for c in df.columns if c != group and c not in order]
    return df.groupBy(group).agg(F.min(F.struct(*order, *rest)).alias("x")).select(group, "x.*")
