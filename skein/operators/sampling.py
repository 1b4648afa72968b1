"""Seeded samples by hash order: the same rows on every engine and every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.ranks import ranked
from skein.operators.skew import lookup
from skein.session import Scratch


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, uniformly and without replacement."""
    return df.where(F.col(key).isNotNull()).orderBy(hash_key(key, seed), key).limit(n)


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each group; each task keeps only its first n of a group before the shuffle."""
    w = W.partitionBy(group).orderBy(hash_key(key, seed), key)
    return df.where(F.col(key).isNotNull()).withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def largest_remainder(counts: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, n, quota): total in proportion to n; rest by largest fraction, then stratum.

    counts has a row per stratum.
    """
    share = F.lit(float(total)) * F.col("n") / F.sum("n").over(W.partitionBy())
    x = counts.select(stratum, "n", share.alias("share")).withColumn("base", F.floor("share"))
    left = F.lit(total) - F.sum("base").over(W.partitionBy())
    order = F.row_number().over(W.orderBy(F.desc(F.col("share") - F.col("base")), stratum))
    return x.withColumn("quota", F.col("base") + F.when(order <= left, 1).otherwise(0)).select(stratum, "n", F.col("quota").cast("bigint").alias("quota"))


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    """A sample in proportion to the strata's sizes (largest remainder); strata of any size."""
    counts = df.where(F.col(stratum).isNotNull() & F.col(key).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"))
    quota = largest_remainder(counts, stratum, total)
    return per_group(df.where(F.col(stratum).isNotNull()), stratum, key, total, seed).join(F.broadcast(quota.select(stratum, "quota")), stratum).where(F.col("draw") <= F.col("quota")).drop("quota")


def targeted(df: DataFrame, key: str, text: str, probes: dict[str, str], n: int, seed: int) -> DataFrame:
    """n rows per probe, probes in order of name, no row twice: (probe, draw, ...).

    A row drawn by a probe is not drawn again; of the first probes' draws at most n rows
    per earlier probe can be lost, so n * (earlier + 1) candidates of each are enough.
    """
    spark = df.sparkSession
    taken, out = None, None
    for name in sorted(probes):
        c = df.where(F.coalesce(F.col(text), F.lit("")).rlike(probes[name]))
        if taken is not None:
            c = c.join(F.broadcast(taken), key, "left_anti")
        drawn = sample(c, key, n, seed).withColumn("probe", F.lit(name))
        rows = drawn.select(key).limit(n).collect()  # n rows at most
        ids = spark.createDataFrame([(r[0],) for r in rows], drawn.select(key).schema)
        taken = ids if taken is None else taken.unionByName(ids)
        out = drawn if out is None else out.unionByName(drawn)
    return out


def blinded_order(df: DataFrame, key: str, item: str, seed: int, scratch: Scratch) -> DataFrame:
    """df with position 0, 1, 2 ... in which no two neighbours share an item, whenever that is possible.

    Rows are listed by how often their item occurs, items in hash order, and take first the
    even places, then the odd ones: copies of an item then lie apart unless one item holds
    more than half of all rows. Ranks are found across tasks. key makes rows distinct.
    """
    n = df.count()
    counts = df.groupBy(item).agg(F.count("*").alias("_many"))
    listed = lookup(df, item, counts).withColumn("_less", -F.coalesce("_many", F.lit(0))).withColumn("_item", hash_key(item, seed)).withColumn("_key", hash_key(key, seed)).withColumn("_all", F.lit(0))
    k = F.col("_n") - 1
    half = (n + 1) // 2
    out = ranked(listed, ["_all"], ["_less", "_item", "_key", key], "_n", scratch)
    return out.withColumn("position", F.when(k < half, 2 * k).otherwise(2 * (k - half) + 1)).select(*df.columns, "position")


def neighbours_alike(ordered: DataFrame, item: str) -> DataFrame:
    """(n): neighbouring positions that hold the same item."""
    a = ordered.select("position", F.col(item).alias("a"))
    b = ordered.select((F.col("position") - 1).alias("position"), F.col(item).alias("b"))
    return a.join(b, "position").agg(F.count_if(F.col("a") == F.col("b")).alias("n"))
