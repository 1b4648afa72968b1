"""Data-quality profiles: nulls, malformed values, counts, lengths, duplicates, references.

All functions take and return DataFrames; none gathers rows. Null groups are shown
under a name of their own where a function has a `missing` parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.ranks import running_sum
from skein.operators.skew import lookup
from skein.session import Scratch


def basic(df: DataFrame, time: Column) -> DataFrame:
    """Rows, and the earliest and latest time as microseconds."""
    return df.agg(F.count("*").alias("n_rows"), F.unix_micros(F.min(time)).alias("first_us"), F.unix_micros(F.max(time)).alias("last_us"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for every column, in one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns))).alias("x")).select("x.*")


def malformed(df: DataFrame, column: str, parsed: Column, examples: int = 5) -> DataFrame:
    """(n_malformed, examples): values that are there but do not parse, and the smallest few of them."""
    bad = df.where(F.col(column).isNotNull() & parsed.isNull()).groupBy(column).agg(F.count("*").alias("n"))
    w = W.orderBy(column)
    first = bad.orderBy(column).limit(examples).withColumn("k", F.row_number().over(w)).agg(F.array_sort(F.collect_list(F.struct("k", column))).alias("e"))
    shown = first.select(F.array_join(F.transform("e", lambda x: x[column]), "|").alias("examples"))
    return bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_malformed")).select("n_malformed", shown.scalar().alias("examples"))


def text_flags(df: DataFrame, column: str) -> DataFrame:
    """How many texts hold a link, a mention, an emoji, an agent's signature, or nothing."""
    c = F.coalesce(F.col(column), F.lit(""))
    return df.agg(
        F.count_if(c.rlike(X.URL_PREFIX)).alias("urls"),
        F.count_if(c.rlike(r"@[A-Za-z0-9_]")).alias("mentions"),
        F.count_if(c.rlike(X.EMOJI)).alias("emoji"),
        F.count_if(c.rlike(X.SIGNATURE)).alias("signed"),
        F.count_if(X.blank(F.col(column))).alias("blank"),
    )


def value_counts(df: DataFrame, column: str, missing: str = "<missing>") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def per_month(df: DataFrame, time: Column) -> DataFrame:
    """(month, n); rows without a time are left out."""
    return df.where(time.isNotNull()).groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def month_shares(df: DataFrame, time: Column) -> DataFrame:
    m = per_month(df, time)
    return m.select("month", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))  # a row per month


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, quartiles, 95th percentile and range of text lengths in characters; missing texts count as empty."""
    n = F.length(F.coalesce(F.col(column), F.lit("")))
    q = lambda p, name: F.percentile(n, p).alias(name)
    return df.agg(F.avg(n).alias("mean"), q(0.25, "p25"), q(0.5, "median"), q(0.75, "p75"), q(0.95, "p95"), F.min(n).alias("min"), F.max(n).alias("max"))


def duplicate_stats(df: DataFrame, key: str) -> DataFrame:
    """Rows of keys that repeat, those keys, and keys whose rows are all alike."""
    rest = [c for c in df.columns if c != key]
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(*rest)).alias("kinds")).where(F.col("n") > 1)
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("kinds") == 1).alias("n_identical"))


def crosstab(df: DataFrame, row: Column, column: Column, values: list[str]) -> DataFrame:
    """Counts of row values by column values, zero where a pair does not occur."""
    t = df.select(row.cast("string").alias("row_value"), column.cast("string").alias("c")).groupBy("row_value").pivot("c", values).count()
    return t.select("row_value", *(F.coalesce(F.col(v), F.lit(0)).alias(f"n_{v}") for v in values))


def mixed_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one value."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(value).alias("n_values")).where(F.col("n_values") > 1)


def spearman(df: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Rank correlation with average ranks for ties: Pearson's over two frames of ranks.

    Ranks come from counts of distinct values and their running totals across tasks, so
    that neither rows nor values are ordered in one place.
    """
    pairs = scratch.cut(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), "pairs")

    def with_rank(rows: DataFrame, c: str) -> DataFrame:
        v = pairs.groupBy(c).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
        r = running_sum(v, ["_all"], [c], F.col("_n"), "_upto", scratch)
        return lookup(rows, c, scratch.cut(r.select(c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"r_{c}")), "ranks"), "inner")

    return with_rank(with_rank(pairs, a), b).agg(F.corr(f"r_{a}", f"r_{b}").alias("rho"), F.count("*").alias("n"))


def ordinal_steps(df: DataFrame, group: str, index: str) -> DataFrame:
    """Groups whose index does not run 0, 1, 2 ... without gaps and repeats."""
    g = df.groupBy(group).agg(F.min(index).alias("low"), F.max(index).alias("high"), F.count("*").alias("n"), F.count_distinct(index).alias("kinds"))
    return g.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("kinds") != F.col("n"))).select(group, "low", "high", "n")
