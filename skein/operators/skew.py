"""Look-ups by keys of which a few may hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than 1/HOT of the rows are split off; by counting there are fewer than HOT.
HOT = 500


def hot_keys(rows: DataFrame, key: str, hot: int = HOT) -> list:
    """The fewer than `hot` keys that hold more than 1/hot of the rows each; counted map-side first."""
    n = rows.count()
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
    return [r[0] for r in counts.where(F.col("_c") * hot > n + hot).select(key).collect()]


def lookup(rows: DataFrame, key: str, table: DataFrame, how: str = "left", keys: list | None = None) -> DataFrame:
    """rows joined with table, which has at most one row per key.

    Rows of hot keys never meet in one task: the table's rows for these few keys are
    broadcast, and only the others are shuffled. Null keys match nothing. keys: the hot
    keys if they are known; otherwise they are counted, and rows should be a written table.
    """
    keys = hot_keys(rows, key) if keys is None else keys
    if not keys:
        return rows.join(table, key, how)
    known = F.coalesce(F.col(key).isin(keys), F.lit(False))
    big = rows.where(known).join(F.broadcast(table.where(known)), key, how)
    return big.unionByName(rows.where(~known).join(table.where(~known), key, how))
