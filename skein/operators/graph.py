"""Reply-graph operators on (id, parent) rows; the hierarchy itself is in hierarchy.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fan-out thresholds.
FANOUT = (10, 50)


def child_edges(df: DataFrame, id_col: str, children: str) -> DataFrame:
    """(id, child) from a comma list; entries that are no numbers are left out."""
    c = F.explode(F.split(F.coalesce(F.col(children), F.lit("")), ","))
    return df.select(F.col(id_col).alias("id"), c.alias("c")).select("id", F.trim("c").try_cast("bigint").alias("child")).where(F.col("child").isNotNull() & F.col("id").isNotNull())


def edge_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two edge sets (parent, child): in both, in one only, and their agreement in percent of the union."""
    x = a.distinct().withColumn("in_a", F.lit(1)).join(b.distinct().withColumn("in_b", F.lit(1)), ["parent", "child"], "full")
    n = x.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
    total = F.col("both") + F.col("only_a") + F.col("only_b")
    return n.withColumn("agreement_pct", F.round(F.try_divide(F.col("both") * 100.0, total), 2))


def dangling(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct references (ref) that are no node (id)."""
    return refs.select("ref").where(F.col("ref").isNotNull()).distinct().join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti")


def children_counts(nodes: DataFrame) -> DataFrame:
    """(id, n_children) for every node, counted before the join so that no parent is a hot key."""
    n = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("n_children"))


def children_histogram(nodes: DataFrame) -> DataFrame:
    """Nodes without, with one, two, three or more children; the most; orphans; fan-out."""
    c = children_counts(nodes).join(nodes.select("id", F.col("parent").isNull().alias("no_parent")), "id")
    k = F.col("n_children")
    agg = [F.count_if(k == 0).alias("none"), F.count_if(k == 1).alias("one"), F.count_if(k == 2).alias("two"), F.count_if(k >= 3).alias("three_or_more"), F.max(k).alias("most"), F.count_if((k == 0) & F.col("no_parent")).alias("orphans")]
    for t in FANOUT:
        agg += [F.count_if(k >= t).alias(f"fanout_{t}"), F.sum(F.when(k >= t, k).otherwise(0)).alias(f"replies_{t}")]
    return c.agg(*agg).withColumn("branching_pct", F.round((F.col("two") + F.col("three_or_more")) * 100.0 / F.greatest(F.col("one") + F.col("two") + F.col("three_or_more"), F.lit(1)), 2))


def with_parent(nodes: DataFrame, *columns: str) -> DataFrame:
    """nodes joined with attributes of the parent (p_...); rows without one in the table drop out."""
    p = nodes.select(F.col("id").alias("p_id"), *(F.col(c).alias(f"p_{c}") for c in columns))
    return nodes.join(p, nodes.parent == p.p_id)


def chronology(nodes: DataFrame) -> DataFrame:
    """Edges whose parent is earlier, of the same time, or later; edges without both times are left out."""
    e = with_parent(nodes, "ts").where(F.col("ts").isNotNull() & F.col("p_ts").isNotNull())
    return e.agg(F.count_if(F.col("p_ts") < F.col("ts")).alias("earlier"), F.count_if(F.col("p_ts") == F.col("ts")).alias("tie"), F.count_if(F.col("p_ts") > F.col("ts")).alias("later"))
