"""Per-brand measures of conversations and of the language used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.ranks import ranked
from skein.operators.skew import lookup
from skein.session import Scratch


def brand_metrics(conversations: DataFrame) -> DataFrame:
    """Conversation measures by brand.

    conversations: brand, n_turns, n_brand_turns, any_dm, any_url, mean_brand_length, opened_by,
    minutes. Shares are percent rounded to 2; medians are exact.
    """
    pct = lambda c: F.round(F.count_if(c) * 100.0 / F.count("*"), 2)
    return conversations.where(F.col("brand").isNotNull()).groupBy("brand").agg(
        F.count("*").alias("conversations"),
        F.percentile("n_turns", 0.5).alias("median_turns"),
        pct(F.col("n_turns") >= 4).alias("pct_four_turns"),
        pct(F.col("n_brand_turns") >= 2).alias("pct_two_brand_turns"),
        pct(F.col("any_dm")).alias("pct_dm"),
        pct(F.col("any_url")).alias("pct_url"),
        F.round(F.avg("mean_brand_length"), 2).alias("mean_brand_length"),
        pct(F.col("opened_by") == "brand").alias("pct_brand_opened"),
        F.percentile("minutes", 0.5).alias("median_minutes"),
    )


def language_signals(t: DataFrame, group: str) -> DataFrame:
    """Texts by group with CJK letters, accented letters, foreign words."""
    c = F.coalesce("text", F.lit(""))
    return t.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.count_if(c.rlike(X.CJK)).alias("cjk"), F.count_if(c.rlike(X.ACCENTED)).alias("accented"), F.count_if(c.rlike(X.FOREIGN)).alias("foreign_words"))


def type_token_ratio(t: DataFrame, group: str, order: list[str], budget: int, scratch: Scratch) -> DataFrame:
    """Distinct over all tokens of a group's first `budget` texts in a total order."""
    first = ranked(t.where(F.col(group).isNotNull()).select(group, *order, "text"), [group], order, "_n", scratch).where(F.col("_n") <= budget)
    n = first.select(group, F.explode(X.richness_tokens(F.col("text"))).alias("token")).groupBy(group, "token").agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).withColumn("ttr", F.round(F.col("types") / F.col("tokens"), 6))


def top_terms(t: DataFrame, group: str, k: int, least: int = 4) -> DataFrame:
    """The k most frequent tokens of at least `least` letters by group, ties by token."""
    n = t.where(F.col(group).isNotNull()).select(group, F.explode(X.richness_tokens(F.col("text"))).alias("term")).where(F.length("term") >= least).groupBy(group, "term").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def one_hop(m: DataFrame) -> DataFrame:
    """Measures by brand from single links: a brand is the author of some outbound message.

    m: id, parent, author, inbound, a written table. Links are counted by pair of authors
    first, so that a busy brand is aggregated where its rows are.
    """
    p = m.select(F.col("id").alias("parent"), F.col("author").alias("parent_author"))
    links = lookup(m.where(F.col("parent").isNotNull()).select("id", "parent", F.col("author").alias("child_author")), "parent", p)
    asked = links.select(F.col("parent").alias("id")).distinct().withColumn("_asked", F.lit(True))
    own = m.join(asked, "id", "left").groupBy(F.col("author").alias("brand")).agg(
        F.count("*").alias("messages"), F.count_if(~F.col("inbound")).alias("outbound"), F.count_if(F.col("inbound")).alias("inbound"),
        F.count_if(F.col("parent").isNotNull()).alias("with_parent"), F.count_if(F.col("parent").isNotNull() | F.col("_asked").isNotNull()).alias("linked"),
    ).where((F.col("outbound") > 0) & F.col("brand").isNotNull())
    pairs = links.groupBy("child_author", "parent_author").agg(F.count("*").alias("n"))
    got = pairs.groupBy(F.col("parent_author").alias("brand")).agg(F.sum("n").alias("replies_received"))
    sent = pairs.groupBy(F.col("child_author").alias("brand")).agg(F.sum("n").alias("replies_sent"))
    asked_by = links.select("child_author", "parent").distinct().groupBy(F.col("child_author").alias("brand")).agg(F.count("*").alias("conversation_candidates"))
    either = F.explode(F.array(F.struct(F.col("child_author").alias("brand"), F.col("parent_author").alias("customer")), F.struct(F.col("parent_author").alias("brand"), F.col("child_author").alias("customer"))))
    met = pairs.select(either.alias("x")).select("x.*").where(F.col("brand") != F.col("customer")).distinct().groupBy("brand").agg(F.count("*").alias("customers"))
    out = own.join(got, "brand", "left").join(sent, "brand", "left").join(asked_by, "brand", "left").join(met, "brand", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "brand", "messages", "outbound", "inbound", zero("replies_received"), zero("replies_sent"), zero("customers"), zero("conversation_candidates"),
        F.round(F.col("messages") / F.greatest(F.coalesce("customers", F.lit(0)), F.lit(1)), 2).alias("messages_per_customer"),
        F.round(100.0 * F.col("linked") / F.col("messages"), 1).alias("pct_linked"), F.round(100.0 * F.col("with_parent") / F.col("messages"), 1).alias("pct_with_parent"),
    )


def min_max_score(df: DataFrame, weights: dict[str, float], higher_is_better: dict[str, bool] | None = None) -> DataFrame:
    """df with score: the weighted sum of its columns, each scaled to 0..1 over all rows (1 where all are equal), rounded to 4."""
    up = higher_is_better or {}
    whole = W.partitionBy()  # over one row per brand
    score = F.lit(0.0)
    for c, w in weights.items():
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        x = (F.col(c) - low) / (high - low)
        score = score + F.lit(w) * F.when(high == low, F.lit(1.0)).otherwise(x if up.get(c, True) else 1 - x)
    return df.withColumn("score", F.round(score, 4))
