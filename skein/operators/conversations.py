"""Conversations as components of the reply graph: participants, order, timing, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import hierarchy as H
from skein.operators.ranks import ranked
from skein.session import Scratch


def members(messages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """messages (id, parent, ...) with root and depth; what is in or before a loop belongs to the loop's smallest id."""
    r = H.roots(messages.select("id", "parent"), scratch)
    return messages.join(r, "id")


def participants(m: DataFrame) -> DataFrame:
    """Per root: turns, customers, other authors, and the status that follows from them.

    m: root, author, inbound. Status is the first that holds of no_customer, no_brand,
    multi_customer, multi_brand, clean; null authors and directions count as nobody.
    """
    distinct = m.groupBy("root", "author", "inbound").agg(F.count("*").alias("n"))
    who = F.col("author").isNotNull()
    p = distinct.groupBy("root").agg(
        F.sum("n").alias("n_turns"),
        F.sum(F.when(F.col("inbound"), F.col("n")).otherwise(0)).alias("n_customer_turns"),
        F.sum(F.when(~F.col("inbound"), F.col("n")).otherwise(0)).alias("n_brand_turns"),
        F.count_if(who & F.col("inbound")).alias("n_customers"),
        F.count_if(who & ~F.col("inbound")).alias("n_brands"),
    )
    status = F.when(F.col("n_customers") == 0, "no_customer").when(F.col("n_brands") == 0, "no_brand").when(F.col("n_customers") > 1, "multi_customer").when(F.col("n_brands") > 1, "multi_brand").otherwise("clean")
    return p.withColumn("status", status)


def dominant(m: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's most frequent value (smallest on ties): counted first, so only (group, value) pairs are compared."""
    n = m.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value))).alias("x")).select(group, F.col(f"x.{value}").alias(value), (-F.col("x.n")).alias("n"))


def thread_counts(m: DataFrame) -> DataFrame:
    """Per root, the most components that any of its customers takes part in."""
    pairs = m.where(F.col("inbound") & F.col("author").isNotNull()).select("root", "author").distinct()
    per = pairs.groupBy("author").agg(F.count("*").alias("k"))
    return pairs.join(per, "author").groupBy("root").agg(F.max("k").alias("customer_thread_count"))


def timing(m: DataFrame) -> DataFrame:
    """Per root: first and last time (microseconds), minutes between, greatest depth."""
    t = m.groupBy("root").agg(F.unix_micros(F.min("ts")).alias("started_us"), F.unix_micros(F.max("ts")).alias("ended_us"), F.max("depth").alias("max_depth"))
    return t.withColumn("minutes", F.round((F.col("ended_us") - F.col("started_us")) / 6e7, 2))


def turn_index(m: DataFrame, scratch: Scratch) -> DataFrame:
    """m with turn_index: the place in its component by (ts, id), from 0, nulls first; components may be of any size."""
    out = ranked(m.withColumn("_null", F.col("ts").isNotNull()), ["root"], ["_null", "ts", "id"], "_n", scratch)
    return out.withColumn("turn_index", (F.col("_n") - 1).cast("int")).drop("_n", "_null")


def invariants(m: DataFrame, source_rows: DataFrame, table: DataFrame) -> DataFrame:
    """(invariant, violations), one row per check: one pass over ids, one over links, one over conversations, one over their table.

    m: id, parent, root, ts, turn_index; source_rows: id; table: root, n_turns, status, n_customers, n_brands.
    """
    both = m.select("id", "root", F.lit(1).alias("here"), F.lit(0).alias("there")).unionByName(source_rows.select("id", F.lit(None).cast("bigint").alias("root"), F.lit(0).alias("here"), F.lit(1).alias("there")))
    ids = both.groupBy("id").agg(F.sum("here").alias("h"), F.sum("there").alias("t"), F.min("root").alias("low"), F.max("root").alias("high"))
    h, t = F.col("h"), F.col("t")
    by_id = ids.agg(
        F.count_if(h > 1).alias("ids_unique"), F.count_if((h > 0) & (t == 0)).alias("ids_as_in_source"), F.count_if(h == 0).alias("source_ids_kept"),
        F.coalesce(F.abs(F.sum(h) - F.sum(t)), F.lit(0)).alias("turn_count_as_in_source"), F.count_if(F.col("low") != F.col("high")).alias("one_conversation_per_id"),
    )
    p = m.select(F.col("id").alias("p_id"), F.col("root").alias("p_root"), F.col("ts").alias("p_ts"))
    edges = m.where(F.col("parent").isNotNull()).join(p, F.col("parent") == F.col("p_id"), "left")
    by_link = edges.agg(F.count_if(F.col("p_id").isNull()).alias("parent_in_source"), F.count_if(F.col("root") != F.col("p_root")).alias("parent_in_same_conversation"), F.count_if(F.col("ts") < F.col("p_ts")).alias("parent_not_later"))
    per = m.groupBy("root").agg(F.min("turn_index").alias("low"), F.max("turn_index").alias("high"), F.count("*").alias("n"))
    by_root = per.agg(F.count_if(F.col("low") != 0).alias("index_from_zero"), F.count_if(F.col("high") + 1 != F.col("n")).alias("index_without_gaps"))
    own = table.groupBy("root").agg(F.count("*").alias("k"), F.sum("n_turns").alias("told"), F.count_if((F.col("status") == "clean") & ((F.col("n_customers") != 1) | (F.col("n_brands") != 1))).alias("odd"))
    by_table = per.join(own, "root", "full").agg(F.count_if(F.col("k") > 1).alias("conversations_unique"), F.coalesce(F.sum("odd"), F.lit(0)).alias("clean_are_dyads"), F.count_if(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("told", F.lit(0)))).alias("turns_add_up"))
    out = None
    for one in (by_id, by_link, by_root, by_table):
        rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("invariant"), F.col(c).cast("bigint").alias("violations")) for c in one.columns))).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def records(t: DataFrame) -> DataFrame:
    """One row per conversation that a customer opens: opening, brand's reply text, follow-ups, counts.

    t: conversation_id, tweet_id, author, role, text, us, turn_index, in numbered turns. The
    reply is the brand's texts in turn order, joined by line breaks; it is built per
    conversation, so its size is that of the conversation's own text.
    """
    first = t.where((F.col("turn_index") == 0) & (F.col("role") == "customer")).groupBy("conversation_id").agg(F.min(F.struct("tweet_id", "author", "text", "us")).alias("o"))
    said = F.array_sort(F.collect_list(F.when((F.col("role") == "brand") & F.col("text").isNotNull(), F.struct("turn_index", "tweet_id", "text"))))
    g = t.groupBy("conversation_id").agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col("role") == "brand").alias("n_brand_turns"),
        F.count_if((F.col("role") == "customer") & (F.col("turn_index") > 0)).alias("customer_followups"),
        F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("brand_reply"),
        F.round((F.max("us") - F.min("us")) / 6e7, 2).alias("minutes"),
    )
    return first.join(g, "conversation_id").select("conversation_id", F.col("o.tweet_id").alias("tweet_id"), F.col("o.author").alias("customer"), F.col("o.text").alias("customer_message"), "brand_reply", "customer_followups", "n_turns", "n_brand_turns", "minutes")


def signals(t: DataFrame, dm_pattern: str, url_pattern: str) -> DataFrame:
    """Per conversation: whether the brand asks for a direct message or links, its mean text length, who opens."""
    brand = F.col("role") == "brand"
    text = F.when(brand, F.coalesce("text", F.lit("")))
    return t.groupBy("conversation_id").agg(
        F.coalesce(F.max(text.rlike(dm_pattern)), F.lit(False)).alias("any_dm"),
        F.coalesce(F.max(text.rlike(url_pattern)), F.lit(False)).alias("any_url"),
        F.avg(F.length(text)).alias("mean_brand_length"),
        F.min(F.when(F.col("turn_index") == 0, F.col("role"))).alias("opened_by"),
    )
