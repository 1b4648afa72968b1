"""The relations that queries start from, as DataFrames and as SQL of the same meaning.

messages: one row per message of raw_messages with a numeric id (id, parent, author,
inbound, ts, text). turns: one row per (conversation_id, tweet_id) of turns. openings:
turns with index 0 by a customer. classes of labels and sources come as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import numeric_id
from skein.functions.text import parsed_time
from skein.session import read

_NUM = "try_cast(trunc(try_cast(CASE WHEN regexp_full_match(trim({0}), '[+-]?[0-9]+(\\.[0-9]*)?') THEN trim({0}) END AS DECIMAL(38,6))) AS BIGINT)"
_TIME = """coalesce(timezone('UTC', try_strptime(regexp_replace(trim(created_at), '^[A-Za-z]{3} ', ''), '%b %d %H:%M:%S %z %Y')),
  try_strptime(trim(created_at), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(trim(created_at), '%d-%m-%Y %H:%M'), try_strptime(trim(created_at), '%Y-%m-%d'))"""

MESSAGES = f"""messages AS (SELECT id, min(parent) AS parent, min(author) AS author, bool_or(inbound) AS inbound, min(ts) AS ts, min(text) AS text FROM (
  SELECT {_NUM.format("tweet_id")} AS id, {_NUM.format("in_response_to_tweet_id")} AS parent, nullif(trim(author_id), '') AS author,
    lower(trim(inbound)) IN ('true', '1') AS inbound, {_TIME} AS ts, text FROM raw_messages) WHERE id IS NOT NULL GROUP BY id)"""
TURNS = """turns1 AS (SELECT conversation_id, tweet_id, min(nullif(trim(author_id), '')) AS author,
    min(CASE WHEN lower(trim(speaker)) IN ('customer', 'brand') THEN lower(trim(speaker)) END) AS speaker, min(brand) AS brand, epoch_us(min(created_at)) AS us,
    min(text) AS text, min(parent_tweet_id) AS parent, min(turn_index) AS turn_index
  FROM turns WHERE conversation_id IS NOT NULL GROUP BY conversation_id, tweet_id),
 t AS (SELECT *, CASE WHEN regexp_full_match(author, '[0-9]+') THEN 'customer' WHEN author IS NOT NULL THEN 'brand' ELSE speaker END AS role FROM turns1)"""
OPENINGS = TURNS + ", openings AS (SELECT conversation_id, min(tweet_id) AS tweet_id, min(author) AS author, min(brand) AS brand, min(us) AS us, min(text) AS text FROM t WHERE turn_index = 0 AND role = 'customer' GROUP BY conversation_id)"


def _blank_to_null(c: str) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "raw_messages").select(
        numeric_id(F.col("tweet_id")).alias("id"),
        numeric_id(F.col("in_response_to_tweet_id")).alias("parent"),
        _blank_to_null("author_id").alias("author"),
        F.coalesce(F.lower(F.trim("inbound")).isin("true", "1"), F.lit(None)).alias("inbound"),
        parsed_time(F.col("created_at")).alias("ts"),
        "text",
    )
    return r.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"), F.min("author").alias("author"), F.max("inbound").alias("inbound"), F.min("ts").alias("ts"), F.min("text").alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lower(F.trim("speaker"))
    r = read(spark, sf_dir, "turns").where(F.col("conversation_id").isNotNull())
    r = r.groupBy("conversation_id", "tweet_id").agg(
        F.min(_blank_to_null("author_id")).alias("author"),
        F.min(F.when(s.isin("customer", "brand"), s)).alias("speaker"),
        F.min("brand").alias("brand"),
        F.unix_micros(F.min("created_at")).alias("us"),
        F.min("text").alias("text"),
        F.min("parent_tweet_id").alias("parent"),
        F.min("turn_index").alias("turn_index"),
    )
    role = F.when(F.col("author").rlike("^[0-9]+$"), F.lit("customer")).when(F.col("author").isNotNull(), F.lit("brand")).otherwise(F.col("speaker"))
    return r.withColumn("role", role)


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where((F.col("turn_index") == 0) & (F.col("role") == "customer"))
    return t.groupBy("conversation_id").agg(*(F.min(c).alias(c) for c in ("tweet_id", "author", "brand", "us", "text")))


def sql(*parts: str) -> str:
    """A WITH clause of the given relations followed by the last part."""
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body
