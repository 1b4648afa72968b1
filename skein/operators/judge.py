"""Judging replies by a model: strict parsing, a run with one retry, status by item.

Parsing stays in the JVM. An infrastructure failure (the completer raises) is tried once
more; an answer that does not parse is final. Empty replies are not sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.grounding import Completer, generate, retry_failures
from skein.session import Scratch

LOW, HIGH, MOST_WORDS = 1, 5, 40


def judgement(raw: Column) -> Column:
    """A struct (score, reason, error) of an answer that must be {"score": 1 ... 5, "reason": at most 40 words}; error is null if it is."""
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    keys = F.array_sort(F.json_object_keys(raw))
    score, reason = F.try_variant_get(v, "$.score", "bigint"), F.try_variant_get(v, "$.reason", "string")
    words = F.size(F.split(F.trim(F.regexp_replace(reason, r"\s+", " ")), " "))
    error = (
        F.when(v.isNull(), "invalid_json")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_an_object")
        .when(~F.coalesce(keys == F.array(F.lit("reason"), F.lit("score")), F.lit(False)), "wrong_keys")
        .when(F.coalesce(kind("$.score") != "BIGINT", F.lit(True)), "score_not_a_number")
        .when(~score.between(LOW, HIGH), "score_out_of_range")
        .when(F.coalesce(kind("$.reason") != "STRING", F.lit(True)), "reason_not_text")
        .when(words > MOST_WORDS, "reason_too_long")
    )
    return F.struct(F.when(error.isNull(), score).alias("score"), F.when(error.isNull(), reason).alias("reason"), error.alias("error"))


def run(items: DataFrame, dimensions: list[str], complete: Completer, again: Completer | None = None) -> DataFrame:
    """(item, dimension, score, reason, error, failure) of items (item, message, reply), a row per dimension.

    again: the completer of the second try, by default the first one's. Empty and null
    replies get error empty_reply without a call.
    """
    s = Scratch(items.sparkSession, "judge")
    asked = items.select("item", "message", "reply", F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    prompt = F.concat(F.lit("Rate the "), "dimension", F.lit(" of the reply from 1 to 5.\nCustomer: "), F.coalesce("message", F.lit("")), F.lit("\nReply: "), F.coalesce("reply", F.lit("")), F.lit('\nAnswer as JSON with "score" and "reason".'))
    asked = s.cut(asked.withColumn("id", F.concat_ws("\x01", "item", "dimension")).withColumn("prompt", prompt), "asked")
    sent = asked.where(~X.blank(F.col("reply")))
    first = s.cut(generate(sent, "prompt", complete), "first")
    second = s.cut(generate(first.where(F.col("failure").isNotNull()).drop("raw", "failure"), "prompt", again or complete), "second")
    merged = retry_failures(first, second, "id").withColumn("j", judgement(F.col("raw")))
    done = merged.select("item", "dimension", "j.score", "j.reason", F.when(F.col("failure").isNull(), F.col("j.error")).alias("error"), "failure")
    none = asked.where(X.blank(F.col("reply"))).select("item", "dimension", F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("string").alias("reason"), F.lit("empty_reply").alias("error"), F.lit(None).cast("string").alias("failure"))
    return done.unionByName(none)


def item_status(judged: DataFrame) -> DataFrame:
    """(item, status): failed if a call failed twice, empty without a reply, unparsed if an answer did not parse, else complete."""
    g = judged.groupBy("item").agg(F.count_if(F.col("failure").isNotNull()).alias("f"), F.count_if(F.col("error") == "empty_reply").alias("e"), F.count_if(F.col("error").isNotNull()).alias("u"))
    return g.select("item", F.when(F.col("f") > 0, "failed").when(F.col("e") > 0, "empty").when(F.col("u") > 0, "unparsed").otherwise("complete").alias("status"))


def dimension_summary(judged: DataFrame) -> DataFrame:
    """By dimension: judged and unusable answers, mean score, counts of the scores."""
    ok = F.col("score").isNotNull()
    return judged.groupBy("dimension").agg(F.count_if(ok).alias("judged"), F.count_if(~ok).alias("unusable"), F.round(F.avg("score"), 6).alias("mean"), *(F.count_if(F.col("score") == k).alias(f"n{k}") for k in range(LOW, HIGH + 1)))
