"""Evidence blocks, prompts and checks of replies."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skein.operators import grounding as G
from skein.plans.registry import Registry
from skein.session import read

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

# evidence by key; every past reply is checked, allowed is the message and the query's other evidence
_EV = """ev AS (SELECT query_id, rank, min(historical_customer_message) AS message, min(historical_brand_reply) AS reply FROM evidence WHERE query_id IS NOT NULL GROUP BY 1, 2),
qs AS (SELECT annotation_id AS query_id, min(text_display) AS message FROM b02_fresh_labelled WHERE annotation_id IS NOT NULL GROUP BY 1),
ot AS (SELECT a.query_id, a.rank, string_agg(coalesce(b.message, '') || ' ' || coalesce(b.reply, ''), ' ' ORDER BY b.rank) AS other FROM ev a JOIN ev b ON a.query_id = b.query_id AND a.rank <> b.rank GROUP BY 1, 2),
c AS (SELECT e.query_id, e.rank, e.reply, coalesce(q.message, '') || ' ' || coalesce(other, '') AS allowed FROM ev e JOIN qs q USING (query_id) LEFT JOIN ot ON ot.query_id = e.query_id AND ot.rank = e.rank)"""
_URL = r"https?://\S+|www\.\S+"


def _evidence(spark, sf):
    e = read(spark, sf, "evidence").where(F.col("query_id").isNotNull())
    return e.groupBy("query_id", "rank").agg(F.min("historical_customer_message").alias("message"), F.min("historical_brand_reply").alias("reply"))


def _messages(spark, sf):
    b = read(spark, sf, "b02_fresh_labelled").where(F.col("annotation_id").isNotNull())
    return b.groupBy(F.col("annotation_id").alias("query_id")).agg(F.min("text_display").alias("question"))


def _checked(spark, sf):
    e = _evidence(spark, sf)
    item = F.concat(F.coalesce("message", F.lit("")), F.lit(" "), F.coalesce("reply", F.lit("")))
    every = e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "reply", item.alias("t")))).alias("all"))  # a query has a handful of items
    c = every.join(_messages(spark, sf), "query_id").select("query_id", "question", "all", F.explode("all").alias("x"))
    other = F.array_join(F.transform(F.filter("all", lambda y: y["rank"] != F.col("x.rank")), lambda y: y["t"]), " ")
    return c.select("query_id", F.col("x.rank").alias("rank"), F.col("x.reply").alias("reply"), F.concat(F.coalesce("question", F.lit("")), F.lit(" "), other).alias("allowed"))


def _list(c):
    return F.array_join(c, "|")


_Q = lambda p: p.replace("'", "''")
_EXTRACT = "list_sort(list_distinct(regexp_extract_all(coalesce({0}, ''), '{1}', 0)))"


@query(f"WITH {_EV}, x AS (SELECT query_id, rank, list_sort(list_filter({_EXTRACT.format('reply', _URL)}, lambda u: NOT list_contains({_EXTRACT.format('allowed', _URL)}, u))) AS f FROM c) SELECT query_id, rank, array_to_string(f, '|') AS found FROM x WHERE len(f) > 0")
def g2_unsupported_url(spark, sf):
    c = _checked(spark, sf).withColumn("f", G.unsupported_urls(F.col("reply"), F.col("allowed")))
    return c.where(F.size("f") > 0).select("query_id", "rank", _list("f").alias("found"))


@query(f"WITH {_EV}, x AS (SELECT query_id, rank, list_filter(list_transform({_EXTRACT.format('reply', G.NUMBER)}, lambda n: trim(n)), lambda n: NOT contains(allowed, n)) AS f FROM c) SELECT query_id, rank, array_to_string(f, '|') AS found FROM x WHERE len(f) > 0")
def g3_unsupported_number(spark, sf):
    c = _checked(spark, sf).withColumn("f", G.unsupported_numbers(F.col("reply"), F.col("allowed")))
    return c.where(F.size("f") > 0).select("query_id", "rank", _list("f").alias("found"))


@query(f"WITH {_EV} SELECT query_id, rank, array_to_string({_EXTRACT.format('lower(reply)', _Q(G.ACTION))}, '|') AS actions, array_to_string({_EXTRACT.format('lower(reply)', _Q(G.RESOLVED))}, '|') AS resolutions FROM c")
def g4_g5_claims(spark, sf):
    return _checked(spark, sf).select("query_id", "rank", _list(G.claims(F.col("reply"), G.ACTION)).alias("actions"), _list(G.claims(F.col("reply"), G.RESOLVED)).alias("resolutions"))


@query(f"WITH {_EV} SELECT query_id, rank, array_to_string({_EXTRACT.format('reply', G.IDENTIFIER)}, '|') AS found FROM c WHERE regexp_matches(coalesce(reply, ''), '{G.IDENTIFIER}')")
def g6_leaked_identifier(spark, sf):
    c = _checked(spark, sf).withColumn("f", G.leaked_identifiers(F.col("reply")))
    return c.where(F.size("f") > 0).select("query_id", "rank", _list("f").alias("found"))


@query()
def g7_copying(spark, sf):
    """Replies that copy a past one: every reply against all others of its query."""
    e = _evidence(spark, sf)
    every = e.groupBy("query_id").agg(F.collect_list(F.struct("rank", "reply")).alias("all"))
    x = e.select("query_id", "rank", "reply").join(every, "query_id")
    x = x.select("query_id", "rank", "reply", F.transform(F.filter("all", lambda y: y["rank"] != F.col("rank")), lambda y: y["reply"]).alias("sources"))
    return G.copying(x, "reply", "sources").select("query_id", "rank", F.round("copy_ratio", 6).alias("copy_ratio"), "copy_span")


_FLAGS = f"""concat_ws('|', CASE WHEN len(list_filter({_EXTRACT.format("reply", _URL)}, lambda u: NOT list_contains({_EXTRACT.format("allowed", _URL)}, u))) > 0 THEN 'unsupported_url' END,
  CASE WHEN len(list_filter(list_transform({_EXTRACT.format("reply", G.NUMBER)}, lambda n: trim(n)), lambda n: NOT contains(allowed, n))) > 0 THEN 'unsupported_number' END,
  CASE WHEN regexp_matches(lower(coalesce(reply, '')), '{_Q(G.ACTION)}') THEN 'action_claim' END, CASE WHEN regexp_matches(lower(coalesce(reply, '')), '{_Q(G.RESOLVED)}') THEN 'resolution_claim' END, CASE WHEN regexp_matches(coalesce(reply, ''), '{G.IDENTIFIER}') THEN 'leaked_identifier' END)"""


@query(f"WITH {_EV}, x AS (SELECT query_id, rank, CASE WHEN trim(regexp_replace(coalesce(reply, ''), '\\s+', ' ', 'g')) = '' THEN 'empty_reply' ELSE {_FLAGS} END AS flags FROM c) SELECT query_id, rank, flags, flags = '' AS passed FROM x")
def grounding_checks(spark, sf):
    """All flags of every past reply, and whether it passes."""
    f = G.flags(F.col("reply"), F.col("allowed"))
    return _checked(spark, sf).select("query_id", "rank", _list(f).alias("flags")).withColumn("passed", F.col("flags") == "")


@query(f"""WITH {_EV}, ln AS (SELECT query_id, rank, '[' || rank || '] Customer: ' || substring(trim(regexp_replace(regexp_replace(coalesce(message, ''), '@\\S+', ' ', 'g'), '\\s+', ' ', 'g'), ' '), 1, 400) || chr(10) || 'Brand: ' || substring(trim(regexp_replace(regexp_replace(coalesce(reply, ''), '@\\S+', ' ', 'g'), '\\s+', ' ', 'g'), ' '), 1, 400) AS line FROM ev)
  SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS block FROM ln GROUP BY 1""")
def format_evidence(spark, sf):
    return G.evidence_block(_evidence(spark, sf))


ORACLE["build_prompt"] = ORACLE["format_evidence"].replace("SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS block FROM ln GROUP BY 1", """, bl AS (SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS block FROM ln GROUP BY 1)
  SELECT q.query_id, sha256('Draft a reply to the customer, using only the past exchanges.' || chr(10) || chr(10) || 'Past exchanges:' || chr(10) || coalesce(block, '(none)') || chr(10) || chr(10) || 'Customer: ' || trim(regexp_replace(regexp_replace(coalesce(q.message, ''), '@\\S+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') || chr(10) || chr(10) || 'Answer as JSON with "reply", "needs_more_information" and "evidence_used".') AS prompt_hash FROM qs q LEFT JOIN bl USING (query_id)""")


@query()
def build_prompt(spark, sf):
    q = _messages(spark, sf).join(G.evidence_block(_evidence(spark, sf)), "query_id", "left")
    return q.select("query_id", F.sha2(G.prompt(F.col("question"), F.col("block")), 256).alias("prompt_hash"))


@query("SELECT annotation_id, sha256('stub' || chr(31) || '0.000' || chr(31) || '42' || chr(31) || coalesce(text_display, '')) AS cache_key FROM b02_fresh_labelled")
def llm_cache_key(spark, sf):
    b = read(spark, sf, "b02_fresh_labelled")
    return b.select("annotation_id", G.cache_key(F.coalesce("text_display", F.lit("")), "stub", 0.0, 42).alias("cache_key"))


@query(f"WITH {_EV} SELECT query_id, trim(regexp_replace(regexp_replace(coalesce(reply, ''), '@\\S+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS echo, 'Thanks for your message. Please send us the details so that we can look into it.' AS fixed FROM ev WHERE rank = 1")
def baseline_replies(spark, sf):
    from skein.functions.text import sanitised

    e = _evidence(spark, sf).where(F.col("rank") == 1)
    return e.select("query_id", sanitised(F.coalesce("reply", F.lit(""))).alias("echo"), F.lit("Thanks for your message. Please send us the details so that we can look into it.").alias("fixed"))


def stub(prompt: str) -> str:
    """A completer for tests: echoes the customer's line; every seventh length fails to be JSON."""
    if len(prompt) % 7 == 0:
        return "no json"
    return json.dumps({"reply": prompt.rsplit("Customer: ", 1)[-1].split("\n")[0][:80], "needs_more_information": False, "evidence_used": ["1"]})


def _drafts(spark, sf):
    q = _messages(spark, sf).join(G.evidence_block(_evidence(spark, sf)), "query_id", "left")
    return G.parse_reply(G.generate(q.select("query_id", G.prompt(F.col("question"), F.col("block")).alias("prompt")), "prompt", stub), "raw")


_PROMPTS = ORACLE["build_prompt"].split("SELECT q.query_id, sha256(")[0]
_PROMPT = ORACLE["build_prompt"].split("SELECT q.query_id, sha256(")[1].split(") AS prompt_hash")[0]
_CLEAN = "trim(regexp_replace(regexp_replace(coalesce(q.message, ''), '@\\S+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
# what the stub answers, and what parsing makes of it
_DRAFTS = f"{_PROMPTS}, dr AS (SELECT q.query_id, length({_PROMPT}) % 7 = 0 AS bad, trim(substring({_CLEAN}, 1, 80)) AS said FROM qs q LEFT JOIN bl USING (query_id))"


@query(f"{_DRAFTS} SELECT query_id, CASE WHEN NOT bad THEN said END AS reply, CASE WHEN NOT bad THEN true END AS coerced, CASE WHEN bad THEN 'invalid_json' END AS error FROM dr")
def generate_replies(spark, sf):
    return _drafts(spark, sf).select("query_id", "parsed.reply", "parsed.coerced", "parsed.error")


@query(f"{_DRAFTS} SELECT count(*) AS n, count(*) FILTER (NOT bad) AS parsed, count(*) FILTER (bad) AS invalid_json, count(*) FILTER (NOT bad) AS coerced, count(*) FILTER (NOT bad AND said = '') AS empty FROM dr")
def generation_summary(spark, sf):
    """Parsed, failed, coerced and empty answers."""
    p = _drafts(spark, sf).select("parsed.*")
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error") == "invalid_json").alias("invalid_json"), F.count_if(F.coalesce("coerced", F.lit(False))).alias("coerced"), F.count_if(F.col("reply") == "").alias("empty"))


@query("SELECT annotation_id, md5('ask ' || t) AS raw, length(t) >= 40 AS cached FROM (SELECT annotation_id, min(coalesce(text_display, '')) AS t FROM b02_fresh_labelled WHERE annotation_id IS NOT NULL GROUP BY 1)")
def cached_generation(spark, sf):
    """Answers to every annotation's text: those of longer texts come from the cache that a first run has written."""
    import hashlib

    from skein.session import Scratch

    s = Scratch(spark, "cache")
    b = read(spark, sf, "b02_fresh_labelled").where(F.col("annotation_id").isNotNull()).groupBy("annotation_id").agg(F.min(F.coalesce("text_display", F.lit(""))).alias("t"))
    asks = s.cut(b.select("annotation_id", "t", F.concat(F.lit("ask "), "t").alias("prompt")), "asks")
    answer = lambda p: hashlib.md5(p.encode()).hexdigest()
    cache = G.AnswerCache(spark, f"{s.base}/answers", "stub", 0.0, 42)
    cache.complete(asks.where(F.length("t") >= 40), "prompt", answer)
    return cache.complete(asks, "prompt", answer).select("annotation_id", "raw", "cached")


@query("SELECT props, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def parse_json_field(spark, sf):
    e = read(spark, sf, "events")
    return e.select("props", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
