"""Conversations rebuilt from the reply graph, and measures by brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import brands as B
from skein.operators import conversations as C
from skein.operators import hierarchy as H
from skein.plans import relations as R
from skein.plans.registry import Registry
from skein.session import Scratch

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_UP = """links AS (SELECT m.id, k.id AS p FROM messages m LEFT JOIN messages k ON m.parent = k.id),
up(id, a) AS (SELECT id, p FROM links WHERE p IS NOT NULL UNION SELECT u.id, l.p FROM up u JOIN links l ON u.a = l.id WHERE l.p IS NOT NULL),
top AS (SELECT id FROM links WHERE p IS NULL),
ring AS (SELECT id FROM up WHERE id = a),
resolved AS (SELECT id, id AS root, 0 AS depth FROM top
  UNION ALL SELECT u.id, max(CASE WHEN x.id IS NOT NULL THEN u.a END), count(*) FROM up u LEFT JOIN top x ON x.id = u.a GROUP BY u.id HAVING count(x.id) > 0
  UNION ALL SELECT u.id, min(u.a), -1 FROM up u JOIN ring r ON r.id = u.a GROUP BY u.id),
m AS (SELECT messages.*, root, depth FROM messages JOIN resolved USING (id))"""
_M = "WITH RECURSIVE " + R.MESSAGES + ",\n" + _UP


def _members(spark, sf):
    s = Scratch(spark, "members")
    return s.cut(C.members(s.cut(R.messages(spark, sf), "messages"), s), "members"), s


@query(f"{_M} SELECT id, root FROM m")
def graph_roots(spark, sf):
    return H.roots(R.messages(spark, sf).select("id", "parent")).select("id", "root")


@query(f"{_M} SELECT id, CAST(depth AS INTEGER) AS depth FROM m WHERE depth >= 0")
def graph_depth(spark, sf):
    return H.roots(R.messages(spark, sf).select("id", "parent")).where(F.col("depth") >= 0).select("id", "depth")


@query(f"{_M} SELECT count(DISTINCT root) AS n_loops, count(*) AS n_messages FROM m WHERE depth = -1")
def graph_cycles(spark, sf):
    r = H.roots(R.messages(spark, sf).select("id", "parent")).where(F.col("depth") == -1)
    return r.agg(F.count_distinct("root").alias("n_loops"), F.count("*").alias("n_messages"))


_STATUS = """part AS (SELECT root, count(*) AS n_turns, count(*) FILTER (inbound) AS n_customer_turns, count(*) FILTER (NOT inbound) AS n_brand_turns,
  count(DISTINCT author) FILTER (inbound) AS n_customers, count(DISTINCT author) FILTER (NOT inbound) AS n_brands FROM m GROUP BY root),
st AS (SELECT *, CASE WHEN n_customers = 0 THEN 'no_customer' WHEN n_brands = 0 THEN 'no_brand' WHEN n_customers > 1 THEN 'multi_customer' WHEN n_brands > 1 THEN 'multi_brand' ELSE 'clean' END AS status FROM part)"""


@query(f"{_M}, {_STATUS} SELECT * FROM st")
def conversation_participants(spark, sf):
    return C.participants(_members(spark, sf)[0])


@query(f"{_M}, {_STATUS} SELECT root, status FROM st")
def conversation_status(spark, sf):
    return C.participants(_members(spark, sf)[0]).select("root", "status")


@query(f"{_M}, {_STATUS} SELECT status, count(*) AS conversations, CAST(sum(n_turns) AS BIGINT) AS turns, quantile_cont(n_turns, 0.5) AS median_turns, max(n_turns) AS most_turns FROM st GROUP BY status")
def status_summary(spark, sf):
    p = C.participants(_members(spark, sf)[0])
    return p.groupBy("status").agg(F.count("*").alias("conversations"), F.sum("n_turns").alias("turns"), F.percentile("n_turns", 0.5).alias("median_turns"), F.max("n_turns").alias("most_turns"))


@query(f"{_M} SELECT root, author, n FROM (SELECT root, author, count(*) AS n, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, author) AS k FROM m WHERE NOT inbound AND author IS NOT NULL GROUP BY root, author) WHERE k = 1")
def dominant_author(spark, sf):
    return C.dominant(_members(spark, sf)[0].where(~F.col("inbound")), "root", "author")


@query(f"{_M}, pairs AS (SELECT DISTINCT root, author FROM m WHERE inbound AND author IS NOT NULL), k AS (SELECT author, count(*) AS k FROM pairs GROUP BY 1) SELECT root, max(k) AS customer_thread_count FROM pairs JOIN k USING (author) GROUP BY root")
def customer_thread_count(spark, sf):
    return C.thread_counts(_members(spark, sf)[0])


@query(f"{_M} SELECT root, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, CAST(max(depth) AS INTEGER) AS max_depth, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 2) AS minutes FROM m GROUP BY root")
def conversation_timing(spark, sf):
    return C.timing(_members(spark, sf)[0])


_INDEX = "CAST(row_number() OVER (PARTITION BY root ORDER BY ts IS NOT NULL, ts, id) - 1 AS INTEGER) AS turn_index"


@query(f"{_M} SELECT id, root, {_INDEX} FROM m")
def turn_index(spark, sf):
    m, s = _members(spark, sf)
    return C.turn_index(m.select("id", "root", "ts"), s).select("id", "root", "turn_index")


@query(f"{_M} SELECT 'conv_' || root AS conversation_id, id AS tweet_id, author, CASE WHEN inbound THEN 'customer' WHEN NOT inbound THEN 'brand' END AS speaker, parent AS parent_tweet_id, {_INDEX} FROM m")
def turns_table(spark, sf):
    m, s = _members(spark, sf)
    return C.turn_index(m, s).select(F.concat(F.lit("conv_"), "root").alias("conversation_id"), F.col("id").alias("tweet_id"), "author", F.when(F.col("inbound"), "customer").when(~F.col("inbound"), "brand").alias("speaker"), F.col("parent").alias("parent_tweet_id"), "turn_index")


@query(f"""{_M}, {_STATUS}, dom AS (SELECT root, author AS brand FROM (SELECT root, author, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, author) AS k FROM m WHERE NOT inbound AND author IS NOT NULL GROUP BY root, author) WHERE k = 1),
  tm AS (SELECT root, CAST(max(depth) AS INTEGER) AS max_depth, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 2) AS minutes FROM m GROUP BY root)
  SELECT 'conv_' || st.root AS conversation_id, dom.brand, status, n_turns, n_customers, n_brands, max_depth, minutes, coalesce(o.parent IS NOT NULL AND max_depth >= 0, false) AS root_truncated
  FROM st LEFT JOIN dom USING (root) JOIN tm USING (root) JOIN messages o ON o.id = st.root""")
def reconstruct_conversations(spark, sf):
    m, _ = _members(spark, sf)
    brand = C.dominant(m.where(~F.col("inbound")), "root", "author").select("root", F.col("author").alias("brand"))
    top = m.where(F.col("id") == F.col("root")).select("root", F.col("parent").isNotNull().alias("told"))
    out = C.participants(m).join(brand, "root", "left").join(C.timing(m), "root").join(top, "root")
    return out.select(F.concat(F.lit("conv_"), "root").alias("conversation_id"), "brand", "status", "n_turns", "n_customers", "n_brands", "max_depth", "minutes", (F.col("told") & (F.col("max_depth") >= 0)).alias("root_truncated"))


@query(f"""{_M}, {_STATUS}, x AS (SELECT *, {_INDEX} FROM m), e AS (SELECT c.root, p.id AS p_id, p.root AS p_root, c.ts, p.ts AS p_ts FROM x c LEFT JOIN x p ON c.parent = p.id WHERE c.parent IS NOT NULL), per AS (SELECT root, min(turn_index) AS low, max(turn_index) AS high, count(*) AS n FROM x GROUP BY root)
  SELECT 'ids_unique' AS invariant, (SELECT count(*) FROM (SELECT id FROM x GROUP BY id HAVING count(*) > 1)) AS violations
  UNION ALL SELECT 'ids_as_in_source', (SELECT count(*) FROM x WHERE id NOT IN (SELECT id FROM messages))
  UNION ALL SELECT 'source_ids_kept', (SELECT count(*) FROM messages WHERE id NOT IN (SELECT id FROM x))
  UNION ALL SELECT 'turn_count_as_in_source', abs((SELECT count(*) FROM x) - (SELECT count(*) FROM messages))
  UNION ALL SELECT 'one_conversation_per_id', (SELECT count(*) FROM (SELECT id FROM x GROUP BY id HAVING count(DISTINCT root) > 1))
  UNION ALL SELECT 'parent_in_source', (SELECT count(*) FROM e WHERE p_id IS NULL)
  UNION ALL SELECT 'parent_in_same_conversation', (SELECT count(*) FROM e WHERE root <> p_root)
  UNION ALL SELECT 'parent_not_later', (SELECT count(*) FROM e WHERE ts < p_ts)
  UNION ALL SELECT 'index_from_zero', (SELECT count(*) FROM per WHERE low <> 0)
  UNION ALL SELECT 'index_without_gaps', (SELECT count(*) FROM per WHERE high + 1 <> n)
  UNION ALL SELECT 'conversations_unique', (SELECT count(*) FROM (SELECT root FROM st GROUP BY root HAVING count(*) > 1))
  UNION ALL SELECT 'clean_are_dyads', (SELECT count(*) FROM st WHERE status = 'clean' AND (n_customers <> 1 OR n_brands <> 1))
  UNION ALL SELECT 'turns_add_up', (SELECT count(*) FROM per FULL JOIN st USING (root) WHERE coalesce(n, 0) <> coalesce(n_turns, 0))""")
def reconstruction_invariants(spark, sf):
    m, s = _members(spark, sf)
    table = s.cut(C.participants(m), "table")
    return C.invariants(s.cut(C.turn_index(m.select("id", "parent", "root", "ts"), s), "numbered"), s.cut(R.messages(spark, sf).select("id"), "source"), table)


# -- records and signals over the exported turns ---------------------------------------

_REC = """first AS (SELECT conversation_id, min((tweet_id, author, text, us)) AS o FROM t WHERE turn_index = 0 AND role = 'customer' GROUP BY 1),
g AS (SELECT conversation_id, count(*) AS n_turns, count(*) FILTER (role = 'brand') AS n_brand_turns, count(*) FILTER (role = 'customer' AND turn_index > 0) AS customer_followups,
  coalesce(string_agg(text, chr(10) ORDER BY turn_index, tweet_id) FILTER (role = 'brand'), '') AS brand_reply, round((max(us) - min(us)) / 6e7, 2) AS minutes FROM t GROUP BY 1)"""


@query(R.sql(R.TURNS, """o AS (SELECT conversation_id, arg_min(tweet_id, tweet_id) AS tweet_id, arg_min_null(author, tweet_id) AS customer, arg_min_null(text, tweet_id) AS customer_message FROM t WHERE turn_index = 0 AND role = 'customer' GROUP BY 1)""",
  _REC.split(",\n", 1)[1], "SELECT o.conversation_id, tweet_id, customer, customer_message, brand_reply, customer_followups, n_turns, n_brand_turns, minutes FROM o JOIN g USING (conversation_id)"))
def corpus_records(spark, sf):
    return C.records(R.turns(spark, sf))


_SIG = r"""sig AS (SELECT conversation_id, coalesce(bool_or(role = 'brand' AND regexp_matches(coalesce(text, ''), '(?i)(^|[^a-z0-9_])(?:dms?|direct message|private message|pm us|inbox)([^a-z0-9_]|$)')), false) AS any_dm,
  coalesce(bool_or(role = 'brand' AND regexp_matches(coalesce(text, ''), 'https?://')), false) AS any_url, avg(CASE WHEN role = 'brand' THEN length(coalesce(text, '')) END) AS mean_brand_length,
  min(CASE WHEN turn_index = 0 THEN role END) AS opened_by FROM t GROUP BY 1)"""


@query(R.sql(R.TURNS, _SIG, "SELECT * FROM sig"))
def conversation_signals(spark, sf):
    return C.signals(R.turns(spark, sf), X.DM, X.URL_PREFIX)


def _with_brand(spark, sf):
    t = R.turns(spark, sf)
    per = t.groupBy("conversation_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "brand").alias("n_brand_turns"), F.round((F.max("us") - F.min("us")) / 6e7, 2).alias("minutes"), F.min("brand").alias("brand"))
    return per.join(C.signals(t, X.DM, X.URL_PREFIX), "conversation_id")


_BM = """per AS (SELECT conversation_id, count(*) AS n_turns, count(*) FILTER (role = 'brand') AS n_brand_turns, round((max(us) - min(us)) / 6e7, 2) AS minutes, min(brand) AS brand FROM t GROUP BY 1),
bm AS (SELECT brand, count(*) AS conversations, quantile_cont(n_turns, 0.5) AS median_turns, round(count(*) FILTER (n_turns >= 4) * 100.0 / count(*), 2) AS pct_four_turns,
  round(count(*) FILTER (n_brand_turns >= 2) * 100.0 / count(*), 2) AS pct_two_brand_turns, round(count(*) FILTER (any_dm) * 100.0 / count(*), 2) AS pct_dm, round(count(*) FILTER (any_url) * 100.0 / count(*), 2) AS pct_url,
  round(avg(mean_brand_length), 2) AS mean_brand_length, round(count(*) FILTER (opened_by = 'brand') * 100.0 / count(*), 2) AS pct_brand_opened, quantile_cont(minutes, 0.5) AS median_minutes
  FROM per JOIN sig USING (conversation_id) WHERE brand IS NOT NULL GROUP BY brand)"""


@query(R.sql(R.TURNS, _SIG, _BM, "SELECT * FROM bm"))
def brand_metrics(spark, sf):
    return B.brand_metrics(_with_brand(spark, sf))


@query(R.sql(R.TURNS, _SIG, _BM, "SELECT conversation_id, brand, any_dm, any_url FROM per LEFT JOIN sig USING (conversation_id)"))
def brand_signals_join(spark, sf):
    return _with_brand(spark, sf).select("conversation_id", "brand", "any_dm", "any_url")


#: Weights of the score's criteria; a choice of this query, not of the operator.
SCORE = {"conversations": 0.4, "pct_four_turns": 0.4, "pct_dm": 0.2}


@query(R.sql(R.TURNS, _SIG, _BM, "lim AS (SELECT min(conversations) AS a, max(conversations) AS b, min(pct_four_turns) AS c, max(pct_four_turns) AS d, min(pct_dm) AS e, max(pct_dm) AS f FROM bm)",
  "SELECT brand, round(0.4 * CASE WHEN b = a THEN 1.0 ELSE (conversations - a) / (b - a) END + 0.4 * CASE WHEN d = c THEN 1.0 ELSE (pct_four_turns - c) / (d - c) END + 0.2 * CASE WHEN f = e THEN 1.0 ELSE 1 - (pct_dm - e) / (f - e) END, 4) AS score FROM bm, lim"))
def brand_score(spark, sf):
    return B.min_max_score(B.brand_metrics(_with_brand(spark, sf)), SCORE, {"pct_dm": False}).select("brand", "score")


@query(R.sql(R.TURNS, "SELECT brand, count(*) AS n, count(*) FILTER (regexp_matches(c, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]')) AS cjk, count(*) FILTER (regexp_matches(c, '[\\x{00C0}-\\x{024F}]')) AS accented, count(*) FILTER (regexp_matches(c, '" + X.FOREIGN + "')) AS foreign_words FROM (SELECT brand, coalesce(text, '') AS c FROM t WHERE brand IS NOT NULL) GROUP BY 1"))
def language_signals(spark, sf):
    return B.language_signals(R.turns(spark, sf), "brand")


_RICH = "regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://', ' ', 'g'), '@\\S+', ' ', 'g')), '[a-z'']+')"


@query(R.sql(R.OPENINGS, f"f AS (SELECT brand, unnest({_RICH}) AS w FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY us, tweet_id) AS k FROM openings WHERE brand IS NOT NULL) WHERE k <= 5000)", "SELECT brand, count(DISTINCT w) AS types, count(*) AS tokens, round(count(DISTINCT w) / count(*), 6) AS ttr FROM f GROUP BY 1"))
def type_token_ratio(spark, sf):
    return B.type_token_ratio(R.openings(spark, sf).withColumn("us", F.coalesce("us", F.lit(2**62))), "brand", ["us", "tweet_id"], 5000, Scratch(spark, "ttr"))


@query(R.sql(R.TURNS, f"f AS (SELECT brand, unnest({_RICH}) AS term FROM t WHERE brand IS NOT NULL)", "SELECT brand, term, n, CAST(k AS INTEGER) AS rank FROM (SELECT brand, term, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, term) AS k FROM f WHERE length(term) >= 4 GROUP BY 1, 2) WHERE k <= 15"))
def brand_text_profile(spark, sf):
    return B.top_terms(R.turns(spark, sf), "brand", 15)


@query(R.sql(R.MESSAGES, """brands AS (SELECT DISTINCT author AS brand FROM messages WHERE NOT inbound AND author IS NOT NULL), ed AS (SELECT c.id AS child, c.parent, c.author AS child_author, p.author AS parent_author, p.id AS p_id FROM messages c LEFT JOIN messages p ON c.parent = p.id WHERE c.parent IS NOT NULL),
  met AS (SELECT parent_author AS brand, child_author AS customer FROM ed WHERE parent_author IS NOT NULL UNION SELECT child_author, parent_author FROM ed WHERE child_author IS NOT NULL), cu AS (SELECT brand, count(DISTINCT customer) AS customers FROM met WHERE customer <> brand GROUP BY 1),
  own AS (SELECT author AS brand, count(*) AS messages, count(*) FILTER (NOT inbound) AS outbound, count(*) FILTER (inbound) AS inbound, count(*) FILTER (parent IS NOT NULL) AS with_parent, count(*) FILTER (parent IS NOT NULL OR id IN (SELECT parent FROM ed)) AS linked FROM messages GROUP BY 1),
  got AS (SELECT parent_author AS brand, count(*) AS replies_received FROM ed GROUP BY 1), sent AS (SELECT child_author AS brand, count(*) AS replies_sent, count(DISTINCT parent) AS conversation_candidates FROM ed GROUP BY 1)""",
  "SELECT brand, messages, outbound, inbound, coalesce(replies_received, 0) AS replies_received, coalesce(replies_sent, 0) AS replies_sent, coalesce(customers, 0) AS customers, coalesce(conversation_candidates, 0) AS conversation_candidates, round(messages / greatest(coalesce(customers, 0), 1), 2) AS messages_per_customer, round(100.0 * linked / messages, 1) AS pct_linked, round(100.0 * with_parent / messages, 1) AS pct_with_parent FROM brands JOIN own USING (brand) LEFT JOIN got USING (brand) LEFT JOIN sent USING (brand) LEFT JOIN cu USING (brand)"))
def brand_comparison(spark, sf):
    """By brand, over single links only: messages, replies both ways, customers met, share of linked messages."""
    s = Scratch(spark, "brands")
    return B.one_hop(s.cut(R.messages(spark, sf).select("id", "parent", "author", "inbound"), "messages"))


@query(R.sql(R.OPENINGS, "SELECT conversation_id, tweet_id, author, text FROM openings"))
def openings(spark, sf):
    return R.openings(spark, sf).select("conversation_id", "tweet_id", "author", "text")
