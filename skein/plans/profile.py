"""Scans, profiles, counts and set operations on the message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.ids import numeric_id, text_key
from skein.operators import graph as G
from skein.operators import profile as P
from skein.operators import sets as S
from skein.plans import relations as R
from skein.plans.registry import Registry
from skein.session import Scratch, read

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("SELECT tweet_id, turn_index FROM turns")
def scan_prune(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "turns").select("tweet_id", "turn_index")


@query("SELECT conversation_id, tweet_id, brand FROM turns WHERE turn_index = 0 AND brand = 'VelaAir'")
def scan_filter_pushdown(spark, sf):
    return read(spark, sf, "turns").where((F.col("turn_index") == 0) & (F.col("brand") == "VelaAir")).select("conversation_id", "tweet_id", "brand")


@query("SELECT count(*) AS n_rows, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us FROM turns")
def profile_basic(spark, sf):
    return P.basic(read(spark, sf, "turns"), F.col("created_at"))


@query(
    "WITH bad AS (SELECT tweet_id, count(*) AS n FROM raw_messages WHERE tweet_id IS NOT NULL AND "
    + R._NUM.format("tweet_id")
    + " IS NULL GROUP BY 1) SELECT CAST(coalesce((SELECT sum(n) FROM bad), 0) AS BIGINT) AS n_malformed, coalesce((SELECT string_agg(tweet_id, '|' ORDER BY tweet_id) FROM (SELECT tweet_id FROM bad ORDER BY tweet_id LIMIT 5)), '') AS examples"
)
def profile_malformed(spark, sf):
    return P.malformed(read(spark, sf, "raw_messages"), "tweet_id", numeric_id(F.col("tweet_id")))


@query(f"SELECT count(*) FILTER (created_at IS NULL) AS missing, count(*) FILTER (created_at IS NOT NULL AND ts IS NULL) AS unparsed, count(ts) AS parsed, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM (SELECT created_at, {R._TIME} AS ts FROM raw_messages)")
def profile_timestamps(spark, sf):
    t = read(spark, sf, "raw_messages").select("created_at", X.parsed_time(F.col("created_at")).alias("ts"))
    return t.agg(F.count_if(F.col("created_at").isNull()).alias("missing"), F.count_if(F.col("created_at").isNotNull() & F.col("ts").isNull()).alias("unparsed"), F.count("ts").alias("parsed"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM raw_messages" for c in ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")))
def profile_nulls(spark, sf):
    return P.null_counts(read(spark, sf, "raw_messages"))


@query(r"""SELECT count(*) FILTER (regexp_matches(c, 'https?://')) AS urls, count(*) FILTER (regexp_matches(c, '@[A-Za-z0-9_]')) AS mentions,
  count(*) FILTER (regexp_matches(c, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]')) AS emoji, count(*) FILTER (regexp_matches(c, '\^[A-Za-z]{1,4}\s*$')) AS signed,
  count(*) FILTER (trim(regexp_replace(c, '\s+', ' ', 'g')) = '') AS blank FROM (SELECT coalesce(text, '') AS c FROM raw_messages)""")
def profile_text_flags(spark, sf):
    return P.text_flags(read(spark, sf, "raw_messages"), "text")


@query("SELECT coalesce(inbound, '<missing>') AS value, count(*) AS n FROM raw_messages GROUP BY 1")
def value_counts(spark, sf):
    return P.value_counts(read(spark, sf, "raw_messages"), "inbound")


@query(R.sql(R.MESSAGES, "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM messages WHERE ts IS NOT NULL GROUP BY 1"))
def tweets_per_month(spark, sf):
    return P.per_month(R.messages(spark, sf), F.col("ts"))


@query(R.sql(R.MESSAGES, "SELECT month, n, n / sum(n) OVER () AS share FROM (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM messages WHERE ts IS NOT NULL GROUP BY 1)"))
def monthly_share(spark, sf):
    return P.month_shares(R.messages(spark, sf), F.col("ts"))


@query("""SELECT avg(n) AS mean, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.95) AS p95,
  CAST(min(n) AS INTEGER) AS min, CAST(max(n) AS INTEGER) AS max FROM (SELECT length(coalesce(text, '')) AS n FROM raw_messages)""")
def text_length_stats(spark, sf):
    return P.length_stats(read(spark, sf, "raw_messages"), "text")


@query("""WITH g AS (SELECT tweet_id, count(*) AS n, count(DISTINCT (author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id)) AS k FROM raw_messages WHERE tweet_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
  SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (k = 1) AS n_identical FROM g""")
def duplicate_stats(spark, sf):
    return P.duplicate_stats(read(spark, sf, "raw_messages"), "tweet_id")


@query("SELECT CAST(regexp_full_match(coalesce(trim(author_id), ''), '[0-9]+') AS VARCHAR) AS row_value, count(*) FILTER (lower(trim(inbound)) = 'true') AS n_true, count(*) FILTER (lower(trim(inbound)) = 'false') AS n_false FROM raw_messages GROUP BY 1")
def crosstab(spark, sf):
    return P.crosstab(read(spark, sf, "raw_messages"), F.coalesce(F.trim("author_id"), F.lit("")).rlike("^[0-9]+$"), F.lower(F.trim("inbound")), ["true", "false"])


@query(R.sql(R.MESSAGES, "SELECT author, count(DISTINCT inbound) AS n_values FROM messages WHERE author IS NOT NULL GROUP BY 1 HAVING count(DISTINCT inbound) > 1"))
def mixed_direction(spark, sf):
    return P.mixed_groups(R.messages(spark, sf), "author", "inbound")


@query(R.sql(R.MESSAGES, "SELECT DISTINCT parent AS ref FROM messages WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM messages)"))
def dangling_refs(spark, sf):
    m = R.messages(spark, sf)
    return G.dangling(m, m.select(F.col("parent").alias("ref")))


_CHILDREN = "c AS (SELECT m.id, m.parent, coalesce(k, 0) AS k FROM messages m LEFT JOIN (SELECT parent, count(*) AS k FROM messages WHERE parent IS NOT NULL GROUP BY 1) n ON n.parent = m.id)"


@query(R.sql(R.MESSAGES, _CHILDREN, """SELECT count(*) FILTER (k = 0) AS none, count(*) FILTER (k = 1) AS one, count(*) FILTER (k = 2) AS two, count(*) FILTER (k >= 3) AS three_or_more, max(k) AS most,
  count(*) FILTER (k = 0 AND parent IS NULL) AS orphans, count(*) FILTER (k >= 10) AS fanout_10, CAST(sum(CASE WHEN k >= 10 THEN k ELSE 0 END) AS BIGINT) AS replies_10,
  count(*) FILTER (k >= 50) AS fanout_50, CAST(sum(CASE WHEN k >= 50 THEN k ELSE 0 END) AS BIGINT) AS replies_50,
  round(count(*) FILTER (k >= 2) * 100.0 / greatest(count(*) FILTER (k >= 1), 1), 2) AS branching_pct FROM c"""))
def children_histogram(spark, sf):
    return G.children_histogram(R.messages(spark, sf))


@query(R.sql(R.MESSAGES, _CHILDREN, "SELECT id, k AS n_children FROM c ORDER BY k DESC, id LIMIT 10"))
def top_fanout(spark, sf):
    return G.children_counts(R.messages(spark, sf)).orderBy(F.desc("n_children"), "id").limit(10)


@query(R.sql(R.MESSAGES, "SELECT author AS brand, count(*) AS n FROM messages WHERE NOT inbound AND author IS NOT NULL GROUP BY 1 ORDER BY n DESC, brand LIMIT 25"))
def top_brands(spark, sf):
    m = R.messages(spark, sf).where(~F.col("inbound") & F.col("author").isNotNull())
    return m.groupBy(F.col("author").alias("brand")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(25)


@query(R.sql(R.MESSAGES, """p AS (SELECT id, epoch_us(ts) AS us FROM messages WHERE ts IS NOT NULL),
  r AS (SELECT rank() OVER (ORDER BY id) + (count(*) OVER (PARTITION BY id) - 1) / 2 AS a, rank() OVER (ORDER BY us) + (count(*) OVER (PARTITION BY us) - 1) / 2 AS b FROM p)""",
  "SELECT corr(a, b) AS rho, count(*) AS n FROM r"))
def spearman(spark, sf):
    return P.spearman(R.messages(spark, sf).select("id", F.unix_micros("ts").alias("us")), "id", "us", Scratch(spark, "spearman"))


@query(R.sql(R.MESSAGES, "SELECT count(*) FILTER (p.ts < c.ts) AS earlier, count(*) FILTER (p.ts = c.ts) AS tie, count(*) FILTER (p.ts > c.ts) AS later FROM messages c JOIN messages p ON c.parent = p.id WHERE c.ts IS NOT NULL AND p.ts IS NOT NULL"))
def chronology(spark, sf):
    return G.chronology(R.messages(spark, sf))


@query(R.sql(R.MESSAGES, "SELECT c.id, c.parent, p.author AS p_author FROM messages c JOIN messages p ON c.parent = p.id"))
def parent_lookup(spark, sf):
    return G.with_parent(R.messages(spark, sf), "author").select("id", "parent", "p_author")


@query(R.sql(R.MESSAGES, "SELECT c.id, CASE WHEN p.id IS NULL THEN -1 ELSE c.parent END AS parent_id, c.parent IS NOT NULL AND p.id IS NULL AS truncated FROM messages c LEFT JOIN messages p ON c.parent = p.id"))
def parent_edges(spark, sf):
    m = R.messages(spark, sf)
    p = m.select(F.col("id").alias("p_id"))
    return m.join(p, m.parent == p.p_id, "left").select("id", F.when(F.col("p_id").isNull(), F.lit(-1)).otherwise(F.col("parent")).alias("parent_id"), (F.col("parent").isNotNull() & F.col("p_id").isNull()).alias("truncated"))


@query(
    f"""WITH a AS (SELECT DISTINCT {R._NUM.format("tweet_id")} AS parent, try_cast(trim(c) AS BIGINT) AS child FROM (SELECT tweet_id, unnest(string_split(response_tweet_id, ',')) AS c FROM raw_messages)),
  b AS (SELECT DISTINCT {R._NUM.format("in_response_to_tweet_id")} AS parent, {R._NUM.format("tweet_id")} AS child FROM raw_messages),
  x AS (SELECT a.parent AS ap, b.parent AS bp FROM (SELECT * FROM a WHERE parent IS NOT NULL AND child IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE parent IS NOT NULL AND child IS NOT NULL) b ON a.parent = b.parent AND a.child = b.child)
  SELECT count(*) FILTER (ap IS NOT NULL AND bp IS NOT NULL) AS both, count(*) FILTER (bp IS NULL) AS only_a, count(*) FILTER (ap IS NULL) AS only_b,
    round(count(*) FILTER (ap IS NOT NULL AND bp IS NOT NULL) * 100.0 / count(*), 2) AS agreement_pct FROM x"""
)
def edge_agreement(spark, sf):
    raw = read(spark, sf, "raw_messages").select(numeric_id(F.col("tweet_id")).alias("id"), numeric_id(F.col("in_response_to_tweet_id")).alias("parent"), "response_tweet_id")
    a = G.child_edges(raw, "id", "response_tweet_id").select(F.col("id").alias("parent"), "child")
    b = raw.where(F.col("id").isNotNull() & F.col("parent").isNotNull()).select("parent", F.col("id").alias("child"))
    return G.edge_agreement(a, b)


_KEYS = "g AS (SELECT DISTINCT lower(trim(conversation_id)) AS k FROM golden WHERE trim(conversation_id) <> ''), b AS (SELECT DISTINCT lower(trim(conversation_id)) AS k FROM b02_fresh_labelled WHERE trim(conversation_id) <> '')"


def _keys(spark, sf, table):
    return read(spark, sf, table).select(text_key(F.col("conversation_id")).alias("k"))


@query(f"WITH {_KEYS} SELECT count(*) FILTER (g.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (g.k IS NULL) AS only_b FROM g FULL JOIN b ON g.k = b.k")
def id_overlap(spark, sf):
    return S.overlap(_keys(spark, sf, "golden"), _keys(spark, sf, "b02_fresh_labelled"), "k")


@query("SELECT count(*) FILTER (o > 1) AS repeated, count(*) FILTER (o = 0) AS missing, count(*) FILTER (e = 0) AS unexpected FROM (SELECT k, sum(e) AS e, sum(o) AS o FROM (SELECT annotation_id AS k, 1 AS e, 0 AS o FROM b02_fresh_labelled UNION ALL SELECT query_id, 0, 1 FROM evidence) GROUP BY k)")
def id_reconciliation(spark, sf):
    return S.reconcile(read(spark, sf, "b02_fresh_labelled").select(F.col("annotation_id").alias("k")), read(spark, sf, "evidence").select(F.col("query_id").alias("k")), "k")


@query("SELECT count(*) AS n_outside, count(*) = 0 AS is_subset FROM (SELECT DISTINCT query_id FROM evidence WHERE query_id IS NOT NULL AND query_id NOT IN (SELECT annotation_id FROM b02_fresh_labelled WHERE annotation_id IS NOT NULL))")
def subset_check(spark, sf):
    return S.subset(read(spark, sf, "evidence").select(F.col("query_id").alias("k")), read(spark, sf, "b02_fresh_labelled").select(F.col("annotation_id").alias("k")), "k")


@query("SELECT conversation_id, tweet_id FROM turns WHERE conversation_id IN (SELECT conversation_id FROM golden)")
def semi_join_ids(spark, sf):
    return S.keep_ids(read(spark, sf, "turns"), read(spark, sf, "golden"), "conversation_id").select("conversation_id", "tweet_id")


@query("SELECT conversation_id, tweet_id FROM turns WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT conversation_id FROM golden WHERE conversation_id IS NOT NULL)")
def exclude_ids(spark, sf):
    return S.drop_ids(read(spark, sf, "turns"), read(spark, sf, "golden"), "conversation_id").select("conversation_id", "tweet_id")


@query("SELECT annotation_id, 'golden' AS origin, sampling_stratum FROM golden UNION ALL SELECT annotation_id, 'b02', sampling_stratum FROM b02_fresh_labelled")
def union_strata(spark, sf):
    a = read(spark, sf, "golden").select("annotation_id", F.lit("golden").alias("origin"), "sampling_stratum")
    return a.unionByName(read(spark, sf, "b02_fresh_labelled").select("annotation_id", F.lit("b02").alias("origin"), "sampling_stratum"))


@query(R.sql(R.TURNS, "SELECT conversation_id, us, tweet_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY us NULLS FIRST, tweet_id) AS k FROM t) WHERE k = 1"))
def first_per_group(spark, sf):
    t = R.turns(spark, sf).select("conversation_id", "us", "tweet_id", "role")
    return S.first_per_group(t, "conversation_id", ["us", "tweet_id"])


@query(R.sql(R.TURNS, "SELECT conversation_id, CAST(min(turn_index) AS INTEGER) AS low, CAST(max(turn_index) AS INTEGER) AS high, count(*) AS n FROM t GROUP BY 1 HAVING min(turn_index) <> 0 OR max(turn_index) <> count(*) - 1 OR count(DISTINCT turn_index) <> count(*)"))
def turn_invariants(spark, sf):
    return P.ordinal_steps(R.turns(spark, sf), "conversation_id", "turn_index")


@query(R.sql(R.TURNS, "SELECT brand, count(*) AS n_turns, count(DISTINCT conversation_id) AS n_conversations FROM t WHERE brand IS NOT NULL GROUP BY 1 ORDER BY n_turns DESC, brand"))
def ordered_metrics(spark, sf):
    t = R.turns(spark, sf).where(F.col("brand").isNotNull())
    return t.groupBy("brand").agg(F.count("*").alias("n_turns"), F.count_distinct("conversation_id").alias("n_conversations")).orderBy(F.desc("n_turns"), "brand")
