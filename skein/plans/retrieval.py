"""Near-duplicates, leakage layers, TF-IDF search and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.ids import number_key, text_key
from skein.operators import leakage as L
from skein.operators import retrieval as V
from skein.operators import sampling as A
from skein.operators import similarity as J
from skein.operators import tfidf as T
from skein.plans import relations as R
from skein.plans.registry import Registry
from skein.session import Scratch, read

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_NORM = "array_to_string(regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce({0}, '')), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '@\\S+', ' ', 'g'), '[a-z0-9'']+'), ' ')"
NORM = lambda c: _NORM.replace("{0}", c)

# -- near-duplicates -------------------------------------------------------------------

_DOCS = f"""d AS (SELECT doc_id, {NORM("text")} AS norm FROM documents),
k AS (SELECT doc_id, list_sort(list_distinct(string_split(norm, ' '))) AS tokens FROM d WHERE norm <> ''),
c AS (SELECT min(doc_id) AS class_id, tokens, len(tokens) AS n FROM k GROUP BY tokens),
e AS (SELECT class_id, n, unnest(tokens) AS token FROM c),
p AS (SELECT x.class_id AS a, y.class_id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard FROM e x JOIN e y ON x.token = y.token AND x.class_id < y.class_id AND x.n BETWEEN 0.8 * y.n - 1e-9 AND y.n / 0.8 + 1e-9 GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.8 - 1e-12)"""


def _near(spark, sf):
    return J.near_duplicates(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", X.canonical_tokens(F.col("text")), Scratch(spark, "near"))


@query(f"WITH {_DOCS} SELECT a, b, round(jaccard, 6) AS jaccard FROM p")
def near_dup_jaccard(spark, sf):
    """Pairs of class representatives; near_dup_members says who they stand for."""
    return _near(spark, sf)[1].select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {_DOCS}, l AS (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p), n AS (SELECT class_id, count(*) AS n_links FROM l GROUP BY 1) SELECT k.doc_id, c.class_id, coalesce(n_links, 0) AS n_links FROM k JOIN c ON k.tokens = c.tokens LEFT JOIN n ON n.class_id = c.class_id")
def near_dup_members(spark, sf):
    return _near(spark, sf)[0].select(F.col("key").alias("doc_id"), "class_id", "n_links")


@query(R.sql(R.OPENINGS, f"g AS (SELECT DISTINCT {NORM('text')} AS norm FROM golden)", f"SELECT conversation_id FROM openings WHERE {NORM('text')} <> '' AND {NORM('text')} IN (SELECT norm FROM g)"))
def exact_text_overlap(spark, sf):
    g = read(spark, sf, "golden").select(X.canonical(F.col("text")).alias("norm")).where(F.col("norm") != "").distinct()
    return R.openings(spark, sf).withColumn("norm", X.canonical(F.col("text"))).join(g, "norm", "left_semi").select("conversation_id")


# -- leakage ---------------------------------------------------------------------------

_HELD = "held AS (SELECT DISTINCT lower(trim(conversation_id)) AS conversation, CAST(try_cast(CASE WHEN regexp_full_match(trim(customer_author_id), '[0-9]+(\\.0*)?') THEN trim(customer_author_id) END AS DECIMAL(38,6)) AS BIGINT) AS customer, text FROM golden)"
_LEAK = f"""o AS (SELECT conversation_id AS id, lower(trim(conversation_id)) AS conversation, try_cast(author AS BIGINT) AS customer, {NORM("text")} AS norm FROM openings),
hn AS (SELECT DISTINCT {NORM("text")} AS norm FROM held), ht AS (SELECT norm, list_distinct(string_split(norm, ' ')) AS tokens FROM hn WHERE norm <> ''),
he AS (SELECT norm, len(tokens) AS n, unnest(tokens) AS token FROM ht), ot AS (SELECT id, list_distinct(string_split(norm, ' ')) AS tokens FROM o WHERE norm <> ''), oe AS (SELECT id, len(tokens) AS n, unnest(tokens) AS token FROM ot),
near AS (SELECT DISTINCT id FROM (SELECT id, norm, count(*) AS c, any_value(oe.n) + any_value(he.n) AS s FROM oe JOIN he USING (token) GROUP BY id, norm) WHERE c / (s - c) >= 0.8 - 1e-12),
marked AS (SELECT id, CASE WHEN conversation IN (SELECT conversation FROM held WHERE conversation IS NOT NULL) THEN 'conversation' WHEN customer IN (SELECT customer FROM held WHERE customer IS NOT NULL) THEN 'customer'
  WHEN norm <> '' AND norm IN (SELECT norm FROM hn) THEN 'exact_text' WHEN id IN (SELECT id FROM near) THEN 'near_duplicate' END AS layer FROM o)"""


def _overlaps(spark, sf):
    held = read(spark, sf, "golden").select(text_key(F.col("conversation_id")).alias("conversation"), number_key(F.col("customer_author_id")).alias("customer"), "text")
    corpus = R.openings(spark, sf).select(F.col("conversation_id").alias("id"), text_key(F.col("conversation_id")).alias("conversation"), number_key(F.col("author")).alias("customer"), "text")
    return L.overlaps(corpus, held, Scratch(spark, "leakage"))


def _marked(spark, sf, layers=L.LAYERS):
    return L.flagged(_overlaps(spark, sf), layers)


@query(R.sql(R.OPENINGS, _HELD, _LEAK, "SELECT id AS conversation_id FROM marked WHERE layer IS NULL"))
def exclude_golden(spark, sf):
    return _marked(spark, sf).where(F.col("layer").isNull()).select(F.col("id").alias("conversation_id"))


@query(R.sql(R.OPENINGS, _HELD, _LEAK, "SELECT l AS layer, (SELECT count(*) FROM marked WHERE layer = l) AS removed FROM (SELECT unnest(['conversation', 'customer', 'exact_text', 'near_duplicate']) AS l) UNION ALL SELECT 'kept', (SELECT count(*) FROM marked WHERE layer IS NULL)"))
def exclude_golden_audit(spark, sf):
    return L.audit(_marked(spark, sf))


@query(R.sql(R.OPENINGS, _HELD, "SELECT count(*) AS n_leaked FROM openings WHERE lower(trim(conversation_id)) IN (SELECT conversation FROM held WHERE conversation IS NOT NULL)"))
def assert_isolated(spark, sf):
    """How many records the isolation check would object to before exclusion."""
    held = read(spark, sf, "golden").select(text_key(F.col("conversation_id")).alias("k"))
    return R.openings(spark, sf).select(text_key(F.col("conversation_id")).alias("k")).join(held.where(F.col("k").isNotNull()).distinct(), "k", "left_semi").agg(F.count("*").alias("n_leaked"))


@query(R.sql(R.OPENINGS, _HELD, "SELECT conversation_id FROM openings WHERE try_cast(author AS BIGINT) IN (SELECT customer FROM held WHERE customer IS NOT NULL) AND lower(trim(conversation_id)) NOT IN (SELECT conversation FROM held WHERE conversation IS NOT NULL)"))
def same_customer_exclusion(spark, sf):
    """Further conversations of held-out customers."""
    g = read(spark, sf, "golden").select(text_key(F.col("conversation_id")).alias("k"), number_key(F.col("customer_author_id")).alias("c"))
    o = R.openings(spark, sf).select("conversation_id", text_key(F.col("conversation_id")).alias("k"), number_key(F.col("author")).alias("c"))
    return o.join(g.where(F.col("c").isNotNull()).select("c").distinct(), "c", "left_semi").join(g.where(F.col("k").isNotNull()).select("k").distinct(), "k", "left_anti").select("conversation_id")


# -- TF-IDF ----------------------------------------------------------------------------

_TF = f"""tk AS (SELECT tweet_id AS doc, regexp_extract_all({NORM("text")}, '[a-z0-9]{{2,}}') AS u FROM (SELECT DISTINCT tweet_id, text FROM openings)),
gr AS (SELECT doc, unnest(list_concat(u, list_transform(range(1, greatest(len(u), 1)), lambda i: u[i] || ' ' || u[i + 1]))) AS term FROM tk),
tf AS (SELECT doc, term, count(*) AS tf FROM gr GROUP BY 1, 2), nn AS (SELECT count(DISTINCT doc) AS n FROM tk),
vocab AS (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM tf, nn GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.6 * any_value(n)),
w0 AS (SELECT doc, term, (1.0 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)), wn AS (SELECT doc, sqrt(sum(w * w)) AS nrm FROM w0 GROUP BY doc), wt AS (SELECT doc, term, w / nrm AS weight FROM w0 JOIN wn USING (doc))"""
_HITS = """meta AS (SELECT tweet_id AS doc, conversation_id, author FROM openings),
pr AS (SELECT q.doc AS query, d.doc, round(sum(q.weight * d.weight), 6) AS similarity FROM wt q JOIN wt d USING (term) WHERE q.doc % 100 = 0 GROUP BY 1, 2),
hits AS (SELECT query, pr.doc, m.conversation_id AS conversation, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, m.conversation_id) AS rank
  FROM pr JOIN meta m ON m.doc = pr.doc JOIN meta qm ON qm.doc = pr.query WHERE similarity > 0 AND m.conversation_id <> qm.conversation_id AND coalesce(m.author <> qm.author, true))"""


def _fitted(spark, sf):
    s = Scratch(spark, "tfidf")
    o = s.cut(R.openings(spark, sf), "openings")
    docs = s.cut(o.select(F.col("tweet_id").alias("doc"), X.terms(F.col("text")).alias("words")), "words")
    w, v = T.fit(docs.select("doc", X.ngrams(F.col("words"), 2).alias("tokens")), s)
    return o, w, v


def _search(spark, sf, k=5):
    o, w, _ = _fitted(spark, sf)
    meta = o.select(F.col("tweet_id").alias("doc"), F.col("conversation_id").alias("conversation"), F.col("author").alias("customer"))
    return o, V.search(w.where(F.col("doc") % 100 == 0), w, meta, Scratch(spark, "search"), k)


@query(R.sql(R.OPENINGS, _TF, "SELECT doc, term, round(weight, 9) AS weight FROM wt"))
def tfidf_weights(spark, sf):
    return T.long_form(_fitted(spark, sf)[1]).select("doc", "term", F.round("weight", 9).alias("weight"))


@query(R.sql(R.OPENINGS, _TF, "SELECT term, df, round(idf, 9) AS idf FROM vocab"))
def tfidf_vocab(spark, sf):
    return _fitted(spark, sf)[2].select("term", "df", F.round("idf", 9).alias("idf"))


@query(R.sql(R.OPENINGS, _TF, _HITS, "SELECT query, CAST(rank AS INTEGER) AS rank, doc, similarity FROM hits WHERE rank <= 5"))
def tfidf_topk(spark, sf):
    """The queries are the openings whose id is divisible by 100; all openings are searched."""
    return _search(spark, sf)[1].select("query", "rank", "doc", "similarity")


@query(R.sql(R.OPENINGS, _TF, _HITS, "SELECT h.query, CAST(h.rank AS INTEGER) AS rank, o.conversation_id, o.text AS customer_message, similarity, CASE WHEN g.n = 2 THEN 'two_turn' ELSE 'multi_turn' END AS shape FROM hits h JOIN openings o ON o.tweet_id = h.doc JOIN (SELECT conversation_id, count(*) AS n FROM t GROUP BY 1) g USING (conversation_id) WHERE h.rank <= 5"))
def evidence_rows(spark, sf):
    o, hits = _search(spark, sf)
    n = R.turns(spark, sf).groupBy("conversation_id").agg(F.count("*").alias("n"))
    x = hits.join(o.select(F.col("tweet_id").alias("doc"), "conversation_id", "text"), "doc").join(n, "conversation_id")
    return x.select("query", "rank", "conversation_id", F.col("text").alias("customer_message"), "similarity", F.when(F.col("n") == 2, "two_turn").otherwise("multi_turn").alias("shape"))


@query(R.sql(R.OPENINGS, f"x AS (SELECT tweet_id, len(regexp_extract_all({NORM('text')}, '[a-z0-9'']+')) AS n FROM openings)", "SELECT count(*) FILTER (n = 0) AS empty, count(*) FILTER (n < 3) AS under_three FROM x"))
def degenerate_queries(spark, sf):
    n = F.size(F.filter(F.split(X.canonical(F.col("text")), " "), lambda x: x != ""))
    return R.openings(spark, sf).agg(F.count_if(n == 0).alias("empty"), F.count_if(n < 3).alias("under_three"))


@query(R.sql(R.OPENINGS, f"x AS (SELECT unnest(list_distinct(regexp_extract_all({NORM('text')}, '[a-z0-9]{{2,}}'))) AS term FROM openings)", "SELECT term, count(*) AS n FROM x WHERE term NOT IN ('the', 'and', 'for', 'with', 'was', 'my', 'to', 'at', 'in', 'of', 'is', 'on', 'an') GROUP BY 1"))
def stopword_filter(spark, sf):
    stop = spark.createDataFrame([(w,) for w in "the and for with was my to at in of is on an".split()], "term string")
    t = R.openings(spark, sf).select(F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))
    return t.join(F.broadcast(stop), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))


@query()
def dense_topk(spark, sf):
    """The ten nearest vectors by cosine of every vector whose id is divisible by 100."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))
    return V.dense_search(v.where(F.col("doc") % 100 == 0), v, 10)


ORACLE["dense_topk"] = """SELECT query, CAST(rank AS INTEGER) AS rank, doc, similarity FROM (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) DESC, d.vec_id) AS rank FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id) WHERE rank <= 10 AND similarity > 0"""

# -- measures of retrieved evidence ------------------------------------------------------

_EV = "ev AS (SELECT query_id, rank, min(similarity) AS similarity, min(historical_weak_intent) AS label, min(try_cast(n_turns AS BIGINT)) AS n_turns, min(evidence_shape) AS shape, min(retrieved_by) AS retrieved_by FROM evidence WHERE query_id IS NOT NULL GROUP BY 1, 2), qs AS (SELECT annotation_id AS query_id, min(lower(replace(trim(primary_intent), ' ', '_'))) AS label FROM b02_fresh_labelled WHERE annotation_id IS NOT NULL GROUP BY 1)"


def _evidence(spark, sf):
    e = read(spark, sf, "evidence").where(F.col("query_id").isNotNull())
    return e.groupBy("query_id", "rank").agg(F.min("similarity").alias("similarity"), F.min("historical_weak_intent").alias("label"), F.min(F.col("n_turns").cast("bigint")).alias("n_turns"), F.min("evidence_shape").alias("shape"), F.min("retrieved_by").alias("retrieved_by"))


def _labels(spark, sf):
    b = read(spark, sf, "b02_fresh_labelled").where(F.col("annotation_id").isNotNull())
    return b.groupBy(F.col("annotation_id").alias("query_id")).agg(F.min(F.lower(F.replace(F.trim("primary_intent"), F.lit(" "), F.lit("_")))).alias("label"))


@query(f"""WITH {_EV}, per AS (SELECT query_id, count(*) AS items, max(similarity) AS best, count(e.label) AS labelled, count(*) FILTER (e.label = q.label) AS matching, count(*) FILTER (n_turns = 2) AS two FROM ev e JOIN qs q USING (query_id) GROUP BY 1)
  SELECT count(*) AS queries, count(items) AS available, round(avg(best), 6) AS mean_best, round(quantile_cont(best, 0.5), 6) AS median_best, round(sum(labelled) / sum(items), 6) AS label_coverage,
    round(sum(matching) / sum(labelled), 6) AS consistency, round(count(*) FILTER (matching > 0) / count(*), 6) AS any_match, round(sum(two) / sum(items), 6) AS two_turn_share FROM qs LEFT JOIN per USING (query_id)""")
def retrieval_summary(spark, sf):
    return V.summary(_evidence(spark, sf), _labels(spark, sf))


@query(f"WITH {_EV} SELECT shape, count(*) AS n, round(avg(similarity), 9) AS mean_similarity FROM ev GROUP BY 1")
def similarity_by_shape(spark, sf):
    return _evidence(spark, sf).groupBy("shape").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 9).alias("mean_similarity"))


@query(f"WITH {_EV} SELECT count(similarity) AS n, min(similarity) AS least, quantile_cont(similarity, 0.5) AS median, round(avg(similarity), 9) AS mean, max(similarity) AS most FROM ev")
def similarity_distribution(spark, sf):
    return V.distribution(_evidence(spark, sf), "similarity")


@query(f"WITH {_EV} SELECT retrieved_by, count(*) AS items, count(e.label) AS labelled, count(*) FILTER (e.label = q.label) AS matching FROM ev e JOIN qs q USING (query_id) GROUP BY 1")
def intent_weak_agreement(spark, sf):
    e, q = _evidence(spark, sf), _labels(spark, sf).withColumnRenamed("label", "want")
    return e.join(q, "query_id").groupBy("retrieved_by").agg(F.count("*").alias("items"), F.count("label").alias("labelled"), F.count_if(F.col("label") == F.col("want")).alias("matching"))


# -- samples -----------------------------------------------------------------------------


@query(R.sql(R.OPENINGS, "SELECT conversation_id FROM openings ORDER BY md5(conversation_id || ':42'), conversation_id LIMIT 2000"))
def dev_pool_sample(spark, sf):
    return A.sample(R.openings(spark, sf).select("conversation_id"), "conversation_id", 2000, 42)


_QUOTA = """mo AS (SELECT *, strftime(make_timestamp(us), '%Y-%m') AS month FROM openings WHERE us IS NOT NULL), cn AS (SELECT month, count(*) AS n FROM mo GROUP BY 1),
sh AS (SELECT month, n, 120.0 * n / sum(n) OVER () AS share FROM cn), fl AS (SELECT *, floor(share) AS base FROM sh),
qu AS (SELECT month, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, month) <= 120 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)"""


def _months(spark, sf):
    return R.openings(spark, sf).where(F.col("us").isNotNull()).withColumn("month", F.date_format(F.timestamp_micros("us"), "yyyy-MM"))


@query(R.sql(R.OPENINGS, _QUOTA, "SELECT month, n, quota FROM qu"))
def largest_remainder(spark, sf):
    return A.largest_remainder(_months(spark, sf).groupBy("month").agg(F.count("*").alias("n")), "month", 120)


@query(R.sql(R.OPENINGS, _QUOTA, "SELECT conversation_id, month FROM (SELECT conversation_id, month, row_number() OVER (PARTITION BY month ORDER BY md5(conversation_id || ':42'), conversation_id) AS k FROM mo) JOIN qu USING (month) WHERE k <= quota"))
def stratified_sample(spark, sf):
    return A.stratified(_months(spark, sf), "month", "conversation_id", 120, 42).select("conversation_id", "month")


#: Probes of the targeted sample; a choice of this query.
PROBES = {"a_bags": r"(?i)bag tag|suitcase|backpack", "b_refund": r"(?i)refund|voucher", "c_staff": r"(?i)supervisor|captain|agent"}


@query(R.sql(R.OPENINGS, *(
    f"{n[0]} AS (SELECT conversation_id FROM openings WHERE regexp_matches(coalesce(text, ''), '{PROBES[n]}')" + "".join(f" AND conversation_id NOT IN (SELECT conversation_id FROM {e[0]})" for e in sorted(PROBES) if e < n) + " ORDER BY md5(conversation_id || ':42'), conversation_id LIMIT 20)"
    for n in sorted(PROBES)), " UNION ALL ".join(f"SELECT conversation_id, '{n}' AS probe FROM {n[0]}" for n in sorted(PROBES))))
def targeted_sample(spark, sf):
    return A.targeted(R.openings(spark, sf).select("conversation_id", "text"), "conversation_id", "text", PROBES, 20, 42).select("conversation_id", "probe")


@query("SELECT annotation_id, batch FROM (SELECT annotation_id, batch, row_number() OVER (PARTITION BY batch ORDER BY md5(annotation_id || ':44'), annotation_id) AS k FROM (SELECT DISTINCT annotation_id, batch FROM golden)) WHERE k <= 15")
def retest_sample(spark, sf):
    return A.per_group(read(spark, sf, "golden").select("annotation_id", "batch").distinct(), "batch", "annotation_id", 15, 44).select("annotation_id", "batch")


@query(R.sql(R.OPENINGS, "SELECT brand, conversation_id FROM (SELECT brand, conversation_id, row_number() OVER (PARTITION BY brand ORDER BY md5(conversation_id || ':42'), conversation_id) AS k FROM openings WHERE brand IS NOT NULL) WHERE k = 1"))
def sample_threads(spark, sf):
    return A.per_group(R.openings(spark, sf).where(F.col("brand").isNotNull()), "brand", "conversation_id", 1, 42).select("brand", "conversation_id")


@query(R.sql(R.OPENINGS, """pool AS (SELECT row_number() OVER (ORDER BY conversation_id) - 1 AS pos, conversation_id AS item, author AS grp FROM openings), nn AS (SELECT count(*) AS n FROM pool),
  d AS (SELECT tweet_id AS query, author AS q_grp, j, CAST('0x' || substring(md5(concat_ws(':', tweet_id, j, 42)), 1, 15) AS BIGINT) % n AS pos FROM openings, range(40) r(j), nn WHERE tweet_id % 100 = 0),
  h AS (SELECT query, item, min(j) AS j FROM d JOIN pool USING (pos) WHERE coalesce(grp <> q_grp, true) GROUP BY 1, 2)""",
  "SELECT query, CAST(k AS INTEGER) AS rank, item FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY j, item) AS k FROM h) WHERE k <= 5"))
def random_evidence(spark, sf):
    from skein.operators.ranks import ranked

    s = Scratch(spark, "random")
    o = s.cut(R.openings(spark, sf), "openings")
    pool = s.cut(ranked(o.select(F.lit(0).alias("_all"), F.col("conversation_id").alias("item"), F.col("author").alias("grp")), ["_all"], ["item"], "n", s).select((F.col("n") - 1).alias("pos"), "item", "grp"), "pool")
    return V.random_items(o.where(F.col("tweet_id") % 100 == 0).select(F.col("tweet_id").alias("query"), F.col("author").alias("grp")), pool, 5, 42)
