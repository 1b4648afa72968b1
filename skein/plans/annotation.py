"""Selections, joins and checks around annotated rows and drafted replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.ids import text_key
from skein.operators import conversations as C
from skein.operators import grounding as G
from skein.operators import metrics as M
from skein.operators import retrieval as V
from skein.operators import sampling as A
from skein.operators import sets as S
from skein.operators.ranks import ranked
from skein.plans import conversations as PC
from skein.plans import evaluation as PE
from skein.plans import relations as R
from skein.plans import replies as PR
from skein.plans import retrieval as PV
from skein.plans.registry import Registry
from skein.session import Scratch, read

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(f"{PC._M}, {PC._STATUS} SELECT root, n_turns FROM st WHERE status = 'clean'")
def clean_conversations(spark, sf):
    return C.participants(PC._members(spark, sf)[0]).where(F.col("status") == "clean").select("root", "n_turns")


@query(R.sql(R.TURNS, "g AS (SELECT conversation_id, count(*) AS n_turns, count(*) FILTER (role = 'brand') AS n_brand_turns, bool_or(turn_index = 0 AND role = 'customer') AS opened FROM t GROUP BY 1)", "SELECT conversation_id FROM g WHERE opened AND n_turns >= 2 AND n_brand_turns >= 1"))
def retrieval_pool(spark, sf):
    return C.records(R.turns(spark, sf)).where((F.col("n_turns") >= 2) & (F.col("n_brand_turns") >= 1)).select("conversation_id")


@query(R.sql(R.TURNS, PC._SIG, "per AS (SELECT conversation_id, count(*) AS n_turns, min(brand) AS brand FROM t GROUP BY 1)", "SELECT count(*) AS conversations, CAST(sum(n_turns) AS BIGINT) AS turns, quantile_cont(n_turns, 0.5) AS median_turns, max(n_turns) AS most_turns, count(*) FILTER (any_dm) AS with_dm, count(*) FILTER (any_url) AS with_url FROM per JOIN sig USING (conversation_id) WHERE brand = 'VelaAir'"))
def brand_summary(spark, sf):
    x = PC._with_brand(spark, sf).where(F.col("brand") == "VelaAir")
    return x.agg(F.count("*").alias("conversations"), F.sum("n_turns").alias("turns"), F.percentile("n_turns", 0.5).alias("median_turns"), F.max("n_turns").alias("most_turns"), F.count_if("any_dm").alias("with_dm"), F.count_if("any_url").alias("with_url"))


@query(R.sql(R.OPENINGS, f"x AS (SELECT conversation_id, text, len(string_split({PV.NORM('text')}, ' ')) AS n FROM openings WHERE {PV.NORM('text')} <> '')", "SELECT conversation_id FROM x WHERE n BETWEEN 8 AND 30 AND regexp_matches(text, '(?i)refund|fee|fare') AND NOT regexp_matches(text, 'https?://')"))
def sanity_message_select(spark, sf):
    """Openings of 8 to 30 words that name money and hold no link."""
    n = F.size(F.split(X.canonical(F.col("text")), " "))
    o = R.openings(spark, sf).where(X.canonical(F.col("text")) != "")
    return o.where(n.between(8, 30) & F.col("text").rlike("(?i)refund|fee|fare") & ~F.col("text").rlike(X.URL_PREFIX)).select("conversation_id")


@query(R.sql(R.OPENINGS, PV._HELD, PV._LEAK, "SELECT (SELECT count(*) FROM openings) AS records, (SELECT count(DISTINCT conversation) FROM o WHERE conversation IN (SELECT conversation FROM held)) AS shared_conversations, (SELECT count(DISTINCT customer) FROM o WHERE customer IN (SELECT customer FROM held)) AS shared_customers, (SELECT count(*) FROM o WHERE norm <> '' AND norm IN (SELECT norm FROM hn)) AS same_text, (SELECT count(*) FROM near) AS near_text"))
def leakage_report(spark, sf):
    """All overlaps of the corpus with held-out data, each layer on its own, in one run."""
    m = PV._overlaps(spark, sf)
    return m.agg(
        F.count("*").alias("records"),
        F.count_distinct(F.when(F.col("conversation_hit"), F.col("conversation"))).alias("shared_conversations"),
        F.count_distinct(F.when(F.col("customer_hit"), F.col("customer"))).alias("shared_customers"),
        F.count_if("exact_text_hit").alias("same_text"),
        F.count_if("near_duplicate_hit").alias("near_text"),
    )


@query(R.sql(R.OPENINGS, PV._HELD, PV._LEAK, "kept AS (SELECT id FROM marked WHERE layer IS NULL)", "SELECT (SELECT count(*) FROM kept k JOIN o USING (id) WHERE conversation IN (SELECT conversation FROM held WHERE conversation IS NOT NULL)) AS leaked, (SELECT count(*) FROM kept WHERE id NOT IN (SELECT id FROM o)) AS outside"))
def isolation_recheck(spark, sf):
    """After exclusion: records that still share a conversation, and records that are not of the corpus."""
    kept = PV._marked(spark, sf).where(F.col("layer").isNull())
    held = read(spark, sf, "golden").select(text_key(F.col("conversation_id")).alias("conversation")).where(F.col("conversation").isNotNull()).distinct()
    leaked = kept.join(held, "conversation", "left_semi").agg(F.count("*").alias("leaked"))
    outside = S.subset(kept.select("id"), R.openings(spark, sf).select(F.col("conversation_id").alias("id")), "id")
    return leaked.select("leaked", outside.select("n_outside").scalar().alias("outside"))


_FORMS = ['{"reply": "to ', '{"reply": "a", "needs_more_information": 0}', "[]", "{", '{"reply": "a", "needs_more_information": true, "evidence_used": [1.0]}', '{"needs_more_information": true}']
_WRONG = [None, "needs_more_information_not_boolean", "not_an_object", "invalid_json", "evidence_used_not_a_rank", "missing_reply"]


@query("SELECT annotation_id, CASE WHEN k = 0 THEN 'to ' || annotation_id END AS reply, CASE WHEN k = 0 THEN true END AS coerced, CASE k " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_WRONG) if e) + " END AS error FROM (SELECT DISTINCT annotation_id, CAST('0x' || substring(md5(annotation_id), 1, 4) AS BIGINT) % 6 AS k FROM b02_fresh_labelled WHERE annotation_id IS NOT NULL)")
def parse_response(spark, sf):
    """Strict parsing of one answer per annotation, well-formed or broken in one of five ways."""
    k = F.conv(F.substring(F.md5("annotation_id"), 1, 4), 16, 10).cast("int") % 6
    forms = F.array(*map(F.lit, _FORMS))
    raw = F.when(k == 0, F.concat(F.lit(_FORMS[0]), "annotation_id", F.lit('", "needs_more_information": false, "evidence_used": ["2"]}'))).otherwise(F.get(forms, k))
    b = read(spark, sf, "b02_fresh_labelled").where(F.col("annotation_id").isNotNull()).select("annotation_id").distinct().select("annotation_id", raw.alias("raw"))
    return G.parse_reply(b, "raw").select("annotation_id", "parsed.reply", "parsed.coerced", "parsed.error")


@query("SELECT annotation_id, md5(t) AS raw FROM (SELECT annotation_id, min(coalesce(text_display, '')) AS t FROM b02_fresh_labelled WHERE annotation_id IS NOT NULL GROUP BY 1)")
def retry_merge(spark, sf):
    """A first run that fails for short texts, a second one for all, merged."""
    b = read(spark, sf, "b02_fresh_labelled").where(F.col("annotation_id").isNotNull()).groupBy("annotation_id").agg(F.min(F.coalesce("text_display", F.lit(""))).alias("t"))
    first = b.select("annotation_id", F.when(F.length("t") >= 40, F.md5("t")).alias("raw"), F.when(F.length("t") < 40, "TimeoutError").alias("failure"))
    again = b.select("annotation_id", F.md5("t").alias("raw"), F.lit(None).cast("string").alias("failure"))
    return G.retry_failures(first, again, "annotation_id").select("annotation_id", "raw")


@query(f"{PR._DRAFTS}, ne AS (SELECT query_id, count(*) AS n FROM ev GROUP BY 1) SELECT query_id, NOT bad AS parsed, CASE WHEN bad THEN 'invalid_json' END AS error, CASE WHEN NOT bad THEN coalesce(n, 0) >= 1 END AS citations_valid FROM dr LEFT JOIN ne USING (query_id)")
def generation_measures(spark, sf):
    """Per draft: whether it parsed, what was wrong, and whether it cites existing evidence only."""
    d = PR._drafts(spark, sf).select("query_id", "parsed.evidence_used", "parsed.error")
    n = PR._evidence(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"))
    return d.join(n, "query_id", "left").select("query_id", F.col("error").isNull().alias("parsed"), "error", G.citations_valid(F.col("evidence_used"), F.coalesce("n", F.lit(0))).alias("citations_valid"))


@query(f"WITH {PR._EV} SELECT (SELECT count(*) FROM qs) AS queries, (SELECT count(*) FROM ev WHERE rank = 1) AS with_echo, (SELECT count(*) FROM ev WHERE rank = 1 AND coalesce(trim(reply), '') = '') AS empty_echo")
def baseline_summary(spark, sf):
    e = PR._evidence(spark, sf).where(F.col("rank") == 1)
    n = e.agg(F.count("*").alias("with_echo"), F.count_if(F.coalesce(F.trim("reply"), F.lit("")) == "").alias("empty_echo"))
    return n.select(PR._messages(spark, sf).agg(F.count("*")).scalar().alias("queries"), "*")


@query(f"WITH {PV._EV} SELECT quantile_cont(best, 0.2) AS similarity_p20, count(*) AS n FROM (SELECT query_id, max(similarity) AS best FROM ev GROUP BY 1)")
def calibrate_thresholds(spark, sf):
    """The 20th percentile of the best similarity: the number, without a rule that uses it."""
    return PV._evidence(spark, sf).groupBy("query_id").agg(F.max("similarity").alias("best")).agg(F.percentile("best", 0.2).alias("similarity_p20"), F.count("*").alias("n"))


@query(f"WITH {PV._EV}, s AS (SELECT query_id, count(*) AS n, max(similarity) AS best, count(label) AS labelled FROM ev GROUP BY 1) SELECT q.query_id, coalesce(n, 0) AS evidence_count, best AS top_similarity, coalesce(labelled, 0) AS labelled FROM qs q LEFT JOIN s USING (query_id)")
def pool_retrieval_signals(spark, sf):
    """What retrieval gives per query; queries without evidence keep a row."""
    s = PV._evidence(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("best"), F.count("label").alias("labelled"))
    return PV._labels(spark, sf).select("query_id").join(s, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("evidence_count"), F.col("best").alias("top_similarity"), F.coalesce("labelled", F.lit(0)).alias("labelled"))


@query(f"WITH {PV._EV} " + " UNION ALL ".join(f"SELECT {k} AS k, round(sum(matching) / sum(labelled), 6) AS consistency FROM (SELECT query_id, count(e.label) AS labelled, count(*) FILTER (e.label = q.label) AS matching FROM ev e JOIN qs q USING (query_id) WHERE rank <= {k} GROUP BY 1)" for k in (1, 3, 5)))
def dev_pool_k_check(spark, sf):
    """Agreement of evidence with the query's label for several k."""
    e, q = PV._evidence(spark, sf), PV._labels(spark, sf)
    out = None
    for k in (1, 3, 5):
        one = V.summary(e.where(F.col("rank") <= k), q).select(F.lit(k).alias("k"), "consistency")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT annotation_id, batch || '/' || coalesce(st, '-') AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY batch, st ORDER BY md5(annotation_id || ':46'), annotation_id) AS k FROM (SELECT annotation_id, min(batch) AS batch, min(sampling_stratum) AS st FROM golden WHERE annotation_id IS NOT NULL GROUP BY 1)) WHERE k <= 4")
def rating_sample(spark, sf):
    g = read(spark, sf, "golden").where(F.col("annotation_id").isNotNull()).groupBy("annotation_id").agg(F.min("batch").alias("batch"), F.min("sampling_stratum").alias("st"))
    g = g.select("annotation_id", F.concat("batch", F.lit("/"), F.coalesce("st", F.lit("-"))).alias("stratum"))
    return A.per_group(g, "stratum", "annotation_id", 4, 46).select("annotation_id", "stratum")


def _item_id(k):
    """j and the number in six digits, or as many as it has."""
    n = k.cast("string")
    return F.concat(F.lit("j"), F.lpad(n, F.greatest(F.lit(6), F.length(n)), F.lit("0")))


@query("SELECT query_id, rank, 'j' || lpad(CAST(k AS VARCHAR), 6, '0') AS item_id FROM (SELECT query_id, rank, row_number() OVER (ORDER BY md5(query_id || ':' || rank || ':47'), query_id, rank) AS k FROM (SELECT DISTINCT query_id, rank FROM evidence WHERE query_id IS NOT NULL))")
def judge_items(spark, sf):
    """(query, rank) pairs in hash order with ids that carry no order of theirs."""
    s = Scratch(spark, "items")
    e = read(spark, sf, "evidence").where(F.col("query_id").isNotNull()).select("query_id", "rank").distinct()
    e = e.withColumn("_h", F.md5(F.concat_ws(":", "query_id", "rank", F.lit("47")))).withColumn("_all", F.lit(0))
    return ranked(e, ["_all"], ["_h", "query_id", "rank"], "_k", s).select("query_id", "rank", _item_id(F.col("_k")).alias("item_id"))


@query(f"WITH {PV._EV} SELECT e.query_id, rank, q.label AS want, e.label FROM ev e JOIN qs q USING (query_id)")
def rating_key_join(spark, sf):
    return PV._evidence(spark, sf).join(PV._labels(spark, sf).withColumnRenamed("label", "want"), "query_id").select("query_id", "rank", "want", "label")


@query(R.sql(R.TURNS, "ev AS (SELECT DISTINCT query_id, rank, conversation_id FROM evidence WHERE query_id IS NOT NULL), c AS (SELECT DISTINCT conversation_id FROM t)", "SELECT query_id, rank, conversation_id, conversation_id IN (SELECT conversation_id FROM c) AS found FROM ev"))
def rebuild_evidence(spark, sf):
    """Evidence looked up again by conversation id; those not found say so."""
    e = read(spark, sf, "evidence").where(F.col("query_id").isNotNull()).select("query_id", "rank", "conversation_id").distinct()
    c = R.turns(spark, sf).select(F.col("conversation_id").alias("c")).distinct()
    return e.join(c, e.conversation_id == c.c, "left").select("query_id", "rank", "conversation_id", F.col("c").isNotNull().alias("found"))


@query("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) * 1.0 / sum(count(*)) OVER () < 0.05 AS small, count(*) * 1.0 / sum(count(*)) OVER () > 0.25 AS dominant FROM embeddings GROUP BY 1")
def cluster_quality(spark, sf):
    from pyspark.sql import Window as W

    n = read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return n.select("label", "n", F.round(share, 6).alias("share"), (share < 0.05).alias("small"), (share > 0.25).alias("dominant"))


_LABELS = ", ".join(f"'{x}'" for x in PE.LABELS)


@query(f"""{PE._E}, rw AS (SELECT annotation_id, truth AS a, coalesce(predicted, '<none>') AS b2 FROM e WHERE truth IS NOT NULL), cn AS (SELECT b, a, b2, sum(w) AS n FROM {PE.drawn("rw", "annotation_id", 42)} GROUP BY ALL),
  pl AS (SELECT b, label, 2 * sum(hit) / sum(n) AS f1 FROM (SELECT b, a AS label, n, CASE WHEN a = b2 THEN n ELSE 0 END AS hit FROM cn UNION ALL SELECT b, b2, n, 0 FROM cn) WHERE label IN ({_LABELS}) GROUP BY ALL), vl AS (SELECT b, sum(f1) / {len(PE.LABELS)} AS v FROM pl GROUP BY 1)
  SELECT count(*) AS resamples, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM vl""")
def bootstrap_macro_f1(spark, sf):
    e = PE._judged(spark, sf).withColumn("predicted", F.coalesce("predicted", F.lit("<none>")))
    counts = M.resampled_counts(e, "annotation_id", "truth", "predicted", seed=42)
    return M.interval(M.resampled_macro_f1(counts, PE.LABELS), "value").select("resamples", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""WITH {PE._PAIR}, cn AS (SELECT b, first AS a, second AS b2, sum(w) AS n FROM {PE.drawn("pr", "doc_id", 44)} GROUP BY ALL), tt AS (SELECT b, sum(n) AS t, coalesce(sum(n) FILTER (a = b2), 0) AS s FROM cn GROUP BY 1),
  ra AS (SELECT b, a AS l, sum(n) AS na FROM cn GROUP BY ALL), rb AS (SELECT b, b2 AS l, sum(n) AS nb FROM cn GROUP BY ALL), ex AS (SELECT b, sum(na * nb) AS e FROM ra JOIN rb USING (b, l) GROUP BY 1),
  vl AS (SELECT (s / t - coalesce(e, 0) / (t * t)) / nullif(1 - coalesce(e, 0) / (t * t), 0) AS v FROM tt LEFT JOIN ex USING (b))
  SELECT count(v) AS resamples, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM vl WHERE v IS NOT NULL""")
def bootstrap_kappa(spark, sf):
    counts = M.resampled_counts(PE._raters(spark, sf), "doc_id", "first", "second", seed=44)
    return M.interval(M.resampled_kappa(counts), "value").select("resamples", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""WITH {PV._EV}, it AS (SELECT query_id, max(similarity) AS v FROM ev GROUP BY 1), ms AS (SELECT b, sum(v * w) / sum(w) AS m FROM {PE.drawn("it", "query_id", 46)} WHERE v IS NOT NULL GROUP BY b)
  SELECT (SELECT count(v) FROM it) AS n, (SELECT round(avg(v), 9) FROM it) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM ms""")
def item_bootstrap(spark, sf):
    """Best similarity per query, resampled by query."""
    it = PV._evidence(spark, sf).groupBy("query_id").agg(F.max("similarity").alias("v"))
    return M.bootstrap_mean(it, "query_id", F.col("v"), seed=46).select("n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@query(f"{PE._E} SELECT annotation_id, truth, predicted, coalesce(predicted = truth, false) AS correct FROM e WHERE truth IS NOT NULL")
def evaluation_rows(spark, sf):
    """What was wanted and what was given, apart from each other, by annotation."""
    e = PE._judged(spark, sf).where(F.col("truth").isNotNull())
    return e.select("annotation_id", "truth", "predicted", F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)).alias("correct"))
