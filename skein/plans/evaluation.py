"""Weak labels, annotation tables and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import judge as J
from skein.operators import labels as L
from skein.operators import metrics as M
from skein.operators import sampling as A
from skein.plans import relations as R
from skein.plans.registry import Registry
from skein.session import Scratch, read

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

LABELS = sorted([*L.RULES, "general_dissatisfaction", "non_support_commentary", "other", "unclear"])


def _case(c: str) -> str:
    t = f"nullif(lower(replace(trim({c}), ' ', '_')), '')"
    return f"CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.TYPOS.items()) + f" ELSE {t} END"


def _weak(table: str, key: str, text: str) -> str:
    return (
        f"sc AS (SELECT k, s.label, s.n FROM (SELECT {key} AS k, unnest([" + ", ".join(f"{{'label': '{name}', 'n': " + " + ".join(f"CAST(regexp_matches(coalesce({text}, ''), '(?i){p}') AS INTEGER)" for p in ps) + "}" for name, ps in sorted(L.RULES.items())) + f"]) AS s FROM {table}) WHERE s.n > 0),"
        " wl AS (SELECT k, CASE WHEN count(*) FILTER (n = m) = 1 THEN min(label) FILTER (n = m) END AS weak_label, count(*) AS n_matched FROM (SELECT *, max(n) OVER (PARTITION BY k) AS m FROM sc) GROUP BY k)"
    )


_G = f"g AS (SELECT annotation_id, min(batch) AS batch, min(text) AS text, min({_case('primary_intent')}) AS truth, min({_case('secondary_intent')}) AS second, min({_case('confidence')}) AS confidence, bool_or(coalesce(lower(trim(ambiguous)) = 'yes', false)) AS ambiguous FROM golden WHERE annotation_id IS NOT NULL GROUP BY 1)"
_E = f"WITH {_G}, {_weak('g', 'annotation_id', 'text')}, e AS (SELECT g.*, weak_label AS predicted FROM g LEFT JOIN wl ON wl.k = g.annotation_id)"


def _golden(spark, sf):
    g = read(spark, sf, "golden").where(F.col("annotation_id").isNotNull())
    return g.groupBy("annotation_id").agg(
        F.min("batch").alias("batch"),
        F.min("text").alias("text"),
        F.min(L.clean(F.col("primary_intent"))).alias("truth"),
        F.min(L.clean(F.col("secondary_intent"))).alias("second"),
        F.min(L.clean(F.col("confidence"))).alias("confidence"),
        F.max(F.coalesce(F.lower(F.trim("ambiguous")) == "yes", F.lit(False))).alias("ambiguous"),
    )


def _judged(spark, sf):
    return L.weak_label(_golden(spark, sf), "text").withColumnRenamed("weak_label", "predicted")


@query(R.sql(R.OPENINGS, _weak("openings", "conversation_id", "text"), "SELECT conversation_id, weak_label, CAST(coalesce(n_matched, 0) AS INTEGER) AS n_matched FROM openings LEFT JOIN wl ON wl.k = conversation_id"))
def weak_label(spark, sf):
    return L.weak_label(R.openings(spark, sf), "text").select("conversation_id", "weak_label", "n_matched")


@query(R.sql(R.OPENINGS, _weak("openings", "conversation_id", "text"), "SELECT coalesce(weak_label, '<none>') AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM openings LEFT JOIN wl ON wl.k = conversation_id GROUP BY 1"))
def weak_label_stats(spark, sf):
    from pyspark.sql import Window as W

    n = L.weak_label(R.openings(spark, sf), "text").groupBy(F.coalesce("weak_label", F.lit("<none>")).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("SELECT annotation_id, 'primary_intent' AS column_name, primary_intent AS before, " + _case("primary_intent") + " AS after FROM b02_fresh_labelled WHERE primary_intent IS NOT NULL AND primary_intent IS DISTINCT FROM " + _case("primary_intent") + " UNION ALL SELECT annotation_id, 'confidence', confidence, " + _case("confidence") + " FROM b02_fresh_labelled WHERE confidence IS NOT NULL AND confidence IS DISTINCT FROM " + _case("confidence"))
def label_normalise_log(spark, sf):
    return L.change_log(read(spark, sf, "b02_fresh_labelled"), "annotation_id", ["primary_intent", "confidence"])


@query(f"WITH {_G} SELECT truth, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (ambiguous) AS flagged FROM g WHERE truth IS NOT NULL GROUP BY 1")
def intent_table(spark, sf):
    return L.label_table(_golden(spark, sf), "truth", "confidence", "ambiguous")


@query(f"WITH {_G} SELECT least(truth, second) AS first_label, greatest(truth, second) AS second_label, count(*) AS n FROM g WHERE truth <> second GROUP BY 1, 2")
def secondary_pairs(spark, sf):
    return L.label_pairs(_golden(spark, sf), "truth", "second")


@query(f"WITH {_G} SELECT concat_ws('+', CASE WHEN ambiguous THEN 'ambiguous' END, CASE WHEN confidence = 'low' THEN 'low' END, CASE WHEN second IS NOT NULL THEN 'second' END) AS pattern, count(*) AS n FROM g GROUP BY 1")
def reason_patterns(spark, sf):
    return L.patterns(_golden(spark, sf), {"ambiguous": F.col("ambiguous"), "low": F.col("confidence") == "low", "second": F.col("second").isNotNull()})


_FLAT = "regexp_replace(trim(coalesce({0}, '')), '\\s+', ' ', 'g')"


@query(f"""WITH {_G}, per AS (SELECT annotation_id, count(DISTINCT coalesce(text, '')) AS k FROM golden WHERE annotation_id IS NOT NULL GROUP BY 1),
  src AS (SELECT DISTINCT tweet_id, {_FLAT.format("text")} AS f FROM turns WHERE tweet_id IS NOT NULL), own AS (SELECT DISTINCT annotation_id, try_cast(CASE WHEN regexp_full_match(trim(tweet_id), '[0-9]+') THEN trim(tweet_id) END AS BIGINT) AS tweet_id, {_FLAT.format("text")} AS f FROM golden WHERE annotation_id IS NOT NULL)
  SELECT 'known_label' AS check_name, count(*) FILTER (NOT coalesce(truth IN ({", ".join(f"'{x}'" for x in LABELS)}), false)) AS n FROM g UNION ALL
  SELECT 'known_confidence', count(*) FILTER (NOT coalesce(confidence IN ('high', 'medium', 'low'), false)) FROM g UNION ALL SELECT 'text_present', count(*) FILTER (NOT coalesce(trim(text) <> '', false)) FROM g UNION ALL
  SELECT 'second_differs', count(*) FILTER (NOT coalesce(second IS NULL OR second <> truth, false)) FROM g UNION ALL SELECT 'one_text_per_id', (SELECT count(*) FROM per WHERE k > 1) UNION ALL
  SELECT 'text_as_in_source', (SELECT count(*) FROM own WHERE tweet_id IN (SELECT tweet_id FROM src) AND (tweet_id, f) NOT IN (SELECT (tweet_id, f) FROM src))""")
def batch_validation(spark, sf):
    """Violations by check: labels, texts, one text per id, and texts that differ from the turn they were taken from."""
    flat = lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ")
    rows = read(spark, sf, "golden").where(F.col("annotation_id").isNotNull())
    out = L.violations(_golden(spark, sf), {"known_label": F.col("truth").isin(LABELS), "known_confidence": F.col("confidence").isin("high", "medium", "low"), "text_present": F.trim("text") != "", "second_differs": F.col("second").isNull() | (F.col("second") != F.col("truth"))})
    many = rows.groupBy("annotation_id").agg(F.count_distinct(F.coalesce("text", F.lit(""))).alias("k")).where(F.col("k") > 1)
    own = rows.select("annotation_id", F.when(F.trim("tweet_id").rlike("^[0-9]+$"), F.trim("tweet_id")).try_cast("bigint").alias("tweet_id"), flat(F.col("text")).alias("f")).distinct()
    src = read(spark, sf, "turns").where(F.col("tweet_id").isNotNull()).select("tweet_id", flat(F.col("text")).alias("f")).distinct()
    other = own.join(src.select("tweet_id").distinct(), "tweet_id", "left_semi").join(src, ["tweet_id", "f"], "left_anti")
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    return out.unionByName(one("one_text_per_id", many)).unionByName(one("text_as_in_source", other))


@query(f"WITH {_G} SELECT annotation_id, concat_ws('+', CASE WHEN ambiguous THEN 'ambiguous' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END) AS reason, substring(text, 1, 90) AS excerpt FROM g WHERE ambiguous OR confidence = 'low'")
def review_cases(spark, sf):
    g = _golden(spark, sf).where(F.col("ambiguous") | (F.col("confidence") == "low"))
    return g.select("annotation_id", F.concat_ws("+", F.when(F.col("ambiguous"), "ambiguous"), F.when(F.col("confidence") == "low", "low_confidence")).alias("reason"), F.substring("text", 1, 90).alias("excerpt"))


@query("SELECT annotation_id, batch, sampling_stratum, conversation_id, text FROM (SELECT annotation_id, batch, sampling_stratum, conversation_id, text FROM golden UNION ALL SELECT annotation_id, 'b02', sampling_stratum, conversation_id, text_display FROM b02_fresh_labelled) ORDER BY annotation_id")
def golden_frame(spark, sf):
    g = read(spark, sf, "golden").select("annotation_id", "batch", "sampling_stratum", "conversation_id", "text")
    b = read(spark, sf, "b02_fresh_labelled").select("annotation_id", F.lit("b02").alias("batch"), "sampling_stratum", "conversation_id", F.col("text_display").alias("text"))
    return g.unionByName(b).orderBy("annotation_id")


_LAB = "lab AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in LABELS) + "]) AS label)"
_PL = f"""{_LAB}, pl AS (SELECT label, coalesce(t, 0) AS support, CASE WHEN coalesce(p, 0) = 0 THEN 0.0 ELSE coalesce(h, 0) / p END AS precision, CASE WHEN coalesce(t, 0) = 0 THEN 0.0 ELSE coalesce(h, 0) / t END AS recall,
  CASE WHEN coalesce(t, 0) + coalesce(p, 0) = 0 THEN 0.0 ELSE 2 * coalesce(h, 0) / (coalesce(t, 0) + coalesce(p, 0)) END AS f1 FROM lab
  LEFT JOIN (SELECT truth AS label, count(*) AS t, count(*) FILTER (predicted = truth) AS h FROM e WHERE truth IS NOT NULL GROUP BY 1) a USING (label) LEFT JOIN (SELECT predicted AS label, count(*) AS p FROM e WHERE truth IS NOT NULL GROUP BY 1) b USING (label))"""


@query(f"{_E}, {_PL} SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pl")
def classification_metrics(spark, sf):
    return M.per_label(_judged(spark, sf), "truth", "predicted", LABELS).select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"{_E}, {_PL} SELECT (SELECT count(*) FROM e WHERE truth IS NOT NULL) AS n, (SELECT round(avg(CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END), 9) FROM e WHERE truth IS NOT NULL) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM pl")
def overall_metrics(spark, sf):
    return M.overall(_judged(spark, sf), "truth", "predicted", LABELS).select("n", *(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


@query(f"{_E} SELECT truth, predicted, count(*) AS n FROM e WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return M.confusion(_judged(spark, sf), "truth", "predicted")


@query(f"{_E} SELECT batch, count(*) AS n, round(avg(CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM e WHERE truth IS NOT NULL GROUP BY GROUPING SETS ((batch), ())")
def evaluation_grid(spark, sf):
    """Accuracy by batch and over all (batch null), in one pass."""
    e = _judged(spark, sf).where(F.col("truth").isNotNull())
    return e.rollup("batch").agg(F.count("*").alias("n"), F.round(F.avg(F.col("truth").eqNullSafe(F.col("predicted")).cast("double")), 9).alias("accuracy"))


@query(f"{_E} SELECT count(*) AS n, count(*) FILTER (predicted = truth) AS correct FROM e WHERE truth IN ({', '.join(repr(x) for x in sorted(L.RULES))})")
def predictable_view(spark, sf):
    e = _judged(spark, sf).where(F.col("truth").isin(*sorted(L.RULES)))
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("truth").eqNullSafe(F.col("predicted"))).alias("correct"))


@query(f"WITH {_G} SELECT truth AS label, count(*) AS n FROM g WHERE truth IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def majority_label(spark, sf):
    return M.majority(_golden(spark, sf), "truth")


_PAIR = "pr AS (SELECT a.doc_id, a.reading_level AS first, b.reading_level AS second FROM (SELECT DISTINCT * FROM reading_labels) a JOIN (SELECT DISTINCT * FROM reading_labels) b ON a.doc_id = b.doc_id AND a.rater_id < b.rater_id WHERE a.reading_level IS NOT NULL AND b.reading_level IS NOT NULL)"


def _raters(spark, sf):
    r = read(spark, sf, "reading_labels").distinct()
    a = r.select("doc_id", F.col("rater_id").alias("ra"), F.col("reading_level").alias("first"))
    b = r.select("doc_id", F.col("rater_id").alias("rb"), F.col("reading_level").alias("second"))
    return a.join(b, "doc_id").where((F.col("ra") < F.col("rb")) & F.col("first").isNotNull() & F.col("second").isNotNull()).select("doc_id", "first", "second")


@query(f"WITH {_PAIR}, c AS (SELECT first AS a, second AS b, count(*) AS n FROM pr GROUP BY 1, 2), x AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c) SELECT CAST(any_value(t.n) AS BIGINT) AS n, round((SELECT coalesce(sum(n), 0) FROM c WHERE a = b) / any_value(t.n), 9) AS agreement, round(1 - (SELECT sum(n) FROM c WHERE a <> b) * any_value(t.n) / sum(na * nb) FILTER (x.a <> y.b), 9) AS kappa FROM x, y, t")
def cohens_kappa(spark, sf):
    return M.kappa(_raters(spark, sf), "first", "second").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query(f"WITH {_PAIR}, c AS (SELECT first AS a, second AS b, count(*) AS n FROM pr GROUP BY 1, 2), x AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c) SELECT CAST(any_value(t.n) AS BIGINT) AS n, round((SELECT coalesce(sum(n), 0) FROM c WHERE a = b) / any_value(t.n), 9) AS agreement, round(1 - (SELECT sum(n * (a - b) * (a - b)) FROM c) * any_value(t.n) / sum(na * nb * (x.a - y.b) * (x.a - y.b)), 9) AS kappa FROM x, y, t")
def weighted_kappa(spark, sf):
    return M.kappa(_raters(spark, sf), "first", "second", weighted=True).select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query(f"WITH {_PAIR} SELECT first AS level, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(count(*) FILTER (first = second) / count(*), 9) END AS agreement FROM pr GROUP BY 1")
def agreement_by_label(spark, sf):
    """Agreement by first label; null where fewer than three rows make a rate."""
    return _raters(spark, sf).groupBy(F.col("first").alias("level")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.count_if(F.col("first") == F.col("second")) / F.count("*"), 9)).alias("agreement"))


@query(f"WITH {_PAIR} SELECT count(*) AS n, round(avg(CASE WHEN first = second THEN 1.0 ELSE 0.0 END), 9) AS exact, round(avg(CASE WHEN abs(first - second) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS within_one, round(avg(abs(first - second)), 9) AS mean_abs_difference FROM pr")
def retest_agreement(spark, sf):
    d = F.abs(F.col("first") - F.col("second"))
    return _raters(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg((d == 0).cast("double")), 9).alias("exact"), F.round(F.avg((d <= 1).cast("double")), 9).alias("within_one"), F.round(F.avg(d), 9).alias("mean_abs_difference"))


@query("WITH c AS (SELECT source AS a, lang AS b, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM c), x AS (SELECT sum(k * (k - 1) / 2.0) AS v FROM (SELECT sum(n) AS k FROM c GROUP BY a)), y AS (SELECT sum(k * (k - 1) / 2.0) AS v FROM (SELECT sum(n) AS k FROM c GROUP BY b)) SELECT CAST(s.n AS BIGINT) AS n, round((s.s - x.v * y.v / (s.n * (s.n - 1) / 2.0)) / ((x.v + y.v) / 2.0 - x.v * y.v / (s.n * (s.n - 1) / 2.0)), 9) AS ari FROM s, x, y")
def adjusted_rand(spark, sf):
    return M.adjusted_rand(read(spark, sf, "documents"), "source", "lang").select("n", F.round("ari", 9).alias("ari"))


def drawn(rows: str, key: str, seed: int, resamples: int = M.RESAMPLES) -> str:
    """SQL of metrics.resampled(): the columns of a relation, b and w."""
    w = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in M.POISSON)
    return f"(SELECT *, {w} AS w FROM (SELECT {rows}.*, blk * 8 + i AS b, CAST('0x' || substring(md5(concat_ws(':', {key}, blk, {seed})), 1 + 4 * i, 4) AS BIGINT) AS u FROM {rows}, (SELECT CAST(range AS INTEGER) AS blk FROM range({(resamples + 7) // 8})), (SELECT CAST(range AS INTEGER) AS i FROM range(8)) WHERE {key} IS NOT NULL) WHERE b < {resamples} AND w > 0)"


@query(f"""{_E}, rw AS (SELECT annotation_id, CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END AS v FROM e WHERE truth IS NOT NULL), ms AS (SELECT b, sum(v * w) / sum(w) AS m FROM {drawn("rw", "annotation_id", 42)} GROUP BY b)
  SELECT (SELECT count(*) FROM rw) AS n, (SELECT round(avg(v), 9) FROM rw) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM ms""")
def bootstrap_accuracy(spark, sf):
    e = _judged(spark, sf).where(F.col("truth").isNotNull())
    out = M.bootstrap_mean(e, "annotation_id", F.col("truth").eqNullSafe(F.col("predicted")).cast("int"), seed=42)
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@query("SELECT rater_id, count(*) AS n, round(avg(reading_level), 6) AS mean, quantile_cont(reading_level, 0.5) AS median, count(*) FILTER (reading_level = 1) AS n1, count(*) FILTER (reading_level = 2) AS n2, count(*) FILTER (reading_level = 3) AS n3, count(*) FILTER (reading_level = 4) AS n4, count(*) FILTER (reading_level = 5) AS n5, round(count(*) FILTER (reading_level <= 2) / count(*), 6) AS share_low, round(count(*) FILTER (reading_level >= 4) / count(*), 6) AS share_high FROM reading_labels WHERE reading_level IS NOT NULL GROUP BY 1")
def ordinal_describe(spark, sf):
    return M.ordinal(read(spark, sf, "reading_labels"), "rater_id", "reading_level")


@query("WITH x AS (SELECT query_id, avg(similarity) FILTER (retrieved_by = 'tfidf') AS va, avg(similarity) FILTER (retrieved_by = 'random') AS vb FROM evidence WHERE query_id IS NOT NULL AND retrieved_by IN ('tfidf', 'random') GROUP BY 1) SELECT count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL) AS paired, count(*) FILTER (va > vb) AS wins, count(*) FILTER (va = vb) AS ties, count(*) FILTER (va < vb) AS losses, round(avg(va - vb), 6) AS mean_difference, count(*) FILTER (va IS NULL OR vb IS NULL) AS unpaired FROM x")
def paired_comparison(spark, sf):
    return M.paired(read(spark, sf, "evidence"), "query_id", "retrieved_by", "similarity", "tfidf", "random")


# -- ratings: orders as rated replies (item o_custkey, system o_orderstatus, score the first sign of o_orderpriority) --

_RT = "rt AS (SELECT o_orderkey AS response, o_custkey AS item, o_orderstatus AS system, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS score, o_totalprice > 200000 AS flag, o_orderdate AS day FROM orders)"


def _ratings(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("response"), F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("system"), F.substring("o_orderpriority", 1, 1).cast("int").alias("score"), (F.col("o_totalprice") > 200000).alias("flag"), F.col("o_orderdate").alias("day"))


@query(f"WITH {_RT} SELECT system, count(*) FILTER (flag AND score <= 2) AS flagged_low, count(*) FILTER (flag AND score > 2) AS flagged_other, count(*) FILTER (NOT flag AND score <= 2) AS unflagged_low, count(*) FILTER (NOT flag AND score > 2) AS unflagged_other, round(count(*) FILTER (flag) / count(*), 6) AS share_flagged, round(count(*) FILTER (flag AND score <= 2) / count(*) FILTER (flag), 6) AS low_if_flagged, round(count(*) FILTER (NOT flag AND score <= 2) / count(*) FILTER (NOT flag), 6) AS low_if_unflagged FROM rt GROUP BY 1")
def claim_flag_crosstab(spark, sf):
    return M.flag_by_low(_ratings(spark, sf), "system", "flag", "score")


@query(f"WITH {_RT} SELECT 'system' AS dimension, system AS level, count(*) AS n, round(avg(score), 6) AS mean FROM rt GROUP BY 2 UNION ALL SELECT 'flag', CAST(flag AS VARCHAR), count(*), round(avg(score), 6) FROM rt GROUP BY 2")
def behaviour_breakdown(spark, sf):
    return M.breakdown(_ratings(spark, sf), ["system", "flag"], "score")


_WIDE = "wd AS (SELECT item, avg(score) FILTER (system = 'F') AS f, avg(score) FILTER (system = 'O') AS o, avg(score) FILTER (system = 'P') AS p FROM rt GROUP BY 1), ms0 AS (SELECT item, f, o, p, f - o AS f_less_o, f - p AS f_less_p, o - p AS o_less_p FROM wd)"
_MEASURES = ("f", "o", "p", "f_less_o", "f_less_p", "o_less_p")


@query(f"WITH {_RT}, {_WIDE}, rs AS (SELECT b, " + ", ".join(f"sum({m} * w) / sum(w) FILTER ({m} IS NOT NULL) AS {m}" for m in _MEASURES) + f" FROM {drawn('ms0', 'item', 46)} GROUP BY b) " + " UNION ALL ".join(f"SELECT '{m}' AS name, (SELECT count({m}) FROM ms0) AS n, (SELECT round(avg({m}), 9) FROM ms0) AS mean, (SELECT round(quantile_cont({m}, 0.025), 9) FROM rs) AS low, (SELECT round(quantile_cont({m}, 0.975), 9) FROM rs) AS high" for m in _MEASURES))
def system_bootstrap(spark, sf):
    """Mean score by system and paired differences, with intervals over items: an item's ratings move together."""
    by = {k: F.avg(F.when(F.col("system") == k.upper(), F.col("score"))) for k in ("f", "o", "p")}
    wide = _ratings(spark, sf).groupBy("item").agg(*(v.alias(k) for k, v in by.items()))
    wide = wide.select("*", *((F.col(a) - F.col(b)).alias(f"{a}_less_{b}") for a, b in (("f", "o"), ("f", "p"), ("o", "p"))))
    return M.bootstrap_means(wide, "item", list(_MEASURES), seed=46).select("name", "n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@query(f"WITH {_RT}, tw AS (SELECT item, system, arg_min(score, (day, response)) AS first, arg_max(score, (day, response)) AS second FROM rt GROUP BY 1, 2 HAVING count(*) > 1), gg AS (SELECT unnest([system, '<all>']) AS system, first AS a, second AS b FROM tw), c AS (SELECT system, a, b, count(*) AS n FROM gg GROUP BY ALL), sn AS (SELECT system, sum(n) AS n, sum(n) FILTER (a = b) AS same, sum(n) FILTER (abs(a - b) <= 1) AS near FROM c GROUP BY 1), ra AS (SELECT system, a AS l, sum(n) AS na FROM c GROUP BY ALL), rb AS (SELECT system, b AS l, sum(n) AS nb FROM c GROUP BY ALL), ex AS (SELECT system, sum(na * nb) AS e FROM ra JOIN rb USING (system, l) GROUP BY 1) SELECT system, CAST(n AS BIGINT) AS n, round(same / n, 9) AS exact, round(near / n, 9) AS within_one, round((same / n - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM sn JOIN ex USING (system)")
def retest_by_dimension(spark, sf):
    """First and last score of an item by system: agreement and kappa by system and pooled."""
    r = _ratings(spark, sf).groupBy("item", "system").agg(F.count("*").alias("k"), F.min(F.struct("day", "response", "score")).alias("a"), F.max(F.struct("day", "response", "score")).alias("b")).where(F.col("k") > 1)
    return M.kappa_by(r.select("item", "system", F.col("a.score").alias("first"), F.col("b.score").alias("second")), "system", "first", "second")


_ODD = "SELECT DISTINCT query_id, rank, retrieved_by FROM evidence WHERE query_id IS NOT NULL AND retrieved_by IS NOT NULL"


@query(f"SELECT query_id, rank, retrieved_by FROM (SELECT *, row_number() OVER (PARTITION BY retrieved_by ORDER BY md5(query_id || '/' || rank || ':48'), query_id || '/' || rank) AS k FROM ({_ODD})) WHERE k <= 12")
def retest_select(spark, sf):
    """Twelve pieces of evidence per way of retrieval, to be rated again."""
    e = read(spark, sf, "evidence").where(F.col("query_id").isNotNull() & F.col("retrieved_by").isNotNull()).select("query_id", "rank", "retrieved_by").distinct()
    return A.per_group(e.withColumn("key", F.concat_ws("/", "query_id", F.col("rank").cast("string"))), "retrieved_by", "key", 12, 48).select("query_id", "rank", "retrieved_by")


@query("""WITH it AS (SELECT DISTINCT query_id || '/' || rank AS key, query_id AS item FROM evidence WHERE query_id IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY item) AS m, count(*) OVER () AS n FROM it),
  k AS (SELECT key, item, n, row_number() OVER (ORDER BY m DESC, md5(item || ':49'), md5(key || ':49'), key) - 1 AS k FROM n) SELECT key, item, CASE WHEN k < (n + 1) // 2 THEN 2 * k ELSE 2 * (k - (n + 1) // 2) + 1 END AS position FROM k""")
def blinded_order(spark, sf):
    """Evidence in an order in which no query follows itself."""
    s = Scratch(spark, "blinded")
    e = read(spark, sf, "evidence").where(F.col("query_id").isNotNull()).select(F.concat_ws("/", "query_id", F.col("rank").cast("string")).alias("key"), F.col("query_id").alias("item")).distinct()
    return A.blinded_order(s.cut(e, "items"), "key", "item", 49, s)


@query("""WITH r AS (SELECT * FROM reading_labels), d AS (SELECT doc_id, text FROM documents)
  SELECT 'score_present' AS check_name, count(*) FILTER (reading_level IS NULL) AS n FROM r UNION ALL SELECT 'score_in_range', count(*) FILTER (reading_level NOT BETWEEN 1 AND 5) FROM r UNION ALL SELECT 'item_known', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM d)) FROM r
  UNION ALL SELECT 'rated_once', (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY doc_id, rater_id HAVING count(*) > 1)) UNION ALL SELECT 'no_system_named', count(*) FILTER (regexp_matches(rater_id, '(?i)tfidf|random|llm')) FROM r
  UNION ALL SELECT 'no_id_shown', (SELECT count(*) FROM d WHERE doc_id IN (SELECT doc_id FROM r) AND regexp_matches(text, '@[0-9]+'))""")
def rating_validation(spark, sf):
    """Violations of a rating file by check: completeness, score domain, structure, forbidden words and ids in the rated texts."""
    r, d = read(spark, sf, "reading_labels"), read(spark, sf, "documents")
    return L.rating_violations(r, d, ["doc_id", "rater_id"], "doc_id", "reading_level", "rater_id", "text")


_JUDGED = """it AS (SELECT query_id || '/' || rank AS item, min(historical_brand_reply) AS reply FROM evidence WHERE query_id IS NOT NULL GROUP BY 1), dm AS (SELECT unnest(['relevance', 'tone', 'safety']) AS dimension),
x AS (SELECT item, dimension, reply, trim(regexp_replace(coalesce(reply, ''), '\\s+', ' ', 'g')) = '' AS blank, CAST('0x' || substring(md5(coalesce(reply, '')), 1, 4) AS BIGINT) % 10 + length(dimension) AS h FROM it, dm),
j AS (SELECT item, dimension, CASE WHEN NOT blank AND h % 10 > 3 THEN 1 + h % 5 END AS score, CASE WHEN blank THEN 'empty_reply' WHEN h % 10 = 1 THEN 'invalid_json' WHEN h % 10 = 2 THEN 'score_not_a_number' WHEN h % 10 = 3 THEN 'score_out_of_range' END AS error, CASE WHEN NOT blank AND h % 10 = 0 AND h = 10 THEN 'TimeoutError' END AS failure0, h, blank FROM x),
jd AS (SELECT item, dimension, CASE WHEN NOT blank AND h % 10 = 0 AND h <> 10 THEN 1 + h % 5 ELSE score END AS score, error, failure0 AS failure FROM j)"""


def judge_stub(second: bool):
    """A completer for tests, by the hash of the reply and the length of the dimension's name: good, broken, or a time-out that a second try may mend."""
    import hashlib

    def complete(prompt: str) -> str:
        dimension = prompt.split("Rate the ", 1)[1].split(" of the reply", 1)[0]
        reply = prompt.split("\nReply: ", 1)[1].rsplit("\nAnswer as JSON", 1)[0]
        h = int(hashlib.md5(reply.encode()).hexdigest()[:4], 16) % 10 + len(dimension)
        if h % 10 == 0 and not (second and h != 10):
            raise TimeoutError
        return {1: "no json", 2: '{"score": true, "reason": "ok"}', 3: '{"score": 9, "reason": "ok"}'}.get(h % 10, f'{{"score": {1 + h % 5}, "reason": "ok"}}')

    return complete


def _judgements(spark, sf):
    e = read(spark, sf, "evidence").where(F.col("query_id").isNotNull()).groupBy(F.concat_ws("/", "query_id", F.col("rank").cast("string")).alias("item")).agg(F.min("historical_brand_reply").alias("reply"))
    return J.run(e.select("item", F.lit("").alias("message"), "reply"), ["relevance", "tone", "safety"], judge_stub(False), judge_stub(True))


@query(f"WITH {_JUDGED} SELECT item, dimension, score, error, failure FROM jd")
def judge_run(spark, sf):
    """Every past reply judged in three dimensions, failures tried once more."""
    return _judgements(spark, sf).select("item", "dimension", "score", "error", "failure")


@query(f"WITH {_JUDGED} SELECT item, CASE WHEN count(failure) > 0 THEN 'failed' WHEN count(*) FILTER (error = 'empty_reply') > 0 THEN 'empty' WHEN count(error) > 0 THEN 'unparsed' ELSE 'complete' END AS status FROM jd GROUP BY 1")
def judge_item_status(spark, sf):
    return J.item_status(_judgements(spark, sf))


@query(f"WITH {_JUDGED} SELECT dimension, count(score) AS judged, count(*) FILTER (score IS NULL) AS unusable, round(avg(score), 6) AS mean, " + ", ".join(f"count(*) FILTER (score = {k}) AS n{k}" for k in range(1, 6)) + " FROM jd GROUP BY 1")
def judge_summary(spark, sf):
    return J.dimension_summary(_judgements(spark, sf))
