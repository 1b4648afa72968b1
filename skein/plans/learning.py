"""Classifier, reduction and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import learn as M
from skein.operators import sampling as A
from skein.operators import tfidf as T
from skein.operators.labels import clean, weak_label
from skein.plans import relations as R
from skein.plans import retrieval as V
from skein.plans.registry import Registry
from skein.session import Scratch, read

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _openings(spark, sf):
    o = weak_label(R.openings(spark, sf), "text").withColumn("tokens", X.ngrams(X.terms(F.col("text")), 2))
    return M.features(o.select("conversation_id", "weak_label", "tokens"), "tokens")


@query()
def intent_classifier(spark, sf):
    """Fitted on weak labels, applied to the golden texts."""
    s = Scratch(spark, "classifier")
    o = R.openings(spark, sf).select(F.col("conversation_id").alias("key"), "text", F.lit(False).alias("gold"), F.lit(None).cast("string").alias("truth"))
    g = read(spark, sf, "golden").where(F.col("annotation_id").isNotNull()).groupBy(F.col("annotation_id").alias("key")).agg(F.min("text").alias("text"), F.min(clean(F.col("primary_intent"))).alias("truth"))
    both = o.unionByName(g.withColumn("gold", F.lit(True)).select("key", "text", "gold", "truth"))
    x = M.features(weak_label(both, "text").withColumn("tokens", X.ngrams(X.terms(F.col("text")), 2)), "tokens")
    x = s.cut(x.select("key", "gold", "truth", "weak_label", "features"), "features")
    model, labels = M.classifier(x.where(~F.col("gold")), "weak_label")
    return M.predicted(x.where("gold"), model, labels).select("key", "truth", "predicted", F.round("confidence", 4).alias("confidence"))


@query()
def oof_confidence(spark, sf):
    s = Scratch(spark, "oof")
    return M.out_of_fold(s.cut(_openings(spark, sf).select("conversation_id", "weak_label", "features"), "features"), "conversation_id", "weak_label", s)


@query()
def svd_reduce(spark, sf):
    o = M.features(R.openings(spark, sf).select("conversation_id", X.terms(F.col("text")).alias("tokens")), "tokens", buckets=1 << 11)
    return M.svd(o, "conversation_id", 100)[0]


@query()
def kmeans_sweep(spark, sf):
    return M.kmeans_sweep(read(spark, sf, "embeddings").select("embedding"), "embedding", [6, 8, 10, 12, 16, 20])


@query(R.sql(R.OPENINGS, V._TF, """cl AS (SELECT tweet_id AS doc, min(brand) AS cluster FROM openings WHERE brand IS NOT NULL GROUP BY 1), nn2 AS (SELECT count(*) AS n FROM cl), sz AS (SELECT cluster, count(*) AS n_in FROM cl GROUP BY 1),
  pe AS (SELECT cluster, term, sum(weight) AS inside FROM wt JOIN cl USING (doc) GROUP BY 1, 2), wh AS (SELECT term, sum(inside) AS everywhere FROM pe GROUP BY 1),
  lf AS (SELECT cluster, term, round(inside / n_in - (everywhere - inside) / (n - n_in), 9) AS lift FROM pe JOIN wh USING (term) JOIN sz USING (cluster), nn2)""",
  "SELECT cluster, term, lift, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY lift DESC, term) AS k FROM lf) WHERE k <= 15"))
def distinctive_terms(spark, sf):
    o, w, _ = V._fitted(spark, sf)
    c = o.where(F.col("brand").isNotNull()).groupBy(F.col("tweet_id").alias("doc")).agg(F.min("brand").alias("cluster"))
    return M.distinctive_terms(T.long_form(w), c)


@query("""WITH e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS c FROM e GROUP BY 1, 2)
  SELECT label, vec_id, round(d, 6) AS distance, CAST(k AS INTEGER) AS rank FROM (SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY round(d, 6), vec_id) AS k FROM (SELECT label, vec_id, sqrt(sum((v - c) * (v - c))) AS d FROM e JOIN m USING (label, i) GROUP BY 1, 2)) WHERE k <= 8""")
def cluster_describe(spark, sf):
    """The eight vectors nearest to each labelled cluster's centre."""
    from pyspark.sql import Window as W

    e = read(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg("v").alias("c"))
    d = e.join(F.broadcast(m), ["label", "i"]).groupBy("label", "vec_id").agg(F.round(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))), 6).alias("distance"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("distance", "vec_id"))).where(F.col("rank") <= 8)


_DIST = """e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS c FROM e GROUP BY 1, 2), ds AS (SELECT label, vec_id, sqrt(sum((v - c) * (v - c))) AS d FROM e JOIN m USING (label, i) GROUP BY 1, 2)"""


@query(f"""WITH {_DIST}, co AS (SELECT label, count(*) AS n, round(avg(1 / (1 + d)), 6) AS cohesion FROM ds GROUP BY 1), pr AS (SELECT a.label, b.label AS other, round(sqrt(sum((a.c - b.c) * (a.c - b.c))), 6) AS far FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
  ne AS (SELECT label, other, far FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY far, other) AS k FROM pr) WHERE k = 1) SELECT label, n, cohesion, other AS nearest, far AS nearest_distance FROM co LEFT JOIN ne USING (label)""")
def cluster_cohesion(spark, sf):
    """By labelled cluster: size, mean of 1 / (1 + distance to the centre), and the cluster whose centre is nearest."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return M.cohesion(e, "vec_id", "label")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) AS k FROM embeddings WHERE label IS NOT NULL) WHERE k <= 3")
def cluster_random_members(spark, sf):
    return A.per_group(read(spark, sf, "embeddings").where(F.col("label").isNotNull()).select("label", "vec_id"), "label", "vec_id", 3, 42).select("label", "vec_id")


_TEXTS = R.TURNS + """, x AS (SELECT brand AS cluster, coalesce(text, '') AS t FROM t WHERE brand IS NOT NULL)"""


@query(R.sql(_TEXTS, """a AS (SELECT avg(length(t)) AS mean, stddev_samp(length(t)) AS sd, avg(CASE WHEN regexp_matches(t, 'https?://') THEN 1.0 ELSE 0.0 END) AS urls FROM x)""",
  """SELECT cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share, round(avg(CASE WHEN regexp_matches(t, 'https?://') THEN 1.0 ELSE 0.0 END), 6) AS url_share, round(avg(length(regexp_replace(t, '[^A-Z]', '', 'g')) / greatest(length(t), 1)), 6) AS caps_ratio,
  avg(CASE WHEN regexp_matches(t, 'https?://') THEN 1.0 ELSE 0.0 END) > 0.6 AND any_value(urls) < 0.3 AS url_driven, abs(avg(length(t)) - any_value(mean)) > 2 * any_value(sd) AS format_driven, count(*) * 1.0 / (SELECT count(*) FROM x) < 0.01 AS under_one_percent, count(*) * 1.0 / (SELECT count(*) FROM x) > 0.25 AS over_quarter FROM x, a GROUP BY 1"""))
def cluster_text_checks(spark, sf):
    """Quality of a grouping of texts, here by brand: groups driven by links or by length, too small or too large."""
    t = R.turns(spark, sf).where(F.col("brand").isNotNull()).select(F.col("brand").alias("cluster"), F.coalesce("text", F.lit("")).alias("t"))
    return M.text_checks(t, "cluster", "t")
