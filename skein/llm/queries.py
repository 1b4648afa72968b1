"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import dialogue as D
from skein.llm import leaks as L
from skein.llm import mixture as M
from skein.llm import overlap as O
from skein.llm import pii as P
from skein.llm import reading as R
from skein.llm import splits as S
from skein.llm import visual as V
from skein.session import Scratch, read

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- 6: look-alike text --------------------------------------------------------------


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = V.same_look_pairs(V.same_look(read(spark, sf_dir, "b02_fresh_labelled"), "annotation_id", "text_display"), "annotation_id")
    return pairs.select(F.col("a").alias("annotation_id_a"), F.col("b").alias("annotation_id_b"))


@query
def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's text in one consistent form."""
    return V.repair(read(spark, sf_dir, "b02_fresh_labelled").select("annotation_id", "text_display"), "text_display")


# -- 4: conversations ----------------------------------------------------------------


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdicts = D.rebuild(read(spark, sf_dir, "turns"))
    return verdicts.where(F.size("reasons") > 0).select("conversation_id")


@query
def p4_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdicts = D.rebuild(read(spark, sf_dir, "turns"))
    return verdicts.select("conversation_id", "n_turns", F.concat_ws("+", "reasons").alias("reasons"))


@query
def p4_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with replies that no sender clocks can put in order, and what else is wrong with them."""
    _, verdicts = D.rebuild(read(spark, sf_dir, "turns"))
    return verdicts.where(F.col("clock_conflicts") > 0).select("conversation_id", "clock_conflicts", F.concat_ws("+", "reasons", F.lit("clock")).alias("reasons"))


@query
def p4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted conversations as ordered turns."""
    turns, verdicts = D.rebuild(read(spark, sf_dir, "turns"), with_text=True)
    return D.kept_turns(turns, verdicts).select("conversation_id", "position", "role", "tweet_id", "text")


@query
def p4_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and feasible conversations merged by corrected time."""
    s = Scratch(spark, "timeline")
    turns, verdicts = D.rebuild(read(spark, sf_dir, "turns"), s)
    return D.merged_by_time(D.kept_turns(turns, verdicts, feasible=True), s).select("conversation_id", "merged", "position", "role", "tweet_id", "corrected_at")


_BLANK = r"[\s\p{Z}\p{Cf}\p{Cc}\x{034F}\x{115F}\x{1160}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"
_OUTER = r"^[\s\p{Z}\p{Cf}\p{Cc}]+|[\s\p{Z}\p{Cf}\p{Cc}]+$"
_TURNS = f"""
rows0 AS (SELECT *, nullif(regexp_replace(author_id, '{_OUTER}', '', 'g'), '') AS au, lower(regexp_replace(speaker, '{_OUTER}', '', 'g')) AS sp,
    length(regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g')) > 0 AS seen
  FROM turns WHERE nullif(regexp_replace(conversation_id, '{_OUTER}', '', 'g'), '') IS NOT NULL),
t0 AS (SELECT conversation_id, tweet_id, min(au) AS au, min(CASE WHEN sp IN ('customer', 'brand') THEN sp END) AS sp, min(turn_index) AS i, bool_or(seen) AS seen,
    arg_max(text, (seen, text)) AS text FROM rows0 GROUP BY ALL),
t AS (SELECT *, CASE WHEN regexp_full_match(au, '[0-9]+') THEN 'customer' WHEN au IS NOT NULL THEN 'brand' ELSE sp END AS role FROM t0),
v AS (SELECT conversation_id, count(*) AS n_turns,
    coalesce(count(DISTINCT i) = count(*) AND min(i) = 0 AND max(i) = count(*) - 1, false) AS ordered,
    count(*) FILTER (role IS NULL) = 0 AS roles,
    coalesce(bool_or(i = 0 AND role = 'customer'), false) AS opens,
    coalesce(min(i) FILTER (seen AND role = 'customer') < max(i) FILTER (seen AND role = 'brand'), false) AS answered
  FROM t GROUP BY conversation_id)"""
ORACLE["p4_found"] = f"WITH {_TURNS} SELECT conversation_id FROM v WHERE NOT (ordered AND roles AND opens AND answered)"
_REASON = "concat_ws('+', CASE WHEN NOT ordered THEN 'order' END, CASE WHEN NOT roles THEN 'role' END, CASE WHEN NOT opens THEN 'opening' END, CASE WHEN NOT answered THEN 'reply' END)"
ORACLE["p4_verdicts"] = f"WITH {_TURNS} SELECT conversation_id, n_turns, {_REASON} AS reasons FROM v"
ORACLE["p4_conversations"] = f"WITH {_TURNS} SELECT t.conversation_id, CAST(t.i AS INTEGER) AS position, t.role, t.tweet_id, t.text FROM t JOIN v USING (conversation_id) WHERE ordered AND roles AND opens AND answered"


# -- 1: splits -----------------------------------------------------------------------

#: Wanted proportions of the splits.
SPLIT_WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = S.record_groups(read(spark, sf_dir, "golden"), "annotation_id", S.golden_keys())
    return S.joined_groups(groups, "annotation_id")


@query
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every annotation with its split."""
    groups = S.record_groups(read(spark, sf_dir, "golden"), "annotation_id", S.golden_keys())
    return S.assign_splits(groups, "annotation_id", SPLIT_WEIGHTS).select("annotation_id", "split")


@query
def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations, components and share reached by split."""
    groups = S.record_groups(read(spark, sf_dir, "golden"), "annotation_id", S.golden_keys())
    by = S.assign_splits(groups, "annotation_id", SPLIT_WEIGHTS).groupBy("split", "component").agg(F.count("*").alias("n"))
    by = by.groupBy("split").agg(F.sum("n").alias("annotations"), F.count("*").alias("components"))
    total = F.sum("annotations").over(W.partitionBy())  # over one row per split
    return by.select("split", "annotations", "components", F.round(F.col("annotations") / total, 4).alias("share"))


ORACLE["p1_found"] = r"""WITH RECURSIVE
k0 AS (SELECT annotation_id AS r, try_cast(CASE WHEN regexp_full_match(regexp_replace(customer_author_id, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g'), '[+-]?[0-9]+(\.[0-9]*)?') THEN regexp_replace(customer_author_id, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g') END AS DECIMAL(38,6)) AS c,
   nullif(lower(regexp_replace(conversation_id, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g')), '') AS v FROM golden WHERE annotation_id IS NOT NULL),
k AS (SELECT DISTINCT r, 'c' || c AS k FROM k0 WHERE c IS NOT NULL UNION SELECT r, 'v' || v FROM k0 WHERE v IS NOT NULL),
reach(r, s) AS (SELECT DISTINCT r, r FROM k UNION SELECT reach.r, b.r FROM reach JOIN k a ON a.r = reach.s JOIN k b ON a.k = b.k)
SELECT r AS annotation_id, min(s) AS group_id FROM reach GROUP BY r HAVING count(*) > 1"""


_U = "(CAST('0x' || substring(md5(concat_ws(':', component, '{0}', '42')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0"


def _scored(weights: dict[str, str]) -> str:
    """SQL of the best weighted rendezvous score over splits of positive weight."""
    scores = ", ".join(f"{{'score': CASE WHEN {w} > 0 THEN -CAST({w} AS DOUBLE) / ln({_U.format(n)}) ELSE -1.0 END, 'split': '{n}'}}" for n, w in sorted(weights.items()))
    return f"list_reverse_sort([{scores}])[1].split"


_ROOM = {"train": "a", "validation": "b", "test": "c"}
_PICK = "list_reverse_sort([" + ", ".join(f"{{'r': {_ROOM[n]} / CAST({w} AS DOUBLE), 'f': CAST(first = '{n}' AS INTEGER), 's': '{n}'}}" for n, w in SPLIT_WEIGHTS.items()) + "])[1].s"
_STEP = ", ".join(f"{c} - CASE WHEN {_PICK} = '{n}' THEN n ELSE 0 END" for n, c in _ROOM.items())
_SPLITS = (
    ORACLE["p1_found"].split("SELECT r AS annotation_id, min(s)")[0].rstrip()
    + f""",
own AS (SELECT DISTINCT annotation_id AS r FROM golden WHERE annotation_id IS NOT NULL), low AS (SELECT r, min(s) AS s FROM reach GROUP BY 1), cp AS (SELECT r, coalesce(s, r) AS component FROM own LEFT JOIN low USING (r)),
sz AS (SELECT component, count(*) AS n FROM cp GROUP BY 1), tot AS (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS total FROM sz),
big AS (SELECT row_number() OVER (ORDER BY n DESC, component) AS k, component, n, {_scored({n: str(w) for n, w in SPLIT_WEIGHTS.items()})} AS first FROM sz, tot WHERE n * 1000 > total),
st AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS VARCHAR) AS split, total * CAST(0.8 AS DOUBLE) AS a, total * CAST(0.1 AS DOUBLE) AS b, total * CAST(0.1 AS DOUBLE) AS c FROM tot
  UNION ALL SELECT big.k, big.component, {_PICK}, {_STEP} FROM st JOIN big ON big.k = st.k + 1),
fin AS (SELECT greatest(a, 0.0) AS a, greatest(b, 0.0) AS b, greatest(c, 0.0) AS c FROM st ORDER BY k DESC LIMIT 1),
sp AS (SELECT r AS annotation_id, component, split FROM cp JOIN st USING (component) UNION ALL SELECT r, component, {_scored(_ROOM)} FROM cp, fin WHERE component NOT IN (SELECT component FROM big))"""
)
ORACLE["p1_splits"] = f"{_SPLITS} SELECT annotation_id, split FROM sp"
ORACLE["p1_shares"] = f"{_SPLITS} SELECT split, count(*) AS annotations, count(DISTINCT component) AS components, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM sp GROUP BY 1"


# -- 3: overlap across splits --------------------------------------------------------


def _overlap(spark: SparkSession, sf_dir: str) -> O.CrossSplit:
    return O.CrossSplit(read(spark, sf_dir, "b02_fresh_labelled"), "annotation_id", "text_display", repeats=True)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).pairs().select(F.col("a").alias("annotation_id_a"), F.col("b").alias("annotation_id_b"))


@query
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and source."""
    return _overlap(spark, sf_dir).report()


# -- 2: personal information ---------------------------------------------------------

#: A key for tests and reports; production brings its own.
PII_KEY = b"skein-demo-key"


def _pii(spark: SparkSession, sf_dir: str, births: bool = False) -> DataFrame:
    a = read(spark, sf_dir, "b02_fresh_labelled").select(F.lit("text_display").alias("field"), F.col("annotation_id").alias("record_id"), F.col("text_display").alias("text"))
    b = read(spark, sf_dir, "evidence").select(F.lit("historical_brand_reply").alias("field"), F.concat("query_id", F.lit(":"), F.col("rank").cast("string")).alias("record_id"), F.col("historical_brand_reply").alias("text"))
    return P.with_pii(a.unionByName(b).where(F.col("record_id").isNotNull()), "text", PII_KEY, births)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(spark, sf_dir).select("field", "record_id", F.explode("kinds").alias("kind")).distinct()


@query
def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text columns with typed placeholders, dates of birth included."""
    return _pii(spark, sf_dir, births=True).select("field", "record_id", F.col("redacted").alias("text"))


# -- 7: leaked items -----------------------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.leaked_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@query
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, into how many documents, and how completely."""
    by = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("share"), 4).alias("largest_share"))
    return read(spark, sf_dir, "benchmark").select("item_id").join(by, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("largest_share", F.lit(0.0)).alias("largest_share"))


# -- 8: mixture ----------------------------------------------------------------------


#: Part of the sources' tokens that the mixture keeps at least, though its scarcest source then ends at its repeats.
LEAST_PART = 0.5


def _mixture(spark: SparkSession, sf_dir: str) -> M.Mixture:
    return M.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_targets"), least_part=LEAST_PART)


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source contributes to the mixture, against its target, and what limits it."""
    return _mixture(spark, sf_dir).report


@query
def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, raked and reached shares of sources, languages and topics."""
    return _mixture(spark, sf_dir).marginals.select("axis", "name", *(F.round(c, 6).alias(c) for c in ("wanted_share", "raked_share", "reached_share", "residual")))


@query
def p8_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's documents with their number of uses."""
    return _mixture(spark, sf_dir).sample.select("doc_id", "source", "tokens", "copies")


# -- 9: reading level ----------------------------------------------------------------


def _levels(spark: SparkSession, sf_dir: str, formula: bool) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    texts, rated = R.labelled_sample(docs, read(spark, sf_dir, "reading_labels"))
    return R.reading_levels(docs, R.train(texts, rated) if texts else None, formula)


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, False).where(F.col("english") & (F.col("n_words") >= R.LEAST_WORDS) & (F.col("level") >= R.COLLEGE)).select("doc_id")


@query
def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's difficulty; the formula's grade stands beside it for comparison."""
    return _levels(spark, sf_dir, True).select("doc_id", "n_words", "n_sentences", "english", F.round("level", 3).alias("level"), F.round("formula_grade", 2).alias("formula_grade"))
