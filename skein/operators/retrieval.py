"""Search over past exchanges, and measures of what is found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.ranks import ranked
from skein.operators.tfidf import nearest, top_k
from skein.session import Scratch


def search(queries: DataFrame, index: DataFrame, meta: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """(query, rank, doc, conversation, similarity): the k most similar eligible documents of each query.

    queries: doc; index: vectors (see tfidf.py); meta: doc, conversation, customer.
    """
    docs = scratch.cut(index.join(meta.select("doc", "conversation", "customer"), "doc"), "documents")
    return nearest(docs.join(queries.select("doc").distinct(), "doc", "left_semi"), docs, k, scratch)


#: Queries that are compared at a time: what every task is sent. Cells of a task's table of similarities.
QUERY_BLOCK, CELLS = 20_000, 4_000_000


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, rank, doc, similarity) by cosine over arrays of floats, without the query's own doc.

    queries and vectors: doc, vec. Queries are a stated set that meets all vectors, in blocks
    of a fixed size; a task keeps the k best of each query, so no pair is written.
    """
    scratch = Scratch(queries.sparkSession, "dense")
    q = scratch.cut(ranked(queries.select("doc", "vec").where(F.col("vec").isNotNull()).withColumn("_all", F.lit(0)), ["_all"], ["doc"], "n", scratch).select("doc", "vec", F.floor((F.col("n") - 1) / block).alias("block")), "queries")
    blocks = q.agg(F.max("block")).first()[0]
    out = None
    for i in range(blocks + 1 if blocks is not None else 0):
        one = _against(q.where(F.col("block") == i), vectors, k)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query bigint, rank int, doc bigint, similarity double")
    return top_k(out, k).select("query", "rank", "doc", "similarity")


def _against(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Candidates (query, doc, similarity) of one block of queries: the k best per task."""
    rows = queries.select("doc", "vec").orderBy("doc").collect()  # a block
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), unit(np.stack([np.asarray(r[1], float) for r in rows]))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = sent.value
        best_s, best_d = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        step = max(1, CELLS // len(ids))
        for b in batches:
            for a in range(0, len(b), step):
                some = b.iloc[a : a + step]
                docs = some["doc"].to_numpy()
                s = np.round(m @ unit(np.stack([np.asarray(v, float) for v in some["vec"]])).T, 6)
                s[ids[:, None] == docs[None, :]] = -2.0
                s = np.concatenate([best_s, s], axis=1)
                d = np.concatenate([best_d, np.broadcast_to(docs, (len(ids), len(docs)))], axis=1)
                if s.shape[1] > k:  # drop what is surely worse, then order what is left with its ties
                    s = np.where(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k], s, -3.0)
                order = np.lexsort((d, -s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
        good = best_s > 0
        yield pd.DataFrame({"query": np.repeat(ids, best_s.shape[1])[good.ravel()], "doc": best_d[good], "similarity": best_s[good]})

    return vectors.select("doc", "vec").where(F.col("vec").isNotNull()).mapInPandas(run, "query bigint, doc bigint, similarity double")


def summary(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """Availability, best similarity, label coverage, agreement with the query's label.

    evidence: query_id, rank, similarity, label, n_turns; queries: query_id, label (every query once).
    """
    per = evidence.join(queries.select("query_id", F.col("label").alias("want")), "query_id").groupBy("query_id").agg(
        F.count("*").alias("items"),
        F.max("similarity").alias("best"),
        F.count("label").alias("labelled"),
        F.count_if(F.col("label") == F.col("want")).alias("matching"),
        F.count_if(F.col("n_turns") == 2).alias("two_turn"),
    )
    x = queries.select("query_id").join(per, "query_id", "left")
    got = F.col("items").isNotNull()
    return x.agg(
        F.count("*").alias("queries"),
        F.count_if(got).alias("available"),
        F.round(F.avg("best"), 6).alias("mean_best"),
        F.round(F.percentile("best", 0.5), 6).alias("median_best"),
        F.round(F.try_divide(F.sum("labelled"), F.sum("items")), 6).alias("label_coverage"),
        F.round(F.try_divide(F.sum("matching"), F.sum("labelled")), 6).alias("consistency"),
        F.round(F.count_if(F.col("matching") > 0) / F.count("*"), 6).alias("any_match"),
        F.round(F.try_divide(F.sum("two_turn"), F.sum("items")), 6).alias("two_turn_share"),
    )


def distribution(df: DataFrame, value: str) -> DataFrame:
    """n, least, median, mean, most of the known values."""
    c = F.col(value)
    return df.agg(F.count(c).alias("n"), F.min(c).alias("least"), F.percentile(c, 0.5).alias("median"), F.round(F.avg(c), 9).alias("mean"), F.max(c).alias("most"))


def random_items(queries: DataFrame, pool: DataFrame, k: int, seed: int, probes: int = 8) -> DataFrame:
    """(query, rank, item): k pool items per query, drawn by hash without replacement.

    Every query draws k * probes places of the pool's hash order and keeps the first k that
    are not its own group's; the pool is never paired with all queries. Queries that are
    still short draw on, twice as many each time, until they have k items or all that are
    eligible. queries: query, grp; pool: pos (0 .. n - 1, unique), item (unique), grp.
    """
    n = pool.count()
    if n == 0:
        return queries.sparkSession.createDataFrame([], "query string, rank int, item string")
    scratch = Scratch(queries.sparkSession, "draws")
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "query", "j", F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint"), F.lit(n))
    own = pool.groupBy(F.col("grp").alias("q_grp")).agg(F.count("*").alias("own"))
    short = queries.select("query", F.col("grp").alias("q_grp")).join(own, "q_grp", "left")
    short = scratch.cut(short.select("query", "q_grp", F.least(F.lit(k), F.lit(n) - F.coalesce("own", F.lit(0))).alias("need")), "queries")
    start, end, hit = 0, k * probes, None
    while True:
        d = short.select("query", "q_grp", F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("j")).select("query", "q_grp", "j", place.alias("pos"))
        new = d.join(pool, "pos").where(~F.coalesce(F.col("grp") == F.col("q_grp"), F.lit(False))).select("query", "item", "j")
        hit = scratch.cut((new if hit is None else hit.unionByName(new)).groupBy("query", "item").agg(F.min("j").alias("j")), "hits")
        found = hit.groupBy("query").agg(F.count("*").alias("found"))
        short = scratch.cut(short.join(found, "query", "left").where(F.coalesce("found", F.lit(0)) < F.col("need")).drop("found"), "short")
        if not short.limit(1).count():
            break
        start, end = end, 2 * end
    return hit.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("j", "item"))).where(F.col("rank") <= k).select("query", "rank", "item")
