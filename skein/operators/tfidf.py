"""TF-IDF vectors and cosine search over them.

A vector is one row: doc, terms (sorted) and weights, two arrays of equal length and the
size of the document. Searches take a stated set of queries in blocks of bounded size; a
block goes to every task as postings, and one pass over the documents keeps the k best of
each query per task. No pair of a query and a document is ever shuffled, so a term that
most documents hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.ranks import running_sum
from skein.operators.skew import lookup
from skein.session import Scratch, ship

#: Terms in a block of queries: what every task is sent (about 100 bytes each).
BLOCK_TERMS = 400_000
#: Cells of a task's table of similarities, and postings read at a time.
CELLS, POSTINGS = 4_000_000, 8_000_000


def vocabulary(counts: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None = None) -> DataFrame:
    """(term, df, idf) of terms in at least min_df documents and at most the share max_df; of more than
    max_features those of the highest total frequency. idf is ln((1 + n) / (1 + df)) + 1."""
    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features:
        v = v.orderBy(F.desc("total"), "term").limit(max_features)
    return v.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc, term, tf) of docs (doc, tokens); a repeated doc counts as one."""
    return docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def vectors(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, terms, weights): (1 + ln tf) idf, scaled to length 1 per document; unknown terms drop out. counts is a written table."""
    w = lookup(counts, "term", vocab.select("term", "idf"), "inner").select("doc", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    g = w.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return g.select("doc", F.col("t.term").alias("terms"), F.transform("t", lambda x: x["w"] / F.col("norm")).alias("weights"))


def long_form(vecs: DataFrame) -> DataFrame:
    """(doc, term, weight), a row per term."""
    return vecs.select("doc", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("doc", F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"))


def fit(docs: DataFrame, scratch: Scratch, min_df: int = 2, max_df: float = 0.6, max_features: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) of docs (doc, tokens); all terms count unless max_features is given."""
    counts = scratch.cut(term_counts(docs), "counts")
    n = docs.select("doc").distinct().count()
    vocab = scratch.cut(vocabulary(counts, n, min_df, max_df, max_features), "vocabulary")
    return scratch.cut(vectors(counts, vocab), "vectors"), vocab


class Postings:
    """A block of queries by term, and who may not be found for whom."""

    def __init__(self, rows: list):
        self.ids = np.array([r["doc"] for r in rows], np.int64)
        terms: dict[str, list[tuple[int, float]]] = {}
        self.conversations: dict[str, list[int]] = {}
        self.customers: dict[str, list[int]] = {}
        for q, r in enumerate(rows):
            for t, w in zip(r["terms"], r["weights"], strict=True):
                terms.setdefault(t, []).append((q, w))
            if r["conversation"] is not None:
                self.conversations.setdefault(r["conversation"], []).append(q)
            if r["customer"] is not None:
                self.customers.setdefault(r["customer"], []).append(q)
        self.at = {t: i for i, t in enumerate(terms)}
        self.lengths = np.array([len(x) for x in terms.values()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.query = np.array([q for x in terms.values() for q, _ in x], np.int64)
        self.weight = np.array([w for x in terms.values() for _, w in x])

    def similarities(self, docs: pd.DataFrame) -> np.ndarray:
        """(documents, queries), rounded to 6 places, 0 where a document may not be found."""
        nq = len(self.ids)
        flat = [self.at.get(t, -1) for ts in docs["terms"] for t in ts]
        row = np.repeat(np.arange(len(docs)), [len(ts) for ts in docs["terms"]])
        term, w = np.array(flat, np.int64), np.concatenate([np.asarray(x, float) for x in docs["weights"]]) if len(flat) else np.empty(0)
        row, w, term = row[term >= 0], w[term >= 0], term[term >= 0]
        out = np.zeros(len(docs) * nq)
        n = self.lengths[term]
        cuts = np.searchsorted(np.cumsum(n), np.arange(POSTINGS, n.sum() + POSTINGS, POSTINGS), side="left") + 1
        a = 0
        for b in [*cuts.tolist(), len(term)]:
            b = min(b, len(term))
            if b <= a:
                continue
            k = n[a:b]
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.starts[term[a:b]], k)
            out += np.bincount(np.repeat(row[a:b], k) * nq + self.query[place], np.repeat(w[a:b], k) * self.weight[place], minlength=len(out))
            a = b
        out = np.round(out.reshape(len(docs), nq), 6)
        for known, column in ((self.conversations, docs["conversation"]), (self.customers, docs["customer"])):
            for i, v in enumerate(column):
                if v is not None and (own := known.get(v)):
                    out[i, own] = 0.0
        return out


class Best:
    """The k best finds of every query so far; equal similarities go to the smaller conversation."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.zeros(queries)
        self.rows = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, object))

    def add(self, s: np.ndarray, docs: np.ndarray, conversations: np.ndarray) -> None:
        floor = self.least
        if len(s) > self.k:
            floor = np.maximum(floor, -np.partition(-s, self.k - 1, axis=0)[self.k - 1])
        i, q = np.nonzero((s > 0) & (s >= floor))
        if not len(i):
            return
        q, v, d, c = (np.concatenate(x) for x in zip(self.rows, (q, s[i, q], docs[i], conversations[i]), strict=True))
        order = np.lexsort((d, c.astype(str), -v, q))
        q, v, d, c = q[order], v[order], d[order], c[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.rows = q[keep], v[keep], d[keep], c[keep]
        last = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.least[q[last]] = v[last]


def nearest(queries: DataFrame, docs: DataFrame, k: int, scratch: Scratch, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query, rank, doc, conversation, similarity): the k most similar documents of every query.

    queries and docs: doc, terms, weights, conversation, customer. A query's own
    conversation and its customer's others are never found; a null customer excludes
    nobody. Similarities of 0 are left out, ties go to the smaller conversation.
    """
    ship(docs.sparkSession)
    q = scratch.cut(running_sum(queries.withColumn("_all", F.lit(0)), ["_all"], ["doc", "conversation"], F.size("terms").cast("bigint"), "_upto", scratch).withColumn("block", F.floor(F.col("_upto") / block_terms)).drop("_all", "_upto"), "queries")
    out = None
    for r in q.select("block").distinct().orderBy("block").collect():  # queries' terms / block_terms
        one = _against(q.where(F.col("block") == r["block"]), docs, k)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "query bigint, rank int, doc bigint, conversation string, similarity double")
    return top_k(out, k, "conversation").select("query", "rank", "doc", "conversation", "similarity")


def _against(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    block = Postings(queries.collect())  # one block
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        best = Best(len(p.ids), k)
        step = max(1, CELLS // max(len(p.ids), 1))
        for b in batches:
            for a in range(0, len(b), step):
                some = b.iloc[a : a + step]
                best.add(p.similarities(some), some["doc"].to_numpy(), some["conversation"].to_numpy())
        q, v, d, c = best.rows
        yield pd.DataFrame({"query": p.ids[q], "doc": d, "conversation": c, "similarity": v})

    return docs.select("doc", "conversation", "customer", "terms", "weights").mapInPandas(run, "query bigint, doc bigint, conversation string, similarity double")


def top_k(pairs: DataFrame, k: int, tie: str = "doc") -> DataFrame:
    """The k best of every query, rank from 1; similarities of 0 or less are left out."""
    w = W.partitionBy("query").orderBy(F.desc("similarity"), tie)
    return pairs.where(F.col("similarity") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
