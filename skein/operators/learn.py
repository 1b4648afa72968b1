"""Models on Spark ML: intent classifier, out-of-fold confidence, reduction, clusters.

Features are hashed, so no vocabulary is gathered; fits run on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as X
from skein.operators.ranks import ranked
from skein.session import Scratch

#: A vector as Parquet has it: type 0 is sparse, 1 dense.
VECTOR = T.StructType([T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
#: Entries from which a row's products are added by themselves; products added at a time; rows of the sum sent at a time; rows projected at a time.
LONG_ROW, PRODUCTS, STRIPE, PROJECTED = 256, 8_000_000, 64, 2_000


def features(df: DataFrame, tokens: str, buckets: int = 1 << 14) -> DataFrame:
    """df with features: hashed TF-IDF of unit length."""
    tf = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=buckets).transform(df)
    w = IDF(inputCol="_tf", outputCol="_w", minDocFreq=2).fit(tf).transform(tf)
    return Normalizer(inputCol="_w", outputCol="features").transform(w).drop("_tf", "_w")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with class_weight: rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total, kinds = (n.agg(F.sum("_n"), F.count("*")).first() or (0, 1))
    return df.join(F.broadcast(n), label).withColumn("class_weight", F.lit(float(total or 0)) / (F.lit(float(kinds or 1)) * F.col("_n"))).drop("_n")


def classifier(train: DataFrame, label: str, reg: float | None = None, steps: int = 100):
    """(model, labels): multinomial logistic regression with balanced classes; train needs features."""
    labels = [r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # one row per label
    index = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
    t = balanced(train.where(F.col(label).isNotNull()), label).withColumn("_y", index[F.col(label)])
    n = t.count()
    lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="class_weight", family="multinomial", standardization=False, elasticNetParam=0.0, regParam=reg or 1.0 / max(n, 1), maxIter=steps)
    return lr.fit(t), labels


def predicted(df: DataFrame, model, labels: list[str]) -> DataFrame:
    """df with predicted and confidence (largest probability)."""
    p = vector_to_array("probability")
    names = F.array(*map(F.lit, labels))
    out = model.transform(df)
    return out.withColumn("confidence", F.array_max(p)).withColumn("predicted", F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))).drop("rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, key: str, label: str, scratch: Scratch, folds: int = 5, seed: int = 42, steps: int = 100) -> DataFrame:
    """(key, label, predicted, confidence): every labelled row judged by a model that has not seen its fold.

    Folds are stratified: the rows of a label take turns in hash order of the key, so copies
    of a key should have been removed before. Rows without a label are judged by the model
    of all labelled rows.
    """
    d = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    known = scratch.cut(ranked(d.where(F.col(label).isNotNull()), [label], ["_h", key], "_place", scratch).withColumn("_fold", F.col("_place") % folds).drop("_place"), "folds")
    out = None
    for k in range(folds):
        model, labels = classifier(known.where(F.col("_fold") != k), label, steps=steps)
        part = predicted(known.where(F.col("_fold") == k), model, labels).select(key, label, "predicted", "confidence")
        out = part if out is None else out.unionByName(part)
    model, labels = classifier(known, label, steps=steps)
    return out.unionByName(predicted(d.where(F.col(label).isNull()), model, labels).select(key, label, "predicted", "confidence"))


def _flat(features: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries by row, places, values) of vectors as Parquet has them."""
    places = [np.arange(len(x["values"])) if x["type"] else np.asarray(x["indices"], np.int64) for x in features]
    n = np.array([len(x) for x in places], np.int64)
    return n, np.concatenate(places), np.concatenate([np.asarray(x["values"], float) for x in features])


def add_products(whole: np.ndarray, n: np.ndarray, at: np.ndarray, v: np.ndarray) -> None:
    """Add every row's products of entries (n entries by row, their places and values) to whole, places by places."""
    size, ends = len(whole), np.cumsum(n)
    for r in np.flatnonzero(n > LONG_ROW):
        i, x = at[ends[r] - n[r] : ends[r]], v[ends[r] - n[r] : ends[r]]
        whole[np.ix_(i, i)] += np.outer(x, x)
    short = np.where(n > LONG_ROW, 0, n)
    some = np.repeat(n <= LONG_ROW, n)
    at, v, done = at[some], v[some], np.cumsum(short * short)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PRODUCTS, "right")))
        k = short[a:b]
        first = int(short[:a].sum())
        one = np.arange(k.sum()) + first
        times = np.repeat(k, k)  # each entry meets all of its row
        left = np.repeat(one, times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(np.repeat(np.cumsum(k) - k, k) + first, times)
        whole += np.bincount(at[left] * size + at[right], v[left] * v[right], minlength=size * size).reshape(size, size)
        a = b


def gram(features: DataFrame, size: int) -> np.ndarray:
    """Sum over all rows of the products of features (as Parquet has vectors), size x size, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = None
        for b in batches:
            if len(b):
                whole = np.zeros((size, size)) if whole is None else whole
                add_products(whole, *_flat(b["features"]))
        whole = None if whole is None else np.tril(whole)
        for a in range(0, size if whole is not None else 0, STRIPE):
            yield pd.DataFrame({"i": [a], "v": [whole[a : a + STRIPE].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b["i"], b["v"], strict=True):
                sums[i] = sums[i] + np.frombuffer(v) if i in sums else np.frombuffer(v)
        for i, v in sums.items():
            yield pd.DataFrame({"i": [i], "v": [v.tobytes()]})

    parts = features.coalesce(max(2 * features.sparkSession.sparkContext.defaultParallelism, 1)).mapInPandas(run, "i int, v binary")
    out = np.zeros((size, size))
    for r in parts.repartition("i").mapInPandas(add, "i int, v binary").collect():  # size x size numbers, whatever the rows
        x = np.frombuffer(r["v"]).reshape(-1, size)
        out[r["i"] : r["i"] + len(x)] = x
    return out + np.tril(out, -1).T


def svd(df: DataFrame, key: str, k: int) -> tuple[DataFrame, list[float], float]:
    """((key, reduced), singular values, share of the sum of squares explained) of the rows' features, not centred.

    reduced has k entries, or as many as there are singular values above 0. One pass sums
    the products of the features, whose size is fixed; their eigenvectors are those of the rows. In each
    the entry furthest from 0 is positive.
    """
    scratch = Scratch(df.sparkSession, "svd")
    cut = scratch.cut(df.select(key, "features"), "features")
    # as Parquet has vectors: their entries reach Python without a call by row
    rows = df.sparkSession.read.schema(T.StructType([cut.schema[key], T.StructField("features", VECTOR)])).parquet(cut._skein_path)
    kind = cut.schema[key].dataType.simpleString()
    one = rows.select(F.coalesce("features.size", F.size("features.values")).alias("n")).first()
    products = gram(rows.select("features"), one["n"] if one else 1)
    values, v = np.linalg.eigh(products)
    values, v = values[::-1][:k], v[:, ::-1][:, :k]
    some = values > max(values[0], 0.0) * len(products) * np.finfo(float).eps
    values, v = values[some], v[:, some]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    sent = df.sparkSession.sparkContext.broadcast(v)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            for a in range(0, len(b), PROJECTED):
                x = b.iloc[a : a + PROJECTED]
                n, at, w = _flat(x["features"])
                out = np.zeros((len(x), m.shape[1]))
                if len(at):
                    out[n > 0] = np.add.reduceat(m[at] * w[:, None], (np.cumsum(n) - n)[n > 0], axis=0)
                yield pd.DataFrame({key: x[key], "reduced": list(out)})

    out = rows.mapInPandas(project, f"{key} {kind}, reduced array<double>")
    return out, [float(x) for x in np.sqrt(values)], float(values.sum() / (np.trace(products) or 1.0))


def kmeans_sweep(df: DataFrame, column: str, ks: list[int], starts: int = 10, seed: int = 42) -> DataFrame:
    """Of the best of several starts for every k: cost, silhouette, sizes, and how alike its two most similar centres are (cosine).

    column is an array of numbers; a k of no fewer than the rows is left out.
    """
    d = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("features")).cache()
    n = d.count()
    rows = []
    for k in (k for k in ks if k < n):
        best = min((KMeans(k=k, seed=seed + s, maxIter=20).fit(d) for s in range(starts)), key=lambda m: m.summary.trainingCost)
        sizes = np.array(best.summary.clusterSizes) / n
        c = np.array(best.clusterCenters())
        unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        alike = unit @ unit.T
        np.fill_diagonal(alike, 0.0)
        rows.append((k, float(best.summary.trainingCost), float(ClusteringEvaluator().evaluate(best.transform(d))), float(sizes.max()), float(sizes.min()), int((sizes < 0.01).sum()), float(alike.max())))
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double, largest_share double, smallest_share double, under_one_percent int, closest_centres double")


def distinctive_terms(weights: DataFrame, clusters: DataFrame, top: int = 15) -> DataFrame:
    """(cluster, term, lift, rank): mean weight inside less mean weight outside, absent terms as 0.

    weights: doc, term, weight; clusters: doc, cluster, one row per doc.
    """
    from pyspark.sql import Window as W

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n_in"))
    total = clusters.agg(F.count("*").alias("n")).first()[0]
    per = weights.join(clusters, "doc").groupBy("cluster", "term").agg(F.sum("weight").alias("inside"))
    whole = per.groupBy("term").agg(F.sum("inside").alias("everywhere"))
    lift = F.col("inside") / F.col("n_in") - F.coalesce(F.try_divide(F.col("everywhere") - F.col("inside"), F.lit(total) - F.col("n_in")), F.lit(0.0))
    x = per.join(whole, "term").join(F.broadcast(sizes), "cluster").select("cluster", "term", F.round(lift, 9).alias("lift"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("lift"), "term"))).where(F.col("rank") <= top)


def cohesion(entries: DataFrame, item: str, cluster: str) -> DataFrame:
    """(cluster, n, cohesion, nearest, nearest_distance) of vectors as entries (item, cluster, i, v): a row per entry.

    Centres are one row per cluster and place, whatever the number of items.
    """
    m = entries.groupBy(cluster, "i").agg(F.avg("v").alias("c"))
    d = entries.join(m, [cluster, "i"]).groupBy(cluster, item).agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))).alias("d"))
    size = d.groupBy(cluster).agg(F.count("*").alias("n"), F.round(F.avg(1 / (1 + F.col("d"))), 6).alias("cohesion"))
    other = m.select(F.col(cluster).alias("nearest"), "i", F.col("c").alias("o"))
    far = m.join(other, "i").where(F.col(cluster) != F.col("nearest")).groupBy(cluster, "nearest").agg(F.round(F.sqrt(F.sum(F.pow(F.col("c") - F.col("o"), 2))), 6).alias("far"))
    near = far.groupBy(cluster).agg(F.min(F.struct("far", "nearest")).alias("x")).select(cluster, F.col("x.nearest").alias("nearest"), F.col("x.far").alias("nearest_distance"))
    return size.join(near, cluster, "left")


def text_checks(df: DataFrame, cluster: str, text: str) -> DataFrame:
    """By cluster: size, share, links, capitals; whether links or length drive it, and whether it is under 1 % or over a quarter of all."""
    link, n = F.col(text).rlike(X.URL_PREFIX).cast("double"), F.length(text)
    whole = df.agg(F.count("*").alias("all"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("sd"), F.avg(link).alias("urls"))
    g = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(link).alias("u"), F.avg(X.caps_ratio(F.col(text))).alias("caps"), F.avg(n).alias("len"))
    x = g.select("*", *(whole.select(c).scalar().alias(c) for c in whole.columns))
    share = F.col("n") / F.col("all")
    return x.select(
        cluster, "n", F.round(share, 6).alias("share"), F.round("u", 6).alias("url_share"), F.round("caps", 6).alias("caps_ratio"), ((F.col("u") > 0.6) & (F.col("urls") < 0.3)).alias("url_driven"),
        (F.abs(F.col("len") - F.col("mean")) > 2 * F.col("sd")).alias("format_driven"), (share < 0.01).alias("under_one_percent"), (share > 0.25).alias("over_quarter"),
    )
