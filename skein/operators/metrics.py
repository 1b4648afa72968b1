"""Evaluation statistics over rows of labels and ratings.

Everything starts from contingency counts, so the work after the first aggregation is
bounded by the number of labels. Undefined values (0/0) are null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import shuffle_partitions


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over rows where both are known."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def label_frame(spark: SparkSession, labels: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], "label string")


def per_label(df: DataFrame, truth: str, predicted: str, labels: list[str], group: list[str] | None = None) -> DataFrame:
    """(group..., label, support, precision, recall, f1) for every label of a fixed list; 0/0 is 0.

    Rows without truth take no part; rows without a prediction count against recall.
    """
    g = group or []
    known = df.where(F.col(truth).isNotNull())
    x = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth).eqNullSafe(F.col(predicted))).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit"))))
    n = known.select(*g, x.alias("x")).select(*g, "x.*").groupBy(*g, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("given"), F.sum("hit").alias("hit"))
    names = F.broadcast(label_frame(df.sparkSession, labels))
    if g:
        groups = known.select(*g).distinct()
        full = groups.withColumn("label", F.explode(F.array(*map(F.lit, labels)))).join(n, [*g, "label"], "left")
    else:
        full = names.join(n, "label", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return full.select(*g, "label", z("support").alias("support"), div(z("hit"), z("given")).alias("precision"), div(z("hit"), z("support")).alias("recall"), div(2 * z("hit"), z("given") + z("support")).alias("f1"))


def overall(df: DataFrame, truth: str, predicted: str, labels: list[str], group: list[str] | None = None) -> DataFrame:
    """(group..., n, accuracy, macro_f1, weighted_f1); the macro mean is over all listed labels."""
    g = group or []
    known = df.where(F.col(truth).isNotNull())
    acc = known.groupBy(*g).agg(F.count("*").alias("n"), F.avg(F.col(truth).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy")) if g else known.agg(F.count("*").alias("n"), F.avg(F.col(truth).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy"))
    f = per_label(df, truth, predicted, labels, group)
    agg = [F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")]
    if g:
        return acc.join(f.groupBy(*g).agg(*agg), g)
    one = f.agg(*agg)
    return acc.select("*", one.select("macro_f1").scalar().alias("macro_f1"), one.select("weighted_f1").scalar().alias("weighted_f1"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n), pairs that occur."""
    return contingency(df, truth, predicted).select(F.col("a").alias("truth"), F.col("b").alias("predicted"), "n")


def kappa(df: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """(n, agreement, kappa): Cohen's kappa, or with quadratic weights for numeric labels; null if undefined."""
    c = contingency(df, a, b)
    total = c.agg(F.sum("n")).first()[0]  # one number
    if not total:
        return df.sparkSession.createDataFrame([(0, None, None)], "n bigint, agreement double, kappa double")
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    miss = (lambda x, y: F.pow(x - y, 2)) if weighted else (lambda x, y: (x != y).cast("double"))
    # expected disagreement from the margins, cell by cell: at most labels x labels rows
    seen = c.agg(F.sum(F.col("n") * miss(F.col("a"), F.col("b"))).alias("seen"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    margins_a = ra.agg(F.collect_list(F.struct("a", "na")).alias("la"))
    margins_b = rb.agg(F.collect_list(F.struct("b", "nb")).alias("lb"))
    x = seen.select("*", margins_a.scalar().alias("la"), margins_b.scalar().alias("lb"))
    expected = F.aggregate("la", F.lit(0.0), lambda acc, p: acc + F.aggregate("lb", F.lit(0.0), lambda acc2, q: acc2 + p["na"] * q["nb"] * miss(p["a"], q["b"])))
    return x.select(F.lit(int(total)).cast("bigint").alias("n"), (F.col("same") / total).alias("agreement"), (1 - F.try_divide(F.col("seen") * float(total), expected)).alias("kappa"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari) of two partitions; null where it is undefined."""
    c = contingency(df, a, b)
    pairs = lambda x: x * (x - 1) / 2.0
    s = c.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    sa = c.groupBy("a").agg(F.sum("n").alias("k")).agg(F.sum(pairs(F.col("k"))).alias("v"))
    sb = c.groupBy("b").agg(F.sum("n").alias("k")).agg(F.sum(pairs(F.col("k"))).alias("v"))
    x = s.select("*", sa.scalar().alias("sa"), sb.scalar().alias("sb"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), pairs(F.col("n")))
    return x.select("n", F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2.0 - expected).alias("ari"))


#: 65,536 times the cumulative probabilities of the Poisson distribution with mean 1.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)
RESAMPLES = 2_000


def resampled(df: DataFrame, key: str, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """df with resample and w: how often a row counts in each resample, rows of weight 0 left out.

    Weights are independent Poisson draws with mean 1, read off a hash of key, resample and
    seed, eight to a hash. They are made where the rows are and summed there first, so that
    a resample costs no shuffle of rows; rows of one key move together.
    """
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), "_b", F.lit(str(seed))))
    spread = df.where(F.col(key).isNotNull()).repartition(shuffle_partitions(df.sparkSession), key)  # each row becomes many
    rows = spread.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // 8)))).withColumn("_h", h)
    draws = F.array(*(F.struct((F.col("_b") * 8 + i).alias("resample"), F.conv(F.substring("_h", 1 + 4 * i, 4), 16, 10).cast("int").alias("u")) for i in range(8)))
    x = rows.withColumn("_d", F.explode(draws)).select(*df.columns, "_d.resample", sum((F.col("_d.u") >= c).cast("int") for c in POISSON).alias("w"))
    return x.where((F.col("w") > 0) & (F.col("resample") < resamples))


def bootstrap_means(df: DataFrame, key: str, values: list[str], resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(name, n, mean, low, high): the mean of each column and its percentile interval over resampled rows; nulls are skipped."""
    x = resampled(df.select(key, *values), key, resamples, seed).groupBy("resample").agg(*(F.try_divide(F.sum(F.col(v) * F.col("w")), F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v) for v in values))
    out = x.agg(*(F.struct(F.percentile(v, 0.025).alias("low"), F.percentile(v, 0.975).alias("high")).alias(v) for v in values))
    whole = df.where(F.col(key).isNotNull()).agg(*(F.struct(F.count(v).alias("n"), F.avg(v).alias("mean")).alias(f"{v}_all") for v in values))
    names = F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(f"{v}_all.n").alias("n"), F.col(f"{v}_all.mean").alias("mean"), F.col(f"{v}.low").alias("low"), F.col(f"{v}.high").alias("high")) for v in values)))
    return out.select("*", *(whole.select(f"{v}_all").scalar().alias(f"{v}_all") for v in values)).select(names.alias("x")).select("x.*")


def bootstrap_mean(df: DataFrame, key: str, value: Column, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(n, mean, low, high): mean of a value and its percentile interval over resampled rows; an empty table has n 0 and nulls."""
    return bootstrap_means(df.select(F.col(key).alias("k"), value.cast("double").alias("v")), "k", ["v"], resamples, seed).select("n", "mean", "low", "high")


def ordinal(df: DataFrame, group: str, value: str, low: int = 2, high: int = 4, levels: int = 5) -> DataFrame:
    """By group: n, mean, median, counts of the levels 1 ... , shares at or below low and at or above high; null values are skipped."""
    x = df.where(F.col(value).isNotNull())
    hist = [F.count_if(F.col(value) == k).alias(f"n{k}") for k in range(1, levels + 1)]
    return x.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.percentile(value, 0.5).alias("median"), *hist, F.round(F.count_if(F.col(value) <= low) / F.count("*"), 6).alias("share_low"), F.round(F.count_if(F.col(value) >= high) / F.count("*"), 6).alias("share_high"))


def flag_by_low(df: DataFrame, system: str, flag: str, value: str, low: int = 2) -> DataFrame:
    """By system the 2 x 2 counts of a flag against a low score, the share flagged, and the share of low scores with and without the flag."""
    x = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(system, F.col(flag).alias("f"), (F.col(value) <= low).alias("l"))
    n = lambda c: F.count_if(c)
    f, bad = F.col("f"), F.col("l")
    return x.groupBy(system).agg(
        n(f & bad).alias("flagged_low"), n(f & ~bad).alias("flagged_other"), n(~f & bad).alias("unflagged_low"), n(~f & ~bad).alias("unflagged_other"),
        F.round(F.try_divide(n(f), F.count("*")), 6).alias("share_flagged"), F.round(F.try_divide(n(f & bad), n(f)), 6).alias("low_if_flagged"), F.round(F.try_divide(n(~f & bad), n(~f)), 6).alias("low_if_unflagged"),
    )


def breakdown(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """By every column of `by` and each of its values: (dimension, level, n, mean); null levels are named <none>."""
    d = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("<none>")).alias("level")) for c in by)))
    return df.where(F.col(value).isNotNull()).select(d.alias("d"), value).groupBy("d.dimension", "d.level").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def kappa_by(df: DataFrame, group: str, a: str, b: str, pooled: str = "<all>") -> DataFrame:
    """(group, n, exact, within_one, kappa) for every group and over all rows together; kappa is null where it is undefined."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = known.select(F.explode(F.array(F.col(group).cast("string"), F.lit(pooled))).alias("g"), F.col(a).alias("a"), F.col(b).alias("b"))
    c = x.groupBy("g", "a", "b").agg(F.count("*").alias("n"))  # groups x labels x labels rows
    seen = c.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, F.col("n")).otherwise(0)).alias("near"))
    ra, rb = c.groupBy("g", F.col("a").alias("label")).agg(F.sum("n").alias("na")), c.groupBy("g", F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    e = ra.join(rb, ["g", "label"]).groupBy("g").agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    return seen.join(e, "g", "left").select(F.col("g").alias(group), "n", F.round(po, 9).alias("exact"), F.round(F.col("near") / F.col("n"), 9).alias("within_one"), F.round(F.try_divide(po - pe, 1 - pe), 9).alias("kappa"))


def paired(df: DataFrame, item: str, system: str, value: str, a: str, b: str) -> DataFrame:
    """System a against b on shared items: wins, ties, losses, mean difference, items with one side only.

    Several values of a system on an item are averaged.
    """
    x = df.where(F.col(system).isin(a, b) & F.col(item).isNotNull()).groupBy(item).agg(F.avg(F.when(F.col(system) == a, F.col(value))).alias("va"), F.avg(F.when(F.col(system) == b, F.col(value))).alias("vb"))
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    d = F.when(both, F.col("va") - F.col("vb"))
    return x.agg(F.count_if(both).alias("paired"), F.count_if(F.coalesce(d > 0, F.lit(False))).alias("wins"), F.count_if(F.coalesce(d == 0, F.lit(False))).alias("ties"), F.count_if(F.coalesce(d < 0, F.lit(False))).alias("losses"), F.round(F.avg(d), 6).alias("mean_difference"), F.count_if(~both).alias("unpaired"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label (smallest on ties) and its count."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)


def resampled_counts(df: DataFrame, key: str, a: str, b: str, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(resample, a, b, n): contingency counts of resampled rows; rows without key or label take no part."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b"))
    return resampled(rows, "k", resamples, seed).groupBy("resample", "a", "b").agg(F.sum("w").alias("n"))


def interval(df: DataFrame, value: str) -> DataFrame:
    """(resamples, low, high): the middle 95 % of a statistic; undefined resamples are left out."""
    return df.where(F.col(value).isNotNull()).agg(F.count("*").alias("resamples"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def resampled_macro_f1(counts: DataFrame, labels: list[str]) -> DataFrame:
    """(resample, value): macro F1 over a fixed list of labels."""
    x = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("both"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("b").alias("label"), F.col("n").alias("both"), F.lit(0).cast("bigint").alias("hit"))))
    per = counts.select("resample", x.alias("x")).select("resample", "x.*").where(F.col("label").isin(labels)).groupBy("resample", "label").agg((2 * F.sum("hit") / F.sum("both")).alias("f1"))
    return per.groupBy("resample").agg((F.sum("f1") / len(labels)).alias("value"))


def resampled_kappa(counts: DataFrame) -> DataFrame:
    """(resample, value): Cohen's kappa, null where it is undefined."""
    ra, rb = counts.groupBy("resample", "a").agg(F.sum("n").alias("na")), counts.groupBy("resample", "b").agg(F.sum("n").alias("nb"))
    pe = ra.join(rb, (ra.resample == rb.resample) & (ra.a == rb.b)).groupBy(ra.resample).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    po = counts.groupBy("resample").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("s"))
    p, e = F.col("s") / F.col("t"), F.coalesce("e", F.lit(0)) / (F.col("t") * F.col("t"))
    return po.join(pe, "resample", "left").select("resample", F.try_divide(p - e, 1 - e).alias("value"))
