"""Labels: rule-based weak labels, typo repair, checks and tables of annotated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the bundled queries, label by label; every pattern counts once. Case is ignored.
RULES: dict[str, list[str]] = {
    "baggage": [r"bag tag", r"suitcase|backpack|luggage|duffel", r"baggage claim", r"never showed up"],
    "boarding_and_gate": [r"boarding group", r"gate [a-e][0-9]+", r"jet bridge"],
    "booking_fees_and_fare_rules": [r"change fee", r"fare jumped", r"the fee was", r"booking"],
    "flight_cancellation_rebooking": [r"rebooked", r"cancel", r"standby"],
    "flight_delay": [r"has sat at", r"hours late", r"on time", r"delay"],
    "loyalty_and_lounge": [r"lounge", r"miles from", r"loyalty"],
    "praise_and_compliment": [r"thanks to", r"kudos", r"saved the"],
    "seating_and_upgrade": [r"seat [0-9]+[a-f]", r"upgrade", r"sit together", r"first class"],
    "staff_and_service_complaint": [r"hung up", r"just shrugged", r"double billed", r"ignored my"],
}
#: Spelling repair of the bundled label columns.
TYPOS = {"bagage": "baggage", "med": "medium", "hgh": "high"}


def scores(text: Column, rules: dict[str, list[str]]) -> Column:
    """Array of (n, label) for every label with a matching pattern, by label; one projection, no join."""
    t = F.coalesce(text, F.lit(""))
    each = [F.struct(sum((t.rlike(f"(?i){p}").cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(name).alias("label")) for name, ps in sorted(rules.items())]
    return F.filter(F.array(*each), lambda x: x["n"] > 0)


def weak_label(df: DataFrame, text: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """df with weak_label (the label with most patterns; null for none or a tie) and n_matched (labels with any)."""
    s = F.col("_s")
    top = F.array_max(F.transform(s, lambda x: x["n"]))
    best = F.filter(s, lambda x: x["n"] == top)
    return df.withColumn("_s", scores(F.col(text), rules or RULES)).withColumn("weak_label", F.when(F.size(best) == 1, best[0]["label"])).withColumn("n_matched", F.size("_s")).drop("_s")


def clean(c: Column, typos: dict[str, str] | None = None) -> Column:
    """Trimmed, lower case, spaces as underscores, known typos repaired; blank is null."""
    t = F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("_")))
    for wrong, right in (typos or TYPOS).items():
        t = F.when(t == wrong, F.lit(right)).otherwise(t)
    return F.when(t != "", t)


def change_log(df: DataFrame, key: str, columns: list[str], typos: dict[str, str] | None = None) -> DataFrame:
    """(key, column_name, before, after) for every known value that cleaning changes."""
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("before"), clean(F.col(c), typos).alias("after")) for c in columns)))
    return df.select(key, x.alias("x")).select(key, "x.*").where(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))


def label_table(df: DataFrame, label: str, confidence: str, flag: str) -> DataFrame:
    """By label: rows, confidence levels and flagged rows."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), n(F.col(confidence) == "high").alias("high"), n(F.col(confidence) == "medium").alias("medium"), n(F.col(confidence) == "low").alias("low"), n(F.col(flag)).alias("flagged"))


def label_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs of different labels given to one row."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return x.groupBy(F.least(a, b).alias("first_label"), F.greatest(a, b).alias("second_label")).agg(F.count("*").alias("n"))


def patterns(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(pattern, n): which of the conditions hold together, joined by +; the empty pattern is none."""
    p = F.concat_ws("+", *(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()))
    return df.groupBy(p.alias("pattern")).agg(F.count("*").alias("n"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, n): rows that break each rule, in one pass; a rule that is null holds for nobody."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check_name"), F.col(name).alias("n")) for name in checks))).alias("x")).select("x.*")


def rating_violations(ratings: DataFrame, items: DataFrame, key: list[str], item: str, score: str, rater: str, text: str, low: int = 1, high: int = 5, forbidden: str = r"(?i)tfidf|random|llm", ids: str = r"@[0-9]+") -> DataFrame:
    """(check_name, n): ratings without a score, outside the scale, of unknown items, repeated by key, of raters that name a system, and rated texts that show an id."""
    r = ratings.join(items.select(F.col(item).alias("_i")).distinct(), F.col(item) == F.col("_i"), "left")
    c = r.agg(
        F.count_if(F.col(score).isNull()).alias("score_present"),
        F.count_if(~F.col(score).between(low, high)).alias("score_in_range"),
        F.count_if(F.col("_i").isNull() & F.col(item).isNotNull()).alias("item_known"),
        F.count_if(F.col(rater).rlike(forbidden)).alias("no_system_named"),
    )
    out = c.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n")) for n in c.columns))).alias("x")).select("x.*")
    many = ratings.groupBy(*key).agg(F.count("*").alias("k")).where(F.col("k") > 1)
    shown = items.where(F.col(text).rlike(ids)).join(ratings.select(item).distinct(), item, "left_semi")
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    return out.unionByName(one("rated_once", many)).unionByName(one("no_id_shown", shown))
