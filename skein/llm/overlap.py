"""Same or near-same records across splits.

A text is the set of its words; its fingerprint is cut into bit blocks, one per segment of
the word space, and texts that are alike in at least 4/5 of their words can differ in only
so many of them. Within that Hamming radius two texts agree in several whole blocks, so a
join on codes of combined blocks, across splits only, misses none (operators/blocks.py). A
128-bit fingerprint then drops what lies beyond the radius, and the words themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import text_key
from skein.llm.visual import look_key
from skein.operators import blocks as B
from skein.session import Scratch

THRESHOLD, MIN_WORDS = 0.8, 6
WORD = r"([\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}\p{M}]+)*)"
LINK_OR_HANDLE = r"(?:https?://|www\.)\S+|@\w+"
TRAIN, HELD_OUT = "train", ("validation", "test")


def words(c: Column) -> Column:
    """A text's words in order, as a reader sees them: without case, links and handles."""
    t = F.regexp_replace(F.lower(look_key(c)), LINK_OR_HANDLE, " ")
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(1))


def text_classes(rows: DataFrame, text: str, split: Column, scratch: Scratch, min_words: int = MIN_WORDS, repeats: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with class_id, one row per class of equal word sets): class_id is null for texts too short to compare."""
    listed = rows.withColumn("_all", words(F.col(text).cast("string"))).withColumn("_words", F.sort_array(F.array_distinct("_all")))
    marked = scratch.cut(listed.withColumn("class_id", F.when(F.size("_all" if repeats else "_words") >= min_words, F.md5(F.array_join("_words", " ")))).withColumn("_split", split).drop("_all"), "marked")
    classes = marked.where(F.col("class_id").isNotNull()).groupBy("class_id").agg(F.first("_words").alias("words"), F.max(F.col("_split") == TRAIN).alias("trains"), F.max(F.col("_split").isin(*HELD_OUT)).alias("tests"))
    return marked.drop("_words"), scratch.cut(classes, "classes")


def alike_classes(classes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): class a occurs in training, b in held-out data, their words are alike; a = b where one class is in both."""
    known = lambda c: F.coalesce(c, F.lit(False))
    fit = classes.where(known("trains") | known("tests"))
    hashed = fit.select("class_id", F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"), known("trains").alias("trains"), known("tests").alias("tests"))
    sides = scratch.cut(B.coded(hashed, threshold, ("trains", "tests")), "codes")
    pairs = B.side(sides.where("trains"), "a").join(B.side(sides.where("tests"), "b"), "code").where((F.col("a") != F.col("b")) & B.within_radius("a", "b", threshold))
    pairs = scratch.cut(pairs.select("a", "b").distinct(), "candidates")
    wa, wb = classes.select(F.col("class_id").alias("a"), F.col("words").alias("wa")), classes.select(F.col("class_id").alias("b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    checked = pairs.join(wa, "a").join(wb, "b").select("a", "b", (both / (F.size("wa") + F.size("wb") - both)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    same = sides.where(F.col("trains") & F.col("tests")).select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("similarity"))
    return checked.unionByName(same)


class CrossSplit:
    """Overlaps between training and held-out rows of one table.

    Rows join by conversation (see text_key) or by text: at least min_words distinct words
    on both sides (all words with repeats), alike by `threshold` or more. Null texts and conversations join nothing,
    rows of no or another split take no part, and rows without a key are ignored. If a key
    has rows in both kinds of splits, it is not paired with itself.
    """

    def __init__(self, rows: DataFrame, key: str, text: str, split: str = "split", conversation: str = "conversation_id", source: str | None = "source", threshold: float = THRESHOLD, min_words: int = MIN_WORDS, repeats: bool = False):
        self.scratch = Scratch(rows.sparkSession, "overlap")
        r = rows.select(F.col(key).alias("key"), text_key(F.col(conversation)).alias("conv"), text_key(F.col(split)).alias("sp"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"), F.col(text).alias("text"))
        r = r.where(F.col("key").isNotNull() & F.col("sp").isin(TRAIN, *HELD_OUT))
        self.rows, classes = text_classes(r, "text", F.col("sp"), self.scratch, min_words, repeats)
        self.rows = self.rows.select("key", "conv", "sp", "source", "class_id").distinct()
        self.links = self.scratch.cut(alike_classes(classes, self.scratch, threshold), "links")

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        train, held = self.rows.where(F.col("sp") == TRAIN), self.rows.where(F.col("sp") != TRAIN)
        return train.select(F.col("key").alias("ka"), F.col("conv").alias("conv"), F.col("class_id").alias("a")), held.select(F.col("key").alias("kb"), F.col("conv").alias("conv"), F.col("class_id").alias("b"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b: one in training, the other held out, of the same conversation or alike."""
        train, held = self._sides()
        by_conv = train.where(F.col("conv").isNotNull()).select("ka", "conv").join(held.select("kb", "conv"), "conv").select("ka", "kb")
        by_text = train.select("ka", "a").join(self.links.select("a", "b"), "a").join(held.select("kb", "b"), "b").select("ka", "kb")
        both = by_conv.unionByName(by_text).where(F.col("ka") != F.col("kb"))
        return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()

    def leaked(self) -> DataFrame:
        """Held-out rows (key, sp, source) with the ways they overlap training; pairs are never expanded."""
        train, _ = self._sides()
        held = self.rows.where(F.col("sp") != TRAIN)
        convs = train.where(F.col("conv").isNotNull()).select("conv").distinct().withColumn("same_conversation", F.lit(True))
        texts = self.links.groupBy(F.col("b").alias("class_id")).agg(F.max("similarity").alias("similarity"))
        out = held.join(convs, "conv", "left").join(texts, "class_id", "left")
        return out.select("key", "sp", "source", F.coalesce("same_conversation", F.lit(False)).alias("same_conversation"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))

    def report(self) -> DataFrame:
        """Held-out keys by split and source, and how many overlap training and how."""
        k = self.leaked().groupBy("sp", "source", "key").agg(F.max("same_conversation").alias("c"), F.max("similarity").alias("s"))
        return k.groupBy(F.col("sp").alias("split"), "source").agg(
            F.count("*").alias("records"),
            F.count_if(F.col("c") | (F.col("s") > 0)).alias("overlapping"),
            F.count_if(F.col("c")).alias("same_conversation"),
            F.count_if(F.col("s") == 1).alias("same_words"),
            F.count_if((F.col("s") > 0) & (F.col("s") < 1)).alias("near_same_words"),
        )
