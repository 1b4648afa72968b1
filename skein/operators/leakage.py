"""Keeping held-out records out of a corpus, layer by layer.

Layers are ordered: conversation, customer, exact normalised text, near-duplicate text.
A record counts for the first layer that removes it, so the counts are those of the
records still kept before each layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.similarity import THRESHOLD, jaccard_join, token_classes
from skein.session import Scratch

LAYERS = ("conversation", "customer", "exact_text", "near_duplicate")


def overlaps(corpus: DataFrame, held: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """corpus (id, conversation, customer, text) with <layer>_hit: whether that layer on its own finds the record in held.

    held: conversation, customer, text. Null keys match nothing, empty texts match no text.
    """
    # texts are normalised once and written, as several joins read them
    c = scratch.cut(corpus.withColumn("_t", X.canonical_tokens(F.col("text"))), "corpus").withColumn("_norm", F.array_join("_t", " "))
    h = scratch.cut(held.withColumn("_t", X.canonical_tokens(F.col("text"))), "held").withColumn("_norm", F.array_join("_t", " "))
    out = c.drop("_t")
    for name, column in (("conversation", "conversation"), ("customer", "customer")):
        keys = h.select(F.col(column).alias("_k")).where(F.col("_k").isNotNull()).distinct().withColumn(f"_{name}", F.lit(True))
        out = out.join(keys, out[column] == keys["_k"], "left").drop("_k")
    norms = h.select(F.col("_norm").alias("_n")).where(F.col("_n") != "").distinct().withColumn("_exact_text", F.lit(True))
    out = out.join(norms, out["_norm"] == norms["_n"], "left").drop("_n")
    members, classes = token_classes(c, "id", F.col("_t"), scratch)
    _, gold = token_classes(h.select(F.monotonically_increasing_id().alias("id"), "_t"), "id", F.col("_t"), scratch)
    near = jaccard_join(classes, gold, scratch, threshold).select(F.col("a").alias("class_id")).distinct()
    ids = members.join(near, "class_id").select(F.col("key").alias("_id")).withColumn("_near_duplicate", F.lit(True))
    out = out.join(ids, out["id"] == ids["_id"], "left").drop("_id")
    hits = [F.coalesce(f"_{n}", F.lit(False)).alias(f"{n}_hit") for n in LAYERS]
    return scratch.cut(out.select(*corpus.columns, *hits), "overlaps")


def flagged(found: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """What overlaps() found, with layer: the first of the given layers that removes the record, or null."""
    layer = F.lit(None).cast("string")
    for name in reversed(LAYERS):
        if name in layers:
            layer = F.when(F.col(f"{name}_hit"), F.lit(name)).otherwise(layer)
    return found.withColumn("layer", layer).drop(*(f"{n}_hit" for n in LAYERS))


def audit(marked: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(layer, removed): records that each layer removes, null for layers that are off, and those kept."""
    n = marked.agg(*(F.count_if(F.col("layer") == name).alias(name) if name in layers else F.lit(None).cast("bigint").alias(name) for name in LAYERS), F.count_if(F.col("layer").isNull()).alias("kept"))
    return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("layer"), F.col(c).alias("removed")) for c in (*LAYERS, "kept")))).alias("x")).select("x.*")


class LeakageError(ValueError):
    """A corpus holds held-out records."""


def assert_isolated(corpus: DataFrame, held: DataFrame, key: str) -> None:
    """Raise if a key of the corpus is held out."""
    n = corpus.select(key).join(held.select(key).distinct(), key, "left_semi").count()
    if n:
        raise LeakageError(f"{n} records share {key} with held-out data")
