"""Mixing sources to target weights.

Documents fall into cells of source, language and topic (kinds.py). Iterative proportional
fitting rakes the cells' token weights to the three marginals, never above the
source's allowed repeats; a document's weight is how often it should be used. Whole
uses are certain, the rest is drawn by systematic sampling in hash order, so that
every cell's sum of uses is met to within one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import kinds as K
from skein.operators.ranks import running_sum
from skein.session import Scratch, ship

#: Most rounds of raking; it ends before once every marginal that can be met is met to RESIDUAL of the whole.
ROUNDS, RESIDUAL, SEED = 500, 1e-7, 42
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern of that vocabulary, as its publisher states it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, models: K.Kinds, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, language, topic, tokens); texts are counted whole, null and empty ones as 0."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, scorer = encoder(path), K.Scorer(sent.value)
        for b in batches:
            told = [scorer.of(K.word_counts(t)) for t in b["text"]]
            tokens = [len(e.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "language": [x for x, _ in told], "topic": [x for _, x in told], "tokens": tokens})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, language string, topic string, tokens bigint")


class Target(NamedTuple):
    share: float
    max_repeats: int


Cell = tuple[str, str, str]


def rake(cells: dict[Cell, float], sources: dict[str, Target], languages: dict[str, float], topics: dict[str, float], size: float, rounds: int = ROUNDS) -> dict[Cell, float]:
    """Uses per document by cell, between 0 and the source's repeats.

    cells: tokens available. The marginals are raked in turn, sources last; a source that
    cannot reach its share ends at its repeats. Language and topic shares are of what the
    sources reach. What marginals then miss is for the caller to report (see marginals()).
    """
    keys = [k for k in sorted(cells) if cells[k] > 0 and k[0] in sources and sources[k[0]].share > 0]
    if not keys:
        return {}
    have = np.array([cells[k] for k in keys])
    cap = np.array([float(sources[k[0]].max_repeats) for k in keys])
    use = np.minimum(1.0, cap)
    places: list[tuple[int, float, np.ndarray]] = []
    for axis, want in ((1, languages), (2, topics), (0, {s: t.share for s, t in sources.items()})):
        at: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            at.setdefault(k[axis], []).append(i)
        places += [(axis, want.get(name, 0.0), np.array(at[name])) for name in sorted(at)]
    for _ in range(rounds):
        before = use.copy()
        for axis, share, at in places:
            goal = share * (size if axis == 0 else float(use @ have))
            u, h, c = use[at], have[at], cap[at]
            # raise what is not at its cap until the marginal is met or all are
            for _ in range(20):
                got = float(u @ h)
                if got <= 0 or abs(got - goal) <= 1e-12 * max(goal, 1):
                    break
                free = (u < c) | (goal < got)
                fixed = got - float(u[free] @ h[free])
                if not free.any() or got == fixed:
                    break
                u[free] = np.minimum(u[free] * max(goal - fixed, 0.0) / (got - fixed), c[free])
            use[at] = u
        if float(np.abs(use - before) @ have) <= RESIDUAL * max(size, 1.0):
            break
    return dict(zip(keys, map(float, use), strict=True))


def natural_size(available: dict[str, float], sources: dict[str, Target], least_part: float) -> float:
    """The most tokens at which every source with documents reaches its share, but at least the given part of what there is."""
    bounds = [n * sources[s].max_repeats / sources[s].share for s, n in available.items() if n > 0 and s in sources and sources[s].share > 0]
    return max(min(bounds, default=0.0), least_part * sum(available.values()))


class Mixture(NamedTuple):
    """sample: doc_id, source, language, topic, tokens, weight, copies (1 or more).
    report: per target source its shares, tokens, documents, copies and what limits it.
    marginals: (axis, name, wanted_share, raked_share, reached_share, residual) of sources, languages and topics."""

    sample: DataFrame
    report: DataFrame
    marginals: DataFrame


def mix(docs: DataFrame, targets: DataFrame, size: int | None = None, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None, least_part: float = 0.0, models: K.Kinds | None = None, seed: int = SEED, path: str = TOKENIZER, scratch: Scratch | None = None) -> Mixture:
    """The mixture of docs (doc_id, source, text and, to learn languages from, lang).

    targets: source, target_share, max_repeats, one row per source. size is the wanted
    number of tokens, by default natural_size(): with least_part 0 all sources that have
    documents reach their share; with more, a very scarce source may end at its repeats
    instead of shrinking the whole, which the report says (limit: repeats). languages and
    topics are wanted shares, by default those of the target sources' tokens. models: by
    default fitted on all of docs. Documents of no or another source and those
    without text are left out.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixture")
    known = {r["source"]: Target(float(r["target_share"]), int(r["max_repeats"])) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").collect()}  # one row per source
    models = models or K.fit(docs, seed, scratch)
    sources = targets.select("source").where(F.col("source").isNotNull()).distinct()
    sized = scratch.cut(with_tokens(docs.join(sources, "source", "left_semi").where(F.length("text") > 0), models, path), "tokens")
    # as many rows as sources, languages and topics allow, whatever the corpus
    cells = {(r["source"], r["language"], r["topic"]): float(r["tokens"]) for r in sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).collect()}

    def shares(amounts: dict[Cell, float], axis: int) -> dict[str, float]:
        out: dict[str, float] = {}
        total = max(sum(amounts.values()), 1.0)
        for k, v in amounts.items():
            out[k[axis]] = out.get(k[axis], 0.0) + v / total
        return out

    total = sum(cells.values())
    held = {s: v * max(total, 1.0) for s, v in shares(cells, 0).items()}
    wanted = [{s: t.share for s, t in known.items()}, languages or shares(cells, 1), topics or shares(cells, 2)]
    use = rake(cells, known, wanted[1], wanted[2], float(size or natural_size(held, known, least_part)))
    weights = spark.createDataFrame([(*k, v) for k, v in sorted(use.items())], "source string, language string, topic string, weight double")  # a row per cell
    weighed = sized.join(F.broadcast(weights), ["source", "language", "topic"]).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    summed = running_sum(weighed, ["source", "language", "topic"], ["_h", "doc_id"], F.col("weight"), "_upto", scratch)
    start = (F.shiftrightunsigned(F.xxhash64("source", "language", "topic", F.lit(seed)), 11).cast("double")) / float(1 << 53)
    copies = (F.floor(F.col("_upto") + start + 1e-9) - F.floor(F.col("_upto") - F.col("weight") + start + 1e-9)).cast("int")
    sample = scratch.cut(summed.withColumn("copies", copies).where(F.col("copies") > 0).select("doc_id", "source", "language", "topic", "tokens", "weight", "copies"), "sample")

    # reports: from here on everything is by cell or by source
    drawn = {(r["source"], r["language"], r["topic"]): float(r["t"]) for r in sample.groupBy("source", "language", "topic").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    raked = {k: v * cells[k] for k, v in use.items()}
    rows = []
    for axis, name in enumerate(("source", "language", "topic")):
        a, b = shares(raked, axis), shares(drawn, axis)
        rows += [(name, x, w, a.get(x, 0.0), b.get(x, 0.0), b.get(x, 0.0) - w) for x, w in sorted(wanted[axis].items())]
    marginals = spark.createDataFrame(rows, "axis string, name string, wanted_share double, raked_share double, reached_share double, residual double")
    full = {s for s in known if any(k[0] == s for k in use) and all(v >= known[s].max_repeats - 1e-9 for k, v in use.items() if k[0] == s)}
    limits = spark.createDataFrame([(s, "repeats" if s in full else "no documents" if s not in held else "none") for s in sorted(known)], "source string, limit string")
    used = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").cast("bigint").alias("copies"), F.max("copies").alias("most_copies"))
    there = sized.groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
    report = targets.join(used, "source", "left").join(there, "source", "left").join(limits, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = report.select("source", "target_share", "max_repeats", *map(zero, ("tokens_available", "tokens", "documents", "copies", "most_copies")), "limit")
    return Mixture(sample, report.withColumn("reached_share", F.round(F.col("tokens") / F.lit(max(sum(drawn.values()), 1.0)), 4)), marginals)
