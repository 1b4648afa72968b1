"""Language and topic of a text, by models fitted on the whole corpus.

Languages: a multinomial model of character trigrams, learned from the `lang` column as
far as it can be read, then once more without the rows it disagrees with, since that
column is dirty. Topics: spherical k-means over words weighted by rarity; a topic is
named after the words that weigh most in its centre.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.session import Scratch

REST = "other"
#: Documents a language needs.
LEAST_DOCS = 3
#: Number of topics, rounds of k-means, steps of a word's weight.
TOPICS, ROUNDS, STEPS = 8, 25, float(1 << 30)
TRIGRAMS, WORDS = 1 << 13, 1 << 12
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Kinds(NamedTuple):
    """languages: names and log-probabilities (trigrams, names); topics: names and centres (words, names)."""

    languages: list[str]
    trigrams: np.ndarray
    topics: list[str]
    words: np.ndarray


def word_counts(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


def _trigrams(word: str) -> list[int]:
    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode()) % TRIGRAMS for i in range(len(w) - 2)]


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORDS


def _log_probabilities(texts: list[Counter], names: list[str], order: list[str]) -> np.ndarray:
    n = np.full((TRIGRAMS, len(order)), 0.1)
    for ws, name in zip(texts, names, strict=True):
        k = order.index(name)
        for w, c in ws.items():
            for t in _trigrams(w):
                n[t, k] += c
    return np.log(n / n.sum(axis=0))


def fit_languages(texts: list[str], names: list[str]) -> tuple[list[str], np.ndarray]:
    """The model of texts at hand; languages_of() does the same for tables."""
    counts = [word_counts(t) for t in texts]
    order = sorted(n for n, k in Counter(names).items() if k >= LEAST_DOCS)
    if not order:
        return [], np.zeros((TRIGRAMS, 0))
    rows = [(c, n) for c, n in zip(counts, names, strict=True) if n in order and c]
    table = _log_probabilities([c for c, _ in rows], [n for _, n in rows], order)
    scored = Scorer(Kinds(order, table, [], np.zeros((WORDS, 0))))
    sure = [(c, n) for c, n in rows if scored.of(c)[0] == n]
    return order, _log_probabilities([c for c, _ in sure], [n for _, n in sure], order)


def fit_topics(texts: list[str], k: int = TOPICS, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """The topics of texts at hand; topics_of() is for tables."""
    counts = [c for c in map(word_counts, texts) if c]
    if not counts:
        return [], np.zeros((WORDS, 0))
    x = np.zeros((len(counts), WORDS))
    df: Counter = Counter()
    for i, ws in enumerate(counts):
        df.update(ws.keys())
        for w, c in ws.items():
            x[i, _bucket(w)] += c
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    x = np.log1p(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres = [x[0]]
    for _ in range(k - 1):  # far from those chosen, with chance
        far = np.maximum(1 - np.max(x @ np.array(centres).T, axis=1), 0)
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 1e-9 else x[len(centres)])
    c = np.array(centres)
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        new = np.array([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    weight = (c * idf).T
    words = sorted(w for w, n in df.items() if n >= 2 and len(w) > 3) or sorted(df)
    at = np.array([_bucket(w) for w in words])
    names: list[str] = []
    for i in range(k):
        best = np.argsort(-c[i, at], kind="stable")[:2]
        names.append("+".join(words[j] for j in best))
    return [f"{i}:{n}" for i, n in enumerate(names)], weight


class Scorer:
    """The models applied text by text; what a word adds is worked out once and kept in a table."""

    def __init__(self, kinds: Kinds, words: int = 100_000):
        self.kinds, self.split = kinds, len(kinds.languages)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((words, self.split + len(kinds.topics)))

    def _places(self, counts: Counter) -> list[int]:
        out = []
        for w in counts:
            k = self.at.get(w)
            if k is None:
                if len(self.at) >= len(self.rows):
                    return []
                k = self.at[w] = len(self.at)
                self.rows[k, : self.split] = self.kinds.trigrams[_trigrams(w)].sum(axis=0)
                self.rows[k, self.split :] = self.kinds.words[_bucket(w)]
            out.append(k)
        return out

    def of(self, counts: Counter) -> tuple[str, str]:
        """(language, topic); 'other' for a text without letters or a model without classes."""
        if not counts:
            return REST, REST
        at = self._places(counts)
        if not at:  # the table is full of words from other texts
            self.at.clear()
            if len(counts) > len(self.rows):
                self.rows = np.zeros((2 * len(counts), self.rows.shape[1]))
            at = self._places(counts)
        n, x = np.fromiter(counts.values(), float, len(counts)), self.rows[at]
        language, topic = n @ x[:, : self.split], np.log1p(n) @ x[:, self.split :]
        return (self.kinds.languages[int(language.argmax())] if len(language) else REST), (self.kinds.topics[int(topic.argmax())] if len(topic) and topic.max() > 0 else REST)


def language_code(c):
    """The language of a code as two or three small letters; null for none and for 'und'."""
    code = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when((code != "") & (code != "und"), code)


def word_table(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, words, counts, at, n) of docs (doc_id, lang, text): the words of each text, and the buckets they fall into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = lru_cache(maxsize=200_000)(_bucket)
        for b in batches:
            counts = [word_counts(t) for t in b["text"]]
            at: list[Counter] = []
            for ws in counts:
                x: Counter = Counter()
                for w, c in ws.items():
                    x[bucket(w)] += c
                at.append(x)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"]} | {"words": [list(x) for x in counts], "counts": [list(x.values()) for x in counts], "at": [list(x) for x in at], "n": [list(x.values()) for x in at]})

    return docs.select("doc_id", "lang", "text").mapInPandas(run, "doc_id bigint, lang string, words array<string>, counts array<int>, at array<int>, n array<int>")


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of arrays v (as bytes) by i; as many rows as i has values, of one size."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b["i"], b["v"], strict=True):
                sums[i] = sums[i] + np.frombuffer(v) if i in sums else np.frombuffer(v)
        for i, v in sums.items():
            yield pd.DataFrame({"i": [i], "v": [v.tobytes()]})

    return {r["i"]: np.frombuffer(r["v"]) for r in parts.repartition("i").mapInPandas(add, "i int, v binary").collect()}


def languages_of(table: DataFrame) -> tuple[list[str], np.ndarray]:
    """What fit_languages() gives for all rows of a word_table()."""
    order = sorted(r["lang"] for r in table.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).collect())  # codes of two or three letters
    if not order:
        return [], np.zeros((TRIGRAMS, 0))
    known = table.where(F.col("lang").isin(order) & (F.size("words") > 0)).select("lang", "words", "counts")

    def counted(first: Kinds | None) -> np.ndarray:
        sent = table.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(sent.value) if sent.value else None
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                words: dict[str, Counter] = {}
                for g, ws, cs in zip(b["lang"], b["words"], b["counts"], strict=True):
                    if scorer is None or scorer.of(dict(zip(ws, cs, strict=True)))[0] == g:
                        mine = words.setdefault(g, Counter())
                        for w, c in zip(ws, cs.tolist(), strict=True):
                            mine[w] += c
                for g, ws in words.items():
                    tris = [_trigrams(w) for w in ws]
                    flat = np.fromiter((t for x in tris for t in x), np.int64)
                    times = np.repeat(np.fromiter(ws.values(), float), [len(x) for x in tris])
                    sums[g] = sums.get(g, 0) + np.bincount(flat, times, minlength=TRIGRAMS)
            for g, v in sums.items():
                yield pd.DataFrame({"i": [order.index(g)], "v": [v.tobytes()]})

        n = np.full((TRIGRAMS, len(order)), 0.1)
        for i, v in _summed(known.mapInPandas(run, "i int, v binary")).items():
            n[:, i] += v
        return np.log(n / n.sum(axis=0))

    return order, counted(Kinds(order, counted(None), [], np.zeros((WORDS, 0))))


def _units(at: pd.Series, n: pd.Series, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry by text, buckets, weights) of texts with words; weights are in steps of 2 ** -30, so that sums don't depend on their order."""
    k = np.array([len(x) for x in at], np.int64)
    flat, starts = np.concatenate(list(at)).astype(np.int64), np.cumsum(k) - k
    x = np.log1p(np.concatenate(list(n)).astype(float)) * idf[flat]
    norm = np.maximum(np.sqrt(np.add.reduceat(x * x, starts)), 1e-12)
    return starts, flat, np.round(x / np.repeat(norm, k) * STEPS) / STEPS


def topics_of(table: DataFrame, k: int = TOPICS, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """Spherical k-means as in fit_topics(), over all rows of a word_table() (doc_id, words, at, n)."""
    spark = table.sparkSession
    t = table.where(F.size("at") > 0)
    total = t.count()
    if not total:
        return [], np.zeros((WORDS, 0))
    df = np.zeros(WORDS)
    for r in t.select(F.explode("at").alias("b")).groupBy("b").agg(F.count("*").alias("c")).collect():  # WORDS rows at most
        df[r["b"]] = r["c"]
    idf = np.log((1 + total) / (1 + df))

    def chance(step: int):
        return ((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed), F.lit(step)), 11) + 1).cast("double") / float(1 << 53)).alias("u")

    def drawn(centres: np.ndarray | None, step: int) -> np.ndarray | None:
        """A text, far from the centres with chance: the first of exponential times by distance."""
        sent = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                starts, flat, x = _units(b["at"], b["n"], idf)
                far = np.ones(len(b)) if sent.value is None else np.maximum(1 - np.add.reduceat(sent.value.T[flat] * x[:, None], starts, axis=0).max(axis=1), 0)
                far[far <= 1e-9] = 0
                with np.errstate(divide="ignore"):
                    b = b.assign(time=np.where(far > 0, -np.log(b["u"].to_numpy()) / far, np.inf))
                yield b[b["time"] < np.inf].nsmallest(1, ["time", "doc_id"])[["doc_id", "at", "n", "time"]]

        best = t.select("doc_id", "at", "n", chance(step)).mapInPandas(run, "doc_id bigint, at array<int>, n array<int>, time double").orderBy("time", "doc_id").limit(1).toPandas()
        if not len(best):
            return None
        _, flat, x = _units(best["at"], best["n"], idf)
        out = np.zeros(WORDS)
        out[flat] = x
        return out

    def means(c: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(c)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(sent.value.size)
            for b in batches:
                if len(b):
                    starts, flat, x = _units(b["at"], b["n"], idf)
                    near = np.argmax(np.add.reduceat(sent.value.T[flat] * x[:, None], starts, axis=0), axis=1)
                    sums += np.bincount(np.repeat(near, np.diff(np.r_[starts, len(flat)])) * WORDS + flat, x, minlength=sums.size)
            for i, v in enumerate(sums.reshape(sent.value.shape)):
                if v.any():
                    yield pd.DataFrame({"i": [i], "v": [v.tobytes()]})

        new = c.copy()
        for i, v in _summed(t.select("at", "n").mapInPandas(run, "i int, v binary")).items():
            new[i] = v / max(np.linalg.norm(v), 1e-12)
        return new

    chosen: list[np.ndarray] = []
    while len(chosen) < min(k, total) and (x := drawn(np.array(chosen) if chosen else None, len(chosen))) is not None:
        chosen.append(x)
    c = np.array(chosen)
    for _ in range(ROUNDS):
        new = means(c)
        done = np.allclose(new, c)
        c = new
        if done:
            break
    # of a bucket's words the first two can name a topic, since they weigh the same
    words = t.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).withColumn("b", (F.crc32("w") % WORDS).cast("int"))
    first = lambda x: sorted((r["w"], r["b"]) for r in x.withColumn("k", F.row_number().over(W.partitionBy("b").orderBy("w"))).where(F.col("k") <= 2).collect())
    named = first(words.where((F.col("n") >= 2) & (F.length("w") > 3))) or first(words)
    at = np.array([b for _, b in named])
    names = ["+".join(named[j][0] for j in np.argsort(-x[at], kind="stable")[:2]) for x in c]
    return [f"{i}:{n}" for i, n in enumerate(names)], (c * idf).T


def fit(docs: DataFrame, seed: int = 42, scratch: Scratch | None = None) -> Kinds:
    """Models of all rows of docs (doc_id, text, and lang if there is one) with an id and a text."""
    scratch = scratch or Scratch(docs.sparkSession, "kinds")
    code = language_code(F.col("lang").cast("string")) if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", code.alias("lang"), "text")
    table = scratch.cut(word_table(rows), "words")
    out = Kinds(*languages_of(table), *topics_of(table, seed=seed))
    scratch.drop(table)
    return out
