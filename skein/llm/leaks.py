"""Held-out passages inside a training corpus.

Items and documents are word sequences; five consecutive words make a shingle, which is
kept as a 64-bit hash, since the words themselves are compared in the end. A
document that reproduces enough of an item, with some words changed, must share a
known number of the item's shingles with it, hence at least one of the rarest
m - t + 1. Only documents that meet this prefix are joined further; the places of the
shared shingles then bound where a passage of the item's size can lie, and the words
of that window are compared exactly and in order.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.visual import look
from skein.session import Scratch

SHINGLE = 5
#: A passage counts from this many words and this share of the item on, with one word in CHANGED altered.
LEAST_WORDS, LEAST_SHARE, CHANGED = 20, 0.4, 12
#: Most bytes of item shingles (8 each) that are sent to every task; more of them are joined by a shuffle instead.
BROADCAST_BYTES = 64 << 20
#: Alignments worked out at a time.
ALIGNED = 256
_WORD = re.compile(r"[^\W_]+")
_TAGS = re.compile(r"</?[a-zA-Z!][^<>]*>")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """A text's words without case, punctuation, markup and character codes; look-alikes are one."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", look(text)) if not unicodedata.combining(c))
    return _WORD.findall(text.lower().replace("'", ""))


def needed(n_words: int) -> int:
    """Words of a passage that counts, for an item of n_words."""
    return max(min(LEAST_WORDS, n_words), math.ceil(LEAST_SHARE * n_words))


def least_shared(n_words: int) -> int:
    """Shingles that any passage that counts has in common with its item."""
    w = needed(n_words)
    return max(1, w - (SHINGLE - 1) - SHINGLE * math.ceil(w / CHANGED))


class Words:
    """64-bit numbers of words, remembered within a task."""

    def __init__(self, most: int = 1_000_000):
        self.known: dict[str, int] = {}
        self.most = most

    def ids(self, ws: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        out = np.empty(len(ws), np.uint64)
        for i, w in enumerate(ws):
            h = self.known.get(w)
            if h is None:
                h = self.known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i] = h
        return out

    def shingles(self, ws: list[str]) -> np.ndarray:
        """The hash of every run of SHINGLE words."""
        n = len(ws) - SHINGLE + 1
        if n <= 0:
            return np.empty(0, np.int64)
        w = self.ids(ws)
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h = h * _STEP + w[k : k + n]
        h ^= h >> np.uint64(29)
        return (h * _STEP).view(np.int64)


def window(n_words: int) -> int:
    """Words of a document that a whole item can take up."""
    return n_words + math.ceil(n_words / CHANGED) + 2


def stretches(starts: list[int], size: int) -> list[tuple[int, int]]:
    """Where passages of at most size words may lie that hold a shared shingle; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        a, b = max(0, s + SHINGLE - size), s + size
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def aligned(parts: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """By pair, the words that agree in the best local alignment, where a changed, added or missing word costs as much as one that agrees gains.

    All pairs go through one table each, row by row and together; score and agreeing words
    are kept in one number, so that the best score counts first and then the most words.
    """
    rows, width = max(map(len, parts)), max(map(len, items))
    unit = 1 << int(width + 1).bit_length()
    p = np.full((rows, len(parts)), -1, np.int64)
    x = np.full((len(items), width), -2, np.int64)
    for i, (part, item) in enumerate(zip(parts, items, strict=True)):
        p[: len(part), i], x[i, : len(item)] = part, item
    slope = np.arange(width, dtype=np.int64) * unit
    table, best = np.zeros((len(items), width + 1), np.int64), np.zeros(len(items), np.int64)
    for row in p:
        new = np.where(x == row[:, None], table[:, :-1] + unit + 1, np.maximum(table[:, :-1], table[:, 1:]) - unit)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[new < unit] = 0
        table[:, 1:] = new
        np.maximum(best, new.max(axis=1), out=best)
    return best % unit


def _item_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Words()
    for b in batches:
        out = []
        for i, t in zip(b["item_id"], b["text"], strict=True):
            ws = words(t)
            out.append(pd.DataFrame({"item_id": i, "n_words": len(ws), "size": window(len(ws)), "least": least_shared(len(ws)), "shingle": known.shingles(ws)}))
        if out:
            yield pd.concat(out)


def _doc_shingles(keep):
    """Places of shingles in documents; keep: a broadcast, sorted array of the shingles wanted, or None for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, known = keep.value if keep is not None else None, Words()
        for b in batches:
            docs, places, found = [], [], []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                h = known.shingles(words(t))
                at = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h) if len(wanted) else np.empty(0, int)
                docs.append(np.full(len(at), d, np.int64))
                places.append(at)
                found.append(h[at])
            if docs:
                yield pd.DataFrame({"doc_id": np.concatenate(docs), "doc_pos": np.concatenate(places), "shingle": np.concatenate(found)})

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        codes: dict[str, int] = {}
        number = lambda ws: np.array([codes.setdefault(w, len(codes)) for w in ws], np.int64)  # noqa: E731, B023
        todo, last = [], (None, np.empty(0, np.int64))
        for k, (d, text, item, starts) in enumerate(zip(b["doc_id"], b["text"], b["item"], b["starts"], strict=True)):
            if last[0] != d:
                last = (d, number(words(text)))
            x = number(words(item))
            todo += [(last[1][s:e], x, k) for s, e in stretches([int(s) for s in starts], window(len(x)))]
        todo.sort(key=lambda t: (len(t[0]), len(t[1])))
        n, size = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        for a in range(0, len(todo), ALIGNED):
            some = todo[a : a + ALIGNED]
            at = np.array([k for _, _, k in some])
            size[at] = [len(x) for _, x, _ in some]
            np.maximum.at(n, at, aligned([p for p, _, _ in some], [x for _, x, _ in some]))
        good = np.array([size[k] > 0 and n[k] >= needed(int(size[k])) for k in range(len(b))], bool)
        yield pd.DataFrame({"doc_id": b["doc_id"][good], "item_id": b["item_id"][good], "n_words": n[good], "share": n[good] / np.maximum(size[good], 1)})


def leaked_items(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_words, share): documents that hold an item or a good part of it.

    docs: doc_id, text; items: item_id, text; other columns are not read. n_words counts
    the item's words that agree in the best alignment with one passage, share is their part
    of the item. Null texts and items of fewer than five words give nothing; copies of a
    document each get their rows. Which shingles are rare is counted over all documents.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["item_id"])
    grams = scratch.cut(items.mapInPandas(_item_shingles, "item_id bigint, n_words int, size int, least int, shingle bigint"), "items")
    distinct = grams.select("shingle").distinct()
    if 8 * grams.count() <= broadcast_bytes:
        keep = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in distinct.toLocalIterator()], np.int64)))
        hits = docs.mapInPandas(_doc_shingles(keep), "doc_id bigint, doc_pos int, shingle bigint")
    else:
        hits = docs.mapInPandas(_doc_shingles(None), "doc_id bigint, doc_pos int, shingle bigint").join(distinct, "shingle", "left_semi").select("doc_id", "doc_pos", "shingle")
    hits = scratch.cut(hits, "hits")

    df = hits.select("doc_id", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("df"))
    per = grams.groupBy("item_id", "shingle").agg(F.max("least").alias("least")).join(df, "shingle")
    m = grams.select("item_id", "shingle").distinct()
    # Of an item's m shingles the rarest m - least + 1 are the prefix. Those that no document
    # has come first and meet nothing, which leaves known - least + 1 of the known ones.
    ranked = per.groupBy("item_id").agg(F.max("least").alias("least"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("by_rarity")).where(F.size("by_rarity") >= F.col("least"))
    prefix = ranked.select("item_id", F.explode(F.slice("by_rarity", F.lit(1), F.size("by_rarity") - F.col("least") + 1)).alias("s")).select("item_id", F.col("s.shingle").alias("shingle"))
    met = scratch.cut(hits.join(prefix, "shingle").select("doc_id", "item_id").distinct(), "met")

    # All shared places, of the pairs that met only: a frequent shingle is looked up for them, never for every item that
    # has it. Some window of the item's size must hold enough of them.
    bounds = grams.groupBy("item_id").agg(F.max("size").alias("size"), F.max("least").alias("least"))
    shared = hits.join(met, "doc_id").join(m, ["item_id", "shingle"])
    places = shared.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_set("doc_pos")).alias("starts")).join(bounds, "item_id")
    last = F.size("starts") - F.col("least")
    fits = F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.get("starts", i + F.col("least") - 1) - F.get("starts", i) <= F.col("size"))
    dense = scratch.cut(places.where((last >= 0) & fits).select("doc_id", "item_id", "starts"), "dense")
    texts = docs.join(dense.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = dense.join(texts, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "text", "item_id", "item", "starts")
    return pairs.mapInPandas(_verify, "doc_id bigint, item_id bigint, n_words int, share double")
