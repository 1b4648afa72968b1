"""Codes of set blocks: a complete candidate join for sets that are alike.

Two sets with Jaccard t or more differ in at most r = (|A| + |B|) (1 - t) / (1 + t) words.
The word space is cut into groups by hash. Of n1 groups at least one holds no more than
k2 of the differences if n1 (k2 + 1) > r; inside it n2 blocks are formed, of which at
most k2 differ, so the two sets agree in n2 - k2 whole blocks of that group. A code
stands for the words of n2 - k2 blocks of one group; a join on codes misses no pair,
whatever n1, k2 and n2 are (two-level partitioning and enumeration). Equal codes mean
equal subsets, presence and absence alike.

Codes over more words meet fewer unrelated sets but are more in number. Which scheme is
taken is settled for every size class by its measured cost: code rows written and rows
joined, over all sets, counted on evenly spaced ones of a scheme's codes. All schemes are
complete, so the choice never changes a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes a set may get under one tag, by level; plan() picks the level. Where even single blocks are more, these are taken.
LEVELS = (48, 96, 192, 384, 768)
#: So many of a scheme's codes are counted for the plan.
COUNTED = 6
_A, _B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def size_class(n: int, threshold: float) -> int:
    """Sizes of one class differ by less than the factor 1/threshold."""
    return int(math.log(n) / -math.log(threshold) + 1e-9)


def largest_size(k: int, threshold: float) -> int:
    n = int(threshold ** -(k + 1)) + 1
    while n > 1 and size_class(n, threshold) > k:
        n -= 1
    return n


def radius(a: int, b: int, threshold: float) -> int:
    """Most words in which sets of a and b words may differ."""
    return int((a + b) * (1 - threshold) / (1 + threshold) + 1e-9)


class Scheme(NamedTuple):
    """n1 groups of n2 blocks, of which k2 may differ."""

    n1: int
    k2: int
    n2: int

    @property
    def codes(self) -> int:
        return self.n1 * math.comb(self.n2, self.k2)

    @property
    def share(self) -> float:
        """Of the word space, what one code covers."""
        return (self.n2 - self.k2) / (self.n1 * self.n2)


@lru_cache(maxsize=4096)
def scheme(tag: int, level: int, threshold: float) -> Scheme:
    """Of the complete schemes with few enough codes the one whose codes cover most words."""
    most = largest_size(tag, threshold)
    r = radius(most, most, threshold)
    allowed = max(LEVELS[level], r + 1)
    every = (Scheme(r // (k2 + 1) + 1, k2, n2) for k2 in range(min(r, 12) + 1) for n2 in range(k2 + 1, k2 + 13))
    return max((s for s in every if s.codes <= allowed), key=lambda s: (s.share, -s.codes))


@lru_cache(maxsize=256)
def _members(s: Scheme) -> np.ndarray:
    """By code the blocks it stands for."""
    return np.array([[g * s.n2 + j for j in c] for g in range(s.n1) for c in combinations(range(s.n2), s.n2 - s.k2)])


def block_codes(flat: np.ndarray, row: np.ndarray, rows: int, tag: int, s: Scheme, only: np.ndarray | None = None) -> np.ndarray:
    """(rows, codes) of sets given as mixed word hashes and their row numbers; only: numbers of the codes wanted, else all.

    Sets of equal class meet under their class's tag, those of neighbouring classes under
    the larger one's; the scheme follows from the tag and the plan alone.
    """
    blocks = s.n1 * s.n2
    b = np.zeros((rows, blocks), np.uint64)
    np.bitwise_xor.at(b, (row, ((flat >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)), flat)
    b = _mix(b + np.arange(blocks, dtype=np.uint64) * _STEP + np.uint64(tag))
    m = _members(s)
    wanted = range(len(m)) if only is None else only
    out = np.empty((rows, len(wanted)), np.uint64)
    for i, q in enumerate(wanted):
        out[:, i] = b[:, m[q]].sum(axis=1, dtype=np.uint64) + np.uint64(q)
    return _mix(out)


def fingerprints(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 2): 128 parity bits; every word flips one, so sets differ in no more bits than in words, and large sets do not fill it up."""
    f = np.zeros((rows, 2), np.uint64)
    np.bitwise_xor.at(f, (row, ((flat >> np.uint64(6)) & np.uint64(1)).astype(np.int64)), np.uint64(1) << (flat & np.uint64(63)))
    return f


class Sets:
    """A batch of hash arrays, flattened, with its tags."""

    def __init__(self, hashes: pd.Series, threshold: float):
        self.n = np.array([len(h) for h in hashes], np.int64)
        self.flat = _mix(np.concatenate([np.asarray(h, np.int64) for h in hashes]).view(np.uint64)) if len(self.n) else np.empty(0, np.uint64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        sizes = {int(x): size_class(int(x), threshold) for x in np.unique(self.n)}
        self.tag = np.array([sizes[int(x)] for x in self.n], np.int64)

    def under(self, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the sets that use a tag (those of its class and of the class below), and their words."""
        at = np.flatnonzero((self.tag == tag) | (self.tag == tag - 1))
        number = np.full(len(self.n), -1)
        number[at] = np.arange(len(at))
        row = number[self.row]
        return at, self.flat[row >= 0], row[row >= 0]

    def tags(self) -> list[int]:
        return sorted({int(t) + d for t in np.unique(self.tag) for d in (0, 1)})


def plan(classes: DataFrame, threshold: float) -> dict[int, int]:
    """The level by tag at which code rows and joined rows together are fewest; classes: hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sets = Sets(b["hashes"], threshold)
            for tag in sets.tags():
                at, flat, row = sets.under(tag)
                done = set()
                for level in range(len(LEVELS)):
                    if (s := scheme(tag, level, threshold)) in done:
                        continue
                    done.add(s)
                    some = np.unique(np.linspace(0, s.codes - 1, COUNTED).astype(int))
                    c = block_codes(flat, row, len(at), tag, s, some).view(np.int64)
                    yield pd.DataFrame({"tag": tag, "level": level, "code": c.ravel()})

    counted = classes.select("hashes").mapInPandas(run, "tag int, level int, code bigint").groupBy("tag", "level", "code").agg(F.count("*").alias("c"))
    cost = counted.groupBy("tag", "level").agg((F.sum("c") + F.sum(F.col("c") * (F.col("c") - 1) / 2)).alias("cost")).collect()  # tags x levels
    best: dict[int, tuple] = {}
    for r in cost:
        whole = scheme(r["tag"], r["level"], threshold).codes
        best[r["tag"]] = min(best.get(r["tag"], (math.inf, 0)), (float(r["cost"]) * whole / min(whole, COUNTED), r["level"]))
    return {t: level for t, (_, level) in best.items()}


def coded(classes: DataFrame, threshold: float, keep: tuple[str, ...] = (), levels: dict[int, int] | None = None) -> DataFrame:
    """(class_id, n, f0, f1, codes, keep...) of classes (class_id, hashes), hashes a non-empty array of distinct bigints.

    levels: a plan() over all sets that will meet; without one, one is made here.
    """
    levels = plan(classes, threshold) if levels is None else levels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sets = Sets(b["hashes"], threshold)
            f = fingerprints(sets.flat, sets.row, len(b)).view(np.int64)
            codes: list[list] = [[] for _ in range(len(b))]
            for tag in sets.tags():
                at, flat, row = sets.under(tag)
                c = block_codes(flat, row, len(at), tag, scheme(tag, levels.get(tag, 0), threshold)).view(np.int64)
                for i, x in zip(at, c, strict=True):
                    codes[i].append(x)
            yield pd.DataFrame({"class_id": b["class_id"], "n": sets.n.astype(np.int32), "f0": f[:, 0], "f1": f[:, 1], "codes": [np.concatenate(x) for x in codes]} | {c: b[c] for c in keep})

    kind = lambda c: classes.schema[c].dataType.simpleString()
    rest = "".join(f", {c} {kind(c)}" for c in keep)
    return classes.select("class_id", "hashes", *keep).mapInPandas(run, f"class_id {kind('class_id')}, n int, f0 bigint, f1 bigint, codes array<bigint>{rest}")


def side(coded_classes: DataFrame, name: str) -> DataFrame:
    """One side of the join: (name, n_name, f0_name, f1_name, code), a row per code."""
    return coded_classes.select(F.col("class_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "f0", "f1")), F.explode("codes").alias("code"))


def within_radius(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and fingerprints allow two joined sides to be alike."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    far = F.bit_count(F.col(f"f0_{a}").bitwiseXOR(F.col(f"f0_{b}"))) + F.bit_count(F.col(f"f1_{a}").bitwiseXOR(F.col(f"f1_{b}")))
    return (far <= F.floor((na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9)) & (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9)


def candidates(a: DataFrame, b: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """Distinct (a, b) pairs of coded classes that may be alike; same: a is b, each pair once, a < b."""
    near = within_radius("a", "b", threshold)
    pairs = side(a, "a").join(side(b, "b"), "code").where(near & (F.col("a") < F.col("b")) if same else near)
    return pairs.select("a", "b").distinct()
