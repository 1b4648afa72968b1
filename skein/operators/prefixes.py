"""Rare-word prefixes: a complete self-join for sets that are alike, in few rows.

Sets of m <= n words with Jaccard t or more share at least o = (m + n) t / (1 + t) words. In
any order of all words that both follow, their first common word is then among the
first m - o + 1 of the one and the first n - o + 1 of the other. Words are ordered by how many
sets hold them, rare ones first, so that few unrelated sets meet; counts are kept for
buckets of words, of which there is a fixed number, and only order the words: no pair
depends on them.

A row is one word of a set's prefix with the parity bits of the set. The sets that have
a word in their prefix meet in one task, where places, sizes and parity bits are
compared in arrays: no pair that they rule out is ever a row. A word that many sets
have is met in several tasks. Rows are made in a few passes over parts of the words, and
shuffle files of a pass are deleted before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.blocks import _mix
from skein.session import Scratch, ship, shuffle_partitions

#: Buckets in which words are counted; 64-bit words of parity bits of a set.
BUCKETS, WORDS = 1 << 18, 4
#: Passes at most, and prefix rows for which one is enough; rows of a task; sets of one word that meet in a single task.
PASSES, ONE_PASS, TASK_ROWS, HOT = 4, 2_000_000, 200_000, 1 << 16
#: Cells of a block of comparisons, sets by sets.
SIDE, WINDOW = 32, 4096
_SALT = np.uint64(0x9E3779B97F4A7C15)


def counts(hashes: DataFrame) -> np.ndarray:
    """By bucket how many rows of hashes (hashes: array of distinct bigints) hold its words."""
    got = hashes.select(F.explode("hashes").alias("h")).groupBy(F.expr(f"h & {BUCKETS - 1}L").alias("b")).agg(F.count("*").alias("c")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[got["b"].to_numpy()] = got["c"].to_numpy()
    return out


def _shared(both: np.ndarray, threshold: float) -> np.ndarray:
    """Words that two sets of so many words together share at least."""
    return np.ceil(both * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """Words of a set that a smaller one's first common word may be among."""
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


def parities(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, WORDS): every word flips one bit, so sets differ in no more bits than in words."""
    f = np.zeros((rows, WORDS), np.uint64)
    np.bitwise_xor.at(f, (row, ((flat >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64)), np.uint64(1) << (flat & np.uint64(63)))
    return f


def with_prefixes(sets: DataFrame, count: np.ndarray, threshold: float) -> DataFrame:
    """sets (..., hashes) with n, f0.. and prefix, the low 32 bits of its rarest words' hashes in order, instead of hashes."""
    ship(sets.sparkSession)
    sent = sets.sparkSession.sparkContext.broadcast(count)
    rest = [c for c in sets.columns if c != "hashes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for b in batches:
            if not len(b):
                continue
            n = np.array([len(h) for h in b["hashes"]], np.int64)
            flat = np.concatenate([np.asarray(h, np.int64) for h in b["hashes"]])
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, c[flat & (BUCKETS - 1)], row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            taken = order[place < prefix_length(n, threshold)[row]]
            ends = np.cumsum(prefix_length(n, threshold))
            f = parities(_mix(flat.view(np.uint64)), row, len(n)).view(np.int64)
            yield pd.DataFrame({x: b[x] for x in rest} | {"n": n.astype(np.int32)} | {f"f{i}": f[:, i] for i in range(WORDS)} | {"prefix": np.split(flat[taken].astype(np.int32), ends[:-1])})

    kinds = "".join(f"{x} {sets.schema[x].dataType.simpleString()}, " for x in rest)
    return sets.mapInPandas(run, f"{kinds}n int, {''.join(f'f{i} bigint, ' for i in range(WORDS))}prefix array<int>")


def _rows(sets: DataFrame, key: str, count: np.ndarray, part: int, parts: int, threshold: float) -> DataFrame:
    """(cell, key, n, place, f0..): a row per prefix word of one part, in every cell of that word; place is negative where the set may only be the larger one."""
    sent = sets.sparkSession.sparkContext.broadcast(count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for b in batches:
            if not len(b):
                continue
            k = np.array([len(x) for x in b["prefix"]], np.int64)
            word = np.concatenate([np.asarray(x, np.int32) for x in b["prefix"]])
            row = np.repeat(np.arange(len(k)), k)
            place = np.arange(len(word)) - np.repeat(np.cumsum(k) - k, k) + 1
            mixed = _mix(word.astype(np.int64).view(np.uint64))
            at = np.flatnonzero(mixed % np.uint64(parts) == np.uint64(part))
            word, mixed, row, place = word[at], mixed[at], row[at], place[at]
            cells = 1 + c[word & (BUCKETS - 1)] // HOT
            own = _mix(mixed + row.astype(np.uint64) * _SALT) % cells.astype(np.uint64)
            some = np.repeat(np.arange(len(word)), cells)
            cell = np.arange(len(some)) - np.repeat(np.cumsum(cells) - cells, cells)
            n = b["n"].to_numpy(np.int64)[row]
            small = (place <= n - _shared(2 * n, threshold) + 1)[some] & (cell == own[some].astype(np.int64))
            out = b[[key, *(f"f{i}" for i in range(WORDS))]].iloc[row[some]]
            yield out.assign(cell=(mixed[some] + cell.astype(np.uint64) * _SALT).view(np.int64), n=n[some].astype(np.int32), place=np.where(small, place[some], -place[some]).astype(np.int32))

    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, "n", *(f"f{i}" for i in range(WORDS)), "prefix").mapInPandas(run, f"cell bigint, {key} {kind}, n int, place int, {', '.join(f'f{i} bigint' for i in range(WORDS))}")


def met(cell: np.ndarray, n: np.ndarray, place: np.ndarray, f: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (smaller, larger) of the rows of equal cells that may be alike."""
    share = threshold / (1 + threshold)
    small, place = place > 0, np.abs(place)
    far = np.floor((n - place + 1) / share - n + 1e-6).astype(np.int64)  # the most words that the other set may have
    least = np.minimum(n, far)  # as the larger set
    most = np.minimum(far, np.floor(n / threshold + 1e-6).astype(np.int64))  # as the smaller set
    bound = ((n + most) * ((1 - threshold) / (1 + threshold)) + 1e-9).astype(np.int64)
    two = f[:, 0] ^ f[:, 2], f[:, 1] ^ f[:, 3]
    one = two[0] ^ two[1]
    order = np.lexsort((least, cell))
    starts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]]) if len(cell) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(cell)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, z in zip(*(x[ends - starts > 1] for x in (starts, ends)), strict=True):
        group = order[a:z]
        keys = least[group]
        s = group[small[group]]
        s = s[np.lexsort((n[s], place[s]))]
        for i in range(0, len(s), SIDE):
            x = s[i : i + SIDE]
            lo, hi = np.searchsorted(keys, n[x].min()), np.searchsorted(keys, most[x].max(), "right")
            limit = bound[x].max()
            for w in range(lo, hi, WINDOW):
                y = group[w : min(w + WINDOW, hi)]
                if limit <= 16:
                    d = np.bitwise_count(one[x][:, None] ^ one[y])
                else:
                    d = np.bitwise_count(two[0][x][:, None] ^ two[0][y]) + np.bitwise_count(two[1][x][:, None] ^ two[1][y])
                p, q = np.nonzero(d <= min(limit, 255))
                p, q = x[p], y[q]
                keep = (n[p] <= n[q]) & (n[q] <= most[p]) & (least[q] >= n[p]) & (p != q)
                p, q = p[keep], q[keep]
                keep = np.bitwise_count(f[p] ^ f[q]).sum(axis=1, dtype=np.int64) <= (n[p] + n[q]) * ((1 - threshold) / (1 + threshold)) + 1e-9
                if keep.any():
                    found.append((p[keep], q[keep]))
    return (np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def candidates(sets: DataFrame, key: str, count: np.ndarray, scratch: Scratch, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, of sets (key, n, f0.., prefix; a written table) that may be alike."""
    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = min(PASSES, 1 + total // ONE_PASS)
    tasks = max(shuffle_partitions(sets.sparkSession), -(-total // (parts * TASK_ROWS)))
    kind = sets.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        if not every:
            return
        b = pd.concat(every, ignore_index=True)
        every.clear()
        f = np.stack([b[f"f{i}"].to_numpy(np.int64) for i in range(WORDS)], axis=1).view(np.uint64)
        p, q = met(b["cell"].to_numpy(np.int64), b["n"].to_numpy(np.int64), b["place"].to_numpy(np.int64), f, threshold)
        x, y = b[key].to_numpy()[p], b[key].to_numpy()[q]
        pairs = pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x)})
        yield pairs[pairs["a"] != pairs["b"]].drop_duplicates()

    out, each = None, []
    for part in range(parts):
        rows = _rows(sets, key, count, part, parts, threshold).repartition(tasks, "cell")
        each.append(scratch.cut(rows.mapInPandas(run, f"a {kind}, b {kind}"), "met", tidy=True))
        out = each[-1] if out is None else out.unionByName(each[-1])
    pairs = scratch.cut(out.distinct(), "candidates", tidy=True)
    scratch.drop(*each)
    return pairs
