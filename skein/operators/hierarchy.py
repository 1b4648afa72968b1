"""Parent-child links to full hierarchies: root, depth, path, descendants, loops.

Weighted disjoint-set forests. Every partition joins its own links into a forest
whose nodes know their offset to the local root. Of a partition's forest only the
nodes that other partitions point at are kept for the next level; those are
merged the same way, by ranges of ids or, where their order fits no ranges, by random
mates, until one task of bounded size holds them, where roots and loops are decided. The answers go back by (partition, outer node), so that a node
with millions of children is looked up once per partition and never becomes a hot
join key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import Scratch, shuffle_partitions

ROOT, LOOP, OPEN, MISSING = 0, 1, 2, 3
#: Most links that one task merges.
TASK_LINKS = 1_000_000
NAMES = ["part", "id", "anc", "off", "low", "last", "state", "seg"]
FOREST = "part int, id bigint, anc bigint, off bigint, low bigint, last bigint, state tinyint"
FOREST_PATHS = FOREST + ", seg array<bigint>"


class OffsetForest:
    """A disjoint-set forest over weighted links of a functional graph.

    Arrays by node: anc is the node reached so far, off the number of links up to
    it, low the smallest id from the node up to but without anc, last the node just
    below anc. compress() halves all paths at once until every pointer ends at a
    root, in a loop, or at a node that is not here.
    """

    def __init__(self, ids, anc, off, low, last, state):
        order = np.argsort(ids, kind="stable")
        self.id, self.anc, self.off, self.low, self.last, self.state = (np.ascontiguousarray(x[order]) for x in (ids, anc, off, low, last, state))
        self.pos = self._index(self.anc)
        self.up = self.pos.copy()

    def _index(self, wanted):
        if not len(self.id):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.id, wanted), len(self.id) - 1)
        return np.where((self.id[at] == wanted) & (self.state == OPEN), at, -1)

    def compress(self) -> OffsetForest:
        rounds = int(np.ceil(np.log2(max(len(self.id), 2)))) + 1
        for _ in range(rounds + 1):
            i = np.flatnonzero((self.state == OPEN) & (self.pos >= 0))
            if not len(i):
                return self
            j = self.pos[i]
            kind, anc, off = self.state[j], self.anc[j].copy(), self.off[j].copy()
            low, last, pos = self.low[j].copy(), self.last[j].copy(), self.pos[j].copy()
            gone, own = kind == MISSING, off == 0
            self.anc[i] = np.where(gone, self.last[i], anc)
            self.last[i] = np.where(gone | own, self.last[i], last)
            self.low[i] = np.where(gone, self.low[i], np.minimum(self.low[i], low))
            self.off[i] = np.where(gone, self.off[i] - 1, np.where(kind == LOOP, -1, self.off[i] + off))
            self.state[i] = np.where(gone, ROOT, kind)
            self.pos[i] = np.where(kind == OPEN, pos, -1)
        i = np.flatnonzero((self.state == OPEN) & (self.pos >= 0))  # as many steps as nodes: these never leave a loop
        self.anc[i], self.off[i] = self.low[self.pos[i]], -1
        self.state[i] = LOOP
        return self

    def segments(self, seg: list) -> list:
        """By node the ids from below anc down to the node; None in loops. seg: what each link spans."""
        full: list = [None] * len(self.id)
        for i in range(len(self.id)):
            if full[i] is not None or self.state[i] in (LOOP, MISSING):
                continue
            chain, k = [], i
            while k >= 0 and full[k] is None and self.state[k] != MISSING:
                chain.append(k)
                k = self.up[k]
            base = full[k] if k >= 0 and full[k] is not None else []
            for k in reversed(chain):
                base = full[k] = [*base, *seg[k]]
        return full

    def batches(self, part: int, full: list | None, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.id), rows):
            b = slice(a, a + rows)
            cols = [pa.array(np.full(len(self.id[b]), part, np.int32)), *(pa.array(x[b].astype(np.int64)) for x in (self.id, self.anc, self.off, self.low, self.last)), pa.array(self.state[b].astype(np.int8))]
            if full is not None:
                cols.append(pa.array(full[b], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=NAMES[: len(cols)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's links as a compressed forest."""
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        c = [t.column(n).to_numpy(zero_copy_only=False).copy() for n in NAMES[1:7]]
        forest = OffsetForest(*c)
        full = None
        if NAMES[7] in t.column_names:
            spans = t.column(NAMES[7]).to_pylist()
            spans = [spans[i] for i in np.argsort(c[0], kind="stable")]
            forest.compress()
            full = forest.segments(spans)
        yield from forest.compress().batches(TaskContext.get().partitionId(), full)


def unique_links(rows: DataFrame, child: str, parent: str) -> DataFrame:
    """One row (id, parent) per distinct child.

    Null children are ignored. Of rows that differ, one naming a parent counts;
    if several parents are named, the smallest.
    """
    return rows.where(F.col(child).isNotNull()).groupBy(F.col(child).cast("bigint").alias("id")).agg(F.min(F.col(parent).cast("bigint")).alias("parent"))


def _answers(level: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What a level asks for beyond its partitions, and the asked nodes' own rows."""
    asked = level.where(F.col("state") == OPEN).select("part", "anc").distinct()
    nodes = scratch.cut(asked.select(F.col("anc").alias("id")).distinct(), "nodes")
    own = level.drop("part").join(nodes, "id", "left_semi").withColumnRenamed("id", "own")
    rows = nodes.join(own, nodes.id == own.own, "left").select(
        "id",
        F.coalesce("anc", "id").alias("anc"),
        F.coalesce("off", F.lit(0)).cast("bigint").alias("off"),
        F.coalesce("low", "id").alias("low"),
        F.coalesce("last", "id").alias("last"),
        F.coalesce("state", F.lit(MISSING)).cast("tinyint").alias("state"),
        *level.columns[7:],
    )
    up = scratch.cut(rows, "asked")
    scratch.drop(nodes)
    return asked, up


def _step(with_path: bool) -> list:
    """A row's columns after its pointer, at row j, has been followed."""
    gone, loop, own = F.col("j_state") == MISSING, F.col("j_state") == LOOP, F.col("j_off") == 0
    cols = [
        F.when(gone, F.col("last")).otherwise(F.col("j_anc")).alias("anc"),
        F.when(gone, F.col("off") - 1).when(loop, F.lit(-1)).otherwise(F.col("off") + F.col("j_off")).cast("bigint").alias("off"),
        F.when(gone, F.col("low")).otherwise(F.least("low", "j_low")).alias("low"),
        F.when(gone | own, F.col("last")).otherwise(F.col("j_last")).alias("last"),
        F.when(gone, F.lit(ROOT)).otherwise(F.col("j_state")).cast("tinyint").alias("state"),
    ]
    if with_path:
        cols.append(F.when(gone, F.col("seg")).when(loop, F.lit(None)).otherwise(F.concat("j_seg", "seg")).alias("seg"))
    return cols


def _as_target(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("j"), *(F.col(c).alias(f"j_{c}") for c in NAMES[2:] if c in rows.columns))


def _give(level: DataFrame, asked: DataFrame, solved: DataFrame) -> DataFrame:
    """The level with its open rows closed by the solved nodes."""
    j = _as_target(solved)
    by_part = asked.join(j, asked.anc == j.j).drop("anc").withColumnRenamed("part", "p")
    opened = level.where(F.col("state") == OPEN)
    closed = opened.join(by_part, (opened.part == by_part.p) & (opened.anc == by_part.j)).select("part", "id", *_step("seg" in level.columns))
    return level.where(F.col("state") != OPEN).unionByName(closed)


def _forest(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_merge, FOREST_PATHS if "seg" in rows.columns else FOREST)


def _mated(rows: DataFrame, parts: int, task_links: int, level: int) -> DataFrame:
    """rows partitioned so that, whatever their order, many lie with the node they point at.

    Every node throws a coin. A row with heads goes where the node it points at goes, one
    with tails where its own id goes; so a quarter of all links are met in one task by
    chance alone. Nodes that very many rows point at are left out of this, so that no
    partition outgrows a task; such rows are leaves of the level and drop out of the next.
    """
    heads = F.xxhash64("id", F.lit(level)) % 2 == 0
    many = rows.where(F.col("state") == OPEN).groupBy("anc").agg(F.count("*").alias("_n")).where(F.col("_n") > max(task_links // 4, 1))
    crowded = [r[0] for r in many.select("anc").collect()]  # fewer than 4 rows / task_links
    follows = heads & (F.col("state") == OPEN) & ~F.col("anc").isin(crowded) if crowded else heads & (F.col("state") == OPEN)
    return rows.withColumn("_at", F.when(follows, F.col("anc")).otherwise(F.col("id"))).repartition(parts, "_at").drop("_at")


def _solve(rows: DataFrame, scratch: Scratch, task_links: int, before: int | None = None, level: int = 0) -> DataFrame:
    """Close all rows (id, anc, off, low, last, state); every anc of an open row is an id.

    Links in the order of ids are merged by ranges. Where that did not halve their number,
    the next level is partitioned by coins instead (see _mated), which shrinks it in any order.
    """
    n = rows.count()
    if n <= task_links:
        return scratch.cut(_forest(rows.repartition(1)).drop("part"), "solved")
    parts = int(np.ceil(2 * n / task_links))
    spread = rows.repartitionByRange(parts, "id") if before is None or n <= before // 2 else _mated(rows, parts, task_links, level)
    merged = scratch.cut(_forest(spread), "level")
    asked, up = _answers(merged, scratch)
    return scratch.cut(_give(merged, asked, _solve(up, scratch, task_links, n, level + 1)).drop("part"), "closed")


def _climb(links: DataFrame, scratch: Scratch, task_links: int, with_path: bool) -> DataFrame:
    nodes = scratch.cut(links.select("id", "parent"), "links")
    parts = max(shuffle_partitions(links.sparkSession), int(np.ceil(nodes.count() / task_links)), 1)
    rooted = F.col("parent").isNull()
    rows = nodes.repartitionByRange(parts, "id").select(
        "id",
        F.coalesce("parent", "id").alias("anc"),
        F.when(rooted, 0).otherwise(1).cast("bigint").alias("off"),
        F.col("id").alias("low"),
        F.col("id").alias("last"),
        F.when(rooted, ROOT).otherwise(OPEN).cast("tinyint").alias("state"),
        *([F.array("id").alias("seg")] if with_path else []),
    )
    level = scratch.cut(_forest(rows), "forest")
    scratch.drop(nodes)
    asked, up = _answers(level, scratch)
    return _give(level, asked, _solve(up, scratch, task_links))


def roots(links: DataFrame, scratch: Scratch | None = None, task_links: int = TASK_LINKS) -> DataFrame:
    """Root and depth of every node: (id, root, depth).

    links: (id, parent), one row per id (see unique_links); other columns are not read.
    A parent that is null or no id makes the node a root of depth 0. Nodes of a loop
    or leading into one get the loop's smallest id as root and depth -1; a node that
    is its own parent is a loop. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(links.sparkSession, "roots")
    out = _climb(links, scratch, task_links, False)
    return out.select("id", F.col("anc").alias("root"), F.col("off").cast("int").alias("depth"))


def paths(links: DataFrame, scratch: Scratch | None = None, task_links: int = TASK_LINKS) -> DataFrame:
    """As roots(), with the path from the root down to the node: (id, root, depth, path).

    path is an array of ids, null for nodes of a loop or leading into one. The result
    holds the sum of all depths, whatever builds it.
    """
    scratch = scratch or Scratch(links.sparkSession, "paths")
    out = _climb(links, scratch, task_links, True)
    return out.select("id", F.col("anc").alias("root"), F.col("off").cast("int").alias("depth"), F.col("seg").alias("path"))


def descendants(with_paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a result of paths(); distance is 1 or more."""
    at = with_paths.where(F.col("depth") > 0).select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return at.where(F.col("pos") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def loop_members(resolved: DataFrame, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Every node with depth -1: (id, loop, in_loop); in_loop is false for nodes that only lead into a loop.

    The link of each loop's smallest node is cut; the path of the node it pointed at
    then runs through exactly the loop.
    """
    scratch = scratch or Scratch(links.sparkSession, "loops")
    bad = scratch.cut(resolved.where(F.col("depth") == -1).select("id", F.col("root").alias("loop")).join(links.select("id", "parent"), "id"), "bad")
    cut = bad.select("id", F.when(F.col("id") != F.col("loop"), F.col("parent")).alias("parent"))
    ends = bad.where(F.col("id") == F.col("loop")).select(F.col("parent").alias("end"))
    on = paths(cut, scratch).join(ends, F.col("id") == F.col("end")).select(F.explode("path").alias("id"), F.lit(True).alias("yes"))
    return bad.join(on, "id", "left").select("id", "loop", F.coalesce("yes", F.lit(False)).alias("in_loop"))
