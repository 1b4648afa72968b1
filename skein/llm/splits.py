"""Splits that keep related records together.

Records and their keys are nodes of a graph. Every task first unites the links it reads
itself; each of its parts is known by its smallest record from then on, and only records
and keys that several tasks saw link parts. Hash-to-Min finds the components of the parts:
every node sends its cluster to the cluster's smallest node and that node to the rest,
until nothing changes. Clusters are kept as rows (node, member), never as lists, so a
component of any size is spread over the cluster. Weighted rendezvous hashing then
gives each component a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.ids import number_key, text_key
from skein.operators.skew import lookup
from skein.session import Scratch

#: At most this many nodes can hold 1/HOT of all rows each; their minima are broadcast.
HOT = 500
MAX_ROUNDS = 60
#: Nodes a task unites before it hands its stars on; it starts afresh then.
TASK_NODES = 500_000
#: What records are marked by as nodes; smaller than any key, so that a component is named after a record.
RECORD = "\x01"


class Stars:
    """Nodes united by links, as stars around the smallest node of each part."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        top = x
        while (y := self.up.setdefault(top, top)) != top:
            top = y
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def unite(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def frame(self) -> pd.DataFrame:
        nodes = list(self.up)
        return pd.DataFrame({"a": [self.find(x) for x in nodes], "b": nodes}, dtype=object)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    s = Stars()
    for b in batches:
        for r, keys in zip(b["record"], b["keys"], strict=True):
            s.find(r)
            for k in keys:
                s.unite(r, k)
        if len(s.up) > TASK_NODES:
            yield s.frame()
            s = Stars()
    yield s.frame()


def _exchange(c: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """One round over n rows: (v, u) means that u is in v's cluster; u = v is always there."""
    stats = scratch.cut(c.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("size")), "minima")
    hot = [r[0] for r in stats.where(F.col("size") * HOT > n + HOT).select("v").collect()]  # fewer than HOT by counting
    told = lookup(c, "v", stats.select("v", "m"), "inner", keys=hot)
    sent = told.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
    new = scratch.cut(sent.distinct(), "clusters")
    scratch.drop(stats)
    return new


def _mark(c: DataFrame) -> tuple:
    r = c.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of an undirected graph (a, b); component is its smallest node.

    Nodes are compared as strings; an edge (a, a) makes a node known; null ends are
    ignored. The number of rounds grows with the logarithm of the longest chain.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")))).alias("x"))
    c = scratch.cut(both.select("x.v", "x.u").distinct(), "clusters")
    mark = _mark(c)
    if not mark[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        new = _exchange(c, mark[0], scratch)
        scratch.drop(c)
        c, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return c.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def record_groups(rows: DataFrame, record: str, keys: dict[str, Column], scratch: Scratch | None = None) -> DataFrame:
    """(record, component): records that share a key, directly or through others, share a component.

    keys: name to canonical key column, null where a key joins nothing. A record without
    any key is a component of its own, a record that occurs in several rows joins all
    their keys, and rows without a record are ignored. A component is named after its
    smallest record. Records and components are strings.
    """
    scratch = scratch or Scratch(rows.sparkSession, "groups")
    tagged = F.array_compact(F.array(*(F.concat(F.lit(f"{name}\x01"), k) for name, k in keys.items())))
    has = rows.where(F.col(record).isNotNull()).select(F.concat(F.lit(RECORD), F.col(record).cast("string")).alias("record"), tagged.alias("keys"))
    stars = scratch.cut(has.mapInPandas(_stars, "a string, b string"), "stars")
    # a node occurs once per task that saw it
    known = scratch.cut(stars.groupBy("b").agg(F.min("a").alias("part"), F.count("*").alias("n")), "parts")
    links = stars.join(known.where(F.col("n") > 1), "b").where(F.col("a") != F.col("part")).select(F.col("part").alias("a"), F.col("a").alias("b")).distinct()
    comp = components(scratch.cut(links, "links"), scratch).select(F.col("node").alias("part"), "component")
    records = scratch.cut(known.where(F.startswith("b", F.lit(RECORD))).select("b", "part"), "records")
    named = lookup(records, "part", scratch.cut(comp, "components"))
    out = named.select(F.substr("b", F.lit(2)).alias(record), F.substr(F.coalesce("component", "part"), F.lit(2)).alias("component"))
    return scratch.cut(out, "groups")


def joined_groups(groups: DataFrame, record: str) -> DataFrame:
    """(record, group_id) for records joined with at least one other; group_id is the smallest record.

    A component is named after its smallest record, so all others show that it is shared;
    no group is gathered.
    """
    others = groups.where(F.col(record) != F.col("component")).select(record, F.col("component").alias("group_id"))
    return others.unionByName(others.select(F.col("group_id").alias(record), "group_id").distinct())


def _uniform(*cols: Column) -> Column:
    """A number in (0, 1) from a hash; equal on every engine for equal values."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rendezvous(component: Column, weights: dict[str, float], seed: int) -> Column:
    """The split with the best weighted rendezvous score, -w / ln(u)."""
    scored = [F.struct((-F.lit(float(w)) / F.log(_uniform(component, F.lit(name), F.lit(str(seed))))).alias("score"), F.lit(name).alias("split")) for name, w in sorted(weights.items()) if w > 0]
    return F.array_max(F.array(*scored))["split"] if scored else F.lit(sorted(weights)[0])


def assign_splits(groups: DataFrame, record: str, weights: dict[str, float], seed: int = 42, scratch: Scratch | None = None, large: int = 1000) -> DataFrame:
    """(record, component, split) with whole components in one split.

    Fewer than `large` components can hold 1/large of the records each. These are placed
    first, largest first, each in the split whose remaining room in proportion to its
    weight is greatest (equal room: rendezvous order), as hashing alone would let one of
    them upset the proportions; all others follow by rendezvous hashing, weighted by the
    room that is left. Adding records leaves most components where they were.
    """
    scratch = scratch or Scratch(groups.sparkSession, "splits")
    spark = groups.sparkSession
    sizes = scratch.cut(groups.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    big = sizes.where(F.col("n") * large > total).withColumn("first", rendezvous(F.col("component"), weights, seed)).orderBy(F.desc("n"), "component").limit(large).collect()
    whole = sum(weights.values())
    room = {s: total * w / whole for s, w in weights.items()}
    placed = []
    for r in big:
        s = max(room, key=lambda k: (room[k] / max(weights[k], 1e-12), k == r["first"], k))
        room[s] -= r["n"]
        placed.append((r["component"], s))
    fixed = spark.createDataFrame(placed, T.StructType([T.StructField("component", T.StringType()), T.StructField("split", T.StringType())]))
    left = {s: max(r, 0.0) for s, r in room.items()}
    left = left if any(left.values()) else dict(weights)
    small = groups.join(F.broadcast(fixed.select("component")), "component", "left_anti").withColumn("split", rendezvous(F.col("component"), left, seed))
    return groups.join(F.broadcast(fixed), "component").unionByName(small).select(record, "component", "split")


def golden_keys() -> dict[str, Column]:
    return {"author": number_key(F.col("customer_author_id")), "conversation": text_key(F.col("conversation_id"))}
