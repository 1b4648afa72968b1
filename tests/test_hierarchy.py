import random

import pytest
from pyspark.sql import functions as F

from skein.functions.ids import number_key, numeric_id, text_key
from skein.operators import hierarchy as H

SCHEMA = "id bigint, parent bigint"


def brute(parents):
    out = {}
    for k in parents:
        path, seen, v = [k], {k: 0}, k
        while True:
            p = parents[v]
            if p is None or p not in parents:
                out[k] = (v, len(path) - 1, path[::-1])
                break
            if p in seen:
                out[k] = (min(path[seen[p] :]), -1, None)
                break
            seen[p] = len(path)
            path.append(p)
            v = p
    return out


def graph(n, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(n * 5), n)
    parents = {}
    for i, k in enumerate(ids):
        r = rng.random()
        parents[k] = None if r < 0.1 else rng.choice(ids) if r < 0.2 else ids[max(0, i - rng.randint(1, 3))] if r < 0.95 and i else 10**9 + i
    parents[ids[0]] = ids[0]
    return parents


@pytest.mark.parametrize(("n", "cap"), [(300, 20), (300, 10**6), (60, 3)])
def test_roots_and_paths_equal_a_walk(spark, n, cap):
    parents = graph(n, n + cap)
    df = spark.createDataFrame(list(parents.items()), SCHEMA)
    want = brute(parents)
    got = {r.id: (r.root, r.depth, r.path) for r in H.paths(df, task_links=cap).collect()}
    assert got == want
    assert {r.id: (r.root, r.depth) for r in H.roots(df, task_links=cap).collect()} == {k: v[:2] for k, v in want.items()}


def test_a_chain_in_random_order_is_merged_by_random_mates(spark):
    ids = random.Random(1).sample(range(10_000), 200)
    parents = dict(zip(ids, [None, *ids[:-1]], strict=True))
    df = spark.createDataFrame(list(parents.items()), SCHEMA)
    got = {r.id: r.depth for r in H.roots(df, task_links=10).collect()}
    assert got == {k: i for i, k in enumerate(ids)}


def test_star_and_long_chain(spark):
    star = [(0, None), *((i, 0) for i in range(1, 3000))]
    chain = [(10_000 + i, 10_000 + i - 1 if i else None) for i in range(3000)]
    got = H.roots(spark.createDataFrame(star + chain, SCHEMA), task_links=500).groupBy("root").agg(F.max("depth").alias("d"), F.count("*").alias("n")).collect()
    assert sorted((r.root, r.d, r.n) for r in got) == [(0, 1, 3000), (10_000, 2999, 3000)]


def test_empty_table_and_extra_columns(spark):
    assert H.roots(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, "x", 5), (2, 1, None, 6)], "id bigint, parent bigint, root string, depth int")
    assert sorted(map(tuple, H.roots(df).collect())) == [(1, 1, 0), (2, 1, 1)]


def test_rows_of_a_message_that_differ(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2), (2, None), (None, 1)], "c bigint, p bigint")
    assert sorted(map(tuple, H.unique_links(df, "c", "p").collect()), key=str) == [(1, 2), (2, None)]


def test_descendants_and_loop_members(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (5, 6), (6, 5), (7, 6), (8, 8)], SCHEMA)
    d = H.descendants(H.paths(df)).collect()
    assert sorted(map(tuple, d)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    m = H.loop_members(H.roots(df), df).collect()
    assert sorted(map(tuple, m)) == [(5, 5, True), (6, 5, True), (7, 5, False), (8, 8, True)]


def test_writings_of_keys(spark):
    texts = ["12", " 12", "12.0", "012", "1.2e1", "１２", "1,200", "12.5", "12x", "", None, "nan", "-3", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(numeric_id(F.col("t")), number_key(F.col("t")), text_key(F.col("t"))).collect()]
    assert [g[0] for g in got] == [12, 12, 12, 12, 12, 12, 1200, None, None, None, None, None, -3, None]
    assert [g[1] for g in got][:8] == ["12"] * 6 + ["1200", "12.5"]
    assert got[9][2] is None and got[10][2] is None


def test_half_of_all_links_point_at_one_node_in_random_order(spark):
    rng = random.Random(4)
    ids = rng.sample(range(1, 50_000), 600)
    parents = {k: 0 if i % 2 else ids[i - 2] if i > 1 else 0 for i, k in enumerate(ids)} | {0: None}
    parents |= {100_000 + i: k for i, k in enumerate(ids)}
    df = spark.createDataFrame(list(parents.items()), SCHEMA).repartition(8)
    want = brute(parents)
    assert {r.id: (r.root, r.depth) for r in H.roots(df, task_links=60).collect()} == {k: v[:2] for k, v in want.items()}
