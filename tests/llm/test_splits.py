import random

from pyspark.sql import functions as F

from skein.llm import splits as S


def union_find(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, *keys in rows:
        for k in keys:
            if k:
                parent[find(("k", k))] = find(("r", r))
        find(("r", r))
    return {r: find(("r", r)) for r, *_ in rows}


def groups(spark, rows):
    df = spark.createDataFrame(rows, "r string, a string, b string").withColumn("component", F.lit("clash"))
    return S.record_groups(df, "r", {"a": F.col("a"), "b": F.col("b")})


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    rows = [(f"r{i:03d}", rng.choice([None, f"x{rng.randint(0, 120)}", "hot" if rng.random() < 0.1 else None]), rng.choice([None, f"y{rng.randint(0, 150)}"])) for i in range(300)]
    rows += rows[:10] + [("r000", "x5", None)]
    got = {r.r: r.component for r in groups(spark, rows).collect()}
    want = union_find([(r, a and "a" + a, b and "b" + b) for r, a, b in rows])
    assert set(got) == set(want)
    first = {}
    for r in got:
        assert first.setdefault(got[r], want[r]) == want[r]
    assert len(set(got.values())) == len(set(want.values()))


def test_long_chain_and_star(spark):
    chain = [(f"c{i:03d}", f"k{(i + 1) // 2}", f"m{i // 2}") for i in range(70)]
    star = [(f"s{i:04d}", "hub", f"leaf{i}") for i in range(1500)]
    g = groups(spark, [*chain, *star])
    assert sorted(r["n"] for r in g.groupBy("component").agg(F.count("*").alias("n")).collect()) == [70, 1500]
    j = {r.r: r.group_id for r in S.joined_groups(g, "r").collect()}
    assert set(j.values()) == {"c000", "s0000"}


def test_splits_hold_components_together_and_keep_proportions(spark):
    rows = [(f"r{i:05d}", f"g{i // 3}", None) for i in range(3000)] + [(f"h{i:05d}", "huge", None) for i in range(1500)]
    g = groups(spark, rows)
    a = S.assign_splits(g, "r", {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert a.groupBy("component").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    n = {r.split: r["n"] for r in a.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 4500 and abs(n["train"] / 4500 - 0.8) < 0.03 and n["test"] / 4500 > 0.07
    again = S.assign_splits(g.repartition(5), "r", {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert a.select("r", "split").exceptAll(again.select("r", "split")).count() == 0


def test_one_key_holds_half_of_all_rows_over_many_partitions(spark):
    rows = [(f"r{i:05d}", "hot" if i % 2 else f"k{i // 6}", f"m{i // 2}" if i % 10 == 0 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "r string, a string, b string").repartition(24)
    got = {r.r: r.component for r in S.record_groups(df, "r", {"a": F.col("a"), "b": F.col("b")}).collect()}
    want = union_find([(r, a and "a" + a, b and "b" + b) for r, a, b in rows])
    smallest = {}
    for r in sorted(want):
        smallest.setdefault(want[r], r)
    assert got == {r: smallest[want[r]] for r in want}


def test_stars_handed_on_in_parts_join_up(spark, monkeypatch):
    s = S.Stars()
    for a, b in [("c", "b"), ("d", "c"), ("z", "y")]:
        s.unite(a, b)
    assert sorted(map(tuple, s.frame().values)) == [("b", "b"), ("b", "c"), ("b", "d"), ("y", "y"), ("y", "z")]


def test_nulls_and_empty_table(spark):
    g = groups(spark, [("a", None, None), ("b", None, None), (None, "x", "y")])
    assert g.count() == 2 and S.joined_groups(g, "r").count() == 0
    assert groups(spark, []).count() == 0
    assert S.assign_splits(groups(spark, []), "r", {"train": 1.0}).count() == 0
