import os
import random

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import prefixes as P
from skein.operators import similarity as J
from skein.session import Scratch

SF = "/root/testdata/sf0.1"


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_words_and_passes_in_several_parts_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT", 7)
    monkeypatch.setattr(P, "ONE_PASS", 500)
    rng = random.Random(8)
    base = [[rng.randint(0, 400) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    sets = {}
    for i in range(400):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 1 else s.add(rng.randint(0, 400))
        sets[f"k{i}"] = s
    df = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in sets.items()], "id string, toks array<string>")
    members, links = J.near_duplicates(df, "id", F.col("toks"), Scratch(spark, "parts"))
    cls = {r.key: r.class_id for r in members.collect()}
    reps = sorted(set(cls.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-12}
    assert len(want) > 100 and {(r.a, r.b) for r in links.collect()} == want


def test_pairs_take_little_disk(spark):
    """What the similarity join shuffles stays under four times the documents."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    s, before = Scratch(spark, "little"), shuffled(spark)
    J.near_duplicates(d, "doc_id", X.canonical_tokens(F.col("text")), s)
    assert shuffled(spark) - before < 4 * os.path.getsize(f"{SF}/documents.parquet")


def test_members_take_little_disk(spark, tmp_path):
    """near_dup_members: shuffles and tables that stay are under six times the documents."""
    s, before = Scratch(spark, "members"), shuffled(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    J.near_duplicates(d, "doc_id", X.canonical_tokens(F.col("text")), s)[0].write.parquet(str(tmp_path / "members"))
    kept = sum(os.path.getsize(os.path.join(a, f)) for a, _, c in os.walk(s.base.removeprefix("file:")) for f in c)
    assert 0 < kept and shuffled(spark) - before + kept < 6 * os.path.getsize(f"{SF}/documents.parquet")


def test_disk_does_not_follow_the_pairs(spark, monkeypatch, tmp_path):
    """near_dup_members: texts of few phrases are alike in many pairs; their sets are not shuffled once a pair, and several blocks give all pairs."""
    monkeypatch.setattr(J, "BLOCK_BYTES", 300_000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(3)
        words = [f"word{rng.getrandbits(60):x}" for _ in range(150)]
        sets = {i: set(rng.sample(words, rng.randint(130, 140))) for i in range(600)}
        df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id bigint, toks array<string>")
        s, before = Scratch(spark, "phrases"), shuffled(spark)
        members, links = J.near_duplicates(df, "id", F.col("toks"), s)
        took = shuffled(spark) - before
        got, linked = {(r.a, r.b): r.jaccard for r in links.collect()}, {r.key: r.n_links for r in members.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert got == {p: x for p, x in share.items() if x >= 0.8 - 1e-12} and len(got) > 50_000
    assert linked == {i: sum(i in p for p in got) for i in sets}
    assert took < 20_000_000, took


def test_sets_of_a_repeated_key_are_all_compared(spark):
    a, b, c = [str(i) for i in range(20)], [str(i) for i in range(1, 20)], [str(i) for i in range(50, 60)]
    sets = spark.createDataFrame([("x", a), ("x", c), ("y", b), ("y", b + [None])], "key string, tokens array<string>")
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    got = sorted(r.jaccard for r in J._alike(sets, pairs, Scratch(spark, "twice"), 0.8).collect())
    assert got == [19 / 21, 19 / 20]
