import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import blocks as B
from skein.operators import similarity as J
from skein.session import Scratch, read


def codes(s, tag, level, t=0.8):
    sets = B.Sets(pd.Series([np.array(sorted(s))]), t)
    return set(B.block_codes(sets.flat, sets.row, 1, tag, B.scheme(tag, level, t))[0].tolist())


@pytest.mark.parametrize("level", range(len(B.LEVELS)))
def test_no_pair_within_the_radius_is_missed(level):
    rng = random.Random(3 + level)
    words = [rng.getrandbits(63) for _ in range(4000)]
    seen = 0
    for _ in range(300):
        a = set(rng.sample(words, rng.randint(1, 240)))
        b = set(a)
        for _ in range(rng.randint(0, max(1, len(a) // 8))):
            if rng.random() < 0.5 and len(b) > 6:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.choice(words))
        if len(a & b) / len(a | b) < 0.8:
            continue
        seen += 1
        ka, kb = B.size_class(len(a), 0.8), B.size_class(len(b), 0.8)
        assert abs(ka - kb) <= 1
        assert any(codes(a, k, level) & codes(b, k, level) for k in {ka, ka + 1} & {kb, kb + 1})
        sets = B.Sets(pd.Series([np.array(sorted(a)), np.array(sorted(b))]), 0.8)
        f = B.fingerprints(sets.flat, sets.row, 2)
        assert sum(int(p ^ q).bit_count() for p, q in zip(f[0], f[1], strict=True)) <= B.radius(len(a), len(b), 0.8)
    assert seen > 100


def test_schemes_are_complete():
    for t in (0.5, 0.8, 0.9):
        for tag in range(24):
            most = B.largest_size(tag, t)
            for level in range(len(B.LEVELS)):
                s = B.scheme(tag, level, t)
                assert s.n1 * (s.k2 + 1) > B.radius(most, most, t) and s.n2 > s.k2


def test_size_classes():
    for n in range(1, 400):
        k = B.size_class(n, 0.8)
        assert B.size_class(B.largest_size(k, 0.8), 0.8) == k and B.largest_size(k, 0.8) >= n


def test_any_level_gives_the_same_candidates_that_hold(spark):
    rng = random.Random(5)
    base = [[rng.getrandbits(62) for _ in range(rng.randint(6, 90))] for _ in range(20)]
    rows = []
    for i in range(300):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 3 else s.add(rng.getrandbits(62))
        rows.append((i, sorted(s)))
    df = spark.createDataFrame(rows, "class_id int, hashes array<bigint>")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
    for level in (0, 2, 4):
        c = B.coded(df, 0.8, levels={k: level for k in range(60)})
        assert want <= {tuple(r) for r in B.candidates(c, c, 0.8, same=True).collect()}
    assert want


def test_few_candidates_on_documents(spark):
    """Where every word is frequent, few pairs are left to compare, and joined rows stay well below all pairs."""
    t = X.canonical_tokens(F.col("text"))
    s = Scratch(spark, "few")
    _, classes = J.token_classes(read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text"), "doc_id", t, s)
    n = classes.count()
    c = s.cut(B.coded(J._hashes(classes), 0.8), "codes")
    joined = c.select(F.explode("codes").alias("code")).groupBy("code").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    met = B.candidates(c, c, 0.8, same=True).count()
    assert met < 0.001 * n * (n - 1) / 2 and joined < 0.15 * n * (n - 1) / 2, (n, joined, met)
