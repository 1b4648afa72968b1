import random

import pytest

from skein.llm import overlap as O
from skein.llm import queries as Q

SCHEMA = "annotation_id string, conversation_id string, split string, source string, text_display string"


def similar(a, b):
    return len(a & b) / len(a | b)


def rows(n=260):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    out, bases = [], [[rng.choice(pool) for _ in range(rng.randint(4, 25))] for _ in range(30)]
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            ws[rng.randrange(len(ws))] = rng.choice(pool)
        text = rng.choice([" ".join(ws), " ".join(ws).upper(), "@you " + " ".join(ws) + " https://x.y/z", None, "", " ".join(ws).replace("w", "ｗ")])
        out.append((f"a{i:03d}", rng.choice([None, " ", f"conv_{rng.randint(0, 90)}", f" CONV_{rng.randint(0, 90)} "]), rng.choice(["train", "train", "test", "validation", None, "other"]), rng.choice(["s1", "s2", None]), text))
    return out + out[:5] + [(None, "conv_1", "train", "s1", "x")]


@pytest.mark.parametrize("seed", [1])
def test_pairs_equal_brute_force(spark, seed):
    import re

    data = rows()
    got = {tuple(r) for r in O.CrossSplit(spark.createDataFrame(data, SCHEMA), "annotation_id", "text_display").pairs().collect()}
    known = [(k, (c or "").strip().lower(), s, frozenset(re.findall(r"\w+", re.sub(r"@\w+|https\S+", " ", (t or "").lower().replace("ｗ", "w"))))) for k, c, s, _, t in data if k and s in ("train", "test", "validation")]
    want = set()
    for a in known:
        for b in known:
            if a[2] == "train" and b[2] != "train" and a[0] != b[0] and (a[1] and a[1] == b[1] or min(len(a[3]), len(b[3])) >= 6 and similar(a[3], b[3]) >= 0.8 - 1e-12):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and want


def test_a_hot_group_of_copies(spark):
    text = "one two three four five six seven"
    data = [(f"t{i}", None, "train", "s", text) for i in range(2000)] + [("v1", None, "test", "s", text + " eight"), ("v2", None, "test", "s", "else " * 7)]
    x = O.CrossSplit(spark.createDataFrame(data, SCHEMA), "annotation_id", "text_display")
    assert x.pairs().count() == 2000
    r = {r.split: (r.records, r.overlapping, r.near_same_words) for r in x.report().collect()}
    assert r == {"test": (2, 1, 1)}


def test_empty_table(spark):
    x = O.CrossSplit(spark.createDataFrame([], SCHEMA), "annotation_id", "text_display")
    assert x.pairs().count() == 0 and x.report().count() == 0


def test_repeated_words_count_towards_the_least_length(spark, tmp_path):
    data = [("t1", None, "train", "s", "no no no no reply again"), ("v1", None, "test", "s", "No, no reply again! No no"), ("t2", None, "train", "s", "no way to go there"), ("v2", None, "test", "s", "no way to go there")]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/b02_fresh_labelled.parquet")
    x = Q._overlap(spark, str(tmp_path))
    assert [tuple(r) for r in x.pairs().collect()] == [("t1", "v1")]
    assert [(r.records, r.overlapping, r.same_words) for r in x.report().collect()] == [(2, 1, 1)]
