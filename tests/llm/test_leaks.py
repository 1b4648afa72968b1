import random

import numpy as np

from skein.llm import leaks as L


def corpus(seed=9):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(900)]
    items = {i: [rng.choice(pool) for _ in range(rng.randint(40, 80))] for i in range(12)}
    docs, want = {}, set()
    for d in range(90):
        ws = [rng.choice(pool) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.6:
            i = rng.randrange(12)
            n = max(24, int(len(items[i]) * rng.choice([0.5, 0.7, 1.0])))
            a = rng.randrange(len(items[i]) - n + 1)
            part = list(items[i][a : a + n])
            for k in range(5, len(part), 13):
                part[k] = rng.choice(pool) if rng.random() < 0.5 else part[k] + " " + rng.choice(pool)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = part
            want.add((d, i))
        elif rng.random() < 0.5:
            i = rng.randrange(12)
            ws[3:3] = items[i][:7]
        text = rng.choice([" ".join(ws), " ".join(ws).upper(), ";\n".join(ws), "<p>" + " ".join(ws) + "</p>&nbsp;"])
        docs[d] = text
    return items, docs, want


def frames(spark, items, docs):
    d = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()] + [(1000, None, ""), (1001, "", ""), (None, "x", "")], "doc_id bigint, text string, item_id string")
    return d, spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(500, "too short"), (501, None), (0, " ".join(items[0]))], "item_id bigint, text string")


def test_equals_brute_force_by_either_way(spark):
    items, docs, want = corpus()
    d, i = frames(spark, items, docs)
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == want
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i, broadcast_bytes=0).collect()} == want


def test_a_passage_in_a_third_of_all_documents(spark):
    items, _, _ = corpus()
    docs = {k: ("x y z " * 10 + " ".join(items[3]) if k % 3 == 0 else f"nothing {k} here") for k in range(600)}
    d, i = frames(spark, items, docs)
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == {(k, 3) for k in range(0, 600, 3)}


def test_empty_tables(spark):
    items, docs, _ = corpus()
    d, i = frames(spark, items, docs)
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0


def test_words_and_bounds():
    assert L.words("It&#39;s <b>A</b>—１２ café!") == ["its", "a", "12", "cafe"] and L.words(None) == []
    assert L.needed(40) == 20 and L.needed(80) == 32 and L.needed(10) == 10
    a = [str(i) for i in range(40)]
    assert best(a, a) == 40 and best(["x"] * 9, a) == 0
    assert L.stretches([50, 3, 10, 200], 20) == [(0, 30), (35, 70), (185, 220)]


def best(doc, item):
    """The definition, cell by cell."""
    score, top = [(0, 0)] * (len(item) + 1), (0, 0)
    for w in doc:
        row = [(0, 0)]
        for j, v in enumerate(item, 1):
            ways = [(x[0] - 1, x[1]) for x in (score[j - 1], score[j], row[-1])]
            s, n = max([*ways, (score[j - 1][0] + 1, score[j - 1][1] + 1)] if w == v else ways)
            row.append((s, n) if s > 0 else (0, 0))
        score, top = row, max(top, *row)
    return top[1]


def test_alignments_together_equal_the_definition():
    rng = random.Random(3)
    pairs = []
    for _ in range(150):
        item = [rng.randrange(30) for _ in range(rng.randint(1, 40))]
        doc = [rng.randrange(30) for _ in range(rng.randint(0, 20))] + [x for x in item if rng.random() < 0.9] + [rng.randrange(30) for _ in range(rng.randint(0, 20))]
        pairs.append((np.array(doc or [0]), np.array(item)))
    got = L.aligned([d for d, _ in pairs], [i for _, i in pairs])
    assert [int(x) for x in got] == [best(list(d), list(i)) for d, i in pairs]


def test_a_frequent_shingle_in_every_item_and_document(spark):
    items, docs, want = corpus()
    boiler = "please see our terms and conditions today"
    items = {k: [*v, *boiler.split()] for k, v in items.items()}
    docs = {k: f"{v} {boiler}" if not v.startswith("<p>") else v for k, v in docs.items()}
    d, i = frames(spark, items, docs)
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(d.repartition(12), i).collect()}
    assert want <= got and len(got) <= len(want) + 3
