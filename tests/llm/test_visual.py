import random
import unicodedata

import pytest

from skein.llm import visual as V

CLEAN = "The office café finished at 8:50am, see @VelaAir"
VARIANTS = [
    "Ｔｈｅ office café finished at 8:50am, see @VelaAir",
    "The oﬃce café ﬁnished at 8:50am, see @VelaAir",
    unicodedata.normalize("NFD", CLEAN),
    "The office café finished at 8:50am, see @VelaAir  ",
    "﻿The of​fice ca­fé finished at 8:50am, see @Vela⁠Air",
    "Τhе оffісе cаfé finished at 8:50аm, see @VelаAir",
]
OTHER = [CLEAN.lower(), CLEAN.replace("é", "e"), CLEAN.replace(",", ";"), CLEAN.replace("8", "9"), CLEAN + " now"]


@pytest.mark.parametrize("text", VARIANTS)
def test_same_look(text):
    assert text != CLEAN and V.look(text) == V.look(CLEAN)


@pytest.mark.parametrize("text", OTHER)
def test_another_look(text):
    assert V.look(text) != V.look(CLEAN)


def test_fold_is_idempotent_and_keeps_pictures():
    rng = random.Random(1)
    pool = "aé  ​́ｆﬁ…Ωж👩‍✈️\n\tº²"
    for _ in range(300):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert V.fold(V.fold(t)) == V.fold(t)
    assert V.fold("👩‍✈") == "👩‍✈" and V.fold("3º m²") == "3º m²" and V.fold("​  ") == ""


def test_repair_only_mixed_tokens_known_to_the_corpus(spark):
    rows = [(1, "lounge in Halden"), (2, "lоungе in Hаlden"), (3, "хyzzу"), (4, "Опоздали на оса"), (5, None), (6, ""), (7, "​"), (8, "мост и лoжка"), (9, "ложка")]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "id int, text string, repaired string")
    got = {r.id: r.repaired for r in V.repair(df, "text").collect()}
    assert got == {1: "lounge in Halden", 2: "lounge in Halden", 3: "хyzzу", 4: "Опоздали на оса", 5: None, 6: "", 7: "", 8: "мост и ложка", 9: "ложка"}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [CLEAN, *VARIANTS, *OTHER, "ok", "ok", "ｏk", None, "", "​", "тоже"]
    rows = [(f"a{i:03d}", rng.choice(texts)) for i in range(120)] + [("a000", CLEAN), ("a000", VARIANTS[0]), (None, CLEAN)]
    df = spark.createDataFrame(rows, "k string, t string").selectExpr("k", "t", "1 AS class_id", "2 AS variant")
    got = {tuple(r) for r in V.same_look_pairs(V.same_look(df, "k", "t"), "k").collect()}
    known = sorted({(k, t) for k, t in rows if k and t and V.look(t)})
    want = {(min(a, b), max(a, b)) for a, s in known for b, t in known if a != b and s != t and V.look(s) == V.look(t)}
    assert got == want


def test_without_repair_mixed_tokens_stay_apart(spark):
    mixed = VARIANTS[-1]
    assert V.class_form(V.fold(mixed)) != V.class_form(CLEAN)  # what the classes would be without the repair
    # no text has the word as it should be, but two writings come down to it; a single mixed writing stays alone
    rows = [("a", "cаll"), ("b", "сall"), ("c", "саӏӏ"), ("d", "zoоm"), ("e", "zoom!"), ("f", "flіght"), ("g", "flight 2")]
    got = {tuple(r) for r in V.same_look_pairs(V.same_look(spark.createDataFrame(rows, "k string, t string"), "k", "t"), "k").collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    alone = V.repair(spark.createDataFrame([("cаll us",), ("we call",)], "t string"), "t").where("t like 'c%'").first().repaired
    assert alone == "call us" and V.repair(spark.createDataFrame([("cаll us",)], "t string"), "t").first().repaired == "cаll us"


@pytest.mark.parametrize(("a", "b"), [("Ꭺ", "A"), ("ϲ", "c"), ("ɑ", "a"), ("ɡ", "g"), ("𝐀", "A"), ("ı", "i")])
def test_forms_of_a_letter(a, b):
    assert V.look(a) == V.look(b) and V.class_form(V.fold(a)) == b


def test_empty_table(spark):
    assert V.same_look(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0
