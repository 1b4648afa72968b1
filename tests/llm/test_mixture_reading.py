import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import kinds as K
from skein.llm import mixture as M
from skein.llm import reading as R

needs_vocabulary = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no vocabulary file here")


def test_rake_meets_the_marginals():
    cells = {("a", "en", "x"): 600.0, ("a", "es", "y"): 200.0, ("b", "en", "y"): 300.0, ("b", "es", "x"): 100.0}
    use = M.rake(cells, {"a": M.Target(0.5, 3), "b": M.Target(0.5, 3)}, {"en": 0.7, "es": 0.3}, {"x": 0.5, "y": 0.5}, 1000.0)
    got = {k: use[k] * cells[k] for k in use}
    assert sum(v for k, v in got.items() if k[0] == "a") == pytest.approx(500, rel=1e-6)
    assert sum(v for k, v in got.items() if k[1] == "en") == pytest.approx(700, rel=1e-3)


def test_rake_respects_repeats():
    use = M.rake({("a", "en", "x"): 100.0, ("b", "en", "x"): 900.0}, {"a": M.Target(0.5, 2), "b": M.Target(0.5, 2), "none": M.Target(0.1, 2)}, {"en": 1.0}, {"x": 1.0}, 1000.0)
    assert use[("a", "en", "x")] == 2.0 and use[("b", "en", "x")] == pytest.approx(500 / 900)
    assert M.rake({}, {}, {}, {}, 10.0) == {}


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "the bag and the gate " * rng.randint(1, 9), "clash") for i in range(900)] + [(1000, "a", None, ""), (1001, "b", "", ""), (1002, "b", "x " * 30_000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, weight string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    sample, report, marginals = M.mix(docs, targets, least_part=0.5)
    got = {r.source: r for r in report.collect()}
    assert got["gone"].tokens == 0 and got["a"].most_copies == 1 and got["b"].most_copies <= 3
    assert sample.where("source NOT IN ('a', 'b')").count() == 0 and sample.agg(F.count_distinct("doc_id") == F.count("*")).first()[0]
    again = M.mix(docs.repartition(3), targets, least_part=0.5).sample
    assert sample.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).count() == 0
    assert {r.source: r.limit for r in report.collect()} == {"a": "repeats", "b": "none", "gone": "no documents"}
    shares = {(r.axis, r.name): r.reached_share for r in marginals.collect()}
    assert shares["source", "gone"] == 0 and sum(v for (a, _), v in shares.items() if a == "language") == pytest.approx(1)
    none = M.mix(docs.limit(0), targets).report
    assert none.count() == 3 and none.agg(F.sum("tokens")).first()[0] == 0


@needs_vocabulary
def test_every_listed_source_counts(spark):
    n = 10_050
    targets = spark.range(n, numPartitions=1).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(1.0 / n).alias("target_share"), F.lit(2).alias("max_repeats"))
    docs = spark.createDataFrame([(i, s, "the bag and the gate") for i, s in enumerate(["s0", f"s{n - 1}"])], "doc_id bigint, source string, text string")
    report = M.mix(docs, targets).report
    got = {r.source: r.tokens for r in report.where("tokens > 0").collect()}
    assert set(got) == {"s0", f"s{n - 1}"}


def test_languages_on_held_out_texts():
    """Learned from texts of which one in ten has a wrong code."""
    say = {
        "en": "the bag was lost at the gate and nobody at the desk could tell me when it will come back from the airport".split(),
        "fr": "bonjour je voudrais savoir pourquoi le vol est annulé depuis hier et quand je serai remboursé pour les billets ça fait".split(),
        "es": "hola necesito saber por qué el vuelo fue cancelado ayer y cuándo me van a devolver el dinero de los billetes".split(),
        "de": "guten tag ich möchte wissen warum der flug gestern gestrichen wurde und wann ich mein geld für die karten zurück bekomme".split(),
        "ru": "здравствуйте скажите почему рейс отменили вчера и когда вернут деньги за билеты которые мы купили в прошлом месяце".split(),
    }
    rng = random.Random(12)
    make = lambda k, n: " ".join(rng.choice(say[k]) for _ in range(n))
    rows = [(make(k, 25), k if rng.random() < 0.9 else rng.choice(sorted(say))) for k in sorted(say) for _ in range(40)]
    order, table = K.fit_languages([t for t, _ in rows], [n for _, n in rows])
    assert order == sorted(say)
    s = K.Scorer(K.Kinds(order, table, [], np.zeros((K.WORDS, 0))))
    tests = [(k, make(k, 6)) for k in sorted(say) for _ in range(60)]
    assert sum(s.of(K.word_counts(t))[0] == k for k, t in tests) >= 0.97 * len(tests)
    assert s.of(K.word_counts("12 34 …")) == ("other", "other")


def test_topics_tell_texts_apart():
    rng = random.Random(13)
    pools = ["suitcase luggage carousel handle wheels zipper".split(), "refund charge invoice payment card billing".split(), "engine turbulence runway captain cockpit altitude".split()]
    texts = [" ".join(rng.choice(pools[i % 3]) for _ in range(15)) for i in range(150)]
    names, weight = K.fit_topics(texts, 3)
    s = K.Scorer(K.Kinds([], np.zeros((K.TRIGRAMS, 0)), names, weight))
    got = [s.of(K.word_counts(" ".join(rng.choice(pools[i % 3]) for _ in range(8))))[1] for i in range(90)]
    assert len(set(got)) == 3 and all(got[i] == got[i % 3] for i in range(90))
    assert K.fit_topics([])[0] == [] and K.fit_languages([], [])[0] == []


@needs_vocabulary
def test_tokens_round_trip():
    e = M.encoder(M.TOKENIZER)
    for t in ("", "Hello there, naïve café 12", "x" * 1000, "Ωж\n\n  "):
        assert e.decode(e.encode_ordinary(t)) == t


def test_sentences_as_a_reader_counts():
    n = lambda t: len(R.sentences(t))
    assert n("One two. Three four! Five?") == 3
    assert n("See Reg. No. 4, Vol. 2, i.e. the annex, e.g. Ch. 3. It ends.") == 2
    assert n("- first line\n- second line\n- third line") == 3
    assert n("A line that is broken\nin the middle of it.\nAnother one.") == 2
    assert n("Read https://a.b/c.d?e=f. now\nplease") == 1 and n("") == 0 and n("   \n\n ") == 0
    assert n("Dr. Ada Low came at 5 p.m. on Monday. She left.") == 2
    assert n("<p>One here.</p><p>Two here.</p>") == 2


def test_grades_and_english():
    easy = "The cat sat on the mat. It was a red cat. We saw it run."
    hard = "Notwithstanding any contrary representation communicated by an intermediary institution, the supervisory authority reserves the discretionary prerogative to reclassify the evidentiary sufficiency of telephonic authorization procedures."
    assert R.grade(R.sentences(easy)) < 3 < 20 < R.grade(R.sentences(hard))
    english = lambda t: R.is_english(R.sentences(t))
    assert english(easy) and not english("Никто не отвечает") and not english("Nadie contestó el teléfono desde las ocho") and not english("")


def test_levels_on_held_out_documents(spark):
    rng = random.Random(11)
    short = ["The cat ran to the {}.", "We saw a {} by the door.", "Mom put the {} in the bag.", "It is a big {}."]
    long = ["Notwithstanding the {} stipulated hereinafter, the administrative authority reserves considerable discretion concerning interpretation.", "The evidentiary sufficiency of the {} necessitates comprehensive institutional reconciliation in the jurisdiction."]
    words = "dog map bus hat provision obligation procedure requirement".split()
    make = lambda pool: " ".join(rng.choice(pool).format(rng.choice(words)) for _ in range(10))
    docs = [(i, make(short if i % 2 else long)) for i in range(80)]
    model = R.train([t for _, t in docs[:40]], [1.0 if i % 2 else 5.0 for i, _ in docs[:40]])
    df = spark.createDataFrame([*docs[40:], (100, None), (101, ""), (102, "123 456")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in R.reading_levels(df, model).collect()}
    assert all((got[i].level < 2.5) == bool(i % 2) and (got[i].level < R.COLLEGE) == bool(i % 2) for i, _ in docs[40:])
    assert got[100].level is None and got[100].n_words == 0 and not got[101].english
    assert R.reading_levels(df.limit(0), model).count() == 0
    assert [r.level for r in R.reading_levels(df, None).collect()] == [None] * 43
    with pytest.raises(ValueError, match="no labelled"):
        R.train([], [])
    labels = spark.createDataFrame([(40, "r", 9), (41, "r", None), (42, "r", 3), (None, "r", 2)], "doc_id bigint, rater_id string, reading_level int")
    texts, levels = R.labelled_sample(df, labels)
    assert levels == [3.0] and len(texts) == 1


def test_scorer_equals_the_models_themselves():
    rng = np.random.default_rng(1)
    w = lambda: rng.normal(size=(R.BUCKETS + 1, R.LEVELS)).astype(np.float32)
    m = R.Model(w(), w(), (0.0, 1.0))
    for words in (["One", "two", "three"], ["x"], ["Naïve", "12", "co-op"] * 40):
        want = []
        for weights, f in ((m.chars, R.char_features(words)), (m.words, R.word_features(words))):
            z = weights[f].astype(float).sum(axis=0) / np.sqrt(len(f)) + weights[-1]
            z = np.exp(z - z.max())
            want.append(z / z.sum())
        for table in (100, 2):
            assert np.allclose(R.Scorer(m, table).sentences([["a", "b"], words])[1], np.mean(want, axis=0), atol=1e-4)
