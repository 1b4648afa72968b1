import datetime as dt
import difflib

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import conversations as C
from skein.operators import grounding as G
from skein.operators import labels as L
from skein.operators import leakage as K
from skein.operators import metrics as M
from skein.operators import ranks
from skein.operators import retrieval as V
from skein.operators import sampling as A
from skein.operators import similarity as J
from skein.operators import tfidf as T
from skein.plans.annotation import _item_id
from skein.session import Scratch
from skein.sources import readers, sinks
from skein.streaming import stream


def one(df):
    return df.collect()[0]


def col(spark, values, fn):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(fn(F.col("c"))).collect()]


def test_normalisers(spark):
    t = "Hi @Brand, see https://x.y/z #Late  Don't\nwait"
    assert col(spark, [t, None, ""], X.canonical) == ["hi see late don't wait", "", ""]
    assert col(spark, ["A &amp; B &lt;x&gt; #Tag @me"], X.discovery_form) == ["a & b <x> tag"]
    assert col(spark, ["@12 Hello  There"], X.sanitised) == ["Hello There"]
    assert col(spark, ["a\r\n\nb"], X.display_form) == ["a / b"]
    assert col(spark, ["ab cd ef"], lambda c: X.ngrams(F.split(c, " "), 3)) == [["ab", "cd", "ef", "ab cd", "cd ef", "ab cd ef"]]
    assert col(spark, ["Mon Oct 23 23:54:23 +0200 2023", "2023-12-02T19:33:53Z", "05-09-2023 04:27", "0000-00-00", "x", None], lambda c: F.unix_micros(X.parsed_time(c))) == [1698098063000000, 1701545633000000, 1693888020000000, None, None, None]


def test_known_thread(spark):
    base = dt.datetime(2017, 10, 31)
    at = {8: "21:45:10", 10: "21:45:59", 9: "21:46:14", 6: "21:46:24", 7: "21:47:48", 5: "21:49:35", 4: "21:54:49", 3: "22:08:27", 1: "22:10:47", 2: "22:11:45"}
    parent = {8: None, 10: 8, 9: 8, 6: 8, 7: 6, 5: 6, 4: 5, 3: 4, 1: 3, 2: 1}
    customer = {8, 7, 5, 3, 2}
    rows = [(i, parent[i], "c1" if i in customer else "b1", i in customer, base + dt.timedelta(hours=int(t[:2]), minutes=int(t[3:5]), seconds=int(t[6:]))) for i, t in at.items()]
    s = Scratch(spark, "known")
    m = s.cut(C.members(spark.createDataFrame(rows, "id bigint, parent bigint, author string, inbound boolean, ts timestamp"), s), "m")
    p = one(C.participants(m))
    assert (p.root, p.status, p.n_customer_turns, p.n_brand_turns) == (8, "clean", 5, 5)
    assert one(C.timing(m)).max_depth == 6
    order = [r.id for r in C.turn_index(m, s).orderBy("turn_index").collect()]
    assert order == [8, 10, 9, 6, 7, 5, 4, 3, 1, 2]


def test_participant_status(spark):
    rows = [(1, "c", True), (2, "c", True), (2, "d", True), (2, "b", False), (3, "c", True), (3, "a", False), (3, "b", False), (4, "b", False), (5, None, None)]
    got = {r.root: r.status for r in C.participants(spark.createDataFrame(rows, "root bigint, author string, inbound boolean")).collect()}
    assert got == {1: "no_brand", 2: "multi_customer", 3: "multi_brand", 4: "no_customer", 5: "no_customer"}


def test_ranks_in_groups_larger_than_a_partition(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.col("id"))
    df = df.unionByName(spark.createDataFrame([(None, -1)], "g string, id bigint"))
    got = ranks.ranked(df, ["g"], ["id"], "n", Scratch(spark, "ranks")).groupBy("g").agg(F.count("*").alias("c"), F.count_distinct("n").alias("k"), F.max("n").alias("m")).collect()
    assert all(r.c == r.k == r.m for r in got) and sum(r.c for r in got) == 1001


@pytest.mark.parametrize("t", [0.8, 0.6])
def test_jaccard_join_equals_all_pairs(spark, t):
    import random

    rng = random.Random(5)
    sets = {i: {rng.randint(0, 25) for _ in range(rng.randint(1, 14))} for i in range(150)}
    sets |= {200 + i: sets[i] for i in range(20)}
    df = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in sets.items()] + [(999, []), (998, None)], "id bigint, toks array<string>")
    members, links = J.near_duplicates(df, "id", F.col("toks"), Scratch(spark, "j"), t)
    cls = {r.key: r.class_id for r in members.collect()}
    assert set(cls) == set(sets) and all(cls[200 + i] == cls[i] for i in range(20))
    reps = sorted(set(cls.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}
    assert {(r.a, r.b) for r in links.collect()} == want


def test_leakage_layers_in_order(spark):
    corpus = spark.createDataFrame([("a", "k1", "u1", "one two three"), ("b", "k2", "u9", "x"), ("c", "k3", "u3", "Hello  there world"), ("d", "k4", "u4", "a b c d e f g h i k"), ("e", "k5", None, None), ("f", "k1", "u9", "hello there world")], "id string, conversation string, customer string, text string")
    held = spark.createDataFrame([("k1", "u9", "hello there @you world"), (None, None, "a b c d e f g h i j k")], "conversation string, customer string, text string")
    got = {r.id: r.layer for r in K.flagged(K.overlaps(corpus, held, Scratch(spark, "l"))).collect()}
    assert got == {"a": "conversation", "b": "customer", "c": "exact_text", "d": "near_duplicate", "e": None, "f": "conversation"}
    off = K.audit(K.flagged(K.overlaps(corpus, held, Scratch(spark, "l")), ("customer",)), ("customer",))
    assert {r.layer: r.removed for r in off.collect()} == {"conversation": None, "customer": 2, "exact_text": None, "near_duplicate": None, "kept": 4}
    with pytest.raises(K.LeakageError):
        K.assert_isolated(corpus, held, "conversation")


def test_weak_labels(spark):
    df = spark.createDataFrame([("Bag tag 1 for my suitcase",), ("gate b12 and lounge",), ("nothing here",), (None,)], "text string")
    assert [(r.weak_label, r.n_matched) for r in L.weak_label(df, "text").collect()] == [("baggage", 1), (None, 2), (None, 0), (None, 0)]


def test_parse_reply():
    ok = '{"reply": " hi ", "needs_more_information": false, "evidence_used": [1, "2"]}'
    assert G.parse_reply_text(ok) == ("hi", False, [1, 2], True, None)
    for raw, error in [("x", "invalid_json"), (None, "invalid_json"), ("[1]", "not_an_object"), ('{"reply": "a"}', "missing_needs_more_information"), ('{"reply": 1, "needs_more_information": true}', "reply_not_text"), ('{"reply": "a", "needs_more_information": 1}', "needs_more_information_not_boolean"), ('{"reply": "a", "needs_more_information": true, "evidence_used": [true]}', "evidence_used_not_a_rank"), ('{"reply": "a", "needs_more_information": true, "evidence_used": [1.0]}', "evidence_used_not_a_rank"), ('{"reply": "a", "needs_more_information": true, "evidence_used": [0]}', "evidence_used_below_one"), ('{"reply": "a", "needs_more_information": true, "evidence_used": "1"}', "evidence_used_not_a_list")]:
        assert G.parse_reply_text(raw)[4] == error


def test_grounding_flags(spark):
    rows = [("", "x"), (None, "x"), ("ok", None), ("see https://a.b/c", "https://a.b/c"), ("see https://a.b/c.", "https://a.b/c"), ("costs $12 or 1234", "912345 $12"), ("We've refunded you, it has been resolved", ""), ("hi @123", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "r string, a string").select(G.flags(F.col("r"), F.col("a"))).collect()]
    assert got == [["empty_reply"], ["empty_reply"], [], [], ["unsupported_url"], [], ["action_claim", "resolution_claim"], ["leaked_identifier"]]


def test_copying_equals_sequence_matcher(spark):
    a, b = "thanks for your patience, we are looking into it", "thanks for your patience we are looking into it now"
    df = spark.createDataFrame([(1, a, [b, "short", None]), (2, a, []), (3, None, [b]), (4, a, None)], "k int, reply string, sources array<string>")
    got = {r.k: r.copy_ratio for r in G.copying(df, "reply", "sources").collect()}
    assert got[1] == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) and got[2] == got[3] == got[4] == 0


def test_generation_failures_are_retried(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "k int, p string")

    def flaky(p):
        if p == "bad":
            raise TimeoutError
        return p

    first = G.generate(df, "p", flaky)
    assert {r.k: r.failure for r in first.collect()} == {1: None, 2: "TimeoutError"}
    assert {r.k: r.raw for r in G.retry_failures(first, G.generate(df, "p", str.upper), "k").collect()} == {1: "good", 2: "BAD"}


def test_metrics_on_fixed_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "a")], "t string, p string")
    got = {r.label: (r.support, r.precision, r.recall) for r in M.per_label(df, "t", "p", ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (1, 0.0, 0.0), "c": (0, 0.0, 0.0)}
    o = one(M.overall(df, "t", "p", ["a", "b", "c"]))
    assert o.n == 3 and o.accuracy == pytest.approx(1 / 3) and o.macro_f1 == pytest.approx(2 / 9)
    same = spark.createDataFrame([(1, 1), (1, 1)], "t int, p int")
    assert one(M.kappa(same, "t", "p")).kappa is None
    assert one(M.kappa(spark.createDataFrame([(1, 2), (2, 1), (5, 5)], "t int, p int"), "t", "p", True)).kappa == pytest.approx(1 - 2 * 3 / 52)
    assert one(M.adjusted_rand(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y")], "t int, p string"), "t", "p")).ari == pytest.approx(1.0)
    assert one(M.kappa(same.limit(0), "t", "p")).n == 0


def test_samples_are_stable_and_without_repeats(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else "r", "bag" if i % 2 else "fare") for i in range(90)], "k int, g string, t string")
    a = [r.k for r in A.sample(df, "k", 10, 1).collect()]
    assert a == [r.k for r in A.sample(df.repartition(7), "k", 10, 1).collect()] and len(set(a)) == 10
    got = A.stratified(df, "g", "k", 10, 1).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"s": 7, "r": 3}
    t = A.targeted(df, "k", "t", {"b": "fare", "a": "bag|fare"}, 5, 1).collect()
    assert len({r.k for r in t}) == len(t) == 10


def test_dense_search_skips_the_query_itself(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "doc bigint, vec array<double>")
    got = V.dense_search(v.where("doc = 1"), v, 3).collect()
    assert [(r.query, r.rank, r.doc) for r in got] == [(1, 1, 2)]
    assert V.dense_search(v.limit(0), v, 3).count() == 0
    whole = V.dense_search(v, v, 2)
    assert whole.count() and whole.exceptAll(V.dense_search(v, v, 2, block=1)).count() == 0


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,x,"two\nlines ""q""",,\n', encoding="utf-8")
    r = one(readers.raw_csv(spark, str(p)))
    assert r.text == 'two\nlines "q"' and r.response_tweet_id is None and readers.physical_lines(spark, str(p)) == 3
    b = tmp_path / "b_labelled.csv"
    b.write_bytes(sinks.report_csv([{"conversation_id": "c1", "notes": ""}], ["conversation_id", "notes"]))
    got = one(readers.annotation_csv(spark, str(b)))
    assert got.conversation_id == "c1" and got.notes == ""
    assert one(readers.labelled_conversations(spark, str(tmp_path))).file == "b_labelled.csv"
    ids = tmp_path / "ids.txt"
    assert sinks.id_list(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "k string"), "k", str(ids), ["note"]) == 2
    assert ids.read_text() == "# note\na\nb\n" and sorted(r.id for r in readers.id_list(spark, str(ids)).collect()) == ["a", "b"]
    with pytest.raises(FileExistsError):
        sinks.report_json({}, str(ids))
    df = spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string")
    sinks.parquet(df, str(tmp_path / "t"))
    assert readers.same_rows(spark.read.parquet(str(tmp_path / "t")).select("b", "a"), df) and not readers.same_rows(df.distinct(), df)
    assert sinks.markdown(df.limit(1)).splitlines()[2] == "| 1 | x |"


def test_streams_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 3, base + dt.timedelta(hours=5 * i), "k", float(i), f"bag tag {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "user int, ts timestamp, kind string, value double, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream.run_to_table(stream.labelled(stream.source(spark, str(tmp_path / "in")), "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert readers.same_rows(spark.read.parquet(str(tmp_path / "out")), stream.labelled(df, "text"))
    stream.run_to_table(stream.windowed_counts(stream.source(spark, str(tmp_path / "in"), 10), "ts", "kind", late="1 second"), str(tmp_path / "w"), str(tmp_path / "cw"))
    batch = stream.windowed_counts(df, "ts", "kind")
    closed = spark.read.schema(batch.schema).parquet(str(tmp_path / "w"))
    assert closed.count() and closed.exceptAll(batch).count() == 0


def test_resampled_statistics_equal_a_direct_count(spark):
    import hashlib

    rows = [(i, "ab"[i % 2], "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame([*rows, (99, None, "a")], "k int, t string, p string")
    counts = M.resampled_counts(df, "k", "t", "p", 11, 3)
    f1 = {r.resample: r.value for r in M.resampled_macro_f1(counts, ["a", "b", "c"]).collect()}
    kappa = {r.resample: r.value for r in M.resampled_kappa(counts).collect()}
    weight = lambda k, b: sum(int(hashlib.md5(f"{k}:{b // 8}:3".encode()).hexdigest()[4 * (b % 8) : 4 * (b % 8) + 4], 16) >= c for c in M.POISSON)
    for b in range(11):
        drawn = [r for r in rows for _ in range(weight(r[0], b))]
        t, p = [r[1] for r in drawn], [r[2] for r in drawn]
        n = len(drawn)
        both = lambda x: t.count(x) + p.count(x)
        want = sum(2 * sum(u == v == x for u, v in zip(t, p, strict=True)) / both(x) if both(x) else 0 for x in "abc") / 3
        assert f1[b] == pytest.approx(want)
        po, pe = sum(u == v for u, v in zip(t, p, strict=True)) / n, sum(t.count(x) * p.count(x) for x in "abc") / n**2
        assert kappa[b] == pytest.approx((po - pe) / (1 - pe))
    mean = M.bootstrap_mean(df, "k", F.col("k"), 400, 3).first()
    assert mean.n == 31 and mean.low < mean["mean"] < mean.high
    assert tuple(M.bootstrap_mean(df.limit(0), "k", F.col("k"), 16).first()) == (0, None, None, None)


def test_no_term_is_cut_from_the_vocabulary_unasked(spark):
    n = 100_100
    tokens = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string"))
    docs = spark.range(4).select(F.col("id").alias("doc"), F.when(F.col("id") < 2, tokens).otherwise(F.array(F.lit("x"))).alias("tokens"))
    weights, vocab = T.fit(docs, Scratch(spark, "fit"))
    assert vocab.count() == n + 1 and T.long_form(weights).count() == 2 * n + 2
    assert T.fit(docs, Scratch(spark, "fit"), max_features=5)[1].count() == 5


def test_item_ids_stay_apart_beyond_six_digits(spark):
    df = spark.createDataFrame([(7,), (100_000,), (1_000_000,), (1_000_001,)], "k bigint")
    assert [r[0] for r in df.orderBy("k").select(_item_id(F.col("k"))).collect()] == ["j000007", "j100000", "j1000000", "j1000001"]


def test_random_items_are_drawn_until_all_eligible_are_found(spark):
    pool = spark.range(200).select(F.col("id").alias("pos"), F.format_string("i%03d", "id").alias("item"), F.when(F.col("id") >= 3, "g").alias("grp"))
    queries = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h"), (4, None)], "query bigint, grp string")
    got = {}
    for r in V.random_items(queries, pool, 5, 42).collect():
        got.setdefault(r["query"], []).append(r["item"])
    assert sorted(got[1]) == sorted(got[2]) == ["i000", "i001", "i002"] and len(set(got[3])) == len(set(got[4])) == 5


def test_spearman_has_average_ranks(spark):
    from skein.operators import profile as P

    rows = [(1.0, 5), (2.0, 5), (2.0, 7), (4.0, 1), (9.0, 9), (None, 3), (3.0, None)] + [(float(i % 17), i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b int")
    import pandas as pd

    known = pd.DataFrame([r for r in rows if None not in r], columns=["a", "b"]).rank()
    got = P.spearman(df, "a", "b", Scratch(spark, "rho")).first()
    assert got.n == 205 and got.rho == pytest.approx(known["a"].corr(known["b"]))
    assert P.spearman(df.limit(0), "a", "b", Scratch(spark, "rho")).first().n == 0


def test_sparse_search_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    pool = [f"t{i}" for i in range(40)] + ["hot"] * 30
    docs = [(i, sorted({rng.choice(pool) for _ in range(rng.randint(0, 12))}), f"c{i % 90:02d}", rng.choice(["a", "b", "z", None])) for i in range(200)]
    rows = [(d, ts, [1.0 / max(len(ts), 1) ** 0.5] * len(ts), c, u) for d, ts, c, u in docs]
    df = spark.createDataFrame(rows, "doc bigint, terms array<string>, weights array<double>, conversation string, customer string").repartition(7)
    for block in (30, 10**6):
        got = {}
        for r in T.nearest(df.where("doc % 10 = 0"), df, 4, Scratch(spark, "n"), block).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["conversation"], r["similarity"]))
        want = {}
        for q, tq, wq, cq, uq in rows:
            if q % 10:
                continue
            found = [(-round(sum(a * b for x, a in zip(tq, wq, strict=True) for y, b in zip(td, wd, strict=True) if x == y), 6), cd) for d, td, wd, cd, ud in rows if cd != cq and (ud is None or uq is None or ud != uq)]
            best = sorted(x for x in found if x[0] < 0)[:4]
            if best:
                want[q] = [(k, c, -s) for k, (s, c) in enumerate(best, 1)]
        assert {q: sorted(v) for q, v in got.items()} == want
    assert T.nearest(df.limit(0), df, 4, Scratch(spark, "n")).count() == 0


def test_lookup_splits_hot_keys(spark):
    from skein.operators import skew

    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("k"), "id").repartition(12)
    table = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 1500, 3)), (None, 7)], "k string, v int")
    assert skew.hot_keys(rows, "k") == ["hot"]
    for how in ("left", "inner"):
        a, b = skew.lookup(rows, "k", table, how).select("k", "id", "v"), rows.join(table, "k", how).select("k", "id", "v")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_tables_go_when_their_scope_is_left(spark):
    import os

    from skein.session import scope

    with scope():
        s = Scratch(spark, "scoped")
        df = s.cut(spark.range(3))
        folder = s.base.removeprefix("file:")
        assert df.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder)
    kept = Scratch(spark, "kept").cut(spark.range(3))
    assert kept.count() == 3


def test_learning_on_separable_texts(spark):
    import random

    from skein.operators import learn

    rng = random.Random(2)
    pools = {"bags": "suitcase luggage belt lost wheel".split(), "money": "refund charge card paid fee".split()}
    rows = [(i, k, [rng.choice(pools[k]) for _ in range(6)]) for i in range(80) for k in [sorted(pools)[i % 2]]]
    df = learn.features(spark.createDataFrame([*rows, (900, None, pools["bags"])], "key int, label string, tokens array<string>"), "tokens", 256).cache()
    got = {r.key: (r.label, r.predicted, r.confidence) for r in learn.out_of_fold(df, "key", "label", Scratch(spark, "oof"), steps=20).collect()}
    assert len(got) == 81 and all(p == k and c > 0.5 for k, p, c in got.values() if k) and got[900][:2] == (None, "bags")
    reduced, values, explained = learn.svd(df, "key", 4)
    assert len(values) == 4 and values == sorted(values, reverse=True) and 0.3 < explained <= 1 + 1e-9 and all(len(r.reduced) == 4 for r in reduced.collect())
    points = spark.createDataFrame([([float(c * 10 + rng.random()), float(-c * 7 + rng.random())],) for c in range(3) for _ in range(30)], "v array<double>")
    sweep = {r.k: r for r in learn.kmeans_sweep(points, "v", [2, 3, 200], starts=3).collect()}
    assert set(sweep) == {2, 3} and sweep[3].silhouette > 0.9 and sweep[3].cost < sweep[2].cost and abs(sweep[3].largest_share - 1 / 3) < 1e-9


def test_judgements_are_read_strictly(spark):
    from skein.operators import judge

    cases = {
        '{"score": 4, "reason": "good"}': (4, None), '{"score": true, "reason": "x"}': (None, "score_not_a_number"), '{"score": 6, "reason": "x"}': (None, "score_out_of_range"), '{"score": 3}': (None, "wrong_keys"),
        '{"score": 3, "reason": "x", "more": 1}': (None, "wrong_keys"), '{"score": 3, "reason": 5}': (None, "reason_not_text"), "[1]": (None, "not_an_object"), "no": (None, "invalid_json"), '{"score": "3", "reason": "x"}': (None, "score_not_a_number"),
        '{"score": 3, "reason": "' + "w " * 41 + '"}': (None, "reason_too_long"), '{"score": 3.5, "reason": "x"}': (None, "score_not_a_number"), "null": (None, "not_an_object"),
    }
    got = {r.raw: (r.j.score, r.j.error) for r in spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", judge.judgement(F.col("raw")).alias("j")).collect()}
    assert got == cases
    assert spark.createDataFrame([(None,)], "raw string").select(judge.judgement(F.col("raw")).alias("j")).first().j.error == "invalid_json"
    items = spark.createDataFrame([("a", "m", "r"), ("b", "m", " "), ("c", "m", None)], "item string, message string, reply string")

    def down(_):
        raise TimeoutError

    judged = judge.run(items, ["tone", "help"], down, lambda p: '{"score": 2, "reason": "ok"}')
    assert {r.item: r.status for r in judge.item_status(judged).collect()} == {"a": "complete", "b": "empty", "c": "empty"}
    assert {r.item: r.status for r in judge.item_status(judge.run(items, ["tone"], down)).collect()}["a"] == "failed"


def test_answers_are_asked_once(spark, tmp_path):
    from skein.operators import grounding

    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None), (5, "bad")], "k int, prompt string")
    log = tmp_path / "calls"
    log.mkdir()

    def ask(p):
        (log / f"{p}-{len(list(log.iterdir()))}").write_text("")
        if p == "bad":
            raise OSError
        return p.upper()

    cache = grounding.AnswerCache(spark, str(tmp_path / "answers"), "m", 0.0, 1)
    first = {r.k: (r.raw, r.failure, r.cached) for r in cache.complete(df.coalesce(1), "prompt", ask).collect()}
    assert first == {1: ("P", None, False), 2: ("P", None, False), 3: ("Q", None, False), 4: (None, None, None), 5: (None, "OSError", False)}
    again = {r.k: r.cached for r in cache.complete(df, "prompt", ask).collect()}
    assert again == {1: True, 2: True, 3: True, 4: None, 5: False}
    names = sorted(p.name.split("-")[0] for p in log.iterdir())
    assert names == ["bad", "bad", "p", "q"]
    assert grounding.AnswerCache(spark, str(tmp_path / "answers"), "other", 0.0, 1).complete(df, "prompt", ask).where("cached").count() == 0


def test_order_without_equal_neighbours(spark):
    from skein.operators import sampling

    rows = [(f"k{i:03d}", "hot" if i < 60 else f"i{i % 9}") for i in range(120)]
    s = Scratch(spark, "order")
    out = sampling.blinded_order(s.cut(spark.createDataFrame(rows, "key string, item string").repartition(5)), "key", "item", 3, s)
    assert sampling.neighbours_alike(out, "item").first().n == 0 and sorted(r.position for r in out.collect()) == list(range(120))


def test_small_files_and_projections(spark, tmp_path):
    from skein.sources import readers

    assert readers.csv_bytes('﻿a,"b c"\r\n1,"x\ny"\r\n'.encode()) == (["a", "b c"], [{"a": "1", "b c": "x\ny"}]) and readers.csv_bytes(b"") == ([], [])
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.txt").write_bytes(b"abc")
    assert [tuple(r) for r in readers.file_hashes(spark, str(tmp_path / "f")).collect()] == [("one.txt", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    a = spark.createDataFrame([(1, "x", 2), (2, "y", None)], "k int, flag string, gold int")
    assert readers.only(a, ["k", "flag", "absent"]).columns == ["k", "flag"]
    b = spark.createDataFrame([(1, "x", 2), (3, "z", 1)], "k int, flag string, gold int")
    assert sorted(map(tuple, readers.changed_rows(a, b, "k", ["flag"]).collect())) == [(2, "flag", "y", None), (3, "flag", None, "z")]
    t = spark.createDataFrame([("AbC d",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(X.caps_ratio(F.col("t"))).collect()] == [0.4, 0.0, 0.0] and t.select(X.slug(F.col("t"))).first()[0] == "AbC_d"
