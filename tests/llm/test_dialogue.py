import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.llm import dialogue as D
from skein.session import Scratch

SCHEMA = "conversation_id string, tweet_id bigint, author_id string, speaker string, created_at timestamp, text string, parent_tweet_id bigint, turn_index int, role string"
T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def turn(conv, i, author, text="hi", at=None, speaker=None, tweet=None, parent=None):
    return (conv, tweet if tweet is not None else i, author, speaker, at or T0 + dt.timedelta(minutes=i), text, parent if parent is not None else (i - 1 if i else None), i)


def reasons(spark, rows):
    _, v = D.rebuild(frame(spark, rows))
    return {r.conversation_id: set(r.reasons) for r in v.collect()}


def test_reasons(spark):
    rows = [
        turn("ok", 0, "1"), turn("ok", 1, "Brand"),
        turn("spoken", 0, None, speaker=" Customer"), turn("spoken", 1, "", speaker="BRAND "),
        turn("gap", 0, "1"), turn("gap", 2, "Brand"),
        turn("twice", 0, "1"), turn("twice", 1, "Brand"), turn("twice", 1, "Brand", tweet=9),
        turn("merged", 0, "1"), turn("merged", 1, None, text=None, tweet=5), turn("merged", 1, "Brand", tweet=5),
        turn("nobody", 0, "1"), turn("nobody", 1, None, speaker="custmer"), turn("nobody", 2, "Brand"),
        turn("brand", 0, "Brand"), turn("brand", 1, "1"), turn("brand", 2, "Brand"),
        turn("silent", 0, "1"), turn("silent", 1, "Brand", text="​ "),
        turn("early", 0, "1", text=" "), turn("early", 1, "Brand"), turn("early", 2, "1"),
        turn(None, 0, "1"),
        ("noindex", 1, "1", None, None, "hi", None, None),
    ]
    assert reasons(spark, rows) == {
        "ok": set(), "spoken": set(), "merged": set(), "gap": {"order"}, "twice": {"order"}, "nobody": {"role"}, "brand": {"opening"},
        "silent": {"reply"}, "early": {"reply"}, "noindex": {"order", "opening", "reply"},
    }


def test_a_wrong_clock_is_found_and_corrected(spark):
    rng = random.Random(7)
    rows = []
    for c in range(120):
        at = T0 + dt.timedelta(hours=c)
        for i in range(4):
            author = str(c) if i % 2 == 0 else ("Late" if c % 2 else "Good")
            at += dt.timedelta(seconds=20 + 60 * rng.random())
            rows.append((f"c{c}", c * 10 + i, author, None, at - dt.timedelta(seconds=500 * (author == "Late")), "hi", c * 10 + i - 1 if i else None, i))
    df = frame(spark, rows)
    x = {r.sender: r.x for r in D.sender_offsets(D.reply_edges(D.merged_turns(df)), Scratch(spark, "x")).collect()}
    assert max(x, key=lambda s: abs(x[s])) == "Late" and 420 < x["Late"] < 600 and "Good" not in x
    turns, v = D.rebuild(df)
    assert v.where(F.size("reasons") > 0).count() == 0 and v.agg(F.sum("clock_conflicts")).first()[0] == 0
    late = turns.where("author = 'Late'").join(turns.selectExpr("conversation_id", "turn_index + 1 AS turn_index", "corrected_at AS before"), ["conversation_id", "turn_index"])
    assert late.where(F.col("corrected_at") < F.col("before") - F.expr("interval 1 second")).count() == 0


def test_replies_that_no_clock_explains_are_counted(spark):
    rows = [("c", 1, "1", None, T0 + dt.timedelta(minutes=9), "a", None, 0), ("c", 2, "B", None, T0 + dt.timedelta(minutes=8), "b", 1, 1), ("c", 3, "1", None, T0, "c", 2, 2)]
    _, v = D.rebuild(frame(spark, rows))
    r = v.collect()[0]
    assert r.clock_conflicts > 0 and r.reasons == []


def test_contradicting_bounds_settle_and_every_broken_reply_counts(spark):
    late, early = T0 - dt.timedelta(seconds=7200), T0 + dt.timedelta(seconds=60)
    rows = [("c", 1, "1", None, T0, "a", None, 0), ("c", 2, "B", None, late, "b", 1, 1), ("d", 1, "B", None, T0, "a", None, 0), ("d", 2, "1", None, early, "b", 1, 1)]
    df = frame(spark, rows)
    edges = D.reply_edges(D.merged_turns(df))
    x = {r.sender: r.x for r in D.sender_offsets(edges, Scratch(spark, "x")).collect()}
    assert abs(x["B"] - x["1"] - 3630) < 0.1
    assert {r.conversation_id: r.clock_conflicts for r in D.rebuild(df)[1].collect()} == {"c": 1, "d": 1}
    with pytest.raises(RuntimeError):
        D.sender_offsets(edges, Scratch(spark, "x"), rounds=1)


def test_offsets_reach_the_least_squares_breaches(spark):
    rng = random.Random(3)
    bounds = {}
    for _ in range(30):
        a, b = rng.sample("abcdefgh", 2)
        bounds[a, b] = rng.uniform(-900, 500)
    x = dict.fromkeys("abcdefgh", 0.0)
    for _ in range(40_000):  # plain gradient steps
        g = dict.fromkeys(x, 0.0)
        for (a, b), lead in bounds.items():
            u = max(0.0, lead + x[a] - x[b])
            g[a], g[b] = g[a] - u, g[b] + u
        x = {s: v + g[s] / 30 for s, v in x.items()}
    want = {p: max(0.0, lead + x[p[0]] - x[p[1]]) for p, lead in bounds.items()}
    assert sum(u > 1 for u in want.values()) > 2
    edges = spark.createDataFrame([(a, b, lead) for (a, b), lead in bounds.items()], "a string, b string, lead double")
    y = {r.sender: r.x for r in D.sender_offsets(edges, Scratch(spark, "x")).collect()}
    assert all(abs(max(0.0, lead + y.get(a, 0.0) - y.get(b, 0.0)) - want[a, b]) < 0.1 for (a, b), lead in bounds.items())


def test_ordered_lists_and_empty_table(spark):
    rows = [turn("a", 0, "1", text="x"), turn("a", 1, "B", text="y"), turn("a", 2, "1", text="z")]
    t, v = D.rebuild(frame(spark, rows[::-1] + rows[:1]), with_text=True)
    lists = D.turn_lists(D.kept_turns(t, v), chunk=2).orderBy("part").collect()
    assert [[x.text for x in r.turns] for r in lists] == [["x", "y"], ["z"]]
    t, v = D.rebuild(frame(spark, []), with_text=True)
    assert t.count() == 0 and v.count() == 0


def test_turns_are_merged_by_corrected_time(spark):
    """The brand's clock is ten minutes slow: as stored its answers come first, as corrected they do not."""
    rows = []
    for c in range(30):
        for i in range(4):
            at = T0 + dt.timedelta(hours=c, seconds=40 * i) - dt.timedelta(seconds=600 * (i % 2))
            rows.append((f"c{c}", c * 10 + i, "Brand" if i % 2 else f"{c}", None, at, "hi", c * 10 + i - 1 if i else None, i))
    s = Scratch(spark, "merge")
    turns, v = D.rebuild(frame(spark, rows), s)
    got = D.merged_by_time(D.kept_turns(turns, v, feasible=True), s)
    assert got.where("merged = position").count() == 120
    raw = turns.withColumnRenamed("turn_index", "position").join(frame(spark, rows).select("tweet_id", "created_at"), "tweet_id").withColumn("corrected_at", F.col("created_at"))
    assert D.merged_by_time(raw, s).where("merged = position").count() < 120  # without the clocks


def test_infeasible_conversations_are_left_out_where_asked(spark):
    rows = [("c", 1, "1", None, T0 + dt.timedelta(minutes=9), "a", None, 0), ("c", 2, "B", None, T0 + dt.timedelta(minutes=8), "b", 1, 1), ("c", 3, "1", None, T0, "c", 2, 2), turn("d", 0, "7"), turn("d", 1, "B")]
    t, v = D.rebuild(frame(spark, rows))
    assert {r[0] for r in D.kept_turns(t, v).select("conversation_id").collect()} == {"c", "d"}
    assert {r[0] for r in D.kept_turns(t, v, feasible=True).select("conversation_id").collect()} == {"d"}


def test_one_sender_and_one_question_hold_half_of_all_rows(spark):
    rows = [turn("hot", 0, "1")] + [("hot", i, "Brand", None, T0 + dt.timedelta(seconds=i - 300), "hi", 0, i) for i in range(1, 1500)]
    rows += [x for c in range(400) for x in (turn(f"c{c}", 0, str(c + 10)), turn(f"c{c}", 1, "Brand"))]
    t, v = D.rebuild(frame(spark, rows).repartition(16))
    got = {r.conversation_id: (r.n_turns, r.reasons, r.clock_conflicts) for r in v.collect()}
    assert len(got) == 401 and got["hot"] == (1500, [], 0) and t.count() == 1500 + 800
