"""Message rows rebuilt into ordered conversations with speaker roles.

A reply cannot be older than what it answers. From all replies between two senders
follows how far their clocks must at least differ; the offsets that break these
bounds least, in the sense of least squares, correct the timestamps. Bounds that the
offsets still break contradict each other: they lie on a loop of replies that no clocks
satisfy, and their conversations are infeasible. Turns are merged by corrected time.
Conversations whose turn indexes are not complete and unique, or that are empty or lack a
reply, are rejected, infeasible ones too if asked for.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import outer_trim
from skein.llm.visual import visible
from skein.operators.ranks import ranked
from skein.operators.skew import hot_keys, lookup
from skein.session import Scratch

CUSTOMER, BRAND = "customer", "brand"
#: Seconds by which a bound may stay broken, and the largest step at which the offset estimate has settled.
TOLERANCE, STEP = 0.5, 0.001
#: Rounds after which the estimate gives up with an error; its results are never taken before it has settled.
ROUNDS = 10_000
#: Turns in one element of a list of turns.
CHUNK = 1000


def _none_if_blank(c):
    t = outer_trim(c)
    return F.when(F.length(t) > 0, t)


def merged_turns(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per (conversation_id, tweet_id), with role and visibility.

    Rows without a conversation are ignored. Where rows of a turn differ, the first
    known value in sort order counts, and its text is visible if any row's is.
    """
    author, speaker = _none_if_blank(F.col("author_id")), F.lower(outer_trim(F.col("speaker")))
    t = rows.where(_none_if_blank(F.col("conversation_id")).isNotNull()).select(
        "conversation_id",
        F.col("tweet_id").cast("bigint").alias("tweet_id"),
        author.alias("author"),
        F.when(speaker.isin(CUSTOMER, BRAND), speaker).alias("speaker"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
        F.col("parent_tweet_id").cast("bigint").alias("parent"),
        F.col("turn_index").cast("int").alias("turn_index"),
        visible(F.col("text")).alias("seen"),
        *([F.col("text")] if with_text else []),
    )
    firsts = [F.min(c).alias(c) for c in ("author", "speaker", "at", "parent", "turn_index")]
    t = t.groupBy("conversation_id", "tweet_id").agg(*firsts, F.max("seen").alias("seen"), *([F.max(F.struct("seen", "text"))["text"].alias("text")] if with_text else []))
    role = F.when(F.col("author").rlike("^[0-9]+$"), F.lit(CUSTOMER)).when(F.col("author").isNotNull(), F.lit(BRAND)).otherwise(F.col("speaker"))
    return t.withColumn("role", role)


def reply_edges(turns: DataFrame) -> DataFrame:
    """(conversation_id, a, b, lead): sender b answers a; lead is by how many seconds the question is younger.

    A question with very many answers is looked up, not joined in one task.
    """
    known = F.col("parent").isNotNull() & (F.col("parent") != F.col("tweet_id"))
    place = lambda c: F.concat_ws("\x01", "conversation_id", F.col(c).cast("string")).alias("place")
    child = turns.where(known).select("conversation_id", place("parent"), F.col("author").alias("b"), F.col("at").alias("t_b"))
    asked = turns.where(F.col("tweet_id").isNotNull()).select(place("tweet_id"), F.col("author").alias("a"), F.col("at").alias("t_a"))
    return lookup(child, "place", asked, "inner").select("conversation_id", "a", "b", ((F.col("t_a") - F.col("t_b")) / 1e6).alias("lead"))


class Hot(NamedTuple):
    """Senders that stand in many of some rows, as the asking and as the answering side."""

    a: list
    b: list


def _hot(rows: DataFrame) -> Hot:
    return Hot(hot_keys(rows, "a"), hot_keys(rows, "b"))


def _with_offsets(pairs: DataFrame, x: DataFrame, hot: Hot) -> DataFrame:
    xa, xb = x.select(F.col("sender").alias("a"), F.col("x").alias("xa")), x.select(F.col("sender").alias("b"), F.col("x").alias("xb"))
    out = lookup(lookup(pairs, "a", xa, keys=hot.a), "b", xb, keys=hot.b)
    return out.withColumn("broken", F.col("lead") + F.coalesce("xa", F.lit(0.0)) - F.coalesce("xb", F.lit(0.0)))


def _pulls(at: DataFrame) -> DataFrame:
    """(s, n, g): of each sender in broken bounds their number and what they ask of its clock in sum."""
    sides = F.array(F.struct(F.col("b").alias("s"), F.col("u").alias("g")), F.struct(F.col("a").alias("s"), (-F.col("u")).alias("g")))
    return at.where(F.col("u") > 0).select(F.explode(sides).alias("m")).groupBy("m.s").agg(F.count("*").alias("n"), F.sum("m.g").alias("g"))


def _steps(at: DataFrame, pulls: DataFrame, hot: Hot) -> DataFrame:
    """(sender, d): the damped step of each pulled sender; all steps together never raise the sum of squares."""
    far = F.abs("g") / F.col("n")  # no step is longer
    pa, pb = (pulls.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), far.alias(f"far{c}")) for c in ("a", "b"))
    x = lookup(lookup(at, "a", pa, keys=hot.a), "b", pb, keys=hot.b).na.fill({"na": 1, "nb": 1, "fara": 0.0, "farb": 0.0})
    x = x.where(F.col("u") + F.col("fara") + F.col("farb") > 0)  # broken, or a step could break it
    both = F.col("na") + F.col("nb")
    weight = x.select(F.explode(F.array(F.struct(F.col("a").alias("s"), (both / F.col("na")).alias("w")), F.struct(F.col("b").alias("s"), (both / F.col("nb")).alias("w")))).alias("m"))
    weight = weight.groupBy("m.s").agg(F.sum("m.w").alias("w"))
    return pulls.where(F.col("g") != 0).join(weight, "s").select(F.col("s").alias("sender"), (F.col("g") / F.col("w")).alias("d"))


def sender_offsets(edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE, step: float = STEP) -> DataFrame:
    """(sender, x): seconds to add to a sender's timestamps; senders of no broken bound are absent.

    Of all replies from a to b only the tightest bound x_b - x_a >= lead matters. The
    sum of squared breaches is brought down by steps in which each side of a broken
    bound takes a share in proportion to how many broken bounds it stands in, so that
    one wrong clock moves rather than all its partners. Steps are damped by the bounds
    they could break, carry momentum, and are taken back if that raises the sum. They
    end when no bound is broken by more than tolerance or no clock moves by step; where
    bounds contradict each other, the breaches that are left are the least squares ones.
    An estimate that has not settled after `rounds` raises a RuntimeError.
    """
    spark = edges.sparkSession
    state = spark.createDataFrame([], "sender string, x double, was double")
    two = edges.where((F.col("a") != F.col("b")) & F.col("lead").isNotNull())
    pairs = scratch.cut(two.groupBy("a", "b").agg(F.max("lead").alias("lead")), "pairs")
    hot = _hot(pairs)
    least, k = float("inf"), 0
    for _ in range(rounds):
        ahead = F.col("x") + (F.col("x") - F.col("was")) * (k / (k + 3))
        now = _with_offsets(pairs, state.select("sender", "x"), hot).select("a", "b", "lead", F.col("broken").alias("ux"))
        at = scratch.cut(_with_offsets(now, state.select("sender", ahead.alias("x")), hot).select("a", "b", "ux", F.col("broken").alias("u")), "bounds")
        worst, total = at.agg(F.max("ux"), F.sum(F.greatest("ux", F.lit(0.0)) ** 2)).first()
        if worst is None or worst <= tolerance:
            settled = True
        elif k > 1 and total > least:  # momentum went too far
            settled, k = False, 0
            back = scratch.cut(state.select("sender", F.col("was").alias("x"), "was"), "offsets")
            scratch.drop(state)
            state = back
        else:
            least, k = total, k + 1
            pulls = scratch.cut(_pulls(at), "pulls")
            moved = state.select("sender", "x", ahead.alias("y")).join(_steps(at, pulls, hot), "sender", "full")
            x, y, d = (F.coalesce(c, F.lit(0.0)) for c in ("x", "y", "d"))
            new = scratch.cut(moved.select("sender", (y + d).alias("x"), x.alias("was"), F.abs(d).alias("d")), "offsets")
            settled = (new.agg(F.max("d")).first()[0] or 0.0) < step
            scratch.drop(state, pulls)
            state = new
        scratch.drop(at)
        if settled:
            scratch.drop(pairs)
            return state.select("sender", "x")
    raise RuntimeError(f"clock offsets have not settled after {rounds} rounds")


def rebuild(rows: DataFrame, scratch: Scratch | None = None, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, verdicts).

    turns: conversation_id, turn_index, tweet_id, author, role, corrected_at and, if wanted,
    text, in no order; see kept_turns() and merged_by_time().
    verdicts: one row per conversation with n_turns, the reasons to reject it (empty: keep),
    and clock_conflicts, the replies older than what they answer by the final clocks: since
    the offsets are the least squares ones, any of these makes the conversation infeasible.
    Reasons: order (the turn indexes are not 0, 1, 2 ... once each), role (a turn without
    one), opening (turn 0 is not the customer's), reply (no visible brand text after visible
    customer text). An empty table gives empty results; null times take no part in the
    estimate.
    """
    scratch = scratch or Scratch(rows.sparkSession, "dialogue")
    turns = scratch.cut(merged_turns(rows, with_text), "turns")
    edges = scratch.cut(reply_edges(turns), "edges")
    x = sender_offsets(edges, scratch)
    timed = edges.where(F.col("lead").isNotNull())
    conflicts = _with_offsets(timed, x, _hot(timed)).where(F.col("broken") > TOLERANCE).groupBy("conversation_id").agg(F.count("*").alias("clock_conflicts"))

    i, seen, role = F.col("turn_index"), F.col("seen"), F.col("role")
    by_index = turns.groupBy("conversation_id", "turn_index").agg(
        F.count("*").alias("n"),
        F.count_if(role.isNull()).alias("no_role"),
        F.count_if(role == CUSTOMER).alias("customers"),
        F.max(seen & (role == CUSTOMER)).alias("asks"),
        F.max(seen & (role == BRAND)).alias("answers"),
    )
    per = by_index.groupBy("conversation_id").agg(
        F.sum("n").alias("n_turns"),
        F.count("*").alias("n_indexes"),
        F.count_if(i.isNull()).alias("unordered"),
        F.min(i).alias("low"),
        F.max(i).alias("high"),
        F.sum("no_role").alias("no_role"),
        F.coalesce(F.max((i == 0) & (F.col("customers") > 0)), F.lit(False)).alias("opens"),
        F.min(F.when(F.col("asks"), i)).alias("asked"),
        F.max(F.when(F.col("answers"), i)).alias("answered"),
    )
    ordered = (F.col("unordered") == 0) & (F.col("low") == 0) & (F.col("n_indexes") == F.col("n_turns")) & (F.col("high") == F.col("n_turns") - 1)
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(ordered, F.lit(False)), F.lit("order")),
            F.when(F.col("no_role") > 0, F.lit("role")),
            F.when(~F.col("opens"), F.lit("opening")),
            F.when(~F.coalesce(F.col("asked") < F.col("answered"), F.lit(False)), F.lit("reply")),
        )
    )
    verdicts = per.select("conversation_id", "n_turns", reasons.alias("reasons")).join(conflicts, "conversation_id", "left").withColumn("clock_conflicts", F.coalesce("clock_conflicts", F.lit(0)).cast("bigint"))
    shift = x.select(F.col("sender").alias("author"), "x")
    at = F.timestamp_micros((F.col("at") + F.coalesce("x", F.lit(0.0)) * 1e6).cast("bigint"))
    out = lookup(turns, "author", shift).select("conversation_id", "turn_index", "tweet_id", "author", "role", at.alias("corrected_at"), *(["text"] if with_text else []))
    return out, scratch.cut(verdicts, "verdicts")


def kept_turns(turns: DataFrame, verdicts: DataFrame, feasible: bool = False) -> DataFrame:
    """The turns of accepted conversations, with position 0, 1, 2 ... by turn index; feasible: without infeasible ones."""
    good = verdicts.where((F.size("reasons") == 0) & ((F.col("clock_conflicts") == 0) | F.lit(not feasible))).select("conversation_id")
    return turns.join(good, "conversation_id", "left_semi").withColumnRenamed("turn_index", "position")


def merged_by_time(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """kept with merged, the place in its conversation by corrected time (ties and unknown times: by position), from 0.

    Conversations of any size are ranked across tasks.
    """
    timed = kept.withColumn("_t", F.coalesce(F.unix_micros("corrected_at"), F.lit(2**62)))
    return ranked(timed, ["conversation_id"], ["_t", "position"], "_n", scratch).withColumn("merged", (F.col("_n") - 1).cast("int")).drop("_n", "_t")


def turn_lists(kept: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conversation_id, part, turns): ordered lists of turns, parts of at most chunk turns."""
    part = F.floor(F.col("position") / chunk).cast("int")
    turn = F.struct("position", "role", "tweet_id", "corrected_at", "text")
    return kept.groupBy("conversation_id", part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
