"""Checks of a drafted reply against what it may rest on.

allowed is the customer's message and the evidence, joined by blanks. Every check is a
column: the array of what it objects to, sorted and distinct, empty if nothing.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as X
from skein.session import Scratch

#: Numbers that need support, and claims a reply must not make.
NUMBER = r"([$£€]\s?[0-9][0-9.,]*|[0-9]+(?:\.[0-9]+)?\s?%|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}|[0-9]{4,})"
ACTION = r"(?i)((?:i|we)(?:'ve| have) (?:refunded|issued|processed|cancelled|rebooked|sent|credited|upgraded))"
RESOLVED = r"(?i)((?:has|have) been (?:resolved|fixed|refunded|processed|rebooked)|is now (?:resolved|fixed))"
IDENTIFIER = r"(@[0-9]+)"
COPY_RATIO, COPY_LENGTH, SPAN = 0.90, 20, 200


def _all(c: Column, pattern: str) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))))


def unsupported_urls(reply: Column, allowed: Column) -> Column:
    """Links of the reply that are no link, as a whole, of what is allowed."""
    return F.array_sort(F.array_except(_all(reply, f"({X.URL})"), _all(allowed, f"({X.URL})")))


def unsupported_numbers(reply: Column, allowed: Column) -> Column:
    """Amounts, shares, phone numbers and long numbers of the reply that do not occur in what is allowed."""
    a = F.coalesce(allowed, F.lit(""))
    return F.filter(F.transform(_all(reply, NUMBER), lambda x: F.trim(x)), lambda x: ~F.contains(a, x))


def claims(reply: Column, pattern: str) -> Column:
    return _all(F.lower(reply), pattern)


def leaked_identifiers(reply: Column) -> Column:
    return _all(reply, IDENTIFIER)


def flags(reply: Column, allowed: Column) -> Column:
    """Codes of all checks that object, in order; an empty reply has only that flag."""
    empty = X.blank(reply)
    some = F.array_compact(
        F.array(
            F.when(F.size(unsupported_urls(reply, allowed)) > 0, F.lit("unsupported_url")),
            F.when(F.size(unsupported_numbers(reply, allowed)) > 0, F.lit("unsupported_number")),
            F.when(F.size(claims(reply, ACTION)) > 0, F.lit("action_claim")),
            F.when(F.size(claims(reply, RESOLVED)) > 0, F.lit("resolution_claim")),
            F.when(F.size(leaked_identifiers(reply)) > 0, F.lit("leaked_identifier")),
        )
    )
    return F.when(empty, F.array(F.lit("empty_reply"))).otherwise(some)


def copying(df: DataFrame, reply: str, sources: str, ratio: float = COPY_RATIO, least: int = COPY_LENGTH) -> DataFrame:
    """df with copy_ratio (most alike source, 0 for none) and copy_span (longest shared stretch if copied).

    sources is an array of texts. Texts are compared without links, mentions and case by
    matching blocks; pairs whose lengths already rule the ratio out, or with a side shorter
    than `least`, are not compared, as they can neither be flagged nor change a flag.
    """

    @F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("span", T.StringType())]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, ys in zip(a, b, strict=True):
            best, span = 0.0, None
            for y in ys if ys is not None else ():
                if x is None or y is None or min(len(x), len(y)) < least or 2.0 * min(len(x), len(y)) / (len(x) + len(y)) < ratio:
                    continue
                m = difflib.SequenceMatcher(None, x, y, autojunk=False)
                if m.real_quick_ratio() < ratio or m.quick_ratio() < ratio:
                    continue
                if (r := m.ratio()) > best:
                    k = m.find_longest_match()
                    best, span = r, x[k.a : k.a + k.size][:SPAN]
            out.append((best, span if best >= ratio else None))
        return pd.DataFrame(out, columns=["ratio", "span"])

    form = F.transform(F.col(sources), lambda s: X.copy_form(s))
    return df.withColumn("_c", run(X.copy_form(F.col(reply)), form)).withColumn("copy_ratio", F.col("_c.ratio")).withColumn("copy_span", F.col("_c.span")).drop("_c")


def evidence_block(items: DataFrame, limit: int = 400) -> DataFrame:
    """(query_id, block): a query's evidence by rank, sanitised and cut to `limit` characters a side.

    items: query_id, rank, message, reply; a query has a handful of items.
    """
    side = lambda c: F.substring(X.sanitised(F.coalesce(c, F.lit(""))), 1, limit)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Customer: "), side(F.col("message")), F.lit("\nBrand: "), side(F.col("reply")))
    return items.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("block"))


def prompt(message: Column, block: Column) -> Column:
    return F.concat(F.lit("Draft a reply to the customer, using only the past exchanges.\n\nPast exchanges:\n"), F.coalesce(block, F.lit("(none)")), F.lit("\n\nCustomer: "), X.sanitised(F.coalesce(message, F.lit(""))), F.lit('\n\nAnswer as JSON with "reply", "needs_more_information" and "evidence_used".'))


def cache_key(prompt_text: Column, model: str, temperature: float, seed: int) -> Column:
    """SHA-256 over the call's canonical text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(f"{temperature:.3f}"), F.lit(str(seed)), prompt_text), 256)


#: What parse_reply returns.
PARSED = T.StructType([T.StructField("reply", T.StringType()), T.StructField("needs_more_information", T.BooleanType()), T.StructField("evidence_used", T.ArrayType(T.IntegerType())), T.StructField("coerced", T.BooleanType()), T.StructField("error", T.StringType())])


def parse_reply_text(raw: str | None) -> tuple:
    """A model's answer, strictly typed: (reply, needs_more_information, evidence_used, coerced, error)."""
    fail = lambda e: (None, None, None, None, e)
    try:
        x = json.loads(raw or "")
    except ValueError:
        return fail("invalid_json")
    if not isinstance(x, dict):
        return fail("not_an_object")
    if missing := [k for k in ("reply", "needs_more_information") if k not in x]:
        return fail("missing_" + "+".join(missing))
    if not isinstance(x["reply"], str):
        return fail("reply_not_text")
    if not isinstance(x["needs_more_information"], bool):
        return fail("needs_more_information_not_boolean")
    used, out, coerced = x.get("evidence_used", []), [], False
    if not isinstance(used, list):
        return fail("evidence_used_not_a_list")
    for v in used:
        if isinstance(v, str) and v.isascii() and v.isdigit():
            v, coerced = int(v), True
        if isinstance(v, bool) or not isinstance(v, int):
            return fail("evidence_used_not_a_rank")
        if v < 1:
            return fail("evidence_used_below_one")
        out.append(v)
    return x["reply"].strip(), x["needs_more_information"], out, coerced, None


def parse_reply(df: DataFrame, raw: str) -> DataFrame:
    """df with parsed, a struct as in PARSED; error is null if the answer is well formed."""

    @F.pandas_udf(PARSED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_reply_text(t) for t in s], columns=[f.name for f in PARSED.fields])

    return df.withColumn("parsed", run(F.col(raw)))


def citations_valid(used: Column, n_evidence: Column) -> Column:
    """Whether all cited ranks exist; null if nothing was parsed."""
    return F.forall(used, lambda x: (x >= 1) & (x <= n_evidence))


Completer = Callable[[str], str]


def generate(df: DataFrame, prompt_column: str, complete: Completer) -> DataFrame:
    """df with raw (the completer's answer) and failure (its exception's name); one call per row, where the rows are."""
    schema = T.StructType([*df.drop("raw", "failure").schema.fields, T.StructField("raw", T.StringType()), T.StructField("failure", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws, fails = [], []
            for p in b[prompt_column]:
                try:
                    raws.append(complete(p))
                    fails.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a backend raises is recorded
                    raws.append(None)
                    fails.append(type(e).__name__)
            yield b.assign(raw=raws, failure=fails)

    return df.drop("raw", "failure").mapInPandas(run, schema)


class AnswerCache:
    """Answers kept by the hash of everything that determines them, as a table in a shared folder.

    A call is made once per distinct key that the table does not hold; failures are not kept.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, temperature: float, seed: int):
        self.spark, self.path = spark, path
        self.key = lambda p: cache_key(p, model, temperature, seed)

    def answers(self) -> DataFrame:
        """(key, raw), the first answer of each key; empty before the first write."""
        try:
            kept = self.spark.read.schema("key string, raw string").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], "key string, raw string")
        return kept.groupBy("key").agg(F.min("raw").alias("raw"))

    def complete(self, df: DataFrame, prompt_column: str, complete: Completer) -> DataFrame:
        """df with raw, failure, and cached (whether the answer was there before); null prompts get nulls."""
        rows = df.drop("raw", "failure", "cached").withColumn("_key", self.key(F.col(prompt_column)))
        known = self.answers()
        missing = rows.where(F.col(prompt_column).isNotNull()).groupBy("_key").agg(F.min(prompt_column).alias("_prompt")).join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
        scratch = Scratch(self.spark, "answers")
        before = scratch.cut(known, "known")
        new = scratch.cut(generate(missing, "_prompt", complete), "new")
        new.where(F.col("failure").isNull()).select(F.col("_key").alias("key"), "raw").write.mode("append").parquet(self.path)
        told = before.select(F.col("key").alias("_key"), "raw", F.lit(None).cast("string").alias("failure"), F.lit(True).alias("cached")).unionByName(new.select("_key", "raw", "failure", F.lit(False).alias("cached")))
        return rows.join(told, "_key", "left").drop("_key")


def retry_failures(first: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """The first run's rows, those that failed replaced by the second run's."""
    ok = first.where(F.col("failure").isNull())
    return ok.unionByName(again.join(ok.select(key), key, "left_anti"))
