"""Text that looks the same but differs in its characters, brought to one form.

fold() undoes what has no look of its own: invisible characters, kinds of spaces,
character width and font, joined letters, split accents. repair() then treats look-alike
letters script by script: a token that mixes scripts is rewritten in its dominant
script when the corpus vocabulary holds the result. class_form() is the key for "looks
the same": the repaired text, in which tokens wholly of another script, which the repair
leaves as they are, count by their look. A mixed token that could not be repaired keeps
its characters and looks like no other spelling. look() maps every look-alike of any
text to one prototype, for operators that read words as a reader sees them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import Scratch

#: Letters of other scripts and the Latin letters they look like.
CYRILLIC, CYRILLIC_AS = "АВЕКМНОРСТУХІЅЈԚԜҮӀԌаеорсухіѕјԁһԛԝӏѵԍ", "ABEKMHOPCTYXISJQWYIGaeopcyxisjdhqwlvg"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαινορυϲϳ", "ABEZHIKMNOPTYXCJaivopucj"
ARMENIAN, ARMENIAN_AS = "օսհոզցՍՕ", "ouhnqgUO"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHiJKLMPRSTVWZ"
#: Latin letters of other form.
LATIN_FORMS, LATIN_FORMS_AS = "ɑɡıꞬ", "agiG"
#: Invisible characters outside the format category, as code point ranges.
IGNORABLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
#: The same for Spark expressions: what remains of a blank text is nothing.
INVISIBLE_OR_SPACE = r"[\s\p{Z}\p{Cf}\p{Cc}\x{034F}\x{115F}\x{1160}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"

_TWINS = {"CYRILLIC": (CYRILLIC, CYRILLIC_AS), "GREEK": (GREEK, GREEK_AS), "ARMENIAN": (ARMENIAN, ARMENIAN_AS), "CHEROKEE": (CHEROKEE, CHEROKEE_AS)}
TO_LATIN = {a: b for one, as_ in (*_TWINS.values(), (LATIN_FORMS, LATIN_FORMS_AS)) for a, b in zip(one, as_, strict=True)}
FROM_LATIN = {name: dict(zip(reversed(as_), reversed(one), strict=True)) for name, (one, as_) in _TWINS.items()}
_LOOK = str.maketrans(TO_LATIN)
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
PLAIN = r"^[\x20-\x7E]*$"


@lru_cache(maxsize=20_000)
def fold_char(c: str) -> str:
    """A character without width, font, joining or kind of space; empty if it is invisible."""
    if c in TO_LATIN:  # as it is, also where it stands for another letter
        return c
    kind, n = unicodedata.category(c), ord(c)
    if kind[0] == "Z" or c in "\t\n\r\v\f\x85":
        return " "
    if kind in ("Cf", "Cc") or any(a <= n <= b for a, b in IGNORABLE):
        return ""
    how = unicodedata.decomposition(c).split(" ")
    if how[0] in ("<wide>", "<narrow>", "<font>") or how[0] == "<compat>" and how[1] != "0020":
        return "".join(fold_char(x) for x in unicodedata.normalize("NFKC", c))
    return c


def _joins_emoji(text: str, i: int) -> bool:
    """Whether the joiner at i makes one picture of its neighbours."""
    before = text[max(0, i - 2) : i].replace("\ufe0f", "")[-1:]
    return bool(before) and i + 1 < len(text) and unicodedata.category(before) in ("So", "Sk") and unicodedata.category(text[i + 1]) == "So"


def fold(text: str) -> str:
    out = "".join(c if c == "\u200d" and _joins_emoji(text, i) else fold_char(c) for i, c in enumerate(text))
    return unicodedata.normalize("NFC", out).strip(" ")


def look(text: str) -> str:
    """Equal for texts that look the same."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", fold(text)).translate(_LOOK))


@lru_cache(maxsize=20_000)
def script(c: str) -> str:
    if not c.isalpha():
        return ""
    return unicodedata.name(c, "").split(" ")[0]


def _scripts(text: str) -> Counter:
    return Counter(s for s in map(script, unicodedata.normalize("NFD", text)) if s)


def rewritten(token: str, to: str) -> str | None:
    """The token with every letter in one script; None if a letter has no twin there."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        own = script(c)
        if own == "" or own == to and c not in LATIN_FORMS:
            out.append(c)
            continue
        latin = TO_LATIN.get(c, c if own == "LATIN" else None)
        twin = latin if to == "LATIN" else FROM_LATIN.get(to, {}).get(latin or "")
        if not twin:
            return None
        out.append(twin)
    return unicodedata.normalize("NFC", "".join(out))


def suspects(folded: str) -> list[tuple[int, int, str, str]]:
    """(place, choice, token, rewritten) of the tokens that mix scripts.

    place is the token's number in the text, choice 0 the rewriting in its dominant script
    (on ties the one its text mostly has), then those in its other scripts.
    """
    found, whole = [], None
    for k, m in enumerate(TOKEN.finditer(folded)):
        token = m.group()
        if token.isascii():
            continue
        own = _scripts(token)
        if len(own) < 2:
            continue
        whole = whole or _scripts(folded)
        forms = (rewritten(token, to) for to in sorted(own, key=lambda s: (-own[s], -whole[s], s)))
        found += [(k, i, token, new) for i, new in enumerate(x for x in forms if x)]
    return found


def class_form(repaired: str) -> str:
    """Equal for repaired texts that look the same."""
    if repaired.isascii():
        return repaired
    return TOKEN.sub(lambda m: m.group() if m.group().isascii() or len(_scripts(m.group())) > 1 else unicodedata.normalize("NFC", unicodedata.normalize("NFD", m.group()).translate(_LOOK)), repaired)


def substituted(folded: str, fixes: dict[int, str]) -> str:
    k = iter(range(len(folded) + 1))
    return TOKEN.sub(lambda m: fixes.get(next(k), m.group()), folded)


# -- columns -------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(T.StringType())
def _look_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else look(t))


@F.pandas_udf(T.StringType())
def _form_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else class_form(t))


def _beside_plain(c: Column, udf) -> Column:
    """Plain texts stay in the JVM: Python gets null for them."""
    plain = c.rlike(PLAIN)
    return F.when(plain, F.trim(c)).otherwise(udf(F.when(~plain, c)))


def folded(c: Column) -> Column:
    return _beside_plain(c, _fold_udf)


def look_key(c: Column) -> Column:
    return _beside_plain(c, _look_udf)


def visible(c: Column) -> Column:
    """Whether a reader sees anything; false for null."""
    return F.coalesce(F.length(F.regexp_replace(c, INVISIBLE_OR_SPACE, "")) > 0, F.lit(False))


# -- operator ------------------------------------------------------------------------


#: A text's tokens, as TOKEN finds them.
_TOKENS = r"([\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}\p{M}]+)*)"


def _suspect_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(i, *x, look(x[2])) for i, t in zip(b["text_id"], b["folded"], strict=True) for x in suspects(t)]
        yield pd.DataFrame(out, columns=["text_id", "k", "choice", "token", "new", "shape"])


def _apply_fixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [substituted(t, {int(f["k"]): f["new"] for f in fs}) for t, fs in zip(b["folded"], b["fixes"], strict=True)]
        yield pd.DataFrame({"text_id": b["text_id"], "repaired": out})


def text_id(text: str) -> Column:
    """128 bits that stand for a text."""
    return F.md5(text)


def repair(df: DataFrame, text: str, scratch: Scratch | None = None) -> DataFrame:
    """df with the column repaired: its text in one consistent form.

    The form is fold(), with tokens of mixed scripts rewritten in their dominant script, or
    else in another of their scripts, where the result is in the corpus vocabulary: it is
    a token of some text as written, or two different writings of the corpus come down
    to its look. Other tokens are left. Distinct texts are treated once. A null text gives
    null, an invisible one the empty text; a column named repaired is replaced, other
    columns stay as they are.
    """
    scratch = scratch or Scratch(df.sparkSession, "repair")
    base = df.drop("repaired")
    c = base[text].cast("string")
    texts = base.select(c.alias("text")).where(F.col("text").isNotNull()).distinct()
    texts = scratch.cut(texts.select(text_id("text").alias("text_id"), "text", folded(F.col("text")).alias("folded")), "folded")
    odd = texts.where(~F.col("folded").rlike(r"^[\x00-\x7F]*$")).select("text_id", "folded")
    found = scratch.cut(odd.mapInPandas(_suspect_rows, "text_id string, k int, choice int, token string, new string, shape string"), "suspects")
    # the vocabulary, as far as anything asks for it
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("folded", F.lit(_TOKENS), F.lit(1)))).alias("word"))
    wanted = found.select(F.col("new").alias("word")).distinct()
    known = wanted.join(words, "word", "left_semi").withColumn("is_word", F.lit(True))
    odd_words = odd.select(F.explode(F.array_distinct(F.regexp_extract_all("folded", F.lit(_TOKENS), F.lit(1)))).alias("word")).where(~F.col("word").rlike(r"^[\x00-\x7F]*$")).distinct()
    writings = odd_words.select(look_key(F.col("word")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("shape", F.lit(True).alias("is_shape"))
    told = found.join(known, found.new == known.word, "left").join(writings, "shape", "left").where(F.col("is_word") | F.col("is_shape"))
    best = told.groupBy("text_id", "k").agg(F.min(F.struct(F.col("is_word").isNull().alias("worse"), "choice", "new")).alias("b"))
    fixes = best.groupBy("text_id").agg(F.collect_list(F.struct("k", F.col("b.new").alias("new"))).alias("fixes")).join(odd, "text_id")
    fixed = fixes.mapInPandas(_apply_fixes, "text_id string, repaired string")
    done = texts.join(fixed, "text_id", "left").select(F.col("text").alias("_t"), F.coalesce("repaired", "folded").alias("repaired"))
    return base.join(done, c == F.col("_t"), "left").drop("_t")


def same_look(df: DataFrame, key: str, text: str, scratch: Scratch | None = None) -> DataFrame:
    """(key, class_id, variant) for keys whose text looks like another, different text.

    class_id names the look, the class_form() of the repaired text, variant the exact text.
    Rows without key or text are ignored, and so are texts with nothing visible in them.
    """
    scratch = scratch or Scratch(df.sparkSession, "look")
    rows = repair(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull()).distinct(), "t", scratch)
    plain = F.col("repaired").rlike(PLAIN)
    form = F.when(plain, F.col("repaired")).otherwise(_form_udf(F.when(~plain, F.col("repaired"))))
    rows = rows.select("k", text_id("t").alias("variant"), form.alias("form")).where(F.length("form") > 0)
    rows = scratch.cut(rows.select("k", "variant", text_id("form").alias("class_id")), "looks")
    classes = rows.groupBy("class_id").agg(F.min("variant").alias("a"), F.max("variant").alias("b")).where(F.col("a") < F.col("b")).select("class_id")
    return rows.join(classes, "class_id", "left_semi").select(F.col("k").alias(key), "class_id", "variant")


def same_look_pairs(classes: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b), a < b, of keys whose texts look the same and are not the same string.

    Variants are paired first, so that copies of one string never meet each other.
    """
    v = classes.select("class_id", "variant").distinct()
    pairs = v.select("class_id", F.col("variant").alias("va")).join(v.select("class_id", F.col("variant").alias("vb")), "class_id").where(F.col("va") < F.col("vb"))
    a = classes.select("class_id", F.col("variant").alias("va"), F.col(key).alias("ka"))
    b = classes.select("class_id", F.col("variant").alias("vb"), F.col(key).alias("kb"))
    out = pairs.join(a, ["class_id", "va"]).join(b, ["class_id", "vb"]).where(F.col("ka") != F.col("kb"))
    return out.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
