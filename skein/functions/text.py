"""Text normalisers and patterns as Column to Column functions.

Six normalisers with different meanings; each is named after what it keeps. \\w and \\b
are avoided in patterns, since engines disagree on them beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns shared by the operators below.
URL, URL_PREFIX, MENTION, HASHTAG = r"https?://\S+|www\.\S+", r"https?://", r"@\S+", r"#(\S+)"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
CJK, ACCENTED = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]", r"[\x{00C0}-\x{024F}]"
SIGNATURE = r"\^[A-Za-z]{1,4}\s*$"
DM = r"(?i)(^|[^a-z0-9_])(?:dms?|direct message|private message|pm us|inbox)([^a-z0-9_]|$)"
FOREIGN = r"(?i)(^|[^a-z0-9_])(?:hola|gracias|por favor|vuelo|maleta|merci|bonjour|vol|bagage|nicht|danke|bitte|flug|koffer)([^a-z0-9_]|$)"
TOKENS = r"[a-z0-9']+"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", F.lit(True))


def canonical(c: Column) -> Column:
    """Lower case without links and mentions; runs of a-z, 0-9 and ' joined by one space; null is empty."""
    return F.array_join(canonical_tokens(c), " ")


def canonical_tokens(c: Column) -> Column:
    """The tokens of canonical(), made in one go."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), URL, " "), MENTION, " ")
    return F.regexp_extract_all(t, F.lit(f"({TOKENS})"), F.lit(1))


def unescaped(c: Column) -> Column:
    """The XML entities and &nbsp; as characters, the ampersand last."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def discovery_form(c: Column, keep_mentions: bool = False) -> Column:
    """Unescaped, without links and (by default) mentions, hashtags as words, single spaces, lower case."""
    t = F.regexp_replace(unescaped(c), URL, " ")
    if not keep_mentions:
        t = F.regexp_replace(t, MENTION, " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, HASHTAG, "$1"), r"\s+", " ")))


def sanitised(c: Column) -> Column:
    """Without mentions, single spaces, case kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, MENTION, " "), r"\s+", " "))


def copy_form(c: Column) -> Column:
    """Lower case without links and mentions, single spaces, punctuation kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), URL, " "), MENTION, " "), r"\s+", " "))


def display_form(c: Column) -> Column:
    """Line breaks as ' / '."""
    return F.trim(F.regexp_replace(c, r"[\r\n]+", " / "))


def richness_tokens(c: Column) -> Column:
    """Tokens for type-token ratios: link prefixes and mentions removed, runs of a-z and '."""
    t = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), URL_PREFIX, " "), MENTION, " "))
    return F.regexp_extract_all(t, F.lit("([a-z']+)"), F.lit(1))


def terms(c: Column, least: int = 2) -> Column:
    """Unigrams of at least `least` word characters of the canonical form."""
    return F.regexp_extract_all(canonical(c), F.lit(f"([a-z0-9]{{{least},}})"), F.lit(1))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Unigrams and, up to n, neighbouring tokens joined by a space."""
    out = tokens
    for k in range(2, n + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (k - 1), F.lit(1)))
        out = F.concat(out, F.when(F.size(tokens) >= k, F.transform(starts, _gram(tokens, k))).otherwise(F.array().cast("array<string>")))
    return out


def _gram(tokens: Column, k: int):
    return lambda i: F.array_join(F.slice(tokens, i, k), " ")


def parsed_time(c: Column) -> Column:
    """The time a text gives in one of four formats, as UTC; null for any other."""
    t = F.trim(c)
    bare = F.regexp_replace(t, r"^[A-Za-z]{3} ", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("MMM d HH:mm:ss Z yyyy")),
        F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d\d-\d\dT[\d:]+Z$"), F.regexp_replace(t, "Z$", "")), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(t, F.lit("dd-MM-yyyy HH:mm")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
    )


def caps_ratio(c: Column) -> Column:
    """Capitals A to Z by length; 0 for an empty or missing text."""
    t = F.coalesce(c, F.lit(""))
    return F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(F.length(t), F.lit(1))


def slug(c: Column) -> Column:
    """Runs of other than A-Z, a-z and 0-9 as one underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "_")
