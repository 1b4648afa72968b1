"""Keys that come in several writings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that may surround a key without being part of it.
OUTER = r"^[\s\p{Z}\p{Cf}\p{Cc}]+|[\s\p{Z}\p{Cf}\p{Cc}]+$"
#: A number: sign, digits (also in groups of three), decimals, exponent.
NUMBER = r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]*)?([eE][+-]?[0-9]{1,2})?$"
FULL_WIDTH, ASCII = "０１２３４５６７８９．，＋－", "0123456789.,+-"


def outer_trim(c: Column) -> Column:
    return F.regexp_replace(c, OUTER, "")


def numeric_id(c: Column) -> Column:
    """The number a text writes, as bigint: ' 12', '12.0', '012' and '1.2e1' are 12.

    Null for a missing text, one that is no number, a fraction, or a number out of range.
    """
    t = F.translate(outer_trim(c.cast("string")), FULL_WIDTH, ASCII)
    t = F.when(t.rlike(NUMBER), F.regexp_replace(t, ",", ""))
    n = t.try_cast("decimal(38,6)")
    whole = n.try_cast("bigint")
    return F.when(n == whole.cast("decimal(38,6)"), whole)


def number_key(c: Column) -> Column:
    """A number's canonical text, fractions included; null where the text is no number."""
    t = F.translate(outer_trim(c.cast("string")), FULL_WIDTH, ASCII)
    t = F.when(t.rlike(NUMBER), F.regexp_replace(t, ",", ""))
    n = t.try_cast("decimal(38,6)")
    return F.regexp_replace(F.regexp_replace(n.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def text_key(c: Column) -> Column:
    """A text key without case and outer spaces; null when nothing is left."""
    t = F.lower(outer_trim(c))
    return F.when(F.length(t) > 0, t)
