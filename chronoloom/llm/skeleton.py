"""Confusables skeleton: one form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronoloom.common import spread, table

# Letters of other scripts and the Latin letter that readers see in them.
LOOK_ALIKE = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j", "µ": "μ", "κ": "k",
    # Armenian and Latin extensions
    "օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "ɑ": "a", "ɡ": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G",
    "Ꮓ": "Z", "Ꮞ": "4", "Ꮢ": "R", "Ꮤ": "W", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Roman numerals and signs drawn as one letter
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c",
    "ⅾ": "d", "ⅿ": "m",
}
# Characters that are not drawn though their category isn't Cf (combining grapheme joiner, fillers, selectors).
UNDRAWN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Small capitals of these letters are drawn like their small letters.
LIKE_SMALL = "COSVWXZ"
#: A joiner is drawn between the parts of one emoji, so it stays there.
EMOJI_JOIN = re.compile("(?<=[\u2190-\u2bff\ufe0f\U0001f000-\U0001faff])\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff])")


def prototype(ch: str) -> str:
    """What one character of a decomposed text turns into: width, space, script and the mathematical styles of letters don't matter."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or ch in UNDRAWN or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if cat == "Zs":
        return " "
    tag, _, code = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<font>"):
        ch = "".join(chr(int(x, 16)) for x in code.split())
    small = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(ch, "")) if len(ch) == 1 else None
    if small:
        return small[1].lower() if small[1] in LIKE_SMALL else small[1]
    return LOOK_ALIKE.get(ch, ch)


class _Prototypes(dict):
    """Filled as characters are met: the table follows from ``prototype``, a rule."""

    def __missing__(self, code: int) -> str:
        self[code] = out = prototype(chr(code))
        return out


_TABLE = _Prototypes()


def skeleton(text: str | None) -> str | None:
    """Decompose, replace every character by its prototype, decompose again; line ends become one kind.

    Canonical decomposition only: superscripts, ligatures and fractions stay
    what they are, as a reader sees them. Case, accents, digits, punctuation
    and line breaks stay. Null gives null, a text of undrawn characters ''.
    """
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    parts = EMOJI_JOIN.split(text) if "\u200d" in text else [text]
    return "\u200d".join(unicodedata.normalize("NFD", unicodedata.normalize("NFD", x).translate(_TABLE)) for x in parts)


@F.pandas_udf(StringType())
def skeleton_of(text: pd.Series) -> pd.Series:
    return text.map(skeleton, na_action="ignore")


def add_skeleton(df: DataFrame, text: str, out: str = "skeleton") -> DataFrame:
    """``df`` with the consistent form of a text column, null for null."""
    return df.withColumn(out, skeleton_of(F.col(text)))


def _digests(df: DataFrame, id: str, text: str) -> DataFrame:
    """(i, k, x): each row with the digests of its skeleton and of its text; texts without a drawn character are left out."""
    return table(
        spread(df.select(F.col(id).alias("i"), F.col(text).alias("x")))
        .filter(F.col("x").isNotNull())
        .withColumn("k", skeleton_of("x"))
        .filter(F.col("k").rlike(r"\S"))
        .select("i", F.unhex(F.sha2("k", 256)).alias("k"), F.unhex(F.sha2("x", 256)).alias("x")),
        "skeletons",
    )


def same_look_groups(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """(``id``, ``group_id``, texts): rows whose skeleton at least two different texts have; the group is named by its least id.

    One row for each id and group, whatever the number of copies; no pairs.
    Null, empty and blank texts are in none. Groups are aggregates with map-side
    partials. Empty input gives an empty result, other columns are ignored.
    """
    own = _digests(df, id, text)
    per = own.groupBy("k", "x").agg(F.min("i").alias("i")).groupBy("k").agg(F.min("i").alias("group_id"), F.count("*").alias("texts")).filter("texts > 1")
    return own.join(per, "k").select(F.col("i").alias(id), "group_id", "texts").distinct()


def same_look_pairs(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """Pairs (``id``_a < ``id``_b) of rows whose texts differ but have equal skeletons.

    Identical texts are no pair; null, empty and blank texts (also those of
    undrawn characters only) are in none. Repeated rows of one id and text
    count once. Only digests are shuffled, never texts. A skeleton with a single text, however often
    that is repeated, is dropped by an aggregate with map-side partials before
    anything is joined; then rows meet by (skeleton, text), so a popular text
    pairs with the rows of its look-alikes only, never with its own copies.
    Empty input gives an empty result, other columns are ignored.
    """
    own = _digests(df, id, text)
    mixed = own.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo < hi").select("k")
    rows = own.join(mixed, "k").distinct()
    texts = rows.select("k", "x").distinct()
    # which other texts look like this one, then the rows of those
    other = texts.join(texts.withColumnRenamed("x", "y"), "k").filter("x < y")
    pairs = other.join(rows.select(F.col("i").alias("a"), "k", "x"), ["k", "x"]).join(
        rows.select(F.col("i").alias("b"), "k", F.col("x").alias("y")), ["k", "y"]
    )
    return (
        pairs.filter("a <> b")
        .select(F.least("a", "b").alias(f"{id}_a"), F.greatest("a", "b").alias(f"{id}_b"))
        .distinct()
    )
