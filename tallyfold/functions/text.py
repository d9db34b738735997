"""Text folding, cell cleaning and the shapes of value-like text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns and characters that decide what counts as a number or a date ----
NUMBER_LIKE = r"(?i)^[-+(]?[₺$€£]?\s*[\d.,\s]+%?\s*(tl|try|usd|eur)?\)?\z"
DATE_LIKE = r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}(\s+\d{1,2}:\d{2}(:\d{2})?)?\z"
YEAR = r"^(19|20)\d{2}\z"
SPACE_LIKE = "\u00a0\u2007\u202f"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
TRIMMED = r"[\s\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]+"
TURKISH_FROM, TURKISH_TO = "ışğüöç", "isguoc"
# ----------------------------------------------------------------------------------------------

_MARKS = "[\\u0300-\\u036f]"


def tr_lower(c: Column) -> Column:
    """Lower case as Turkish writes it: İ becomes i, I becomes ı."""
    return F.lower(F.translate(c, "İI", "iı"))


def _stripped(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(x) <= 0x36F)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Every single letter that decomposes to exactly one other character, by Unicode's own rule."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or ch in TURKISH_FROM:
            continue
        plain = _stripped(ch)
        if len(plain) == 1 and plain != ch:
            source.append(ch)
            target.append(plain)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def joined_letters() -> dict[str, str]:
    """Letters that decompose to several ASCII letters (ligatures, digraphs), by Unicode's own rule, in lower case."""
    found = {}
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or not ch.isalpha() or ch != ch.lower():
            continue
        plain = _stripped(ch)
        if len(plain) > 1 and plain.isascii() and plain.isalpha():
            found[ch] = plain.lower()
    return found


def fold_text(c: Column) -> Column:
    """Compare-form of a text: Turkish lower case, ASCII letters, no accents, ligatures as their letters."""
    lowered = F.translate(tr_lower(c), TURKISH_FROM, TURKISH_TO)
    source, target = accent_table()
    joined = joined_letters()
    letters = F.create_map(*[F.lit(x) for pair in joined.items() for x in pair])
    apart = F.array_join(F.transform(F.split(lowered, ""), lambda ch: F.coalesce(F.try_element_at(letters, ch), ch)), "")
    # Letters are taken apart only in texts that hold such a one; ASCII text has only its case to lose.
    whole = F.when(lowered.rlike("[" + "".join(joined) + "]"), apart).otherwise(lowered)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.regexp_replace(F.translate(whole, source, target), _MARKS, ""))


def fold_python(text: str) -> str:
    """The same fold for a single header text, with full compatibility decomposition."""
    lowered = text.replace("İ", "i").replace("I", "ı").lower()
    lowered = lowered.translate(str.maketrans(TURKISH_FROM, TURKISH_TO))
    return _stripped(lowered)


def clean_cell(c: Column) -> Column:
    """Odd spaces to spaces, zero-width characters removed, trimmed; empty becomes null."""
    spaced = F.translate(c, SPACE_LIKE + ZERO_WIDTH, " " * len(SPACE_LIKE))
    trimmed = F.regexp_replace(spaced, rf"^{TRIMMED}|{TRIMMED}\z", "")
    return F.nullif(trimmed, F.lit(""))


def value_like(c: Column) -> Column:
    """True when the text has the shape of a number or of a date."""
    return c.rlike(NUMBER_LIKE) | c.rlike(DATE_LIKE)


def header_like(c: Column) -> Column:
    """True for text and for years, which head the columns of pivot layouts."""
    return c.rlike(YEAR) | ~value_like(c)


def natural_key(c: Column, language: str = "tr") -> Column:
    """Sort key: ``item 9`` comes before ``item 10``, and letters stand where the language's alphabet has them.

    A run of digits is compared by its length without leading zeros and then by its digits, whatever its length; numbers come
    before letters. The runs between them are compared by the collation of the language.
    """
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(p: Column) -> Column:
        number, digits = p.rlike("^[0-9]"), F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.struct(
            F.when(number, 0).otherwise(1).alias("kind"), F.when(number, F.length(digits)).otherwise(0).alias("length"),
            F.when(number, digits).otherwise("").alias("digits"), F.collate(F.when(number, "").otherwise(p), language).alias("text"))

    return F.transform(parts, key)
