"""Expressions that turn one text cell into a number or a moment, or say why they cannot.

Shapes are tested first with anchored patterns; the conversion itself never guesses.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: markers, noise, month names and shapes ------------------------------------
NULL_MARKERS = [
    "", "-", "—", "n/a", "na", "null", "none", "nan", "#n/a", "#yok",
    "#div/0!", "#sayı/0!", "#sayi/0!", "#value!", "#değer!", "#ref!", "#başv!", "#name?", "#ad?",
    "#num!", "#sayı!", "#sayi!", "#null!", "#boş!",
]
MONEY_CODES = r"(?i)TL|TRY|USD|EUR"
MONEY_MARKS = "₺$€% \t\n\x0b\f\r"

# Turkish and English names and short forms of the twelve months, with and without their Turkish letters.
MONTH_NAMES = [
    ["ocak", "oca", "january", "jan"],
    ["şubat", "subat", "şub", "sub", "february", "feb"],
    ["mart", "mar", "march"],
    ["nisan", "nis", "april", "apr"],
    ["mayıs", "mayis", "may"],
    ["haziran", "haz", "june", "jun"],
    ["temmuz", "tem", "july", "jul"],
    ["ağustos", "agustos", "ağu", "agu", "august", "aug"],
    ["eylül", "eylul", "eyl", "september", "sept", "sep"],
    ["ekim", "ekım", "eki", "october", "oct"],
    ["kasım", "kasim", "kas", "november", "nov"],
    ["aralık", "aralik", "ara", "december", "dec"],
]

TIME_TAIL = r"( \d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?)?"
SHAPES = {
    "int": r"[-+]?\d{1,18}",
    "lead0": r"[-+]?0\d+",
    "dot": r"[-+]?\d*\.\d+",
    "amb": r"[-+]?[1-9]\d{0,2}\.\d{3}",
    "tr": r"[-+]?[1-9]\d{0,2}(\.\d{3})+(,\d+)?|[-+]?\d+,\d+",
    "usk": r"[-+]?[1-9]\d{0,2}(,\d{3})+(\.\d+)?",
    "amb_comma": r"[-+]?[1-9]\d{0,2}(,\d{3})+",
    "comma_dec": r"[-+]?\d+,\d+",
}
ISO_SHAPE = r"\d{4}-\d{1,2}(-\d{1,2}" + TIME_TAIL + ")?"
DMY_SHAPE = r"(\d{1,2}\.\d{1,2}\.\d{4}|\d{2}\.\d{2}\.\d{2})" + TIME_TAIL
MIDNIGHT = r" 0?0:00(:00(\.0+)?)?\z"
MAX_EXACT_SCALE = 10
DIGITS = "0123456789"
NUMBER_CHARS = DIGITS + "+-.,"
# ----------------------------------------------------------------------------------------------


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(rf"^(?:{pattern})\z")


def only_chars(c: Column, chars: str) -> Column:
    """True when the text has no other characters; far cheaper than a pattern."""
    return F.translate(c, chars, "") == ""


def present(c: Column) -> Column:
    """The trimmed text, or null when it only says that there is no value."""
    trimmed = F.trim(c)
    return F.when(~F.lower(F.replace(trimmed, F.lit("İ"), F.lit("i"))).isin(NULL_MARKERS), trimmed)


def strip_money(c: Column) -> Column:
    """Currency signs and codes, percent signs and spaces removed. Only text with other characters than figures and signs is searched for codes."""
    codeless = F.when(only_chars(c, NUMBER_CHARS + MONEY_MARKS + "()−"), c).otherwise(F.regexp_replace(c, MONEY_CODES, ""))
    return F.when(only_chars(c, NUMBER_CHARS), c).otherwise(F.translate(codeless, MONEY_MARKS, ""))


def accounting_sign(c: Column) -> Column:
    """``(1,00)``, ``1,00-`` and the typographic minus, all written with a leading ``-``."""
    plain = F.replace(c, F.lit("−"), F.lit("-"))
    unbracketed = F.regexp_replace(plain, r"^\(([0-9.,]+)\)\z", "-$1")
    written = F.regexp_replace(unbracketed, r"^([0-9.,]+)-\z", "-$1")
    marked = c.contains("(") | c.contains("−") | c.endswith("-")
    return F.when(marked, written).otherwise(c)


def money_text(c: Column) -> Column:
    """The number text of a present cell: noise stripped, sign normalised."""
    return accounting_sign(strip_money(c))


def _month_number(word: Column) -> Column:
    table = [
        x
        for number, names in enumerate(MONTH_NAMES, 1)
        for name in names
        for x in (F.lit(name), F.lit(f"{number:02d}"))
    ]
    return F.try_element_at(F.create_map(*table), word)


_DAY_NAME = r"^(\d{1,2})\.?\s+(\p{L}+)\.?,?\s+(\d{4})(.*)\z"
_NAME_DAY = r"^(\p{L}+)\.?\s+(\d{1,2}),?\s+(\d{4})(.*)\z"
_STARTS_NAMED = r"^[0-9]{1,2}\.?\s+\p{L}|^\p{L}+\.?\s+[0-9]"


def month_names(c: Column) -> Column:
    """``5 Ocak 2025`` and ``January 5, 2025`` written as ``5.01.2025``; other text is unchanged."""
    low = F.lower(F.replace(c, F.lit("İ"), F.lit("i")))
    day_first = F.regexp_replace(low, _NAME_DAY, "$2 $1 $3$4")
    month = _month_number(F.regexp_extract(day_first, _DAY_NAME, 2))
    written = F.regexp_replace(day_first, F.lit(_DAY_NAME), F.concat(F.lit("$1."), month, F.lit(".$3$4")))
    # Only text that starts like a named date pays for the lookup.
    return F.when(c.rlike(_STARTS_NAMED), F.coalesce(written, c)).otherwise(c)


def dotted(c: Column) -> Column:
    """A date text in dotted form with a four-digit year (00–69 → 20xx, 70–99 → 19xx)."""
    dots = F.regexp_replace(month_names(c), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})", "$1.$2.$3")
    # The century goes between the date's last dot and a year of exactly two digits.
    young = F.regexp_replace(dots, r"^(\d{2}\.\d{2}\.)([0-6]\d)(?=\z|\s)", "$120$2")
    old = F.regexp_replace(young, r"^(\d{2}\.\d{2}\.)([7-9]\d)(?=\z|\s)", "$119$2")
    return F.upper(old)


def dashed(c: Column) -> Column:
    """A year-first date text in dashed form; ``T`` becomes a space, a zone is dropped unshifted."""
    full = F.regexp_replace(c, r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})", "$1-$2-$3")
    month = F.regexp_replace(full, r"^(\d{4})/(\d{1,2})\z", "$1-$2")
    spaced = F.regexp_replace(month, r"^(\d{4}-\d{1,2}-\d{1,2})T", "$1 ")
    return F.regexp_replace(spaced, r"(:\d{2}(?:\.\d+)?)(?:Z|[+-]\d{2}:?\d{2})\z", "$1")


_DATE_LIKE = (
    r"(\d{1,2}[./-]\d{1,2}[./-](\d{4}|\d\d)|\d{4}[./-]\d{1,2}([./-]\d{1,2})?|\d{1,2}\.?\s+\p{L}+\.?,?\s+\d{4}|\p{L}+\.?\s+\d{1,2},?\s+\d{4})"
    r"([T ][0-9:.+ZAPMapm -]*)?"
)


def date_like(c: Column) -> Column:
    """True for every text that one of the date readings may take, and for little else."""
    return c.rlike("[0-9]") & full_match(c, _DATE_LIKE)


def _moment(text: Column) -> Column:
    """Timestamp of a year-first text; null when there is no such moment.

    One ``try_cast`` reads every plain form. A list of formats would be tried one after another, with
    an exception for every miss; only the rare AM/PM clocks need formats.
    """
    spaced = F.regexp_replace(text, r" ?([AaPp][Mm])\z", " $1")
    half_day = F.coalesce(*[
        F.try_to_timestamp(F.upper(spaced), F.lit(f"yyyy-M-d {clock}")).cast("timestamp_ntz") for clock in ("h:mm:ss a", "h:mm a")
    ])
    return F.when(text.rlike(r"[AaPp][Mm]\z"), half_day).when(~text.rlike(r"\.\d{7}"), text.try_cast("timestamp_ntz"))


_DOTTED_DAY = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})"


def parse_dmy(dotted_text: Column) -> Column:
    shaped = F.when(full_match(dotted_text, DMY_SHAPE), dotted_text)
    return _moment(F.regexp_replace(shaped, _DOTTED_DAY, "$3-$2-$1"))


def parse_mdy(dotted_text: Column) -> Column:
    shaped = F.when(full_match(dotted_text, DMY_SHAPE), dotted_text)
    return _moment(F.regexp_replace(shaped, _DOTTED_DAY, "$3-$1-$2"))


def parse_iso(dashed_text: Column) -> Column:
    return _moment(F.when(full_match(dashed_text, ISO_SHAPE), dashed_text))


def number_type(scale: int) -> str:
    """The exact type that holds ``scale`` decimals; beyond ten they are float noise."""
    if scale == 0:
        return "bigint"
    return f"decimal(38,{scale})" if scale <= MAX_EXACT_SCALE else "double"


# The readers below take money text (see ``money_text``).


def read_integer(text: Column) -> Column:
    return text.try_cast("bigint")


def read_decimal(text: Column, scale: int) -> Column:
    return text.try_cast(number_type(scale))


def read_comma_decimal(text: Column, scale: int) -> Column:
    """Dots group thousands, the comma is the decimal mark."""
    return F.translate(text, ",.", ".").try_cast(number_type(scale))


def read_us_number(text: Column, scale: int) -> Column:
    """Commas group thousands."""
    return F.translate(text, ",", "").try_cast(number_type(scale))


def date_text(c: Column, order: str) -> Column:
    """A cell brought to the form its reading order is parsed from."""
    value = present(c)
    return dashed(value) if order == "iso" else dotted(value)


def parse_date_text(text: Column, order: str, with_time: bool) -> Column:
    """``order`` is ``iso``, ``dmy`` or ``mdy``; a column of midnights becomes a plain DATE."""
    parsed = {"iso": parse_iso, "dmy": parse_dmy, "mdy": parse_mdy}[order](text)
    return parsed if with_time else parsed.cast("date")


def has_time(value: Column) -> Column:
    """A clock time other than a plain midnight is written in the text."""
    return value.contains(":") & ~value.rlike(MIDNIGHT)
