"""Scalar functions as native column expressions (no Python on the executors)."""

from __future__ import annotations

import functools
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of true; ordinals of seat names; generational suffixes; answers that name nobody.
TRUE_WORDS = ("true", "1", "t", "yes", "y")
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11,
    "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19,
    "twentieth": 20, "twenty-first": 21, "twenty-second": 22,
}
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def number(c: Column) -> Column:
    """Text to double; what is no number becomes null."""
    return F.trim(c.cast("string")).try_cast("double")


def day(c: Column) -> Column:
    """Text in one of several formats to a date; what is no date becomes null."""
    text = F.trim(c)
    formats = ("M/d/yy", "M/d/yyyy", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.try_to_timestamp(text)).cast("date")


def truthy(c: Column) -> Column:
    """1 for an accepted spelling of true, whatever its case, else 0; null is 0. Blanks are not trimmed."""
    return F.coalesce(F.lower(c.cast("string")).isin(*TRUE_WORDS), F.lit(False)).cast("int")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def at_least(c: Column, low) -> Column:
    """Clip from below; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def sign(party: Column, plus: str = "DEM", minus: str = "REP") -> Column:
    return F.when(party == plus, 1).when(party == minus, -1).otherwise(0)


def translated(c: Column, mapping: dict[str, str]) -> Column:
    """Code-table lookup; what the table lacks passes through."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[c], c)


def state_code(c: Column, mapping: dict[str, str]) -> Column:
    """Two letters are upper-cased, names looked up, the rest trimmed and passed through."""
    text = F.trim(c)
    return F.when(F.length(text) == 2, F.upper(text)).otherwise(translated(text, mapping))


def seat_number(c: Column, longest: bool = True) -> Column:
    """First run of digits without leading zeros; at-large is 1; else an ordinal that is named; else null.

    Of several ordinals in a name (a longer one holds shorter ones) the longest counts, or with ``longest`` false the
    one that comes first in ``ORDINALS``.
    """
    text = F.lower(c)
    digits = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))
    words = [F.when(text.contains(w), F.lit(str(ORDINALS[w]))) for w in (sorted(ORDINALS, key=lambda w: (-len(w), ORDINALS[w])) if longest else ORDINALS)]
    at_large = F.when(text.rlike("at[- ]large"), F.lit("1"))
    return F.coalesce(digits.try_cast("bigint").cast("string"), at_large, *words)


def seat_digits(c: Column) -> Column:
    """First run of digits without leading zeros, else the empty string."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("bigint").cast("string"), F.lit(""))


def code_parts(c: Column, mark: str = "-") -> tuple[Column, Column]:
    """'CA-07' to ('CA', '7'); a part that is no number stays as it is."""
    parts = F.split(c, mark)
    second = F.try_element_at(parts, F.lit(2))
    return F.try_element_at(parts, F.lit(1)), F.coalesce(second.try_cast("int").cast("string"), second)


@functools.cache
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """From the Unicode tables: characters whose compatibility decomposition has one, and more than one, ASCII character."""
    one, more = {}, {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        ascii_part = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if ascii_part:
            (one if len(ascii_part) == 1 else more)[chr(code)] = ascii_part
    return one, more


def _spans(chars: list[str]) -> str:
    """A character class of ``chars`` for the JVM's regular expressions."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def ascii_folded(c: Column) -> Column:
    """Accents off; characters without an ASCII base are dropped. Plain ASCII text passes as it is.

    Characters of one ASCII character are translated; the few that have more are looked up one by one, and only in
    texts that have any.
    """
    one, more = _decompositions()
    expanded = F.map_from_arrays(F.array(*[F.lit(k) for k in more]), F.array(*[F.lit(v) for v in more.values()]))
    spread = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda ch: F.when(ch.rlike(_spans(list(more))), F.try_element_at(expanded, ch)).otherwise(ch)), "")
    text = F.when(c.rlike(_spans(list(more))), spread).otherwise(c)
    folded = F.regexp_replace(F.translate(text, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def person_key(c: Column) -> Column:
    """'lastname f': folded, lower-cased, without suffix words and anything but letters; null if nothing is left."""
    text = F.regexp_replace(F.lower(ascii_folded(c)), rf"\b({'|'.join(SUFFIXES)})\b", "")
    words = F.filter(F.split(F.regexp_replace(text, r"[^a-z]+", " "), " "), lambda w: w != "")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    return F.when(F.size(words) > 0, F.when(first == last, last).otherwise(F.concat(last, F.lit(" "), F.substring(first, 1, 1))))


def party_group(c: Column, trim: bool = True, groups: tuple[str, ...] = ("DEM", "REP")) -> Column:
    """Group by prefix of the upper-cased party, else OTH."""
    text = F.upper(F.trim(c) if trim else c)
    out = F
    for g in groups:
        out = out.when(text.startswith(g), F.lit(g))
    return out.otherwise(F.lit("OTH"))


def first_contained(c: Column, names: dict[str, str]) -> Column:
    """Label of the first name, in the order given, that the lower-cased text contains; else null."""
    return F.coalesce(*[F.when(F.lower(c).contains(name), F.lit(label)) for name, label in names.items()], F.lit(None).cast("string"))


def is_junk(c: Column, junk: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*junk), F.lit(False))


def recency(days: Column, scale: float = 30.0) -> Column:
    """1 / (1 + days / scale), days below zero as zero."""
    return F.lit(1.0) / (F.lit(1.0) + at_least(days.cast("double"), 0.0) / scale)


def reading_weight(days: Column, size: Column, grade: Column) -> Column:
    """Recent, large, well-graded readings count more; without days or size there is no weight."""
    return recency(days) * F.sqrt(at_least(size.cast("double"), 1.0)) * (F.lit(1.0) + F.coalesce(grade.cast("double"), F.lit(0.0)) / 3)


def joined_key(*parts: Column, district: Column | None = None) -> Column:
    """Parts joined by underscores; a district that is not empty follows the last part after a hyphen."""
    *front, last = parts
    if district is not None:
        last = F.concat(last, F.when(F.coalesce(district, F.lit("")) != "", F.concat(F.lit("-"), district)).otherwise(F.lit("")))
    return F.concat_ws("_", *front, last)


def eve(cycle: Column) -> Column:
    """The first of November of a year."""
    return F.make_date(cycle, F.lit(11), F.lit(1))
