"""Text functions whose results match Python's string semantics, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip and split see it; Java's Unicode class lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: The same, one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Split at runs of white space; a text of nothing else has no words."""
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"(?U){SPACE}+"))


def normalised(text: Column) -> Column:
    """Lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def preview(text: Column, n: int = 50) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def has_any(text: Column, characters: str) -> Column:
    """Any of these characters. Bytes are compared, which is far quicker than a class of a regular expression."""
    out = F.lit(False)
    for c in characters:
        out = out | F.contains(text, F.lit(c))
    return (F.octet_length(text) > F.length(text)) & out if all(c > "\x7f" for c in characters) else out


def has_repeated_character(text: Column) -> Column:
    """One character five times or more in a row."""
    return text.rlike(r"(?d)(.)\1\1\1\1")


def has_kana_around_hanzi(text: Column) -> Column:
    return has_any(text, "们这那什么怎样") & text.rlike("[ぁ-んァ-ン][们这那什么怎样][ぁ-んァ-ン]")


def has_stop_run(text: Column) -> Column:
    return has_any(text, "。、") & text.rlike("[。、]{3,}")


def is_numeric_only(stripped: Column) -> Column:
    return stripped.rlike(r"(?U)^[\p{Nd}\s\x1c-\x1f.,\-]+$")


def has_particle_before_hanzi(text: Column) -> Column:
    return has_any(text, "们这那什") & text.rlike("[はがをにでと][们这那什]")


def mixes_kana_and_simplified(text: Column) -> Column:
    """Any kana (no length mark) together with any of ten simplified characters."""
    return has_any(text, "这那里么们该让给对为") & text.rlike("[ぁ-ゖァ-ヶ]")


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlaps; an empty part never does."""
    return F.when(F.length(part) == 0, F.lit(0)).otherwise((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def thousands(number: Column) -> Column:
    """A whole number with a comma before every third digit."""
    return F.format_number(number, 0)
