"""Text cleaning and tokenisation as native Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMOJI_RANGES, PUNCTUATION, WHITESPACE_RANGES


def merge_ranges(ranges):
    """Sort and merge overlapping code point ranges.

    Fewer ranges make the regex character class cheaper; the set is the same.
    """
    merged = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def char_class(ranges) -> str:
    """Regex character class for code point ranges (Java and RE2 syntax)."""
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


EMOJI_RUN = char_class(merge_ranges(EMOJI_RANGES)) + "+"
SPACE_RUN = char_class(WHITESPACE_RANGES) + "+"
SPACE_CHARS = "".join(chr(c) for lo, hi in WHITESPACE_RANGES for c in range(lo, hi + 1))
PUNCT_RUN = "([" + "".join("\\" + c if c == "-" else c for c in PUNCTUATION) + "])\\1+"
# (?d): only a line feed ends a line, so "." takes every other character
ELONGATION = "(?d)(.)\\1{2,}"
WORD = r"[\p{L}\p{N}_]{2,}"
ANY_WORD = r"[\p{L}\p{N}_]+"
TAG = "<[^>]*>"


def _text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def strip(c) -> Column:
    """Unicode strip; SQL ``trim`` alone removes only U+0020."""
    return F.trim(_text(c), F.lit(SPACE_CHARS))


def find_emojis(c: Column) -> Column:
    """All emoji characters of a text, concatenated."""
    return F.array_join(F.regexp_extract_all(c, F.lit(EMOJI_RUN), F.lit(0)), "")


def blank_emojis(c: Column) -> Column:
    """Each run of emojis becomes one space."""
    return F.regexp_replace(c, EMOJI_RUN, " ")


def extract_emojis(c) -> Column:
    return find_emojis(strip(c))


def remove_emojis(c) -> Column:
    return blank_emojis(strip(c))


def excess_punct_count(c) -> Column:
    """Number of runs of one repeated punctuation character, emojis removed first."""
    return F.regexp_count(remove_emojis(c), F.lit(PUNCT_RUN))


def squeeze_punct(c) -> Column:
    return F.regexp_replace(c, PUNCT_RUN, "$1")


def squeeze_elongation(c) -> Column:
    return F.regexp_replace(c, ELONGATION, "$1$1")


def collapse_spaces(c) -> Column:
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def clean_text(c) -> Column:
    """The whole cleaning chain; null gives the empty string."""
    return collapse_spaces(squeeze_elongation(squeeze_punct(remove_emojis(c))))


def words(c) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD), F.lit(0))


def all_words(c) -> Column:
    """Lower-case words of any length."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(ANY_WORD), F.lit(0))


def _neighbours(tokens: Column, combine) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), combine)


def adjacent(tokens: Column) -> Column:
    """Adjacent tokens as struct(first, second)."""
    return _neighbours(tokens, lambda a, b: F.struct(a.alias("first"), b.alias("second")))


def bigrams(tokens: Column) -> Column:
    """Adjacent tokens joined by a space."""
    return _neighbours(tokens, lambda a, b: F.concat(a, F.lit(" "), b))


def truncate_tokens(tokens: Column, max_tokens: int) -> Column:
    return F.slice(tokens, 1, max_tokens)


def strip_tags(c) -> Column:
    return F.regexp_replace(_text(c), TAG, "")


def pretty_label(c) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("_"), F.lit(" "))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(c * 100, digits))
