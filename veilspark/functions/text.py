"""Text functions as Catalyst expressions; all stay inside the JVM.

Offsets are code points. A page is normalised before matching: one leading byte-order mark goes, a hyphen
at a line end between letters goes with its break, any other hyphen keeps its place and loses the
break, and runs of white space become one space. normalized_breaks has the same length but keeps, in each
space's place, whether the run held no line break (space), one (newline) or more (paragraph separator).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAGRAPH = "\u2029"
#: Line breaks: LF, VT, FF, CR, NEL, line and paragraph separators.
BREAKS = r"\n\x0B\x0C\r\x{85}\x{2028}\x{2029}"


def _joined_lines(text: Column) -> Column:
    text = F.regexp_replace(text, r"^\x{FEFF}", "")
    joined = F.regexp_replace(text, rf"(?U)(?<=\p{{L}})-\s*[{BREAKS}]\s*(?=\p{{L}})", "")
    joined = F.regexp_replace(joined, rf"(?U)-\s*[{BREAKS}]\s*(?=\S)", "-")
    return F.when(F.rlike(text, F.lit(rf"(?U)-\s*[{BREAKS}]")), joined).otherwise(text)


def normalized(text: Column) -> Column:
    """The text that matchers run over. Single spaces, most of all white space, are left as they are."""
    return F.trim(F.regexp_replace(_joined_lines(text), r"(?U)[^!-~](?:(?<= )\s+|(?<! )(?<=\s)\s*)", " "))  # what most characters are is told at once


#: White space that is no single space or LF within a text, an LF after a hyphen, a byte-order mark.
UNEVEN = r"(?U)[^!-~](?:(?<=[^\S \n]|\x{FEFF}|-\n|\A\n)|(?<=[ \n])\s|(?<=\n)\z)"


def normalized_breaks(text: Column) -> Column:
    """normalized(text) with the kind of break kept in each space's place; a text without UNEVEN keeps all but its outer blanks."""
    return F.when(F.rlike(text, F.lit(UNEVEN)), _all_breaks(text)).otherwise(F.trim(text))


def _all_breaks(text: Column) -> Column:
    text = F.regexp_replace(_joined_lines(text), r"\r\n", "\n")
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(text, rf"(?U)[^\S{BREAKS}]*[{BREAKS}]\s*[{BREAKS}]\s*", PARAGRAPH)
    text = F.regexp_replace(text, rf"(?U)[^\S{BREAKS}]*[\n\x0B\x0C\r\x{{85}}\x{{2028}}]\s*", "\n")
    return F.regexp_replace(text, rf"(?U)[^\S{BREAKS}]+", " ")


def folded(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed: how descriptions and recognised text are compared."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(text: Column) -> Column:
    """Luhn check over the digits; false without any."""
    return F.call_function("luhn_check", digits(text))


def has_number(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{N}"))


def has_adjacent_digits(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{N}\p{N}"))


def masked_line(text: Column) -> Column:
    """As reports on a console mask a value: at most twelve dots."""
    return F.repeat(F.lit("•"), F.least(F.length(text), F.lit(12)))


def masked_value(text: Column) -> Column:
    """As a findings list masks a value: four to eighteen dots."""
    return F.repeat(F.lit("•"), F.least(F.greatest(F.length(text), F.lit(4)), F.lit(18)))


def shown_line(text: Column) -> Column:
    """A value on one line."""
    return F.regexp_replace(text, r"\r\n|[\n\r]", "⏎")


def rule_description(kind: Column, literal: Column, canonical: Column) -> Column:
    return F.when(kind == "exact", F.concat(F.lit("“"), literal, F.lit("”"))).otherwise(canonical)


def has_text(text: Column) -> Column:
    """Whether a page has a text layer worth examining."""
    return F.coalesce(F.rlike(text, F.lit(r"(?U)\S")), F.lit(False))
