"""Whitespace, tokens and noise removal.

``\\s`` stands for Unicode White_Space only under ``(?U)``, where Java tests it by character type;
the narrower ASCII class is written out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What RE2 calls \s.
ASCII_SPACE = r"\t\n\f\r "

# Literal heads of the noise phrases.
NOISE_HEADS = ("skip to ", "click here to ", "subscribe to ", "follow us on ")

# Word characters under case folding also include the long s and the Kelvin sign.
_WORD = r"[0-9A-Za-z_\x{17F}\x{212A}]"

# A lazy prefix that reaches back to the line start can only begin where the previous match ended
# or after a newline; saying so, and committing to the first head, keeps the scan linear.
NOISE_PATTERNS = (
    rf"(?iu)(?:\G|(?<=\n))(?>[^\n]*?Skip to )[^\n]*?content[{ASCII_SPACE}]*",
    rf"(?iu)Click here to {_WORD}+[{ASCII_SPACE}]*",
    rf"(?iu)Subscribe to {_WORD}+ {_WORD}+[{ASCII_SPACE}]*",
    rf"(?iu)Follow us on {_WORD}+[{ASCII_SPACE}]*",
)


def fold_case(text: Column) -> Column:
    """Lower case with the long s as an s, so folded letters compare equal to ASCII ones.

    Lower case after upper case would say the same, but the optimizer drops the inner call.
    """
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def contains_any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def trim_space(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_extract(text, r"(?sU)\A\s*+(.*\S)", 1)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def count_words(text: Column) -> Column:
    """Number of fields between runs of Unicode white space.

    Every field gives way to its first character and the space goes; counting matches instead would
    hold all of them in an array.
    """
    return F.length(F.regexp_replace(text, r"(?U)\s*+(\S)\S*+|\s++", "$1"))


def strip_noise(text: Column) -> Column:
    """Delete the four noise phrases in order.

    The first deletion needs one of the heads in the untouched text, so texts without any head
    skip all four scans.
    """
    stripped = text
    for pattern in NOISE_PATTERNS:
        stripped = F.regexp_replace(stripped, pattern, "")
    return F.when(contains_any(fold_case(text), NOISE_HEADS), stripped).otherwise(text)


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{ASCII_SPACE}]{{2,}}|[\t\n\f\r]", " ")


def clean_text(text: Column) -> Column:
    """Noise phrases out, white-space runs to one space, ends trimmed."""
    return trim_space(collapse_space(strip_noise(text)))


def rfc3339(ts: Column) -> Column:
    """RFC 3339 in the session time zone (UTC prints as Z)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
