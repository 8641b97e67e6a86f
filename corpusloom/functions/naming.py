"""Anchors, file names and directory names derived from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ASCII_SPACE


def _strip(text: Column, char: str) -> Column:
    return F.btrim(text, F.lit(char))


def make_anchor(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), rf"[^a-z0-9{ASCII_SPACE}\-]", "")
    return _strip(F.regexp_replace(kept, rf"[{ASCII_SPACE}]+", "-"), "-")


def _safe_stem(title: Column, length: int) -> Column:
    kept = F.regexp_replace(title, rf"[^a-zA-Z0-9\-_{ASCII_SPACE}]", "")
    return F.left(_strip(F.regexp_replace(kept, rf"[{ASCII_SPACE}]+", "_"), "_"), F.lit(length))


def safe_filename(title: Column, index: Column, extension: str) -> Column:
    """First 50 safe characters, the 0-based page index, the extension."""
    stem = _safe_stem(title, 50)
    return F.concat(
        F.when(stem == "", F.lit("page")).otherwise(stem),
        F.lit("_"),
        index.cast("string"),
        F.lit(extension),
    )


def safe_directory_name(title: Column) -> Column:
    """First 30 safe characters in lower case."""
    stem = F.lower(_safe_stem(title, 30))
    return F.when(stem == "", F.lit("untitled")).otherwise(stem)


def page_file(position: Column) -> Column:
    """``page_001.md`` for the page at 0-based ``position``."""
    return F.format_string("page_%03d.md", position + 1)
