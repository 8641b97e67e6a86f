"""Text-quality metrics, score, language, issues and tags as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.numbers import div
from corpusloom.functions.urls import let
from corpusloom.functions.text import (
    ASCII_SPACE,
    count_words,
    fold_case,
    is_blank,
)

# Phrases counted as boilerplate.
BOILERPLATE = (
    "copyright",
    "all rights reserved",
    "privacy policy",
    "terms of service",
    "cookie policy",
    "newsletter",
    "subscribe",
    "follow us",
    "social media",
    "navigation",
    "menu",
    "footer",
    "header",
)

# Words that hint at a navigation page.
NAVIGATION_HINTS = (
    "table of contents",
    "navigation",
    "site map",
    "index",
    "directory",
    "menu",
    "links",
)

# Words counted as English.
ENGLISH_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
)

# Score thresholds for passing and for skipping.
PASS_SCORE = 0.4
SKIP_SCORE = 0.3

# A whole field that is one of the words; the first letter is tested before the look behind.
_ENGLISH = (
    rf"(?U)(?=[{''.join(sorted({w[0] for w in ENGLISH_WORDS}))}])(?<!\S)"
    rf"(?:{'|'.join(ENGLISH_WORDS)})(?!\S)"
)
_FENCE = r"```[\s\S]*?```"
_FENCE_PARTS = r"```([0-9A-Za-z_]*)\n([\s\S]*?)```"
_HEADER = rf"(?dm)^#{{1,6}}[{ASCII_SPACE}]+.+"
# A link can only start at the first bracket after a closing bracket or after the last match.
_MARKDOWN_LINK = r"(?:\G|(?<=\]))[^\[\]]*+\[[^\]]++\]\([^)]++\)"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the issue detector and the page filter."""

    min_score: float = 0.5
    min_word_count: int = 50
    require_title: bool = True
    require_content: bool = True
    skip_navigation: bool = True
    blacklist: tuple[str, ...] = ("404", "not found", "error")
    language: str = ""


@dataclass(frozen=True)
class QualityWeights:
    """Share of each part of the score; the image share is never awarded."""

    words: float = 0.3
    code: float = 0.2
    images: float = 0.1
    headers: float = 0.15
    ratio: float = 0.15
    title: float = 0.1


def code_block_count(text: Column) -> Column:
    """Fenced blocks plus a third of the inline spans outside them."""
    fenced = F.regexp_count(text, F.lit(_FENCE))
    inline = F.regexp_count(F.regexp_replace(text, _FENCE, ""), F.lit("`[^`]+`"))
    return F.when(
        F.contains(text, F.lit("`")), fenced + div(inline, 3).cast("int")
    ).otherwise(F.lit(0))


def header_count(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("#")), F.regexp_count(text, F.lit(_HEADER))).otherwise(
        F.lit(0)
    )


def total_lines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def empty_lines(text: Column) -> Column:
    """Lines without any visible character: all lines minus those with one."""
    visible = r"(?U)\S[^\n]*+"
    return total_lines(text) - F.regexp_count(text, F.lit(visible))


def empty_line_ratio(text: Column) -> Column:
    return empty_lines(text).cast("double") / total_lines(text)


def has_title(title: Column) -> Column:
    return ~title.isin("", "Untitled")


def _present(phrases, text: Column) -> Column:
    """The phrases that are substrings of the text, in their order."""
    listed = F.array(*[F.lit(p) for p in phrases])
    return let(text, lambda t: F.filter(listed, lambda phrase: F.contains(t, phrase)))


def content_ratio(text: Column, folded: Column | None = None) -> Column:
    """Share of bytes outside boilerplate phrases.

    A phrase is only searched with its pattern where a plain substring test on the folded text
    finds it, which most texts fail. Phrases are array entries, as thirteen branches written out make
    generated methods too long for the JVM to compile.
    """
    folded = fold_case(text) if folded is None else folded
    size = F.octet_length(text)
    found = _present(BOILERPLATE, folded)
    matched = F.aggregate(
        found,
        F.lit(0),
        lambda total, phrase: total
        + size
        - F.octet_length(F.regexp_replace(text, F.concat(F.lit("(?iu)"), phrase), F.lit(""))),
    )
    rest = F.greatest(size - matched, F.lit(0))
    return F.when(size == 0, F.lit(0.0)).otherwise(rest.cast("double") / size)


def quality_score(
    words: Column,
    code_blocks: Column,
    headers: Column,
    ratio: Column,
    titled: Column,
    weights: QualityWeights = QualityWeights(),
) -> Column:
    """Weighted sum; the operand order fixes the last bits of the double."""

    def thirds(count: Column) -> Column:
        return (
            F.when(count >= 3, F.lit(1.0))
            .when(count > 0, count.cast("double") / F.lit(3.0))
            .otherwise(F.lit(0.0))
        )

    word_part = (
        F.when(words >= 500, F.lit(1.0))
        .when(words >= 100, words.cast("double") / F.lit(500.0))
        .otherwise(F.lit(0.0))
    )
    return (
        word_part * F.lit(weights.words)
        + thirds(code_blocks) * F.lit(weights.code)
        + thirds(headers) * F.lit(weights.headers)
        + F.least(ratio, F.lit(1.0)) * F.lit(weights.ratio)
        + F.when(titled, F.lit(1.0)).otherwise(F.lit(0.0)) * F.lit(weights.title)
    )


def detect_language(
    text: Column, words: Column | None = None, lowered: Column | None = None
) -> Column:
    """``en`` when more than one word in twenty is a common English one, else ``unknown``."""
    words = count_words(text) if words is None else words
    low = F.lower(text) if lowered is None else lowered
    common = F.regexp_count(low, F.lit(_ENGLISH))
    return F.when(common > div(words, 20), F.lit("en")).otherwise(F.lit("unknown"))


def code_blocks(text: Column) -> Column:
    """Fenced blocks as ``array<struct<language, content, line_count>>`` in text order."""
    languages = F.regexp_extract_all(text, F.lit(_FENCE_PARTS), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(_FENCE_PARTS), F.lit(2))
    return F.transform(
        F.arrays_zip(languages.alias("language"), bodies.alias("content")),
        lambda block: F.struct(
            F.when(block["language"] == "", F.lit("text"))
            .otherwise(block["language"])
            .alias("language"),
            block["content"].alias("content"),
            total_lines(block["content"]).alias("line_count"),
        ),
    )


def markdown_link_count(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("](")), F.regexp_count(text, F.lit(_MARKDOWN_LINK))
    ).otherwise(F.lit(0))


def is_navigation_page(
    title: Column, text: Column, words: Column | None = None, lowered: Column | None = None
) -> Column:
    """Two points make a navigation page: hints in text 1, in title 2, many links 1."""
    words = count_words(text) if words is None else words
    low_text = F.lower(text) if lowered is None else lowered
    low_title = F.lower(title)
    in_text, in_title = (F.size(_present(NAVIGATION_HINTS, low)) for low in (low_text, low_title))
    linked = (words > 0) & (
        markdown_link_count(text).cast("double") / F.greatest(words, F.lit(1)) > 0.3
    )
    return in_text + in_title * 2 + linked.cast("int") >= 2


def blacklisted_patterns(text: Column, blacklist, lowered: Column | None = None) -> Column:
    """The blacklist entries found in the text, in blacklist order."""
    if not blacklist:
        return F.array().cast("array<string>")
    low = F.lower(text) if lowered is None else lowered
    return F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in blacklist])
    )


def is_blacklisted(text: Column, blacklist, lowered: Column | None = None) -> Column:
    low = F.lower(text) if lowered is None else lowered
    return reduce(
        lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in blacklist], F.lit(False)
    )


def _issue(kind: str, severity: str, description: Column | str) -> Column:
    text = F.lit(description) if isinstance(description, str) else description
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        text.alias("description"),
    )


def detect_issues(
    title: Column,
    text: Column,
    rules: QualityRules = QualityRules(),
    words: Column | None = None,
    lowered: Column | None = None,
) -> Column:
    """Ordered ``array<struct<type, severity, description>>``."""
    words = count_words(text) if words is None else words

    def blacklisted(found: Column) -> Column:
        listed = F.concat(
            F.lit("Content contains blacklisted pattern"),
            F.when(F.size(found) > 1, F.lit("s: ")).otherwise(": "),
            F.array_join(found, ", "),
        )
        return F.when(F.size(found) > 0, _issue("blacklisted_content", "warning", listed))

    checks = [
        F.when(
            words < rules.min_word_count,
            _issue(
                "word_count", "warning", "Content has fewer words than recommended minimum"
            ),
        )
    ]
    if rules.require_title:
        checks.append(
            F.when(~has_title(title), _issue("missing_title", "error", "Page is missing a title"))
        )
    if rules.require_content:
        checks.append(
            F.when(is_blank(text), _issue("empty_content", "error", "Page has no content"))
        )
    checks.append(let(blacklisted_patterns(text, rules.blacklist, lowered), blacklisted))
    return F.array_compact(F.array(*checks))


def should_skip(
    score: Column, navigation: Column, issues: Column, skip_navigation: bool = True
) -> Column:
    skip = (score < SKIP_SCORE) | F.exists(issues, lambda i: i["severity"] == "error")
    return skip | navigation if skip_navigation else skip


def generate_tags(words: Column, code_blocks: Column, headers: Column, ratio: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(code_blocks > 0, F.lit("technical")),
            F.when(words > 1000, F.lit("long-form")).when(words < 200, F.lit("short-form")),
            F.when(headers > 0, F.lit("structured")),
            F.when((words >= 500) & (code_blocks >= 2), F.lit("comprehensive")),
            F.when(ratio < 0.3, F.lit("low-content")),
        )
    )
