"""Scored pages, quality filters and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import quality as Q
from corpusloom.functions.numbers import div
from corpusloom.functions.text import count_words, fold_case
from corpusloom.operators.distributed import pinned
from corpusloom.session import store


def extract_metrics(df: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Add the metrics of a text as plain columns."""
    return _measured(df, title, content).drop("_lower")


def _measured(df: DataFrame, title: str, content: str) -> DataFrame:
    """Metrics and the lower-case text.

    Words and both case-folded texts are computed once in a first step and read by the next.
    """
    text = F.col(content)
    step = df.withColumns(
        {"word_count": count_words(text), "_folded": fold_case(text), "_lower": F.lower(text)}
    )
    step = step.withColumns(
        {
            "code_block_count": Q.code_block_count(text),
            "image_count": F.lit(0),
            "link_count": F.lit(0),
            "header_count": Q.header_count(text),
            "total_lines": Q.total_lines(text),
            "empty_lines": Q.empty_lines(text),
            "content_ratio": Q.content_ratio(text, F.col("_folded")),
            "has_title": Q.has_title(F.col(title)),
        }
    ).drop("_folded")
    return step.withColumns(
        {
            "empty_line_ratio": F.col("empty_lines").cast("double") / F.col("total_lines"),
            "has_headers": F.col("header_count") > 0,
        }
    )


def analyze_content(
    df: DataFrame,
    rules: Q.QualityRules = Q.QualityRules(),
    weights: Q.QualityWeights = Q.QualityWeights(),
    title: str = "title",
    content: str = "content",
) -> DataFrame:
    """Add a ``quality`` struct. Image and link counts are 0, as texts do not carry them.

    Score and counts are computed once per row. Navigation, language, issues and tags are only computed where they
    are read; pin ``quality`` before filters on them if it is read again.
    """
    metrics = _measured(df, title, content)
    text, head, words = F.col(content), F.col(title), F.col("_core.word_count")
    low = F.col("_lower")
    core = F.struct(
        Q.quality_score(
            F.col("word_count"),
            F.col("code_block_count"),
            F.col("header_count"),
            F.col("content_ratio"),
            F.col("has_title"),
            weights,
        ).alias("score"),
        "word_count",
        "code_block_count",
        "image_count",
        "link_count",
        "empty_line_ratio",
        "content_ratio",
        "has_title",
        "has_headers",
        "header_count",
    )
    quality = F.struct(
        *[
            F.col(f"_core.{name}").alias(name)
            for name in (
                "score",
                "word_count",
                "code_block_count",
                "image_count",
                "link_count",
                "empty_line_ratio",
                "content_ratio",
                "has_title",
                "has_headers",
            )
        ],
        Q.is_navigation_page(head, text, words, low).alias("is_navigation_page"),
        Q.detect_language(text, words, low).alias("language"),
        Q.detect_issues(head, text, rules, words, low).alias("issues"),
        Q.generate_tags(
            words,
            F.col("_core.code_block_count"),
            F.col("_core.header_count"),
            F.col("_core.content_ratio"),
        ).alias("tags"),
    )
    return pinned(metrics, "_core", core).select(*df.columns, quality.alias("quality"))


def page_metadata(
    df: DataFrame,
    last_modified: Column,
    content_type: str = "text/html",
    content: str = "content",
    words: Column | None = None,
) -> DataFrame:
    """Add the ``metadata`` struct of a page; ``words`` is its word count where that is known."""
    return df.withColumn(
        "metadata",
        F.struct(
            (count_words(F.col(content)) if words is None else words).alias("word_count"),
            last_modified.alias("last_modified"),
            F.lit(content_type).alias("content_type"),
        ),
    )


def extract_code_blocks(df: DataFrame, content: str = "content", keys=("idx",)) -> DataFrame:
    """One row per fenced block: keys, ``pos, language, content, line_count``."""
    blocks = df.select(*keys, F.posexplode(Q.code_blocks(F.col(content))).alias("pos", "_block"))
    return blocks.select(*keys, "pos", "_block.*")


def code_language_counts(df: DataFrame, content: str = "content") -> DataFrame:
    return (
        extract_code_blocks(df, content, ())
        .groupBy("language")
        .agg(F.count("*").alias("blocks"), F.sum("line_count").alias("lines"))
    )


def quality_filter(
    scored: DataFrame, rules: Q.QualityRules = Q.QualityRules(), content: str = "content"
) -> DataFrame:
    """Keep pages above the score and word limits that hold no blacklisted pattern."""
    return scored.filter(
        (F.col("quality.score") >= rules.min_score)
        & (F.col("quality.word_count") >= rules.min_word_count)
        & ~Q.is_blacklisted(F.col(content), rules.blacklist)
    )


def language_filter(scored: DataFrame, language: str) -> DataFrame:
    """Keep one detected language; an empty one keeps everything."""
    return scored.filter(F.col("quality.language") == language) if language else scored


def skip_filter(scored: DataFrame, rules: Q.QualityRules = Q.QualityRules()) -> DataFrame:
    """Drop what :func:`should_skip` names."""
    return scored.filter(
        ~Q.should_skip(
            F.col("quality.score"),
            F.col("quality.is_navigation_page"),
            F.col("quality.issues"),
            rules.skip_navigation,
        )
    )


def quality_stats(scored: DataFrame) -> DataFrame:
    """One row of corpus statistics.

    The word mean is the truncated mean of all words, which does not depend on row order.
    """
    score = F.col("quality.score")
    words = F.sum(F.col("quality.word_count").cast("long"))
    return scored.agg(
        F.count("*").alias("total_pages"),
        F.count_if(score >= Q.PASS_SCORE).alias("passed_pages"),
        F.count_if(score < Q.PASS_SCORE).alias("failed_pages"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_score"),
        F.when(F.count("*") > 0, div(words, F.count("*")))
        .otherwise(F.lit(0))
        .alias("average_word_count"),
    )


def top_pages(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best pages in order, equal scores by ``idx``."""
    return _extreme(scored, F.col("quality.score").desc(), k)


def worst_pages(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` worst pages in order, equal scores by ``idx``."""
    return _extreme(scored, F.col("quality.score").asc(), k)


def _extreme(scored: DataFrame, order: Column, k: int) -> DataFrame:
    """Whole rows of the ``k`` first pages. The choice is made on ``(score, idx)``, so no task sends contents of
    pages that are not among them; the semi-join reads those of the ``k`` chosen."""
    chosen = scored.orderBy(order, "idx").limit(k).select("idx")
    return scored.join(chosen, "idx", "left_semi").orderBy(order, "idx").limit(k)


def common_issues(scored: DataFrame) -> DataFrame:
    return (
        scored.select(F.explode("quality.issues.type").alias("issue_type"))
        .groupBy("issue_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "issue_type")
    )


def tag_counts(scored: DataFrame) -> DataFrame:
    return (
        scored.select(F.explode("quality.tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("count"))
    )


def language_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("quality.language").alias("language")).agg(
        F.count("*").alias("count")
    )


def quality_report(scored: DataFrame, generated_at: Column, k: int = 10) -> DataFrame:
    """One row: statistics, best and worst ``k`` pages, issue counts, time.

    What is gathered is bounded: ``k`` pages twice and one entry per kind of issue. Pages are scored once: what the
    report reads is stored without contents, and each part of the report reads its own columns of that.
    """
    page = F.struct("url", "title", "quality")

    def listed(rows: DataFrame, order: list[Column], item: Column, name: str) -> DataFrame:
        key = F.struct(*order, item.alias("_item"))
        return rows.agg(
            F.transform(F.array_sort(F.collect_list(key)), lambda r: r["_item"]).alias(name)
        )

    score = F.col("quality.score")
    slim = store(scored.select("idx", "url", "title", "quality"), "quality-report")
    top = listed(top_pages(slim, k), [(-score).alias("s"), F.col("idx")], page, "top_pages")
    worst = listed(worst_pages(slim, k), [score.alias("s"), F.col("idx")], page, "worst_pages")
    issue = F.struct("issue_type", "count")
    counts = listed(
        common_issues(slim), [(-F.col("count")).alias("c"), F.col("issue_type")], issue, "issues"
    )
    stats = quality_stats(slim)
    return stats.select(
        F.struct(*stats.columns).alias("stats"),
        top.scalar().alias("top_pages"),
        worst.scalar().alias("worst_pages"),
        counts.scalar().alias("common_issues"),
        generated_at.alias("generated_at"),
    )
