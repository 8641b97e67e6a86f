"""From raw pages to a finished corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.quality import QualityRules, QualityWeights
from corpusloom.functions.urls import CRAWL_RULES, UrlRules
from corpusloom.operators.crawl import crawl_bfs
from corpusloom.operators.distributed import pinned
from corpusloom.operators.extract import extract_pages, scan_pages, texts_of
from corpusloom.operators.links import allowed_domain, graph_of, robots_allowed
from corpusloom.operators.quality import (
    analyze_content,
    language_filter,
    page_metadata,
    quality_filter,
    skip_filter,
)
from corpusloom.session import store


def scrape_with_quality(
    pages: DataFrame,
    timestamp: Column,
    rules: QualityRules = QualityRules(),
    weights: QualityWeights = QualityWeights(),
    skip: bool = False,
) -> DataFrame:
    """Extract, score and filter: ``idx, url, title, content, quality, metadata``.

    ``skip=True`` also drops what :func:`corpusloom.functions.quality.should_skip` names.
    """
    return _good_pages(extract_pages(pages), timestamp, rules, weights, skip)


def _good_pages(
    texts: DataFrame,
    timestamp: Column,
    rules: QualityRules,
    weights: QualityWeights = QualityWeights(),
    skip: bool = False,
) -> DataFrame:
    scored = analyze_content(texts, rules, weights)
    if rules.language or skip:  # filters read what is only computed on demand
        scored = pinned(scored.withColumnRenamed("quality", "_quality"), "quality", F.col("_quality")).drop("_quality")
    kept = language_filter(quality_filter(scored, rules), rules.language)
    kept = skip_filter(kept, rules) if skip else kept
    return page_metadata(kept, timestamp, words=F.col("quality.word_count"))


def build_corpus(
    pages: DataFrame,
    seeds: DataFrame,
    timestamp: Column,
    max_depth: int = 5,
    dedup: bool = True,
    quality: bool = False,
    url_rules: UrlRules = CRAWL_RULES,
    quality_rules: QualityRules = QualityRules(),
    robots: DataFrame | None = None,
    link_scope: str = "content",
) -> DataFrame:
    """Pages a crawl from the seeds reaches: ``idx, title, url, content, timestamp, depth``.

    Only pages on hosts of the seeds, and on hosts whose robots lines let them in, can be reached; both are
    decided on ``idx, url`` without the markup, and only their markup is scanned, once. The crawl then reads the
    stored links, and only pages it reached have their stored text cleaned and scored.
    """
    allowed = allowed_domain(pages.select("idx", "url"), seeds)
    allowed = store(robots_allowed(allowed, robots) if robots is not None else allowed, "allowed")
    scanned = store(scan_pages(pages.join(allowed.select("idx"), "idx", "left_semi")), "scanned")
    edges = graph_of(scanned.select("idx", "url", "links"), link_scope).filter("follow")
    visited = crawl_bfs(
        allowed.select("idx", "url"),
        edges.select(F.col("idx").alias("src"), "pos", F.col("resolved").alias("dst_url")),
        seeds,
        max_depth,
        url_rules if dedup else None,
    ).select("idx", "depth")
    reached = scanned.select("idx", "url", "title", "raw_text").join(visited, "idx", "left_semi")
    texts = texts_of(reached)
    if quality:
        texts = _good_pages(texts, timestamp, quality_rules)
    return texts.select("idx", "title", "url", "content", timestamp.alias("timestamp")).join(
        visited, "idx"
    )
