"""Depth-limited traversal of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.numbers import div
from corpusloom.functions.urls import UrlRules, normalize_url
from corpusloom.operators.distributed import pinned, salted_lookup
from corpusloom.session import Bucketed, store

# Links of one page travel in blocks of this many, so a page with very many is several join keys.
_BLOCK = 4096


def _keyed(df: DataFrame, url: str, rules: UrlRules | None) -> DataFrame:
    """Add ``key``, what counts as the same address: canonical, or exact without fragment."""
    exact = F.regexp_replace(F.col(url), r"#[\s\S]*\z", "")
    key = exact if rules is None else normalize_url(F.col(url), rules)
    return pinned(df, "key", key).filter(F.col("key").isNotNull())


def crawl_bfs(
    pages: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int,
    rules: UrlRules | None = None,
) -> DataFrame:
    """Pages reachable from the seeds with their smallest depth; seeds have depth 1.

    ``pages`` is ``idx, url``; ``edges`` is ``src`` (page idx), ``pos``, ``dst_url`` of followed
    links; ``seeds`` is ``url``. Markup is parsed before this point and never again, and addresses are
    compared before the first round: links turn into ``src, block, dst`` numbers of pages, links to no
    page go, and what is left is written in buckets by source. Pages that were reached are a second
    table, in buckets by page. Every round

    * looks the frontier up among the links, which stay where they are (only the frontier moves),
    * collapses its targets before they shuffle, so a page everybody links to is one row per task,
    * drops known pages with an anti join against the buckets of the second table and appends the rest.

    Rounds end where nothing new is found, so a large ``max_depth`` costs nothing. The driver sees one
    boolean per round.
    """
    if max_depth < 1:
        return pages.select("idx", "url", F.lit(1).alias("depth")).limit(0)
    blocked = edges.select("src", div(F.col("pos"), _BLOCK).alias("block"), "dst_url")
    spelled = store(_keyed(blocked, "dst_url", rules).drop("dst_url"), "links")
    blocks = spelled.groupBy(F.col("src").alias("idx")).agg((F.max("block") + 1).alias("blocks"))
    keyed = _keyed(pages.select("idx", "url"), "url", rules)
    first = keyed.groupBy("key").agg(F.min("idx").alias("idx"))
    known_blocks = F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks")
    targets = store(first.join(blocks, "idx", "left").select("key", F.col("idx").alias("dst"), known_blocks), "targets")
    numbered = salted_lookup(spelled, targets, ["key"], F.struct("src", "block")).drop("key")
    wanted_keys = _keyed(seeds.select("url"), "url", rules).select("key").distinct()
    found = targets.join(wanted_keys, "key", "left_semi").select("dst", "blocks")

    with Bucketed(numbered, "edges", ["src", "block"]) as graph:
        with Bucketed(_reached(found, 1), "reached", ["idx"]) as reached:
            for depth in range(2, max_depth + 1):
                frontier = reached.table().where(F.col("depth") == depth - 1)
                if frontier.isEmpty():
                    break
                fresh = _reached(next_targets(graph.table(), frontier), depth)
                reached.append(fresh.join(reached.table(), "idx", "left_anti"))
            visited = reached.table().select("idx", "depth")
            return store(visited.join(pages.select("idx", "url"), "idx").select("idx", "url", "depth"), "visited")


def _reached(found: DataFrame, depth: int) -> DataFrame:
    return found.select(F.col("dst").alias("idx"), "blocks", F.lit(depth).alias("depth"))


def next_targets(graph: DataFrame, frontier: DataFrame) -> DataFrame:
    """Distinct ``dst, blocks`` that the frontier's pages link to; ``graph`` is not moved."""
    sources = frontier.where("blocks > 0").select(
        F.col("idx").alias("src"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")
    )
    return graph.join(sources, ["src", "block"], "left_semi").groupBy("dst").agg(F.max("blocks").alias("blocks"))


def depth_limit(visited: DataFrame, max_depth: int) -> DataFrame:
    return visited.filter(F.col("depth") <= max_depth)


def page_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("page_count"))


def crawl_summary(visited: DataFrame) -> DataFrame:
    """Pages found at each depth."""
    return visited.groupBy("depth").agg(F.count("*").alias("pages"))
