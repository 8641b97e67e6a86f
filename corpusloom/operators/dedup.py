"""Duplicate URLs: first occurrence by ``idx`` wins.

Which row comes first is a combinable minimum per canonical URL. Sending the answer back joins on
``idx``, which is unique, so a canonical URL shared by much of the table skews nothing.

What reads the canonical form more than once works on :func:`canonical_keys`, a stored ``(idx, canonical)``
table. A job that asks several questions of one table stores it once and passes it as ``keys``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.urls import CRAWL_RULES, UrlRules, normalize_url
from corpusloom.operators.distributed import first_per_key, pinned, salted_lookup
from corpusloom.session import store


def with_canonical(df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url") -> DataFrame:
    """Add ``canonical``, NULL for unparsable URLs."""
    return pinned(df, "canonical", normalize_url(F.col(url), rules))


def _firsts(keyed: DataFrame) -> DataFrame:
    return (
        keyed.filter(F.col("canonical").isNotNull())
        .groupBy("canonical")
        .agg(F.min("idx").alias("idx"))
    )


def canonical_keys(df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url") -> DataFrame:
    """``idx, canonical`` of every row, computed once and stored."""
    return store(with_canonical(df, rules, url).select("idx", "canonical"), "canonical-keys")


def mark_duplicates(
    df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url", keys: DataFrame | None = None
) -> DataFrame:
    """Add ``canonical`` and ``is_duplicate``; unparsable URLs count as duplicates."""
    keys = canonical_keys(df, rules, url) if keys is None else keys
    first = _firsts(keys).select("idx", F.lit(False).alias("is_duplicate"))
    return (
        df.join(keys, "idx", "left")
        .join(first, "idx", "left")
        .withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(True)))
    )


def dedup_urls(df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url") -> DataFrame:
    """One row per canonical URL. Wide payload columns do not travel through the aggregation."""
    keyed = with_canonical(df, rules, url)
    return df.join(_firsts(keyed.select("idx", "canonical")), "idx")


def canonical_map(df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url") -> DataFrame:
    """``url, canonical`` of the rows that came first."""
    keyed = with_canonical(df, rules, url).filter(F.col("canonical").isNotNull())
    return first_per_key(
        keyed.select("canonical", "idx", F.col(url).alias("url")), ["canonical"], "idx"
    ).select("url", "canonical")


def duplicate_count(df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url") -> DataFrame:
    """Rows minus distinct canonical URLs: later occurrences and unparsable rows."""
    per_url = (
        with_canonical(df, rules, url)
        .groupBy("canonical")
        .agg(F.count("*").alias("n"))
    )
    extra = F.when(F.col("canonical").isNull(), F.col("n")).otherwise(F.col("n") - 1)
    return per_url.agg(F.coalesce(F.sum(extra), F.lit(0)).alias("duplicate_count"))


def seen_url_count(
    df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url", approximate: bool = False
) -> DataFrame:
    keyed = with_canonical(df, rules, url)
    count = F.approx_count_distinct if approximate else F.count_distinct
    return keyed.agg(count("canonical").alias("seen_url_count"))


def duplicate_groups(df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url") -> DataFrame:
    """Canonical URLs with their group size and first occurrence; groups stay unmaterialised."""
    keyed = with_canonical(df, rules, url).filter(F.col("canonical").isNotNull())
    return keyed.groupBy("canonical").agg(
        F.count("*").alias("members"),
        F.min("idx").alias("first_idx"),
        F.min_by(F.col(url), F.col("idx")).alias("first_url"),
    )


def duplicate_members(
    df: DataFrame, rules: UrlRules = CRAWL_RULES, url: str = "url", keys: DataFrame | None = None
) -> DataFrame:
    """The members of every group, one per row, with the size of their group."""
    keys = (canonical_keys(df, rules, url) if keys is None else keys).filter(F.col("canonical").isNotNull())
    sizes = keys.groupBy("canonical").agg(F.count("*").alias("members"), F.min("idx").alias("first_idx"))
    sized = salted_lookup(keys, sizes, ["canonical"], F.col("idx"))
    return sized.join(df.select("idx", F.col(url).alias("url")), "idx").select(
        "canonical", "members", "idx", "url", (F.col("idx") == F.col("first_idx")).alias("is_first")
    )


def is_seen(
    df: DataFrame,
    seen: DataFrame,
    rules: UrlRules = CRAWL_RULES,
    url: str = "url",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``canonical`` and ``is_seen``: in the seen set by canonical URL, or unparsable.

    The distinct URLs of the table that are in the seen set are found first; only the ``idx`` of their rows goes back.
    """
    keys = canonical_keys(df, rules, url) if keys is None else keys
    known = with_canonical(seen, rules, url).filter(F.col("canonical").isNotNull()).select("canonical").distinct()
    met = keys.select("canonical").distinct().join(known, "canonical", "left_semi")
    found = salted_lookup(keys, met, ["canonical"], F.col("idx")).select("idx", F.lit(True).alias("is_seen"))
    return (
        df.join(keys, "idx", "left")
        .join(found, "idx", "left")
        .withColumn("is_seen", F.col("canonical").isNull() | F.coalesce("is_seen", F.lit(False)))
    )


def new_links_only(
    links: DataFrame, seen: DataFrame, rules: UrlRules = CRAWL_RULES, seen_url: str = "url"
) -> DataFrame:
    """Followed links to pages not seen yet, one per canonical URL.

    ``links`` has ``idx, pos, resolved, follow``; the smallest ``(idx, pos)`` speaks for a target.
    """
    targets = (
        with_canonical(links.filter("follow"), rules, "resolved")
        .filter(F.col("canonical").isNotNull())
        .groupBy("canonical")
        .agg(F.min(F.struct("idx", "pos", "resolved")).alias("_link"))
        .select("canonical", "_link.*")
    )
    known = with_canonical(seen.select(seen_url), rules, seen_url).select("canonical").distinct()
    return targets.join(known, "canonical", "left_anti")
