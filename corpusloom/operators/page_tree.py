"""The tree pages form by their URL paths, for hierarchical output.

The ancestors of a page are the existing proper ``/`` prefixes of its path, the first page of each
path standing for it. So one explode of path parts and one equi-join on running prefix hashes give depth,
levels, order keys and every traversal; nothing recurses and nothing compares pages pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import urls as U
from corpusloom.operators.distributed import first_per_key, salted_lookup
from corpusloom.session import store

ROOT_TITLE = "Root"
_ANCESTORS = "array<struct<idx: long, title: string>>"


def _step(at: Column, part: Column) -> Column:
    return F.xxhash64(at, part)


def path_hash(path: Column) -> Column:
    """Hash of a whole path, the same as that of the prefix it is for longer paths."""
    steps = F.transform(F.split(path, "/"), lambda part, k: _step(k, part))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, step: acc.bitwiseXOR(step))


def path_prefixes(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """A row per ``/`` prefix of each path: ``idx``, ``keep``, its parts ``_parts`` and hash ``_hash``.

    The hash of a prefix is the one before it and one more part, a running aggregate over the rows of
    ``idx``, so no row holds more than one part of a path and a path of many slashes costs in proportion
    to its length. Hashes propose; whoever joins on them compares the paths.
    """
    parts = nodes.where(F.contains("path", F.lit("/"))).select(
        "idx", *keep, F.size(F.split("path", "/")).alias("_all"), F.posexplode(F.split("path", "/")).alias("_at", "_part")
    )
    steps = parts.where("_at < _all - 1").select(
        "idx", *keep, (F.col("_at") + 1).alias("_parts"), _step(F.col("_at"), F.col("_part")).alias("_step")
    )
    upto = Window.partitionBy("idx").orderBy("_parts").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("_hash", F.bit_xor("_step").over(upto)).drop("_step")


def prefix_owners(nodes: DataFrame, keep: list[str], others: list[str]) -> DataFrame:
    """The first node of each path with what joins it to :func:`path_prefixes`; ``_anc`` is its idx."""
    first = first_per_key(nodes.select(*keep, F.col("path").alias("_anc_path"), "idx", *others), [*keep, "_anc_path"], "idx")
    return first.withColumns(
        {"_parts": F.size(F.split("_anc_path", "/")), "_hash": path_hash(F.col("_anc_path"))}
    ).withColumnRenamed("idx", "_anc")


def proven(found: DataFrame, nodes: DataFrame, or_else: Column | None = None) -> DataFrame:
    """Candidates whose path really is a prefix of the node's, up to a slash; an equal hash is no proof."""
    prefix = F.col("path").startswith(F.concat("_anc_path", F.lit("/")))
    return found.join(nodes.select("idx", "path"), "idx").where(prefix if or_else is None else prefix | or_else)


def build_page_tree(pages: DataFrame, scope: str = "all") -> DataFrame:
    """Nodes ``idx, url, path, title, parent_idx, ancestors, level, true_level``.

    ``parent_idx`` is NULL below the synthetic root. ``ancestors`` runs from the top down.
    ``scope="host"`` keeps hosts apart; by default only paths count.
    """
    if scope not in ("all", "host"):
        raise ValueError(f"scope must be 'all' or 'host', not {scope!r}")
    host = [U.host(F.col("url")).alias("_host")] if scope == "host" else []
    keep = ["_host"] if host else []
    # Read several times below; titles may come from markup, which must not be parsed that often.
    nodes = store(
        pages.select("idx", "url", "title", U.url_path(F.col("url"), "empty").alias("path"), *host),
        "page-nodes",
    )
    owners = prefix_owners(nodes.where("path <> ''"), keep, ["title"])
    wanted = path_prefixes(nodes, keep)
    found = salted_lookup(wanted, owners, [*keep, "_parts", "_hash"], F.col("idx"))
    # The collected list is bounded by the number of slashes in one URL.
    chains = (
        proven(found, nodes)
        .groupBy("idx")
        .agg(F.array_sort(F.collect_list(F.struct("_parts", "_anc", F.col("title").alias("_anc_title")))).alias("_chain"))
        .select(
            "idx",
            F.transform(
                "_chain",
                lambda a: F.struct(a["_anc"].alias("idx"), a["_anc_title"].alias("title")),
            ).alias("ancestors"),
        )
    )
    joined = nodes.join(chains, "idx", "left").withColumn(
        "ancestors", F.coalesce("ancestors", F.array().cast(_ANCESTORS))
    )
    return joined.select(
        "idx",
        "url",
        "path",
        "title",
        F.try_element_at("ancestors", F.lit(-1))["idx"].alias("parent_idx"),
        "ancestors",
        page_level(F.col("idx"), F.col("ancestors")).alias("level"),
        (F.size("ancestors") + 1).alias("true_level"),
    )


def page_level(idx: Column, ancestors: Column) -> Column:
    """Level as assigned in page order: a parent that comes later counts as level 0.

    That is one plus the nearest ancestors whose positions keep falling.
    """
    start = F.struct(
        F.lit(1).alias("level"), idx.alias("last"), F.lit(True).alias("falling")
    )

    def step(acc: Column, ancestor: Column) -> Column:
        falls = acc["falling"] & (ancestor["idx"] < acc["last"])
        return F.struct(
            (acc["level"] + falls.cast("int")).alias("level"),
            ancestor["idx"].alias("last"),
            falls.alias("falling"),
        )

    return F.aggregate(F.reverse(ancestors), start, step, lambda acc: acc["level"])


def insertion_key(ancestors: Column, idx: Column) -> Column:
    """Sorts depth first, children in page order; a parent sorts before its children."""
    return F.concat(F.transform(ancestors, lambda a: a["idx"]), F.array(idx))


def title_key(ancestors: Column, title: Column, idx: Column) -> Column:
    """Sorts depth first, children by title; equal titles by page order."""
    own = F.struct(title.alias("title"), idx.alias("idx"))
    return F.concat(
        F.transform(
            ancestors, lambda a: F.struct(a["title"].alias("title"), a["idx"].alias("idx"))
        ),
        F.array(own),
    )


def page_tree_nodes(tree: DataFrame, literal: bool = False) -> DataFrame:
    """All nodes depth first in page order; ``literal`` skips pages titled like the root."""
    shown = tree.filter(F.col("title") != ROOT_TITLE) if literal else tree
    return shown.orderBy(insertion_key(F.col("ancestors"), F.col("idx")))


def page_tree_height(tree: DataFrame) -> DataFrame:
    return tree.agg(F.coalesce(F.max("true_level"), F.lit(0)).alias("height"))


def subsections(tree: DataFrame) -> DataFrame:
    """Direct children, one row each; their ``idx`` order is the order below a parent."""
    return tree.select("parent_idx", F.col("idx").alias("child_idx"), "title")
