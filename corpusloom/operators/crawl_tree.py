"""The tree a crawl builds page by page.

A page hangs below the longest path prefix on its host among the pages that came before it. Walking
the prefixes of a path from longest to shortest and keeping one if it came before the last kept one
gives the whole chain to the top, so the tree again needs one explode of path parts and one equi-join.

Where several earlier pages qualify, the longest path and then the smallest ``idx`` wins. Paths with
doubled slashes or dot segments are compared as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.operators.distributed import (
    number_rows,
    number_within,
    salted_lookup,
)
from corpusloom.operators.page_tree import path_hash, path_prefixes, prefix_owners, proven
from corpusloom.session import store

SORT_KEYS = ("index", "title", "url", "date")
_KEPT = "array<struct<idx: long, key: string>>"
_FOUND = "array<struct<n: int, place: string, top: boolean, idx: long, key: string>>"


def tree_nodes(urls: DataFrame, contents: DataFrame) -> DataFrame:
    """URLs that have content; the first of equal URLs stays.

    ``urls`` is ``idx, url``; ``contents`` is ``url, title`` and more. Contents that repeat a URL
    count as one, the largest by their columns in order.
    """
    unique = urls.groupBy("url").agg(F.min("idx").alias("idx"))
    others = [c for c in contents.columns if c != "url"]
    single = contents.groupBy("url").agg(F.max(F.struct(*others)).alias("_row"))
    return unique.join(single.select("url", "_row.*"), "url")


def _top_only(path: Column) -> Column:
    """The path's directory is the root."""
    return path.rlike(r"\A/*[^/]*\z")


def _place(path: Column) -> Column:
    """The path itself where it is empty or a single slash, else a dot: all that a chain asks of it."""
    return F.when(path.isin("", "/"), path).otherwise(F.lit("."))


def _chain(idx: Column, path: Column, found: Column) -> Column:
    """Ancestors nearest first out of the candidates ordered from longest path to shortest."""
    start = F.struct(
        _place(path).alias("place"),
        _top_only(path).alias("top"),
        idx.alias("idx"),
        F.array().cast(_KEPT).alias("kept"),
    )

    def step(acc: Column, cand: Column) -> Column:
        fits = (
            (cand["idx"] < acc["idx"])
            & (acc["place"] == ".")
            & F.when(cand["place"] == "/", acc["top"])
            .when(cand["place"] == "", ~acc["top"])
            .otherwise(F.lit(True))
        )
        taken = F.struct(
            cand["place"].alias("place"),
            cand["top"].alias("top"),
            cand["idx"].alias("idx"),
            F.concat(
                acc["kept"],
                F.array(F.struct(cand["idx"].alias("idx"), cand["key"].alias("key"))),
            ).alias("kept"),
        )
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(found, start, step)


def build_tree(
    nodes: DataFrame,
    use_url_hierarchy: bool = True,
    fallback_to_root: bool = True,
    sort_by: str | None = None,
) -> DataFrame:
    """Nodes ``idx, url, path, title, parent_idx, level, reachable, order_key``.

    ``nodes`` is ``idx, url, title`` (and ``last_modified`` for ``date``); the smallest ``idx`` is
    the root. ``order_key`` sorts depth first with children in ``sort_by`` order, or in arrival
    order when it is None. Nodes without a way to the root are kept, unreachable, at level 0.
    """
    if sort_by is not None and sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of {SORT_KEYS}, not {sort_by!r}")
    key = {
        "title": F.col("title"),
        "url": F.col("url"),
        # Instants, not local times, which repeat when clocks go back.
        "date": F.lpad((F.unix_micros("last_modified") + F.lit(1 << 62)).cast("string"), 20, "0")
        if "last_modified" in nodes.columns
        else F.lit(""),
    }.get(sort_by, F.lit(""))
    valid = U.url_is_valid(F.col("url"))
    # Read several times below, so written once.
    base = store(
        nodes.select(
            "idx",
            "url",
            "title",
            U.url_path(F.col("url"), "raw").alias("path"),
            F.when(valid, U.host(F.col("url"))).alias("_host"),
            key.alias("_key"),
        ),
        "crawl-nodes",
    )
    root = base.agg(
        F.min("idx").alias("idx"), F.min_by("_key", "idx").alias("key")
    ).select(F.struct("idx", "key").alias("root"))
    root_ref = root.scalar()

    if use_url_hierarchy:
        parsed = base.filter(F.col("_host").isNotNull())
        owners = prefix_owners(parsed, ["_host"], ["_key"])
        below = parsed.filter(~F.col("path").isin("", "/"))
        # Every node also asks for the root path, unless that is among its prefixes.
        slash = F.lit("/")
        asks = below.filter(~F.col("path").startswith("//")).select(
            "idx", "_host", F.lit(2).alias("_parts"), path_hash(slash).alias("_hash")
        )
        wanted = path_prefixes(below, ["_host"]).unionByName(asks)
        matches = salted_lookup(wanted, owners, ["_host", "_parts", "_hash"], F.col("idx"))
        anc = F.col("_anc_path")
        # Bounded by the number of slashes in one URL.
        found = (
            proven(matches, below, anc == slash)
            .groupBy("idx")
            .agg(
                F.sort_array(
                    F.collect_list(
                        F.struct(
                            F.length(anc).alias("n"),
                            _place(anc).alias("place"),
                            _top_only(anc).alias("top"),
                            F.col("_anc").alias("idx"),
                            F.col("_key").alias("key"),
                        )
                    ),
                    asc=False,
                ).alias("_found")
            )
        )
        joined = base.join(found, "idx", "left")
    else:
        joined = base.withColumn("_found", F.lit(None))
    none = F.array().cast(_FOUND)
    walked = joined.select(
        "idx", "url", "path", "title", "_host", "_key",
        _chain(
            F.col("idx"), F.col("path"), F.coalesce(F.col("_found").cast(_FOUND), none)
        ).alias("_walk"),
        root_ref.alias("_root"),
    )
    at_top = F.lit(use_url_hierarchy) & F.col("_host").isNotNull() & F.col("_walk.place").isin("", "/")
    hooked = (F.col("_walk.idx") != F.col("_root.idx")) & (F.lit(fallback_to_root) | at_top)
    above = F.concat(
        F.when(hooked, F.array("_root")).otherwise(F.array().cast(_KEPT)),
        F.reverse("_walk.kept"),
    )
    linked = walked.withColumns(
        {"_above": above, "reachable": hooked | (F.col("_walk.idx") == F.col("_root.idx"))}
    )
    flipped = F.transform("_above", lambda a: F.struct(a["key"].alias("key"), a["idx"].alias("idx")))
    return linked.select(
        "idx",
        "url",
        "path",
        "title",
        F.try_element_at("_above", F.lit(-1))["idx"].alias("parent_idx"),
        F.when(F.col("reachable"), F.size("_above")).otherwise(F.lit(0)).alias("level"),
        "reachable",
        F.concat(flipped, F.array(F.struct(F.col("_key").alias("key"), "idx"))).alias("order_key"),
    )


def parent_by_url(nodes: DataFrame) -> DataFrame:
    """``idx, parent_idx`` by path hierarchy alone; NULL where no earlier page qualifies."""
    return build_tree(nodes, fallback_to_root=False).select("idx", "url", "parent_idx")


def sort_children(tree: DataFrame) -> DataFrame:
    """Reachable children with their 0-based rank below their parent, in ``order_key`` order."""
    children = tree.filter(F.col("reachable") & F.col("parent_idx").isNotNull())
    return number_within(
        children.select("parent_idx", "idx", "title", "order_key"),
        ["parent_idx"],
        [F.element_at("order_key", -1)],
        "rank",
    ).drop("order_key")


def auto_index(tree: DataFrame) -> DataFrame:
    """Pre-order numbers from 0 for reachable nodes; 0 for the others."""
    numbers = number_rows(
        tree.filter("reachable").select("idx", "order_key"), [F.col("order_key")], "index"
    ).select("idx", "index")
    return tree.join(numbers, "idx", "left").withColumn(
        "index", F.coalesce("index", F.lit(0))
    )


def tree_max_depth(tree: DataFrame) -> DataFrame:
    """Deepest level, and the sum of levels along it that a naive recursion reports."""
    deepest = F.coalesce(F.max(F.when(F.col("reachable"), F.col("level"))), F.lit(0))
    return tree.agg(deepest.alias("max_depth")).withColumn(
        "literal_max_depth", (F.col("max_depth") * (F.col("max_depth") + 1) / 2).cast("int")
    )


def total_nodes(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count("*").alias("total_nodes"))


def traverse_depth_first(tree: DataFrame) -> DataFrame:
    return tree.filter("reachable").orderBy("order_key")


def traverse_breadth_first(tree: DataFrame) -> DataFrame:
    return tree.filter("reachable").orderBy("level", "order_key")


def find_node(tree: DataFrame, url: str) -> DataFrame:
    return tree.filter(F.col("url") == url)


def all_nodes(tree: DataFrame) -> DataFrame:
    return tree.select("idx", "url", "path", "title")


def nodes_by_level(tree: DataFrame, level: int) -> DataFrame:
    return tree.filter(F.col("reachable") & (F.col("level") == level)).orderBy("order_key")
