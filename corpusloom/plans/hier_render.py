"""Renderings that follow the page tree.

Order keys are arrays of ancestors, so depth-first order is a sort. Every page is printed: one without a
title goes by its URL, and siblings whose directory names are equal get their ``idx`` after it. With
``literal=True`` pages titled "" or like the root are left out (their children are not), links in the index
name the last directory only, and of pages with one path the last is kept. Page contents stay out of the
tree's shuffles and join back on ``idx`` at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.naming import make_anchor, safe_directory_name
from corpusloom.functions.text import rfc3339
from corpusloom.operators.distributed import salted_lookup
from corpusloom.operators.page_tree import (
    ROOT_TITLE,
    build_page_tree,
    insertion_key,
    title_key,
)
from corpusloom.plans.render import header_row, json_string, rows, stack, text_of
from corpusloom.session import store

_LAST = (1 << 63) - 1
_ROOT_TIME = "0001-01-01T00:00:00Z"


def _hidden(title: Column) -> Column:
    return title.isin("", ROOT_TITLE)


def _printed(tree: DataFrame, literal: bool) -> DataFrame:
    return tree.filter(~_hidden(F.col("title"))) if literal else tree


def _by_title() -> Column:
    return title_key(F.col("ancestors"), F.col("title"), F.col("idx"))


def _no_key() -> Column:
    return F.array().cast("array<struct<title: string, idx: long>>")


def _counted(literal: bool) -> Column:
    """Pages as the headers count them; ``literal`` leaves out those titled like the root."""
    return F.count_if(F.col("title") != ROOT_TITLE) if literal else F.count("*")


def _indent(level: Column) -> Column:
    return F.repeat(F.lit("  "), level)


def _with_content(pages: DataFrame, tree: DataFrame) -> DataFrame:
    return tree.join(pages.select("idx", "content", "timestamp"), "idx")


def _directory(names: Column) -> Column:
    """Joined directory names of the visible titles."""
    visible = F.filter(names, lambda t: ~_hidden(t))
    return F.array_join(F.transform(visible, safe_directory_name), "/")


def node_directory(ancestors: Column, title: Column) -> Column:
    return _directory(F.concat(F.transform(ancestors, lambda a: a["title"]), F.array(title)))


def _tree(pages: DataFrame, literal: bool) -> DataFrame:
    if not literal:
        title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
        pages = pages.withColumn("title", title)
    return build_page_tree(pages)


def _stored_tree(pages: DataFrame, literal: bool) -> DataFrame:
    """The tree as a table, since a document reads it once per kind of row."""
    return store(_tree(pages, literal), "page-tree")


def _placed_tree(pages: DataFrame, literal: bool) -> DataFrame:
    """The stored tree with each node's directory ``name`` and its whole ``directory``."""
    tree = _stored_tree(pages, literal)
    if literal:
        return tree.withColumns(
            {
                "name": safe_directory_name(F.col("title")),
                "directory": node_directory(F.col("ancestors"), F.col("title")),
            }
        )
    return store(tree.join(_directories(tree), "idx"), "placed-tree")


def _directories(tree: DataFrame) -> DataFrame:
    """``idx, name, shared, directory``, no directory twice.

    Siblings that share a name get ``.idx`` after it; safe names have no dot, so these are new ones.
    """
    plain = safe_directory_name(F.col("title"))
    slot = F.concat(F.coalesce(F.col("parent_idx").cast("string"), F.lit("")), F.lit("/"), plain)
    own = tree.select("idx", plain.alias("_plain"), slot.alias("_slot"))
    sharing = own.groupBy("_slot").agg((F.count("*") > 1).alias("shared"))
    numbered = F.concat("_plain", F.lit("."), F.col("idx").cast("string"))
    named = salted_lookup(own, sharing, ["_slot"], F.col("idx")).select(
        "idx", "shared", F.when(F.col("shared"), numbered).otherwise(F.col("_plain")).alias("name")
    )
    named = store(named, "node-names")
    chain = F.concat(F.transform("ancestors", lambda a: a["idx"]), F.array("idx"))
    steps = tree.select("idx", F.posexplode(chain).alias("_at", "_node"))
    names = named.select(F.col("idx").alias("_node"), F.col("name").alias("_step"))
    # The collected list is bounded by the number of slashes in one URL.
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_step")))
    paths = salted_lookup(steps, names, ["_node"], F.col("idx")).groupBy("idx").agg(
        F.array_join(F.transform(ordered, lambda x: x["_step"]), "/").alias("directory")
    )
    return named.join(paths, "idx")


def _toc_rows(tree: DataFrame, file: str, part: int, literal: bool) -> DataFrame:
    return rows(
        _printed(tree, literal), file, part, _by_title(),
        text_of(
            _indent(F.col("true_level")), "- [", F.col("title"), "](#",
            make_anchor(F.col("title")), ")",
        ),
    )


def render_hier_toc(pages: DataFrame, literal: bool = False) -> DataFrame:
    """The nested contents list alone."""
    return _toc_rows(_tree(pages, literal), "documentation_hierarchical.md", 1, literal)


def render_hier_markdown(
    pages: DataFrame, root_url: str, generated_at: Column, literal: bool = False
) -> DataFrame:
    """``documentation_hierarchical.md``: nested contents, then sections with nested headings."""
    file = "documentation_hierarchical.md"
    tree = _stored_tree(pages, literal)
    head = header_row(
        pages, file, 0, _no_key(), _counted(literal),
        "# Documentation Scrape Results (Hierarchical)\n\n",
        f"**Scraped from:** {root_url}  \n",
        "**Generated:** ", rfc3339(generated_at), "  \n",
        "**Total Pages:** ", F.col("n"), "\n\n---\n\n## Table of Contents\n",
    )
    toc_end = header_row(pages, file, 2, _no_key(), F.count("*"), "\n---\n")
    body = rows(
        _with_content(pages, _printed(tree, literal)), file, 3, _by_title(),
        text_of(
            F.repeat(F.lit("#"), F.least(F.col("true_level") + 1, F.lit(6))),
            " ", F.col("title"), " {#", make_anchor(F.col("title")), "}\n\n",
            "**URL:** ", F.col("url"), "  \n",
            "**Scraped:** ", rfc3339(F.col("timestamp")), "\n\n",
            F.col("content"), "\n",
        ),
    )
    return stack(head, _toc_rows(tree, file, 1, literal), toc_end, body)


def render_hier_index(
    pages: DataFrame, root_url: str, generated_at: Column, literal: bool = False
) -> DataFrame:
    """``index.md`` with nested links; ``literal`` links to the last directory name only."""
    return _index_rows(pages, _placed_tree(pages, literal), root_url, generated_at, literal)


def _index_rows(
    pages: DataFrame, tree: DataFrame, root_url: str, generated_at: Column, literal: bool
) -> DataFrame:
    head = header_row(
        pages, "index.md", 0, _no_key(), _counted(literal),
        "# Documentation Index (Hierarchical)\n\n",
        f"**Scraped from:** {root_url}  \n",
        "**Generated:** ", rfc3339(generated_at), "  \n",
        "**Total Pages:** ", F.col("n"), "\n\n## Structure\n",
    )
    target = F.col("name" if literal else "directory")
    entries = rows(
        _printed(tree, literal), "index.md", 1, _by_title(),
        text_of(
            _indent(F.col("true_level")), "- [", F.col("title"), "](", target, "/index.md)"
        ),
    )
    return stack(head, entries)


def page_paths(pages: DataFrame, literal: bool = False) -> DataFrame:
    """``idx, file, path_collision, is_final``: output file of every printed page.

    Each page has a file of its own; ``path_collision`` tells that siblings share its plain name. With
    ``literal`` pages share files, and the last in depth-first order survives (``is_final``).
    """
    tree = _placed_tree(pages, literal)
    return _last_of_path(tree) if literal else _own_files(tree)


def _file() -> Column:
    return F.concat("directory", F.lit("/index.md")).alias("file")


def _own_files(tree: DataFrame) -> DataFrame:
    return tree.select(
        "idx", _file(), F.col("shared").alias("path_collision"), F.lit(True).alias("is_final")
    )


def _last_of_path(tree: DataFrame) -> DataFrame:
    placed = _printed(tree, True).select(
        "idx", _file(), insertion_key(F.col("ancestors"), F.col("idx")).alias("_key")
    )
    owners = placed.groupBy("file").agg(
        F.count("*").alias("_sharing"), F.max_by("idx", "_key").alias("_final")
    )
    return salted_lookup(placed, owners, ["file"], F.col("idx")).select(
        "idx",
        "file",
        (F.col("_sharing") > 1).alias("path_collision"),
        (F.col("_final") == F.col("idx")).alias("is_final"),
    )


def render_hier_files(pages: DataFrame, literal: bool = False) -> DataFrame:
    """``<directories>/index.md`` per page.

    The list of sub-sections is one row per child, so no parent has to hold its children.
    """
    return _file_rows(pages, _placed_tree(pages, literal), literal)


def _file_rows(pages: DataFrame, tree: DataFrame, literal: bool) -> DataFrame:
    files = _last_of_path(tree).filter("is_final") if literal else _own_files(tree)
    paths = files.select("idx", "file")
    parents = tree.filter("parent_idx IS NOT NULL").select(
        F.col("parent_idx").alias("idx"), F.lit(True).alias("_has_children")
    ).distinct()
    own = (
        tree.select("idx", "url", "title")
        .join(paths, "idx")
        .join(parents, "idx", "left")
        .join(pages.select("idx", "timestamp", "content"), "idx")
    )
    position = F.col("idx")
    head = rows(
        own, F.col("file"), 0, position,
        text_of(
            "# ", F.col("title"), "\n\n",
            "**URL:** ", F.col("url"), "  \n",
            "**Scraped:** ", rfc3339(F.col("timestamp")), "\n",
            F.when(F.col("_has_children"), F.lit("\n## Sub-sections\n")).otherwise(""),
        ),
    )
    children = tree.filter("parent_idx IS NOT NULL").select("idx", "parent_idx", "title", "name")
    kept_parents = paths.withColumnRenamed("idx", "parent_idx")
    listed = rows(
        salted_lookup(children, kept_parents, ["parent_idx"], F.col("idx")),
        F.col("file"), 1, position,
        text_of(
            "- [", F.col("title"), "](", F.col("name"), "/index.md)"
        ),
    )
    tail = rows(
        own, F.col("file"), 2, position,
        text_of(
            F.when(F.col("_has_children"), F.lit("\n")).otherwise(""),
            "---\n\n", F.col("content"),
        ),
    )
    return stack(head, listed, tail)


def render_hier_pages(
    pages: DataFrame, root_url: str, generated_at: Column, literal: bool = False
) -> DataFrame:
    """One file per page in nested directories, with the nested ``index.md`` on top."""
    tree = _placed_tree(pages, literal)
    index = _index_rows(pages, tree, root_url, generated_at, literal)
    flat = index.withColumn(
        "sort_key", F.concat(F.array(F.lit("")), F.transform("sort_key", _sortable))
    )
    files = _file_rows(pages, tree, literal).withColumn(
        "sort_key", F.array(_padded(F.col("sort_key")))
    )
    return stack(flat, files)


def _padded(number: Column) -> Column:
    """A string that sorts like the number, negative ones included."""
    shift = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.lpad((number.cast("decimal(20,0)") + shift).cast("string"), 20, "0")


def _sortable(step: Column) -> Column:
    """A (title, idx) step as one string with the same order."""
    return F.concat(step["title"], F.lit("\x00"), _padded(step["idx"]))


def render_hier_text(
    pages: DataFrame, root_url: str, generated_at: Column, literal: bool = False
) -> DataFrame:
    """``documentation_hierarchical.txt``: blocks indented by level."""
    file = "documentation_hierarchical.txt"
    tree = _stored_tree(pages, literal)
    head = header_row(
        pages, file, 0, _no_key(), _counted(literal),
        "DOCUMENTATION SCRAPE RESULTS (HIERARCHICAL)\n",
        "===========================================\n\n",
        f"Scraped from: {root_url}\n",
        "Generated: ", rfc3339(generated_at), "\n",
        "Total Pages: ", F.col("n"), "\n",
    )
    indent = _indent(F.col("true_level"))
    rule = F.repeat(F.lit("="), F.greatest(F.lit(80) - F.col("true_level") * 2, F.lit(0)))
    body = rows(
        _with_content(pages, _printed(tree, literal)), file, 1, _by_title(),
        text_of(
            indent, rule, "\n",
            indent, "TITLE: ", F.col("title"), "\n",
            indent, "URL: ", F.col("url"), "\n",
            indent, "SCRAPED: ", rfc3339(F.col("timestamp")), "\n",
            indent, rule, "\n\n",
            indent, F.replace(F.col("content"), F.lit("\n"), F.concat(F.lit("\n"), indent)), "\n",
        ),
    )
    return stack(head, body)


def render_hier_json(
    pages: DataFrame, root_url: str, generated_at: Column, literal: bool = False
) -> DataFrame:
    """``documentation_hierarchical.json``: the nested document as opening and closing rows.

    A node opens at its order key and closes at the key followed by the largest position, hence
    after all its descendants. Nesting needs no nested value and no recursion. All pages are there with the
    titles they have; ``literal`` only leaves those titled like the root out of the total.
    """
    file = "documentation_hierarchical.json"
    tree = _stored_tree(pages, True)
    last_child = tree.groupBy(F.col("parent_idx").alias("_parent")).agg(
        F.max("idx").alias("_last")
    )
    has_children = last_child.filter(F.col("_parent").isNotNull()).select(
        F.col("_parent").alias("idx"), F.lit(True).alias("_has_children")
    )
    closing = last_child.select(F.col("_last").alias("idx"), F.lit(True).alias("_is_last"))
    nodes = (
        tree.join(has_children, "idx", "left")
        .join(closing, "idx", "left")
        .join(pages.select("idx", "content", "timestamp", "depth"), "idx")
        .withColumns(
            {
                "_key": insertion_key(F.col("ancestors"), F.col("idx")),
                "_brace": F.repeat(F.lit("  "), F.col("true_level") * 2 + 1),
                "_field": F.repeat(F.lit("  "), F.col("true_level") * 2 + 2),
            }
        )
    )
    brace, field = F.col("_brace"), F.col("_field")
    opened = text_of(
        brace, "{\n", field, '"children": [',
        F.when(F.col("_has_children"), F.lit("")).otherwise("],"),
    )
    closed = text_of(
        F.when(F.col("_has_children"), F.concat(field, F.lit("],\n"))).otherwise(""),
        field, '"content": ', json_string(F.col("content")), ",\n",
        field, '"depth": ', F.col("depth"), ",\n",
        field, '"index": ', F.col("idx"), ",\n",
        field, '"level": ', F.col("level"), ",\n",
        field, '"path": ', json_string(F.col("path")), ",\n",
        field, '"timestamp": "', rfc3339(F.col("timestamp")), '",\n',
        field, '"title": ', json_string(F.coalesce("title", F.lit(""))), ",\n",
        field, '"url": ', json_string(F.col("url")), "\n",
        brace, "}", F.when(F.col("_is_last"), F.lit("")).otherwise(","),
    )
    # Opening and closing row of a node come from one pass over it.
    both = nodes.select(
        F.inline(
            F.array(
                F.struct(F.col("_key").alias("sort_key"), opened.alias("text")),
                F.struct(
                    F.concat("_key", F.array(F.lit(_LAST))).alias("sort_key"),
                    closed.alias("text"),
                ),
            )
        )
    ).select(F.lit(file).alias("file"), F.lit(1).alias("part"), "sort_key", "text")
    none = F.array().cast("array<bigint>")
    some = F.col("n") > 0
    head = header_row(
        pages, file, 0, none, F.count("*"),
        '{\n  "hierarchy": {\n    "children": [', F.when(some, F.lit("")).otherwise("],"),
    )
    foot = header_row(
        pages, file, 2, none, F.count("*"),
        F.when(some, F.lit("    ],\n")).otherwise(""),
        '    "content": "",\n    "depth": 0,\n    "index": 0,\n    "level": 0,\n    "path": "",\n',
        f'    "timestamp": "{_ROOT_TIME}",\n    "title": "{ROOT_TITLE}",\n    "url": ""\n  }},\n',
        '  "root_url": ', json_string(F.lit(root_url)),
        ',\n  "scraped_at": "', rfc3339(generated_at), '",\n  "total_pages": ',
    )
    total = pages.agg(_counted(literal).alias("n"))
    foot = foot.withColumn(
        "text", F.concat("text", total.scalar().cast("string"), F.lit("\n}"))
    )
    return stack(head, both, foot)


def render_hier_adjacency(pages: DataFrame) -> DataFrame:
    """The same tree as one row per node, for JSON lines."""
    tree = _stored_tree(pages, True)
    return tree.join(pages.select("idx", "content", "timestamp", "depth"), "idx").select(
        "idx",
        "parent_idx",
        "url",
        "path",
        "title",
        "content",
        rfc3339(F.col("timestamp")).alias("timestamp"),
        "depth",
        "level",
    )
