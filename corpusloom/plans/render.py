"""Flat renderings of a corpus: markdown, text, JSON, metadata.

Every renderer gives ``file, part, sort_key, text`` rows; a file is its texts in ``(part,
sort_key)`` order, one line feed after each. So a document of any size is a table, never a value,
and :func:`corpusloom.sources.writers.write_rendered` writes it in parallel.

Pages are ``idx, title, url, content, timestamp, depth`` with ``idx`` the dense 0-based page
position (:func:`dense_pages` makes it so). Times and the root URL are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.naming import make_anchor, page_file, safe_filename
from corpusloom.functions.text import rfc3339
from corpusloom.operators.distributed import number_rows, single_value

RULE = "=" * 80
FORMATS = ("markdown", "text", "json")


def dense_pages(pages: DataFrame) -> DataFrame:
    """Replace ``idx`` by the page's 0-based position in ``idx`` order.

    Only the key column is sorted and checkpointed; the pages themselves join back on it.
    """
    numbers = number_rows(pages.select("idx"), [F.col("idx")], "_position")
    joined = pages.join(numbers, "idx")
    return joined.select(
        *[F.col("_position").alias("idx") if c == "idx" else F.col(c) for c in pages.columns]
    )


def text_of(*pieces: Column | str) -> Column:
    """Concatenate columns and literals."""
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces]
    )


def rows(df: DataFrame, file: Column | str, part: int, sort_key: Column, text: Column) -> DataFrame:
    name = F.lit(file) if isinstance(file, str) else file
    return df.select(
        name.alias("file"),
        F.lit(part).alias("part"),
        sort_key.alias("sort_key"),
        text.alias("text"),
    )


def header_row(
    pages: DataFrame, file: str, part: int, sort_key: Column, count: Column, *pieces: Column | str
) -> DataFrame:
    """One row with the page count in ``pieces`` as the column ``n``."""
    return rows(pages.agg(count.alias("n")), file, part, sort_key, text_of(*pieces))


def stack(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def _scraped() -> Column:
    return rfc3339(F.col("timestamp"))


def _zero() -> Column:
    return F.lit(0).cast("long")


def render_markdown_single(pages: DataFrame, root_url: str, generated_at: Column) -> DataFrame:
    """``documentation.md``: header, numbered contents, one section per page."""
    file = "documentation.md"
    title, anchor = F.col("title"), make_anchor(F.col("title"))
    last = single_value(pages, F.max("idx"))
    head = header_row(
        pages, file, 0, _zero(), F.count("*"),
        "# Documentation Scrape Results\n\n",
        f"**Scraped from:** {root_url}  \n",
        "**Generated:** ", rfc3339(generated_at), "  \n",
        "**Total Pages:** ", F.col("n"), "\n\n---\n\n## Table of Contents\n",
    )
    toc = rows(
        pages, file, 1, F.col("idx"),
        text_of(F.col("idx") + 1, ". [", title, "](#", anchor, ")"),
    )
    toc_end = header_row(pages, file, 2, _zero(), F.count("*"), "\n---\n")
    body = rows(
        pages, file, 3, F.col("idx"),
        text_of(
            "## ", title, " {#", anchor, "}\n\n",
            "**URL:** ", F.col("url"), "  \n",
            "**Scraped:** ", _scraped(), "\n\n",
            F.col("content"), "\n",
            F.when(F.col("idx") < last, F.lit("\n---\n")).otherwise(""),
        ),
    )
    return stack(head, toc, toc_end, body)


def render_markdown_pages(pages: DataFrame, root_url: str, generated_at: Column) -> DataFrame:
    """``page_001.md`` and so on, with ``index.md``."""
    body = rows(
        pages, page_file(F.col("idx")), 0, _zero(),
        text_of(
            "# ", F.col("title"), "\n\n",
            "**URL:** ", F.col("url"), "  \n",
            "**Scraped:** ", _scraped(), "\n\n---\n\n",
            F.col("content"),
        ),
    )
    head = header_row(
        pages, "index.md", 0, _zero(), F.count("*"),
        "# Documentation Index\n\n",
        f"**Scraped from:** {root_url}  \n",
        "**Generated:** ", rfc3339(generated_at), "  \n",
        "**Total Pages:** ", F.col("n"), "\n\n## Pages\n",
    )
    entries = rows(
        pages, "index.md", 1, F.col("idx"),
        text_of(F.col("idx") + 1, ". [", F.col("title"), "](", page_file(F.col("idx")), ")"),
    )
    return stack(body, head, entries)


def render_text_single(pages: DataFrame, root_url: str, generated_at: Column) -> DataFrame:
    """``documentation.txt``: header and blocks between rules."""
    file = "documentation.txt"
    last = single_value(pages, F.max("idx"))
    head = header_row(
        pages, file, 0, _zero(), F.count("*"),
        "DOCUMENTATION SCRAPE RESULTS\n============================\n\n",
        f"Scraped from: {root_url}\n",
        "Generated: ", rfc3339(generated_at), "\n",
        "Total Pages: ", F.col("n"), f"\n\n{RULE}\n",
    )
    body = rows(
        pages, file, 1, F.col("idx"),
        text_of(
            "TITLE: ", F.col("title"), "\nURL: ", F.col("url"), "\nSCRAPED: ", _scraped(),
            "\nCONTENT:\n", F.col("content"),
            F.when(F.col("idx") < last, F.lit(f"\n\n{RULE}\n")).otherwise(""),
        ),
    )
    return stack(head, body)


def render_text_pages(pages: DataFrame, root_url: str, generated_at: Column) -> DataFrame:
    """One text file per page, named after its title; :func:`page_metadata_table` goes with it."""
    return rows(
        pages, safe_filename(F.col("title"), F.col("idx"), ".txt"), 0, _zero(),
        text_of(
            "TITLE: ", F.col("title"), "\nURL: ", F.col("url"), "\nSCRAPED: ", _scraped(), "\n\n",
            F.col("content"),
        ),
    )


def json_string(text: Column) -> Column:
    """A JSON string literal with markup characters and line separators escaped."""
    quoted = F.to_json(F.struct(text.alias("s")))
    quoted = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    escapes = {"&": "26", "<": "3c", ">": "3e", chr(0x2028): "2028", chr(0x2029): "2029"}
    for char, code in escapes.items():
        quoted = F.replace(quoted, F.lit(char), F.lit("\\u" + code.rjust(4, "0")))
    return quoted


def render_json(pages: DataFrame, root_url: str, generated_at: Column) -> DataFrame:
    """``documentation.json``: one object, its pages one row each."""
    file = "documentation.json"
    last = single_value(pages, F.max("idx"))
    some = F.col("n") > 0
    head = header_row(
        pages, file, 0, _zero(), F.count("*"),
        "{\n", F.when(some, F.lit('  "pages": [')).otherwise('  "pages": [],'),
    )
    body = rows(
        pages, file, 1, F.col("idx"),
        text_of(
            '    {\n      "title": ', json_string(F.col("title")),
            ',\n      "url": ', json_string(F.col("url")),
            ',\n      "content": ', json_string(F.col("content")),
            ',\n      "timestamp": "', _scraped(),
            '",\n      "depth": ', F.col("depth"),
            "\n    }", F.when(F.col("idx") < last, F.lit(",")).otherwise(""),
        ),
    )
    foot = header_row(
        pages, file, 2, _zero(), F.count("*"),
        F.when(some, F.lit("  ],\n")).otherwise(""),
        '  "root_url": ', json_string(F.lit(root_url)),
        ',\n  "scraped_at": "', rfc3339(generated_at),
        '",\n  "total_pages": ', F.col("n"), "\n}",
    )
    return stack(head, body, foot)


def page_metadata_table(pages: DataFrame) -> DataFrame:
    """Per page: position, title, URL, time, depth."""
    return pages.select("idx", "title", "url", _scraped().alias("timestamp"), "depth")


def scrape_info(pages: DataFrame, root_url: str, generated_at: Column) -> DataFrame:
    """The corpus part of the metadata, one row."""
    return pages.agg(F.count("*").alias("total_pages")).select(
        F.lit(root_url).alias("root_url"),
        rfc3339(generated_at).alias("scraped_at"),
        "total_pages",
    )


def render_output(
    pages: DataFrame,
    root_url: str,
    generated_at: Column,
    output_format: str = "markdown",
    output_type: str = "single",
    hierarchical: bool = False,
    renumber: bool = True,
    literal: bool = False,
) -> DataFrame:
    """Pick a renderer; anything but ``single`` means one file per page. ``literal`` is for hierarchical ones."""
    if output_format not in FORMATS:
        raise ValueError(f"unsupported output format: {output_format}")
    # Imported here because the hierarchical renderers build on this module.
    from corpusloom.plans import hier_render as H

    dense = dense_pages(pages) if renumber else pages
    single = output_type == "single"
    if hierarchical:
        pick = {
            "markdown": H.render_hier_markdown if single else H.render_hier_pages,
            "text": H.render_hier_text,
            "json": H.render_hier_json,
        }
        return pick[output_format](dense, root_url, generated_at, literal)
    pick = {
        "markdown": render_markdown_single if single else render_markdown_pages,
        "text": render_text_single if single else render_text_pages,
        "json": render_json,
    }
    return pick[output_format](dense, root_url, generated_at)
