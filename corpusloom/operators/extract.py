"""Pages in, titles, text and links out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text, is_blank
from corpusloom.operators.distributed import pinned, slices
from corpusloom.operators.html_scan import (
    CONTENT_SELECTORS,
    STRIP_SELECTORS,
    TITLE_SELECTORS,
    make_scanner,
)

_LINKS = "array<struct<pos: int, href: string, in_boilerplate: boolean>>"
_TYPES = {"title": "string", "raw_text": "string", "body_text": "string", "links": _LINKS}
_ARROW_LINK = pa.struct(
    [("pos", pa.int32()), ("href", pa.string()), ("in_boilerplate", pa.bool_())]
)


def scan_pages(
    pages: DataFrame,
    fields: tuple[str, ...] = ("title", "raw_text", "links"),
    content_selectors=CONTENT_SELECTORS,
    strip_selectors=STRIP_SELECTORS,
    title_selectors=TITLE_SELECTORS,
) -> DataFrame:
    """Run the markup scan over Arrow batches and return ``idx, url`` and the asked-for fields.

    The markup itself stays behind: what leaves the Python worker is text and links only. It scans
    about ``SLICE_BYTES`` of pages at a time, so beside the batch that Spark hands it (10,000 rows or 64 MB by its
    defaults) a worker holds the scans of a few pages, whatever the size of the table. A map keeps the partitioning of its input, so no shuffle happens here; see :func:`spread` for
    inputs in few large files.
    """
    unknown = set(fields) - set(_TYPES)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    lists = (tuple(content_selectors), tuple(strip_selectors), tuple(title_selectors))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = make_scanner(*lists)
        for batch in (part for whole in source for part in slices(whole)):
            scans = [scan(markup or "") for markup in batch.column("html").to_pylist()]
            columns = {"idx": batch.column("idx"), "url": batch.column("url")}
            if "title" in fields:
                columns["title"] = pa.array([s.title for s in scans], pa.string())
            if "raw_text" in fields:
                columns["raw_text"] = pa.array([s.content for s in scans], pa.string())
            if "body_text" in fields:
                columns["body_text"] = pa.array([s.body for s in scans], pa.string())
            if "links" in fields:
                columns["links"] = pa.array(
                    [
                        [
                            {"pos": pos, "href": href, "in_boilerplate": inside}
                            for pos, (href, inside) in enumerate(s.links)
                        ]
                        for s in scans
                    ],
                    pa.list_(_ARROW_LINK),
                )
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(
        ["idx long", "url string", *[f"{name} {_TYPES[name]}" for name in _TYPES if name in fields]]
    )
    return pages.select("idx", "url", "html").mapInArrow(batches, schema)


def spread(rows: DataFrame) -> DataFrame:
    """Even out heavy rows over the cores when their scan has fewer splits than there are cores.

    Large inputs have more splits than cores and pass unchanged: no markup is shuffled there.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def extract_title(pages: DataFrame) -> DataFrame:
    return scan_pages(pages, ("title",))


def strip_boilerplate(pages: DataFrame) -> DataFrame:
    """Body text outside the stripped elements, as it stands in the markup."""
    return scan_pages(pages, ("body_text",))


def extract_content(pages: DataFrame) -> DataFrame:
    return scan_pages(pages, ("raw_text",)).select(
        "idx", "url", clean_text(F.col("raw_text")).alias("content")
    )


def links_of(scanned: DataFrame, scope: str = "content") -> DataFrame:
    """One row per link of scanned pages: their other columns, ``pos, href, in_boilerplate``."""
    if scope not in ("raw", "content"):
        raise ValueError(f"scope must be 'raw' or 'content', not {scope!r}")
    others = [c for c in scanned.columns if c != "links"]
    links = scanned.select(*others, F.inline("links"))
    return links if scope == "raw" else links.filter(~F.col("in_boilerplate"))


def extract_links(pages: DataFrame, scope: str = "content") -> DataFrame:
    """One row per ``a[href]``.

    ``content`` leaves out links inside stripped elements, as a crawler that strips before it
    follows does; ``raw`` gives every link of the page.
    """
    return links_of(scan_pages(pages, ("links",)), scope)


def link_count(pages: DataFrame) -> DataFrame:
    """Number of ``a[href]`` in the whole page."""
    return scan_pages(pages, ("links",)).select(
        "idx", "url", F.size("links").alias("link_count")
    )


def non_empty_content(df: DataFrame, column: str = "content") -> DataFrame:
    return df.filter(~is_blank(F.col(column)))


def texts_of(scanned: DataFrame) -> DataFrame:
    """Title and clean content of the scanned pages that have content."""
    cleaned = pinned(
        scanned.select("idx", "url", "title", "raw_text"), "content", clean_text(F.col("raw_text"))
    )
    return non_empty_content(cleaned.drop("raw_text"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Title and clean content of every page that has content."""
    return texts_of(scan_pages(pages, ("title", "raw_text")))
