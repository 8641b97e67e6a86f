import datetime as dt
import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import naming as N
from corpusloom.operators.profile import crawl_profile, crawl_profile_lines
from corpusloom.plans import hier_render as H
from corpusloom.plans import render as R
from corpusloom.sources.files import stage_pieces
from corpusloom.sources.readers import read_objects
from corpusloom.sources.writers import write_rendered

WHEN = dt.datetime(2024, 1, 2, 3, 4, 5)
ROOT = "https://example.com"
PAGES = [
    (0, "Guide", "https://example.com/docs", 'Say "hi" <b> & more\nsecond line', WHEN, 1),
    (1, "Root", "https://example.com/docs/a", "hidden title", WHEN, 2),
    (2, "Deep Page", "https://example.com/docs/a/b", "deep", WHEN, 3),
    (3, "About", "https://example.com/docs/z", "z", WHEN, 2),
    (4, "About", "https://example.com/docs/y", "y", WHEN, 2),
    (5, "Other", "https://example.com/other", "other", WHEN, 1),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        PAGES, "idx long, title string, url string, content string, timestamp timestamp, depth int"
    )


@pytest.fixture(scope="module")
def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def files(sections):
    out = {}
    for row in sections.orderBy("file", "part", "sort_key").collect():
        out[row.file] = out.get(row.file, "") + row.text + "\n"
    return out


def test_names(spark):
    df = spark.createDataFrame([("Hello, World & Co!",), ("Été",), ("",), ("x" * 60,), ("_a b_",)], "t string")
    rows = df.select(
        N.make_anchor(F.col("t")).alias("anchor"),
        N.safe_filename(F.col("t"), F.lit(3), ".txt").alias("file"),
        N.safe_directory_name(F.col("t")).alias("folder"),
    ).collect()
    assert [r.anchor for r in rows] == ["hello-world-co", "t", "", "x" * 60, "a-b"]
    assert [r.file for r in rows] == ["Hello_World_Co_3.txt", "t_3.txt", "page_3.txt", "x" * 50 + "_3.txt", "a_b_3.txt"]
    assert [r.folder for r in rows] == ["hello_world_co", "t", "untitled", "x" * 30, "a_b"]


def test_markdown_single(pages, now):
    text = files(R.render_markdown_single(pages.filter("idx < 2"), ROOT, now))["documentation.md"]
    assert text == (
        "# Documentation Scrape Results\n\n**Scraped from:** https://example.com  \n"
        "**Generated:** 2024-06-01T00:00:00Z  \n**Total Pages:** 2\n\n---\n\n## Table of Contents\n\n"
        "1. [Guide](#guide)\n2. [Root](#root)\n\n---\n\n"
        "## Guide {#guide}\n\n**URL:** https://example.com/docs  \n**Scraped:** 2024-01-02T03:04:05Z\n\n"
        'Say "hi" <b> & more\nsecond line\n\n---\n\n'
        "## Root {#root}\n\n**URL:** https://example.com/docs/a  \n**Scraped:** 2024-01-02T03:04:05Z\n\n"
        "hidden title\n\n"
    )


def test_pages_and_text(pages, now):
    made = files(R.render_markdown_pages(pages, ROOT, now))
    assert sorted(made) == ["index.md", *[f"page_{i:03d}.md" for i in range(1, 7)]]
    assert made["index.md"].endswith("6. [Other](page_006.md)\n")
    text = files(R.render_text_single(pages, ROOT, now))["documentation.txt"]
    assert text.count("=" * 80) == 6 and text.endswith("CONTENT:\nother\n")
    assert set(files(R.render_text_pages(pages, ROOT, now))) >= {"Guide_0.txt", "Deep_Page_2.txt"}


def test_json(pages, now):
    text = files(R.render_json(pages, ROOT, now))["documentation.json"]
    data = json.loads(text)
    assert list(data) == ["pages", "root_url", "scraped_at", "total_pages"]
    assert [p["content"] for p in data["pages"]] == [p[3] for p in PAGES]
    assert "\\u003cb\\u003e \\u0026" in text
    assert text == json.dumps(data, indent=2, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026") + "\n"


def test_no_pages(pages, now):
    none = pages.limit(0)
    data = json.loads(files(R.render_json(none, ROOT, now))["documentation.json"])
    assert data["pages"] == [] and data["total_pages"] == 0
    nested = json.loads(files(H.render_hier_json(none, ROOT, now))["documentation_hierarchical.json"])
    assert nested["hierarchy"]["children"] == []
    assert "**Total Pages:** 0" in files(R.render_markdown_single(none, ROOT, now))["documentation.md"]


def nested(node):
    return [node["title"], [nested(c) for c in node["children"]]]


def test_hier_json(pages, now):
    text = files(H.render_hier_json(pages, ROOT, now))["documentation_hierarchical.json"]
    data = json.loads(text)
    assert nested(data["hierarchy"]) == ["Root", [
        ["Guide", [["Root", [["Deep Page", []]]], ["About", []], ["About", []]]], ["Other", []],
    ]]
    assert data["total_pages"] == 6
    plain = json.dumps(data, indent=2, ensure_ascii=False)
    assert text == plain.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026") + "\n"


def test_hier_markdown(pages, now):
    text = files(H.render_hier_markdown(pages, ROOT, now))["documentation_hierarchical.md"]
    toc = text.split("## Table of Contents\n\n")[1].split("\n\n---")[0]
    about = ["    - [About](#about)"] * 2
    assert toc.split("\n") == [
        "  - [Guide](#guide)", *about, "    - [Root](#root)", "      - [Deep Page](#deep-page)", "  - [Other](#other)",
    ]
    assert "\n#### Deep Page {#deep-page}\n" in text and "**Total Pages:** 6" in text
    literal = files(H.render_hier_markdown(pages, ROOT, now, literal=True))["documentation_hierarchical.md"]
    toc = literal.split("## Table of Contents\n\n")[1].split("\n\n---")[0]
    assert toc.split("\n") == ["  - [Guide](#guide)", *about, "      - [Deep Page](#deep-page)", "  - [Other](#other)"]
    assert "**Total Pages:** 5" in literal


def linked(made, start="index.md"):
    """Files that can be reached from ``start`` by the links in it, relative to its folder."""
    folder = start.rpartition("/")[0]
    targets = re.findall(r"^ *- \[.*\]\((.*)\)$", made[start], re.M)
    return {f"{folder}/{t}" if folder else t for t in targets}


def test_hier_pages(pages, now):
    made = files(H.render_hier_pages(pages, ROOT, now))
    own = {"guide", "guide/root", "guide/root/deep_page", "guide/about.3", "guide/about.4", "other"}
    assert set(made) == {"index.md", *[f"{d}/index.md" for d in own]}
    assert linked(made) == set(made) - {"index.md"}
    assert linked(made, "guide/index.md") == {f"guide/{d}/index.md" for d in ("root", "about.3", "about.4")}
    assert made["guide/about.3/index.md"].endswith("\nz\n") and made["guide/about.4/index.md"].endswith("\ny\n")


def test_hier_pages_literal(pages, now):
    made = files(H.render_hier_pages(pages, ROOT, now, literal=True))
    assert sorted(made) == ["guide/about/index.md", "guide/deep_page/index.md", "guide/index.md", "index.md", "other/index.md"]
    assert made["guide/index.md"].split("## Sub-sections\n\n")[1].startswith(
        "- [Root](root/index.md)\n- [About](about/index.md)\n- [About](about/index.md)\n\n---\n\nSay"
    )
    assert made["guide/about/index.md"].endswith("\ny\n")  # the later of two pages with one path
    assert "    - [About](about/index.md)\n" in made["index.md"]


def test_pages_without_title_and_negative_positions(spark, now):
    rows = [
        (-2, None, "https://h/a", "first", WHEN, 1), (-10, "", "https://h/b", "second", WHEN, 1),
        (7, "Root", "https://h/a/c", "third", WHEN, 1), (8, "", "https://h/b", "again", WHEN, 1),
    ]
    pages = spark.createDataFrame(rows, "idx long, title string, url string, content string, timestamp timestamp, depth int")
    text = files(H.render_hier_markdown(pages, ROOT, now))["documentation_hierarchical.md"]
    assert all(r[3] in text and f"[{r[1] or r[2]}]" in text for r in rows) and "**Total Pages:** 4" in text
    made = files(H.render_hier_pages(pages, ROOT, now))
    assert len(made) == 5 and linked(made) == set(made) - {"index.md"}
    assert files(H.render_hier_text(pages, ROOT, now))["documentation_hierarchical.txt"].count("TITLE: ") == 4
    data = json.loads(files(H.render_hier_json(pages, ROOT, now))["documentation_hierarchical.json"])
    assert data["total_pages"] == 4 and len(data["hierarchy"]["children"]) == 3


def test_hier_text(pages, now):
    text = files(H.render_hier_text(pages, ROOT, now))["documentation_hierarchical.txt"]
    assert "  " + "=" * 78 + "\n  TITLE: Guide\n" in text
    assert '  Say "hi" <b> & more\n  second line\n\n' in text


def test_dispatch(pages, now):
    with pytest.raises(ValueError, match="unsupported output format: unsupported"):
        R.render_output(pages, ROOT, now, "unsupported")
    gaps = pages.withColumn("idx", F.col("idx") * 10 + 3)
    made = files(R.render_output(gaps, ROOT, now, "markdown", "per-page"))
    assert "page_006.md" in made
    hier = R.render_output(pages, ROOT, now, "json", "single", hierarchical=True)
    assert set(files(hier)) == {"documentation_hierarchical.json"}


def read_back(folder):
    found = {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and p.name[0] not in "._"}
    return found


def test_written_files(pages, now, tmp_path):
    sections = R.render_markdown_single(pages, ROOT, now)
    write_rendered(sections, str(tmp_path / "out"))
    assert read_back(tmp_path / "out") == files(sections)
    with pytest.raises(FileExistsError):
        write_rendered(sections, str(tmp_path / "out"))


def test_links_between_written_files_resolve(pages, now, tmp_path):
    sections = H.render_hier_pages(pages, ROOT, now)
    out = tmp_path / "out"
    write_rendered(sections, str(out))
    assert read_back(out) == files(sections)
    links = [(p, m) for p in out.rglob("*.md") for m in re.findall(r"\]\(([^)#:]+)\)", p.read_text())]
    assert links and all((p.parent / m).is_file() or (out / m).is_file() for p, m in links)
    write_rendered(R.render_markdown_single(pages, ROOT, now), str(out), "ignore")
    assert not (out / "documentation.md").exists()
    write_rendered(R.render_markdown_single(pages, ROOT, now), str(out), "overwrite")
    assert set(read_back(out)) == {"documentation.md"}


def test_file_over_many_tasks(spark, tmp_path):
    lines = spark.range(20_000).select(
        F.when(F.col("id") < 19_000, "big/one.txt").otherwise(F.concat(F.lit("small/"), F.col("id"))).alias("file"),
        F.lit(1).alias("part"), F.col("id").alias("sort_key"), F.concat(F.lit("line "), F.col("id")).alias("text"),
    ).repartition(7)
    expected = {"big/one.txt": "".join(f"line {k}\n" for k in range(19_000))}
    expected |= {f"small/{k}": f"line {k}\n" for k in range(19_000, 20_000)}
    write_rendered(lines, str(tmp_path / "whole"))
    assert read_back(tmp_path / "whole") == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_rendered(lines, str(tmp_path / "parts"))
        write_rendered(lines, str(tmp_path / "cut"), object_bytes=50_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert read_back(tmp_path / "parts") == expected
    cut = read_back(tmp_path / "cut")
    big = sorted(n for n in cut if n.startswith("big/"))
    assert len(big) > 1 and big[:2] == ["big/one.txt", "big/one.txt.00001"]
    assert "".join(cut[n] for n in big) == expected["big/one.txt"]


def test_one_staged_object_per_task(tmp_path):
    def batch(files, texts):
        return pa.RecordBatch.from_pydict({"file": files, "text": texts, "part": pa.array([3] * len(files), pa.int32())})

    staged = tmp_path / "staged"
    batches = [batch(["a", "a", "b"], ["1", None, "été"]), batch(["b", "c"], ["2", "3"]), batch(["d"], ["4"])]
    found = [row for pieces in stage_pieces(iter(batches), str(staged)) for row in pieces.to_pylist()]
    assert len(list(staged.iterdir())) == 1 and list(stage_pieces(iter([]), str(staged))) == []
    assert len(list(staged.iterdir())) == 1 and {row["part"] for row in found} == {3}
    whole = {r["file"]: (staged / r["piece"]).read_bytes()[r["start"] : r["start"] + r["bytes"]].decode() for r in found}
    assert whole == {"a": "1\n\n", "b": "été\n2\n", "c": "3\n", "d": "4\n"}


def test_written_objects_are_read_by_name(spark, tmp_path):
    """Nothing is listed, so an object that was not written does not count; all cores write."""
    lines = spark.range(400).selectExpr("concat('d', id % 100, '/index.md') AS file", "1 AS part", "id AS sort_key", "concat('line ', id) AS text")
    objects = write_rendered(lines, str(tmp_path / "out"))
    (tmp_path / "out" / "stray.md").write_text("x")
    expected = {f"d{k}/index.md": "".join(f"line {n}\n" for n in range(k, 400, 100)) for k in range(100)}
    assert {r.file: r.text for r in read_objects(objects, str(tmp_path / "out")).collect()} == expected
    assert len(objects.select(F.input_file_name()).distinct().collect()) == 8
    assert read_objects(write_rendered(lines.limit(0), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


def test_files_stay_below_the_folder(spark, tmp_path):
    rows = spark.createDataFrame([("../away.txt", 1, 1, "x")], "file string, part int, sort_key int, text string")
    with pytest.raises(Exception, match="not a file name below"):
        write_rendered(rows, str(tmp_path / "out"))
    write_rendered(rows.limit(0), str(tmp_path / "none"))
    assert read_back(tmp_path / "none") == {}


def test_profile(spark):
    log = spark.createDataFrame(
        [(0, WHEN, 100_000_000, 1024, False), (1, WHEN, 200_000_000, 2048, True),
         (2, WHEN + dt.timedelta(minutes=61, seconds=1.5), 150_000_000, 1536, False)],
        "idx long, ts timestamp, duration_ns long, bytes long, had_error boolean",
    )
    row = crawl_profile(log).first()
    assert (row.pages_scraped, row.total_bytes, row.errors, row.average_ns) == (3, 4608, 1, 150_000_000)
    lines = "\n".join(r.text for r in crawl_profile_lines(log).orderBy("part", "sort_key").collect())
    assert "Total Duration: 1h1m1.5s\nPages Scraped: 3\nAverage Time per Page: 150ms\n" in lines
    assert "Total Data Downloaded: 4608 bytes (0.00 MB)" in lines
    assert lines.endswith("Page 1: 100ms\nPage 2: 200ms\nPage 3: 150ms")
    empty = crawl_profile(log.limit(0)).first()
    assert (empty.pages_scraped, empty.average_ns, empty.total_duration_ns) == (0, 0, 0)
