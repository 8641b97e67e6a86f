import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text, count_words
from corpusloom.operators.extract import (
    extract_content,
    extract_links,
    extract_pages,
    extract_title,
    link_count,
)
from corpusloom.operators.distributed import SLICE_BYTES
from corpusloom.operators.extract import scan_pages
from corpusloom.operators.html_scan import make_scanner

LONG = "This sentence is repeated until the text is long enough to be taken as the content. " * 3

TITLES = [
    ("<html><head><title>T</title></head><body><h1>H</h1></body></html>", "T"),
    ("<html><body><h1>H</h1></body></html>", "H"),
    ("<html><body><div class='x page-title'>P</div></body></html>", "P"),
    ("<html><body><div data-title='D &amp; E'>x</div></body></html>", "D & E"),
    ("<html><body><p>x</p></body></html>", "Untitled"),
    ("<title>  padded \n</title>", "padded"),
    ("<title>   </title><h1>H</h1>", ""),
    ("<title></title><h1>One</h1><h1>Two</h1>", "One"),
    ("<h1></h1><h1>Two</h1>", "Untitled"),
    ("<title>a &lt;b&gt; <i>c</i></title>", "a <b> <i>c</i>"),
    ("<h1>a<b>b</b><!-- no -->c</h1>", "abc"),
    ("", "Untitled"),
]

CONTENTS = [
    ("<main><p>Main content here</p></main><nav>n</nav><footer>f</footer>", "Main content here"),
    ("<div class='content'>C</div><div class='sidebar'>S</div>", "C"),
    ("<header>h</header><article>A</article>", "A"),
    ("<body><script>s()</script><style>p{}</style>Text</body>", "Text"),
    ("<body>Body only</body>", "Body only"),
    ("<body><nav>n</nav><div class='a sidebar b'>s</div><p>rest</p></body>", "rest"),
    (f"<div class='content'>Short</div><article>{LONG}</article>", LONG.strip()),
    (f"<main>Short</main><article>Also short</article>", "Also short"),
    (f"<main>{LONG}</main><article>x</article>", LONG.strip()),
    ("<article><h1>A</h1><p>B", "AB"),
    ("<article>a<article>b</article></article>", "abb"),
    ("<article>a &amp b &copy; &#233;</article>", "a & b © é"),
    ("<article>1 < 2 and <b>bold<p>x</b>y</article>tail", "1 < 2 and boldxy"),
    ("<p class='related'>no<p>yes", "yes"),
    ("<ul><li class='menu'>no<li>yes</ul>", "yes"),
    ("<article>x<br>y<img src='a>b'>z</article>", "xyz"),
    ("<article>cut <a href='/x", "cut"),
    ("<div id='main'>M</div>", "M"),
    ("<noscript><p>raw</p></noscript>seen", "seen"),
    ("<body><noscript><p>raw</p></noscript>seen", "<p>raw</p>seen"),
    ("<title>T</title>plain", "plain"),
]


@pytest.fixture(scope="module")
def scan():
    return make_scanner()


def test_titles(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(TITLES)], "idx long, url string, html string")
    found = {r.idx: r.title for r in extract_title(df).collect()}
    assert [found[i] for i in range(len(TITLES))] == [t for _, t in TITLES]


def test_contents(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(CONTENTS)], "idx long, url string, html string")
    found = {r.idx: r.content for r in extract_content(df).collect()}
    for i, (html, expected) in enumerate(CONTENTS):
        assert found[i] == expected, html


def test_links(spark):
    html = (
        "<nav><a href='/n'>n</a></nav><article><a HREF=\"/a?x=1&amp;y=2\">a</a><a>no</a>"
        "<a href=/b class=x>b</a><a href='/c?a=1&copy=2'>c</a></article>"
    )
    df = spark.createDataFrame([(1, "u", html), (2, "v", None)], "idx long, url string, html string")
    raw = extract_links(df, "raw").orderBy("pos").collect()
    assert [(r.pos, r.href, r.in_boilerplate) for r in raw] == [
        (0, "/n", True), (1, "/a?x=1&y=2", False), (2, "/b", False), (3, "/c?a=1&copy=2", False),
    ]
    assert [r.href for r in extract_links(df).orderBy("pos").collect()] == [
        "/a?x=1&y=2", "/b", "/c?a=1&copy=2"
    ]
    assert {r.idx: r.link_count for r in link_count(df).collect()} == {1: 4, 2: 0}


def test_empty_pages_are_dropped(spark):
    df = spark.createDataFrame(
        [(1, "u", "<body> &nbsp; </body>"), (2, "v", "<body>x</body>"), (3, "w", None)],
        "idx long, url string, html string",
    )
    assert [r.idx for r in extract_pages(df).collect()] == [2]


def test_scan_is_linear_in_odd_markup(scan):
    for markup in ("<" * 50_000, "<a " * 20_000, "&" * 50_000, "<p>" * 5_000, "<!--" * 20_000, "<b>" * 3000 + "</b>" * 3000):
        scan(markup)


CLEAN = [
    ("Text   with    lots\n\n\nof   whitespace", "Text with lots of whitespace"),
    ("   Text with spaces   ", "Text with spaces"),
    ("Skip to main content This is the actual content", "This is the actual content"),
    ("Content here Click here to subscribe More content", "Content here More content"),
    ("Main content Subscribe to our newsletter End content", "Main content End content"),
    ("Article text Follow us on Twitter Final text", "Article text Final text"),
    ("Text SKIP TO MAIN CONTENT more text", "more text"),
    ("Clean text content", "Clean text content"),
    ("", ""),
    ("   \n\t   ", ""),
    ("a\nb skip to x\ny skip to content z", "a b skip to x z"),
    ("skip to a content b skip to c content d", "d"),
    (" x  ", "x"),
    ("Subscribe to Click here to x our list end", "end"),
]


def test_clean_text(spark):
    df = spark.createDataFrame(CLEAN, "text string, expected string")
    for row in df.select("*", clean_text(F.col("text")).alias("found")).collect():
        assert row.found == row.expected, row


def test_noise_matches_a_plain_scan(spark):
    """The anchored pattern against the unanchored one, on generated lines."""
    import itertools
    import re

    pieces = ["a ", "\n", "Skip to ", "content ", "x"]
    texts = ["".join(p) for n in range(1, 6) for p in itertools.product(pieces, repeat=n)]
    plain = re.compile(r"(?i).*?Skip to .*?content\s*")
    expected = [" ".join(plain.sub("", t).split()) for t in texts]
    df = spark.createDataFrame(list(zip(texts, expected)), "text string, expected string")
    wrong = df.filter(clean_text(F.col("text")) != F.col("expected"))
    assert wrong.count() == 0


def test_words(spark):
    df = spark.createDataFrame(
        [("  Hello   world  this   is  a  test  ", 6), ("", 0), ("a b c\u0085d", 4)],
        "text string, n int",
    )
    assert df.filter(count_words(F.col("text")) != F.col("n")).count() == 0


@pytest.mark.parametrize(
    "page",
    [lambda n: "<b>" * n + "<i>" * n + "</b>" * n, lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n, lambda n: "<p>" + "<span>" * n + "<p>" * n],
    ids=["formatting", "list items", "paragraphs"],
)
def test_scan_takes_linear_time(page):
    import time

    from corpusloom.operators.html_scan import make_scanner

    scan = make_scanner()

    def seconds(n):
        begun = time.process_time()
        scan(page(n))
        return time.process_time() - begun

    seconds(2_000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.05)


def test_misnested_formatting_ends_alone():
    from corpusloom.operators.html_scan import make_scanner

    scan = make_scanner(content_selectors=("b", "i"), strip_selectors=("i",))
    found = scan("<p>x<b>one<i>two</b>three<b>four</b></i>five</p>")
    assert found.content == "one" and found.body == "xonefive"
    scan = make_scanner(content_selectors=("i",), strip_selectors=())
    assert scan("<p>x<b>one<i>two</b>three</i>four</p><i>five").content == "twothreefive"


class Captured:
    """Stands in for a table; keeps the function a task would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_batch_is_scanned_in_slices():
    """A worker holds the scans of few pages, however many pages Spark puts into a batch."""
    pages = [f'<article>{k} {"x" * 4000}</article><a href="/{k}">l</a>' for k in range(3000)] + [None, "y" * 3_000_000]
    batch = pa.RecordBatch.from_pydict({"idx": list(range(len(pages))), "url": ["u"] * len(pages), "html": pages})
    out = list(scan_pages(Captured())(iter([batch, batch.slice(0, 0)])))
    assert len(out) >= batch.nbytes // SLICE_BYTES and max(b.num_rows for b in out) < 500
    table = pa.Table.from_batches(out)
    assert table["idx"].to_pylist() == list(range(len(pages)))
    assert [len(links) for links in table["links"].to_pylist()] == [1] * 3000 + [0, 0]
    assert table["raw_text"][7].as_py() == "7 " + "x" * 4000 and len(table["raw_text"][3001].as_py()) == 3_000_000
