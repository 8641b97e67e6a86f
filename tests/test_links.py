from pyspark.sql import functions as F

from corpusloom.operators import dedup as D
from corpusloom.operators.links import link_graph, robots_allowed, should_follow_link
from corpusloom.operators.distributed import number_rows, number_within, salted_lookup
from corpusloom.sources.readers import read_line_list
from corpusloom.sources.writers import write_lines

BASE = "https://example.com/docs/"
FOLLOW = [
    ("/docs/page1", None),
    ("https://example.com/docs/page2", None),
    ("/docs/guide/getting-started", None),
    ("https://external.com/page", "other_host"),
    ("/docs/file.pdf", "file_extension"),
    ("/images/photo.jpg", "file_extension"),
    ("#section1", "same_page_fragment"),
    ("/login", "blocked_path"),
    ("/api/users", "blocked_path"),
    ("/admin/dashboard", "blocked_path"),
    ("/search?q=test", "blocked_path"),
    ("not-a-valid-url", "malformed_relative"),
    ("short", None),
    ("?page=2", None),
    ("", None),
    ("page.html#x", None),
    ("mailto:a@b.c", "absolute_without_host"),
    ("javascript:void(0)", "absolute_without_host"),
    ("http://example.com:8080/x", "other_host"),
    ("https://Example.com/x", "other_host"),
    ("/x%zz", "unparsable"),
    ("/A.PDF?x", "file_extension"),
    ("x/http://y", "malformed_relative"),
    ("?q=1#frag", "same_page_fragment"),
]


def test_follow(spark):
    df = spark.createDataFrame([(BASE, h, e) for h, e in FOLLOW], "url string, href string, expected string")
    for row in should_follow_link(df).collect():
        assert row.reason == row.expected, row
        assert row.follow == (row.expected is None)


def test_link_graph(spark):
    html = "<nav><a href='/n'>n</a></nav><article><a href='b#x'>b</a><a href='/c.pdf'>c</a></article>"
    pages = spark.createDataFrame([(1, "https://h.example/a/", html)], "idx long, url string, html string")
    rows = link_graph(pages).orderBy("pos").collect()
    assert [(r.resolved, r.follow) for r in rows] == [
        ("https://h.example/a/b", True), ("https://h.example/c.pdf", False),
    ]


def test_robots(spark):
    lines = {
        "open.example": ["User-agent: *", "Disallow: /private"],
        "shut.example": ["user-agent: *", "disallow: /"],
        "sticky.example": ["User-Agent: *", "User-agent: bot", "Disallow: /"],
        "before.example": ["Disallow: /", "User-agent: *"],
    }
    robots = spark.createDataFrame(
        [(h, i, l) for h, ls in lines.items() for i, l in enumerate(ls)], "host string, line_no int, line string"
    )
    pages = spark.createDataFrame([(f"https://{h}/x",) for h in [*lines, "none.example"]], "url string")

    def hosts(literal):
        return {r.url.split("/")[2].split(".")[0] for r in robots_allowed(pages, robots, literal=literal).collect()}

    assert hosts(False) == {"open", "before", "none"}
    assert hosts(True) == {"open", "before", "none", "sticky"}


def test_dedup(spark):
    df = spark.createDataFrame(
        [(1, "https://example.com/page"), (2, "https://example.com/page#section"), (3, "https://EXAMPLE.com/page"),
         (4, "https://example.com/other"), (5, "://bad"), (6, "https://www.example.com/page/")],
        "idx long, url string",
    )
    marked = {r.idx: r.is_duplicate for r in D.mark_duplicates(df).collect()}
    assert marked == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
    assert D.duplicate_count(df).first()[0] == 4
    assert D.seen_url_count(df).first()[0] == 2
    assert sorted(r.idx for r in D.dedup_urls(df).collect()) == [1, 4]
    assert {(r.url, r.canonical) for r in D.canonical_map(df).collect()} == {
        ("https://example.com/page",) * 2, ("https://example.com/other",) * 2,
    }
    members = D.duplicate_members(df).orderBy("idx").collect()
    assert [(r.idx, r.members, r.is_first) for r in members] == [
        (1, 4, True), (2, 4, False), (3, 4, False), (4, 1, True), (6, 4, False),
    ]
    seen = D.is_seen(df, df.filter("idx = 4")).filter("is_seen").collect()
    assert sorted(r.idx for r in seen) == [4, 5]


def test_duplicates_and_seen_add_up(spark):
    df = spark.range(5000).select(
        F.col("id").alias("idx"), F.concat(F.lit("https://h.example/"), F.col("id") % 3).alias("url")
    )
    total = D.duplicate_count(df).first()[0] + D.seen_url_count(df).first()[0]
    assert total == 5000


def test_hot_keys_join_whole(spark):
    facts = spark.range(20000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    dim = spark.range(0, 20000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    found = salted_lookup(facts, dim, ["k"], F.col("id"))
    plain = facts.join(dim, "k")
    assert found.count() == plain.count()
    assert found.agg(F.sum("v")).first() == plain.agg(F.sum("v")).first()
    left = salted_lookup(facts, dim, ["k"], F.col("id"), "left_anti")
    assert left.count() == facts.join(dim, "k", "left_anti").count()


def test_numbers(spark):
    df = spark.range(10000).select((F.col("id") * 7919 % 10007).alias("x"), (F.col("id") % 2).alias("g"))
    numbered = number_rows(df, [F.col("x")]).orderBy("x").collect()
    assert [r.position for r in numbered] == list(range(10000))
    within = number_within(df, ["g"], [F.col("x").desc()]).collect()
    for g in (0, 1):
        rows = sorted((r for r in within if r.g == g), key=lambda r: -r.x)
        assert [r.position for r in rows] == list(range(5000))


def test_line_lists(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("# comment\nline1\nline2\n\n# comment\nline3\n    line4    \n")
    lines = read_line_list(spark, str(source))
    assert sorted(r.line for r in lines.collect()) == ["line1", "line2", "line3", "line4"]
    write_lines(lines, F.col("line"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(text.splitlines()) == ["line1", "line2", "line3", "line4"]
