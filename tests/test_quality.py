import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import quality as Q
from corpusloom.operators import quality as O

RULES = Q.QualityRules(min_word_count=50, blacklist=("error", "404"))


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    rows = df.select("i", column(F.col("content")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_code_blocks(spark):
    texts = ["```go\nx\n```", "```a```\n```b```", "`a` `b` `c`", "none", "```x `a` `b` `c`", ""]
    assert values(spark, texts, Q.code_block_count) == [1, 2, 1, 0, 1, 0]


def test_headers(spark):
    texts = ["# Title\n## Subtitle\n### Sub-subtitle\nContent", "#no", "####### seven", "#\n\nx", "", "a # b"]
    assert values(spark, texts, Q.header_count) == [3, 0, 0, 1, 0, 0]


def test_lines(spark):
    texts = ["", "a", "a\n", "a\n  \n\nb", "\n\n"]
    assert values(spark, texts, Q.total_lines) == [1, 1, 2, 4, 3]
    assert values(spark, texts, Q.empty_lines) == [1, 0, 1, 2, 3]


def test_ratio(spark):
    texts = ["", "menu", "plain words", "Menu and FOOTER", "navigationavigation", "follow usubscribe"]
    expected = [0.0, 0.0, 1.0, 5 / 15, 9 / 19, 0.0]
    assert values(spark, texts, Q.content_ratio) == pytest.approx(expected)


def test_language(spark):
    texts = ["the cat and the dog", "le chat et le chien", "", "The-cat dog", " ".join(["x"] * 20 + ["the"]), " ".join(["x"] * 19 + ["the", "by"])]
    assert values(spark, texts, Q.detect_language) == ["en", "unknown", "unknown", "unknown", "unknown", "en"]


def test_code_block_rows(spark):
    df = spark.createDataFrame([(1, "```py\na\nb\n```\n```\nc```")], "idx long, content string")
    rows = O.extract_code_blocks(df).orderBy("pos").collect()
    assert [(r.pos, r.language, r.content, r.line_count) for r in rows] == [
        (0, "py", "a\nb\n", 3), (1, "text", "c", 1),
    ]


def test_markdown_links_match_a_plain_scan(spark):
    import itertools

    pieces = ["[", "]", "(", ")", "](", "a"]
    texts = ["".join(p) for n in range(1, 7) for p in itertools.product(pieces, repeat=n)][:30000]
    plain = re.compile(r"\[([^\]]+)\]\([^)]+\)")
    rows = [(t, len(plain.findall(t))) for t in texts]
    df = spark.createDataFrame(rows, "t string, n int")
    assert df.filter(Q.markdown_link_count(F.col("t")) != F.col("n")).count() == 0


NAVIGATION = [
    ("Table of Contents", "Introduction\nChapter 1", True),
    ("API Reference", "This guide explains the calls of the interface.", False),
    ("Documentation Index", "All pages", True),
    ("Quick Links", "[a](/a) [b](/b) [c](/c) [d](/d)", True),
    ("", "menu", False),
    ("", "menu navigation", True),
]


def test_navigation(spark):
    df = spark.createDataFrame(NAVIGATION, "title string, content string, expected boolean")
    found = df.withColumn("found", Q.is_navigation_page(F.col("title"), F.col("content")))
    for row in found.collect():
        assert row.found == row.expected, row


GOOD = "This is good content with plenty of useful words. " * 20


def test_issues(spark):
    cases = [
        ("Title", GOOD, []),
        ("", GOOD, ["missing_title"]),
        ("Title", "Short content", ["word_count"]),
        ("Title", "Error 404 - page not found", ["word_count", "blacklisted_content"]),
        ("Title", "", ["word_count", "empty_content"]),
    ]
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, title string, content string")
    rows = df.select("i", Q.detect_issues(F.col("title"), F.col("content"), RULES).alias("issues")).collect()
    found = {r.i: r.issues for r in rows}
    assert [[x.type for x in found[i]] for i in range(len(cases))] == [e for _, _, e in cases]
    assert found[3][1].description == "Content contains blacklisted patterns: error, 404"


def test_score_ranges(spark):
    cases = [(500, 3, 3, 0.8, True, 0.8, 1.0), (200, 1, 2, 0.6, True, 0.4, 0.7), (50, 0, 0, 0.2, False, 0.0, 0.3)]
    df = spark.createDataFrame(cases, "w int, c int, h int, r double, t boolean, low double, high double")
    score = Q.quality_score(*[F.col(x) for x in "wchrt"])
    assert df.filter(~score.between(F.col("low"), F.col("high"))).count() == 0


def test_should_skip(spark):
    issue = "array<struct<type:string,severity:string,description:string>>"
    cases = [
        (0.8, False, [], False),
        (0.2, False, [], True),
        (0.8, True, [], True),
        (0.8, False, [("x", "error", "")], True),
        (0.8, False, [("x", "warning", "")], False),
    ]
    df = spark.createDataFrame(cases, f"score double, nav boolean, issues {issue}, expected boolean")
    found = Q.should_skip(F.col("score"), F.col("nav"), F.col("issues"))
    assert df.filter(found != F.col("expected")).count() == 0


def test_report(spark):
    texts = [("A", GOOD * 5), ("", "x"), ("Untitled", "404"), ("B", "# h\n" + GOOD)]
    df = spark.createDataFrame(
        [(i, f"u{i}", t, c) for i, (t, c) in enumerate(texts)],
        "idx long, url string, title string, content string",
    )
    scored = O.analyze_content(df)
    stats = O.quality_stats(scored).first()
    assert (stats.total_pages, stats.passed_pages + stats.failed_pages) == (4, 4)
    row = O.quality_report(scored, F.lit("2024-01-01").cast("timestamp"), k=2).first()
    assert [p.url for p in row.top_pages] == ["u0", "u3"]
    assert [p.url for p in row.worst_pages] == ["u1", "u2"]
    assert row.common_issues[0]["count"] == 2
    empty = O.quality_stats(scored.limit(0)).first()
    assert (empty.total_pages, empty.average_score, empty.average_word_count) == (0, 0.0, 0)


def test_blacklist_may_be_empty(spark):
    df = spark.createDataFrame([(1, "u", "T", GOOD)], "idx long, url string, title string, content string")
    rules = Q.QualityRules(min_score=0.1, blacklist=())
    assert O.quality_filter(O.analyze_content(df, rules), rules).count() == 1


def test_long_s_counts_as_an_s(spark):
    assert values(spark, ["ſubscribe now"], Q.content_ratio) == [4 / 14]
