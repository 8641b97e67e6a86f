from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.operators.links import resolve

R = U.UrlRules
NORMALIZE = [
    ("https://example.com/page#section", R(remove_fragment=True), "https://example.com/page"),
    ("https://example.com/page?param=value", R(remove_query=True), "https://example.com/page"),
    ("https://example.com/page/", R(remove_trailing=True), "https://example.com/page"),
    ("https://example.com/", R(remove_trailing=True), "https://example.com/"),
    ("https://example.com", R(remove_trailing=True), "https://example.com"),
    ("https://Example.Com/PAGE", R(lowercase=True), "https://example.com/page"),
    ("https://www.example.com/page", R(remove_www=True), "https://example.com/page"),
    ("https://WwW.example.com/page", R(remove_www=True), "https://example.com/page"),
    ("https://www.www.example.com/", R(remove_www=True), "https://www.example.com/"),
    ("https://example.com/page?z=1&a=2&m=3", R(sort_query=True), "https://example.com/page?a=2&m=3&z=1"),
    ("https://WWW.Example.Com/Page/?z=1&a=2#section", U.CRAWL_RULES, "https://example.com/page?a=2&z=1"),
    ("://invalid", R(lowercase=True), None),
    # Beyond the plain cases: what a strict parser and printer do.
    ("HTTPS://Example.com/A", R(), "https://Example.com/A"),
    ("https://example.com/p?", R(remove_query=True), "https://example.com/p?"),
    ("https://example.com/p?&&", R(sort_query=True), "https://example.com/p"),
    ("https://example.com/p?b=2&a=1&b=1", R(sort_query=True), "https://example.com/p?a=1&b=2&b=1"),
    ("https://example.com/p?flag&x=a b", R(sort_query=True), "https://example.com/p?flag=&x=a+b"),
    ("https://example.com/p?x=%zz&y=1;2&k=~*", R(sort_query=True), "https://example.com/p?k=~%2A"),
    ("https://example.com/a b/é", R(), "https://example.com/a%20b/%C3%A9"),
    ("https://example.com/a%20b/", R(remove_trailing=True), "https://example.com/a%20b"),
    ("https://example.com/a(b)/", R(remove_trailing=True), "https://example.com/a%28b%29"),
    ("https://example.com/a(b)", R(remove_trailing=True), "https://example.com/a(b)"),
    ("https://example.com/x//", R(remove_trailing=True), "https://example.com/x/"),
    ("https://bücher.example/", R(), "https://b%C3%BCcher.example/"),
    ("https://u:p@www.example.com:8080/x", R(remove_www=True), "https://u:p@example.com:8080/x"),
    ("mailto:a@example.com", U.CRAWL_RULES, "mailto:a@example.com"),
    ("file:///etc/x", R(), "file:///etc/x"),
    ("http:/x", R(), "http:/x"),
    ("/relative/path/", U.CRAWL_RULES, "/relative/path"),
    ("//host.example/x", R(), "//host.example/x"),
    ("https://example.com/p#a b", R(), "https://example.com/p#a%20b"),
    ("https://example.com/p#", R(), "https://example.com/p"),
    ("", R(), ""),
    (None, R(), None),
]

VALID = [
    ("https://example.com/a?b#c", True),
    ("relative/path", True),
    ("", True),
    ("#frag", True),
    ("://invalid", False),
    (":x", False),
    ("a:b", True),
    ("1a:b", False),
    ("a/b:c", True),
    ("https://example.com/%zz", False),
    ("https://example.com/%4", False),
    ("https://example.com/?q=%zz", True),
    ("https://example.com/#%zz", False),
    ("https://exa mple.com/", False),
    ("https://example.com:80a/", False),
    ("https://example.com:/", True),
    ("https://[::1]:80/", True),
    ("https://[::1/", False),
    ("https://example.com/\x01", False),
    ("https://ex%41mple.com/", False),
    ("https://example.com/a b", True),
]

RESOLVE = [
    # RFC 3986 section 5.4, base http://a/b/c/d;p?q
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"),
    ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"), ("", "http://a/b/c/d;p?q"),
    (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"),
    ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"), ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"), ("../../../../g", "http://a/g"), ("/./g", "http://a/g"),
    ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"),
    ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"),
    ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g;x=1/./y", "http://a/b/c/g;x=1/y"),
    ("g;x=1/../y", "http://a/b/c/y"), ("g?y/./x", "http://a/b/c/g?y/./x"), ("g#s/../x", "http://a/b/c/g#s/../x"),
]


def test_normalize(spark):
    for rules in dict.fromkeys(r for _, r, _ in NORMALIZE):
        cases = [(i, u, e) for i, (u, r, e) in enumerate(NORMALIZE) if r == rules]
        df = spark.createDataFrame(cases, "i int, url string, expected string")
        for row in df.select("*", U.normalize_url(F.col("url"), rules).alias("found")).collect():
            assert row.found == row.expected, row


def test_normalize_is_idempotent(spark):
    """Except where one slash or one www. of several is taken off, as the rules say."""
    urls = [u for u, _, _ in NORMALIZE if u and "www.www" not in u and not u.endswith("//")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    once = df.select(U.normalize_url(F.col("url")).alias("a")).filter("a is not null")
    assert once.select("a", U.normalize_url(F.col("a")).alias("b")).filter("a <> b").count() == 0


def test_valid(spark):
    df = spark.createDataFrame(VALID, "url string, expected boolean")
    for row in df.select("*", U.url_is_valid(F.col("url")).alias("found")).collect():
        assert row.found == row.expected, row


def test_path_and_canonical(spark):
    df = spark.createDataFrame(
        [("https://h/a%20b+c",), ("://bad",), ("mailto:x",), ("https://h",)], "url string"
    )
    rows = df.select(
        U.url_path(F.col("url")).alias("raw"),
        U.url_path(F.col("url"), "empty").alias("empty"),
        U.canonical_url(F.col("url")).alias("canonical"),
    ).collect()
    assert [r.raw for r in rows] == ["/a b+c", "://bad", "", ""]
    assert [r.empty for r in rows] == ["/a b+c", "", "", ""]
    assert [r.canonical for r in rows] == ["https://h/a%20b+c", "://bad", "mailto:x", "https://h"]


def test_resolve(spark):
    df = spark.createDataFrame(RESOLVE, "link string, expected string").withColumn(
        "base", F.lit("http://a/b/c/d;p?q")
    )
    for row in df.select("*", resolve(F.col("base"), F.col("link")).alias("found")).collect():
        assert row.found == row.expected, row


def test_simple_urls_agree_with_the_parser(spark):
    """A query mark sends a URL through the parser; without it the short way is taken."""
    hosts = ("h.example", "www.h.example", "WWW.a:80", "www.", "www.www.a", ":80", "")
    paths = ("", "/", "//", "/a/", "/a//", "/A/b.html", "/../")
    urls = [f"{s}{h}{p}" for s in ("http://", "https://") for h in hosts for p in paths]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    short, parsed = (
        U.normalize_url(x, U.UrlRules(remove_query=True, remove_www=True, remove_trailing=True))
        for x in (F.col("url"), F.concat("url", F.lit("?q=1")))
    )
    assert df.where(~short.eqNullSafe(parsed)).count() == 0
