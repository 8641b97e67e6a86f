"""Pages on other hosts, repeated contents, clock changes, deep markup."""

import time

from pyspark.sql import functions as F

from corpusloom.operators.crawl_tree import build_tree, sort_children, tree_nodes
from corpusloom.operators.html_scan import make_scanner
from corpusloom.plans.corpus import build_corpus


def test_corpus_keeps_to_the_hosts_of_its_seeds(spark):
    def page(*links):
        return "<main>" + "text " * 60 + "".join(f'<a href="{x}">x</a>' for x in links) + "</main>"

    pages = spark.createDataFrame(
        [
            (0, "https://www.h.example/a", page()), (1, "https://h.example/", page("/a")),
            (2, "https://h.example/a", page("/b")), (3, "https://h.example/b", page()),
        ],
        "idx long, url string, html string",
    )
    seeds = spark.createDataFrame([("https://h.example/",)], "url string")
    corpus = build_corpus(pages, seeds, F.current_timestamp())
    assert {(r.idx, r.depth) for r in corpus.collect()} == {(1, 1), (2, 2), (3, 3)}
    robots = spark.createDataFrame(
        [("h.example", 1, "User-agent: *"), ("h.example", 2, "Disallow: /")], "host string, line_no long, line string"
    )
    assert build_corpus(pages, seeds, F.current_timestamp(), robots=robots).count() == 0


def test_repeated_contents_make_one_node(spark):
    urls = spark.createDataFrame([(0, "https://h/"), (1, "https://h/a"), (2, "https://h/a")], "idx long, url string")
    contents = spark.createDataFrame([("https://h/", "top"), ("https://h/a", "x"), ("https://h/a", "y")], "url string, title string")
    nodes = tree_nodes(urls, contents).collect()
    assert sorted((r.idx, r.title) for r in nodes) == [(0, "top"), (1, "y")]


def test_dates_sort_as_instants_where_clocks_go_back(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = [(0, "https://h/", "top", 0), (1, "https://h/a", "late", 1729991400), (2, "https://h/b", "early", 1729990200)]
        nodes = spark.createDataFrame(rows, "idx long, url string, title string, s long")
        tree = build_tree(nodes.withColumn("last_modified", F.timestamp_seconds("s")), sort_by="date")
        ranks = {r.title: r["rank"] for r in sort_children(tree).collect()}
        assert ranks["early"] < ranks["late"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_scan_is_linear_in_depth():
    scan = make_scanner()
    for page in ("<div>" * 50_000, "<b></i>" * 50_000):
        start = time.process_time()
        scan(page)
        assert time.process_time() - start < 5
