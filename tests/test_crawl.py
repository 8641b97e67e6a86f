import random

from pyspark.sql import functions as F

from corpusloom.functions.urls import CRAWL_RULES
from corpusloom.operators import crawl as C
from corpusloom.plans.corpus import build_corpus


def url(i):
    return f"https://h.example/{i}"


def reference_bfs(n, edges, seeds, limit):
    depth, frontier, at = {}, set(seeds), 1
    while frontier and at <= limit:
        depth.update({i: at for i in frontier})
        frontier = {d for s, d in edges if s in frontier and d < n} - set(depth)
        at += 1
    return depth


def test_random_graphs(spark):
    rng = random.Random(7)
    n = 80
    # One page links to nearly everything and everything links to one page.
    edges = {(rng.randrange(n), rng.randrange(n + 20)) for _ in range(150)}
    edges |= {(3, i) for i in range(40, n)} | {(i, 5) for i in range(n)}
    pages = spark.createDataFrame([(i, url(i)) for i in range(n)], "idx long, url string")
    links = spark.createDataFrame([(s, p, url(d)) for p, (s, d) in enumerate(sorted(edges))], "src long, pos int, dst_url string")
    seeds = spark.createDataFrame([(url(0),), (url(1),), ("https://elsewhere.example/",)], "url string")
    for limit in (0, 1, 2, 4, 50):
        found = {r.idx: r.depth for r in C.crawl_bfs(pages, links, seeds, limit).collect()}
        assert found == reference_bfs(n, edges, [0, 1], limit)


def test_many_links_on_one_page(spark):
    n = 10000
    pages = spark.range(n).select(F.col("id").alias("idx"), F.concat(F.lit("https://h.example/"), F.col("id")).alias("url"))
    links = pages.filter("idx > 0").select(F.lit(0).cast("long").alias("src"), F.col("idx").cast("int").alias("pos"), F.col("url").alias("dst_url"))
    seeds = pages.filter("idx = 0").select("url")
    summary = {r.depth: r.pages for r in C.crawl_summary(C.crawl_bfs(pages, links, seeds, 3)).collect()}
    assert summary == {1: 1, 2: n - 1}


def test_canonical_and_exact_keys(spark):
    pages = spark.createDataFrame([(0, url(0)), (1, url(1)), (2, url(1) + "/")], "idx long, url string")
    links = spark.createDataFrame([(0, 0, "HTTPS://www.H.example/1#x")], "src long, pos int, dst_url string")
    seeds = spark.createDataFrame([(url(0) + "#top",)], "url string")
    exact = C.crawl_bfs(pages, links, seeds, 5)
    assert [r.idx for r in exact.collect()] == [0]
    canonical = C.crawl_bfs(pages, links, seeds, 5, CRAWL_RULES)
    assert sorted(r.idx for r in canonical.collect()) == [0, 1]


def test_build_corpus(spark):
    text = "words that matter to the reader and to the writer " * 30
    html = [
        (0, "https://h.example/", f"<title>Home</title><article>{text}<a href='/a'>a</a><a href='/x.pdf'>x</a></article>"),
        (1, "https://h.example/a", f"<title>A</title><article>{text}<a href='b#c'>b</a></article>"),
        (2, "https://h.example/b", "<title>B</title><article>404 short</article>"),
        (3, "https://h.example/lost", f"<title>L</title><article>{text}</article>"),
        (4, "https://h.example/x.pdf", f"<article>{text}</article>"),
    ]
    pages = spark.createDataFrame(html, "idx long, url string, html string")
    seeds = spark.createDataFrame([("https://h.example/",)], "url string")
    now = F.lit("2024-01-01").cast("timestamp")
    found = {r.idx: r.depth for r in build_corpus(pages, seeds, now).collect()}
    assert found == {0: 1, 1: 2, 2: 3}
    assert sorted(r.idx for r in build_corpus(pages, seeds, now, max_depth=2, dedup=False).collect()) == [0, 1]
    # Extracted text is one line without code: half a point is out of reach below 417 words.
    from corpusloom.functions.quality import QualityRules

    rules = QualityRules(min_score=0.4)
    assert sorted(r.idx for r in build_corpus(pages, seeds, now, quality=True, quality_rules=rules).collect()) == [0, 1]
    robots = spark.createDataFrame([("h.example", 0, "User-agent: *"), ("h.example", 1, "Disallow: /")], "host string, line_no int, line string")
    assert build_corpus(pages, seeds, now, robots=robots).count() == 0


def test_edges_and_visited_pages_stay_where_they_are(spark):
    """With broadcasts off, only the frontier and its targets are shuffled in a round."""
    from corpusloom.session import Bucketed

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(1000).select((F.col("id") % 50).alias("src"), F.lit(0).cast("long").alias("block"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("blocks"))
        reached = spark.range(20).select(F.col("id").alias("idx"), F.lit(1).cast("long").alias("blocks"), F.lit(1).alias("depth"))
        with Bucketed(edges, "edges", ["src", "block"]) as graph, Bucketed(reached, "reached", ["idx"]) as known:
            fresh = C.next_targets(graph.table(), known.table()).withColumnRenamed("dst", "idx")
            fresh = fresh.join(known.table(), "idx", "left_anti")
            plan = fresh._jdf.queryExecution().executedPlan().toString()
            # The frontier to its sources' buckets, the targets to theirs.
            assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan
            for line, behind in zip(plan.splitlines(), plan.splitlines()[1:]):
                assert not ("Exchange" in line and "FileScan" in behind)
            assert fresh.count() == 400 - 20
            known.append(fresh.select("idx", "blocks", F.lit(2).alias("depth")))
            assert known.table().count() == 400
            assert known.table().groupBy("idx").count().where("count > 1").isEmpty()
            name = known.name
        assert not spark.catalog.tableExists(name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_long_chain_ends_by_itself(spark):
    n = 12
    pages = spark.createDataFrame([(i, url(i)) for i in range(n)], "idx long, url string")
    links = spark.createDataFrame([(i, 0, url(i + 1)) for i in range(n)], "src long, pos int, dst_url string")
    seeds = spark.createDataFrame([(url(0),)], "url string")
    assert {r.idx: r.depth for r in C.crawl_bfs(pages, links, seeds, 10**6).collect()} == {i: i + 1 for i in range(n)}
