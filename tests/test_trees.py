"""Both trees against a direct restatement of their rules, on random paths."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crawl_tree as C
from corpusloom.operators import page_tree as P

HOSTS = ("https://a.example", "https://b.example")


def random_nodes(seed, n=60):
    rng = random.Random(seed)
    urls = set()
    while len(urls) < n:
        depth = rng.randint(0, 4)
        path = "".join("/" + rng.choice("xyz") for _ in range(depth))
        urls.add(rng.choice(HOSTS) + path + rng.choice(("", "", "/", "?q=1")))
    urls = sorted(urls)
    rng.shuffle(urls)
    return [(i, u, rng.choice(("b", "a", "Root", "", "c")) + str(i % 7)) for i, u in enumerate(urls)]


def split(url):
    rest = url.split("://")[1].split("?")[0]
    host, slash, path = rest.partition("/")
    return host, slash + path


def page_parents(nodes):
    paths = [split(u)[1] for _, u, _ in nodes]
    parents = []
    for i, path in enumerate(paths):
        best, size = None, 0
        for j, cand in enumerate(paths):
            if path in ("", "/") or i == j or cand == "":
                continue
            if path.startswith(cand) and len(cand) > size and path[len(cand) : len(cand) + 1] == "/":
                best, size = j, len(cand)
        parents.append(best)
    return parents


def directory(path):
    head = path.rsplit("/", 1)[0]
    return head or "/"


def crawl_parents(nodes, fallback=True):
    places = [split(u) for _, u, _ in nodes]
    parents = [None]
    for i in range(1, len(places)):
        host, path = places[i]
        if path in ("", "/"):
            parents.append(0)
            continue
        up = directory(path)
        fits = [
            j for j in range(i)
            if places[j][0] == host
            and (places[j][1] == up or (up != "/" and path.startswith(places[j][1] + "/")))
        ]
        best = max(fits, key=lambda j: (len(places[j][1]), -j), default=None)
        parents.append(best if best is not None else (0 if fallback else None))
    return parents


def frame(spark, nodes):
    return spark.createDataFrame(nodes, "idx long, url string, title string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_page_tree(spark, seed):
    nodes = random_nodes(seed)
    parents = page_parents(nodes)
    levels = []
    for i, p in enumerate(parents):
        levels.append(1 if p is None else (levels[p] if p < i else 0) + 1)

    def depth(i):
        return 1 if parents[i] is None else depth(parents[i]) + 1

    tree = P.build_page_tree(frame(spark, nodes))
    rows = {r.idx: r for r in tree.collect()}
    for i in range(len(nodes)):
        assert (rows[i].parent_idx, rows[i].level, rows[i].true_level) == (parents[i], levels[i], depth(i)), nodes[i]

    def walk(parent):
        for i, p in enumerate(parents):
            if p == parent:
                yield i
                yield from walk(i)

    expected = [i for i in walk(None) if nodes[i][2] != "Root"]
    assert [r.idx for r in P.page_tree_nodes(tree, literal=True).collect()] == expected
    assert P.page_tree_height(tree).first()[0] == max(depth(i) for i in range(len(nodes)))


@pytest.mark.parametrize("seed,fallback", [(4, True), (5, True), (6, False)])
def test_crawl_tree(spark, seed, fallback):
    nodes = random_nodes(seed)
    parents = crawl_parents(nodes, fallback)
    tree = C.build_tree(frame(spark, nodes), fallback_to_root=fallback, sort_by="title")
    rows = {r.idx: r for r in tree.collect()}
    assert {i: rows[i].parent_idx for i in rows} == dict(enumerate(parents))

    def walk(i):
        yield i
        for child in sorted(
            (j for j, p in enumerate(parents) if p == i and j), key=lambda j: (nodes[j][2], j)
        ):
            yield from walk(child)

    order = list(walk(0))
    assert [r.idx for r in C.traverse_depth_first(tree).collect()] == order
    assert {i for i in rows if rows[i].reachable} == set(order)
    indexed = {r.idx: r["index"] for r in C.auto_index(tree).collect()}
    assert indexed == {i: order.index(i) if i in order else 0 for i in rows}
    deepest = max(r.level for r in rows.values())
    row = C.tree_max_depth(tree).first()
    assert (row.max_depth, row.literal_max_depth) == (deepest, deepest * (deepest + 1) // 2)


def test_small_crawl_tree(spark):
    urls = ["/", "/docs/", "/docs/guide/", "/docs/api/", "/docs/guide/getting-started", "/docs/api/reference"]
    nodes = [(i, f"https://example.com{u}", f"T{i}") for i, u in enumerate(urls)]
    listed = frame(spark, nodes).select("idx", "url")
    again = spark.createDataFrame([(9, nodes[1][1])], "idx long, url string")
    unique = C.tree_nodes(listed.union(again), frame(spark, nodes).select("url", "title"))
    tree = C.build_tree(unique)
    assert C.total_nodes(tree).first()[0] == 6
    assert {r.parent_idx for r in tree.filter("idx > 0").collect()} == {0}
    assert C.find_node(tree, nodes[1][1]).first().level == 1
    assert C.nodes_by_level(tree, 1).count() == 5
    assert C.nodes_by_level(tree, 5).count() == 0


def test_orders(spark):
    nodes = [
        (0, "https://e.example", "Root page"), (1, "https://e.example/p1", "Zebra"),
        (2, "https://e.example/p1/s", "Sub"), (3, "https://e.example/p2", "Apple"),
        (4, "https://e.example/p2/t", "Sub 2"),
    ]
    df = frame(spark, nodes).withColumn("last_modified", F.timestamp_seconds(100 - F.col("idx")))

    def order(by, walk):
        return [r.idx for r in walk(C.build_tree(df, sort_by=by)).collect()]

    assert order(None, C.traverse_depth_first) == [0, 1, 2, 3, 4]
    assert order("title", C.traverse_depth_first) == [0, 3, 4, 1, 2]
    assert order("url", C.traverse_depth_first) == [0, 1, 2, 3, 4]
    assert order("date", C.traverse_depth_first) == [0, 3, 4, 1, 2]
    assert order(None, C.traverse_breadth_first) == [0, 1, 3, 2, 4]
    ranks = {r.idx: r["rank"] for r in C.sort_children(C.build_tree(df, sort_by="title")).collect()}
    assert ranks == {3: 0, 1: 1, 2: 0, 4: 0}
    with pytest.raises(ValueError):
        C.build_tree(df, sort_by="size")


def test_no_pages(spark):
    none = frame(spark, [])
    assert P.page_tree_height(P.build_page_tree(none)).first()[0] == 0
    assert C.build_tree(none).count() == 0


def test_visitor_stops_at_the_first_error(spark):
    from corpusloom.operators.crawl_tree import build_tree, traverse_breadth_first, traverse_depth_first
    from corpusloom.operators.visit import visit_nodes

    urls = ["/", "/a", "/b", "/a/x", "/a/y", "/b/z", "/a/x/deep", "/c"]
    pages = spark.createDataFrame([(i, f"https://h.example{u}", f"t{i}", "text") for i, u in enumerate(urls)], "idx long, url string, title string, content string")
    tree = build_tree(pages)
    for breadth_first, walk in ((False, traverse_depth_first), (True, traverse_breadth_first)):
        order = [r.idx for r in walk(tree).collect()]

        def names(node):
            return node["title"]

        def fails(node):
            if node["idx"] in (order[3], order[5], order[-1]):
                raise KeyError(node["title"])
            return str(node["level"])

        rows = visit_nodes(tree, names, breadth_first).orderBy("position").collect()
        assert [(r.position, r.idx, r.value, r.error) for r in rows] == [(k, i, f"t{i}", None) for k, i in enumerate(order)]
        rows = visit_nodes(tree, fails, breadth_first).orderBy("position").collect()
        assert [r.idx for r in rows] == order[:4] and [r.error for r in rows] == [None] * 3 + [f"KeyError: 't{order[3]}'"]
    assert visit_nodes(tree.limit(0), names).collect() == []


def test_paths_of_many_slashes(spark):
    long = "https://a.example/x" + "/y" * 10_000
    nodes = [(0, "https://a.example/x", "t"), (1, long[:-2], "u"), (2, long, "v"), (3, "https://a.example/x" + "/y" * 9_000 + "y/y", "w")]
    pages = {r.idx: r for r in P.build_page_tree(frame(spark, nodes)).collect()}
    assert [[a.idx for a in pages[k].ancestors] for k in range(4)] == [[], [0], [0, 1], [0]]
    crawl = {r.idx: r.parent_idx for r in C.build_tree(frame(spark, nodes)).collect()}
    assert crawl == {0: None, 1: 0, 2: 1, 3: 0}


def test_equal_hashes_prove_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "_step", lambda at, part: F.lit(0).cast("long"))
    nodes = random_nodes(4)
    pages = {r.idx: r.parent_idx for r in P.build_page_tree(frame(spark, nodes)).collect()}
    assert [pages[i] for i in range(len(nodes))] == page_parents(nodes)
    crawl = {r.idx: r.parent_idx for r in C.build_tree(frame(spark, nodes)).collect()}
    assert [crawl[i] for i in range(len(nodes))] == crawl_parents(nodes)
