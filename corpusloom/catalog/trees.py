"""URL trees of both kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import bindings as B
from corpusloom.operators import crawl_tree as C
from corpusloom.operators import page_tree as P
from corpusloom.operators.distributed import number_rows
from corpusloom.operators.visit import visit_nodes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_P = f"WITH RECURSIVE {B.PAGE_TREE_SQL}"


def page_tree(s, sf):
    return P.build_page_tree(B.tree_pages(s, sf))


def crawl_tree(s, sf, **options):
    return C.build_tree(B.tree_pages(s, sf), **options)


# --- output tree ---------------------------------------------------------------------------------

query(
    "build_page_tree",
    f"{_P} SELECT idx, url, path, title, parent_idx, level, true_level FROM t",
)(lambda s, sf: page_tree(s, sf).drop("ancestors"))

query("longest_prefix_parent", f"{_P} SELECT idx, parent_idx FROM t")(
    lambda s, sf: page_tree(s, sf).select("idx", "parent_idx")
)

query(
    "longest_prefix_parent_by_host",
    f"WITH {B.TREE_NODES_SQL}, q AS (SELECT a.idx, b.idx AS parent_idx, row_number() OVER "
    "(PARTITION BY a.idx ORDER BY length(b.path) DESC, b.idx) AS rn FROM n a JOIN n b ON a.host = b.host "
    "AND starts_with(a.path, b.path || '/') AND b.path <> '' AND a.path NOT IN ('', '/')) "
    "SELECT n.idx, q.parent_idx FROM n LEFT JOIN q ON q.idx = n.idx AND q.rn = 1",
)(
    lambda s, sf: P.build_page_tree(B.tree_pages(s, sf), "host").select("idx", "parent_idx")
)

query("page_level", f"{_P} SELECT idx, level FROM t")(
    lambda s, sf: page_tree(s, sf).select("idx", "level")
)

query("page_tree_height", f"{_P} SELECT max(true_level) AS height FROM t")(
    lambda s, sf: P.page_tree_height(page_tree(s, sf))
)


def _nodes_query(name: str, where: str, literal: bool) -> None:
    @query(
        name,
        f"{_P} SELECT idx, title, row_number() OVER (ORDER BY ikey) - 1 AS position FROM t {where}",
    )
    def _(s, sf):
        nodes = P.page_tree_nodes(page_tree(s, sf), literal)
        key = P.insertion_key(F.col("ancestors"), F.col("idx")).alias("k")
        return number_rows(nodes.select("idx", "title", key), [F.col("k")]).drop("k")


_nodes_query("page_tree_nodes", "", False)
_nodes_query("page_tree_nodes_literal", "WHERE title <> 'Root'", True)

query("page_tree_listing", f"{_P} SELECT idx, title FROM t")(
    lambda s, sf: P.page_tree_nodes(page_tree(s, sf)).select("idx", "title")
)

query("subsections", f"{_P} SELECT parent_idx, idx AS child_idx, title FROM t")(
    lambda s, sf: P.subsections(page_tree(s, sf))
)

query(
    "url_tree_of_pages",
    "WITH RECURSIVE n AS (SELECT page_id AS idx, "
    "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages), "
    "q AS (SELECT a.idx, b.idx AS parent_idx, row_number() OVER (PARTITION BY a.idx "
    "ORDER BY length(b.path) DESC, b.idx) AS rn FROM n a JOIN n b ON starts_with(a.path, b.path || '/') "
    "AND b.path <> '') "
    "SELECT n.idx, n.path, q.parent_idx FROM n LEFT JOIN q ON q.idx = n.idx AND q.rn = 1",
)(
    lambda s, sf: P.build_page_tree(
        B.urls(s, sf).withColumn("title", F.col("url"))
    ).select("idx", "path", "parent_idx")
)

# --- crawl tree ----------------------------------------------------------------------------------

_C = f"WITH RECURSIVE {B.crawl_tree_sql()}"
_CT = f"WITH RECURSIVE {B.crawl_tree_sql('title')}"
_ORPHANS = f"WITH RECURSIVE {B.crawl_tree_sql(fallback=False)}"

query(
    "build_tree", f"{_C} SELECT idx, url, path, title, parent_idx, level, TRUE AS reachable FROM t"
)(lambda s, sf: crawl_tree(s, sf).drop("order_key"))


@query("add_node", f"WITH {B.TREE_NODES_SQL} SELECT idx, url, title FROM n")
def _add_node(s, sf):
    """The URL list names every page twice; the earlier position stays."""
    nodes = B.tree_pages(s, sf)
    listed = nodes.select("idx", "url")
    again = nodes.select((F.col("idx") + F.lit(1 << 60)).alias("idx"), "url")
    return C.tree_nodes(listed.unionByName(again), nodes.select("url", "title")).select(
        "idx", "url", "title"
    )


query("parent_by_url", f"{_ORPHANS} SELECT idx, parent_idx FROM t0")(
    lambda s, sf: C.parent_by_url(B.tree_pages(s, sf)).select("idx", "parent_idx")
)

query(
    "orphans",
    f"{_ORPHANS} SELECT t0.idx, t0.parent_idx, coalesce(t.level, 0) AS level, t.idx IS NOT NULL AS reachable "
    "FROM t0 LEFT JOIN t ON t.idx = t0.idx",
)(
    lambda s, sf: crawl_tree(s, sf, fallback_to_root=False).select(
        "idx", "parent_idx", "level", "reachable"
    )
)

query(
    "fallback_to_root",
    f"WITH {B.TREE_NODES_SQL} SELECT idx, CASE WHEN idx = (SELECT min(idx) FROM n) THEN NULL "
    "ELSE (SELECT min(idx) FROM n) END AS parent_idx FROM n",
)(
    lambda s, sf: crawl_tree(s, sf, use_url_hierarchy=False).select("idx", "parent_idx")
)

query("tree_depth_level", f"{_C} SELECT idx, level FROM t")(
    lambda s, sf: crawl_tree(s, sf).select("idx", "level")
)

query(
    "sort_children",
    f"{_CT} SELECT idx, parent_idx, title, row_number() OVER (PARTITION BY parent_idx "
    "ORDER BY title, idx) - 1 AS rank FROM t WHERE parent_idx IS NOT NULL",
)(
    lambda s, sf: C.sort_children(crawl_tree(s, sf, sort_by="title"))
)

query(
    "sort_children_by_url",
    f"{_CT} SELECT idx, parent_idx, title, row_number() OVER (PARTITION BY parent_idx "
    "ORDER BY url, idx) - 1 AS rank FROM t WHERE parent_idx IS NOT NULL",
)(
    lambda s, sf: C.sort_children(crawl_tree(s, sf, sort_by="url"))
)

_DATE = "(t0.idx * 7919) % 1000"
query(
    "sort_children_by_date",
    f"WITH RECURSIVE {B.crawl_tree_sql(_DATE)} SELECT idx, parent_idx, title, row_number() OVER (PARTITION BY parent_idx "
    "ORDER BY (idx * 7919) % 1000, idx) - 1 AS rank FROM t WHERE parent_idx IS NOT NULL",
)(
    lambda s, sf: C.sort_children(
        C.build_tree(
            B.tree_pages(s, sf).withColumn("last_modified", F.timestamp_seconds((F.col("idx") * 7919) % 1000)), sort_by="date"
        )
    )
)

query("auto_index", f"{_CT} SELECT idx, row_number() OVER (ORDER BY okey) - 1 AS index FROM t")(
    lambda s, sf: C.auto_index(crawl_tree(s, sf, sort_by="title")).select("idx", "index")
)

query(
    "tree_max_depth",
    f"{_C} SELECT max(level) AS max_depth, max(level) * (max(level) + 1) // 2 AS literal_max_depth FROM t",
)(lambda s, sf: C.tree_max_depth(crawl_tree(s, sf)))

query("total_nodes", f"WITH {B.TREE_NODES_SQL} SELECT count(*) AS total_nodes FROM n")(
    lambda s, sf: C.total_nodes(crawl_tree(s, sf, fallback_to_root=False))
)


@query(
    "traverse_depth_first",
    f"{_C} SELECT idx, title, row_number() OVER (ORDER BY okey) - 1 AS position FROM t",
)
def _dfs(s, sf):
    nodes = C.traverse_depth_first(crawl_tree(s, sf)).select("idx", "title", "order_key")
    return number_rows(nodes, [F.col("order_key")]).drop("order_key")


@query(
    "traverse_breadth_first",
    f"{_C} SELECT idx, title, row_number() OVER (ORDER BY level, okey) - 1 AS position FROM t",
)
def _bfs(s, sf):
    nodes = C.traverse_breadth_first(crawl_tree(s, sf)).select("idx", "title", "level", "order_key")
    return number_rows(nodes, [F.col("level"), F.col("order_key")]).drop("level", "order_key")


query(
    "find_node",
    f"{_C} SELECT idx, url, title, level FROM t WHERE url = 'https://tree.example.com/r1/n1'",
)(
    lambda s, sf: C.find_node(crawl_tree(s, sf), "https://tree.example.com/r1/n1").select(
        "idx", "url", "title", "level"
    )
)

query("all_nodes", f"WITH {B.TREE_NODES_SQL} SELECT idx, url, path, title FROM n")(
    lambda s, sf: C.all_nodes(crawl_tree(s, sf, fallback_to_root=False))
)

query("nodes_by_level", f"{_C} SELECT idx, title FROM t WHERE level = 2")(
    lambda s, sf: C.nodes_by_level(crawl_tree(s, sf), 2).select("idx", "title")
)


# --- visitor ---------------------------------------------------------------------------------------

_STOP = "https://tree.example.com/r1/n1"


def _describe(node: dict) -> str:
    if node["url"] == _STOP:
        raise ValueError(node["url"])
    return f"{node['level']} {node['title']}"


def _visit_sql(order: str) -> str:
    return (
        f"{_C}, v AS (SELECT idx, url, level, title, row_number() OVER (ORDER BY {order}) - 1 AS position FROM t) "
        f"SELECT position, idx, url, CASE WHEN url <> '{_STOP}' THEN level || ' ' || title END AS value, "
        f"CASE WHEN url = '{_STOP}' THEN 'ValueError: ' || url END AS error "
        f"FROM v WHERE position <= (SELECT min(position) FROM v WHERE url = '{_STOP}')"
    )


query("visit_nodes_depth_first", _visit_sql("okey"))(lambda s, sf: visit_nodes(crawl_tree(s, sf), _describe))
query("visit_nodes_breadth_first", _visit_sql("level, okey"))(
    lambda s, sf: visit_nodes(crawl_tree(s, sf), _describe, breadth_first=True)
)
query(
    "visit_nodes_all", f"{_C} SELECT row_number() OVER (ORDER BY okey) - 1 AS position, idx, level || ' ' || title AS value FROM t"
)(lambda s, sf: visit_nodes(crawl_tree(s, sf), lambda node: f"{node['level']} {node['title']}").select("position", "idx", "value"))
