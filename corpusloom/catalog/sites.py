"""Pages, links, URLs, duplicates and crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import bindings as B
from corpusloom.functions import urls as U
from corpusloom.functions.text import clean_text
from corpusloom.operators import crawl as C
from corpusloom.operators import dedup as D
from corpusloom.operators import extract as E
from corpusloom.operators import links as L
from corpusloom.operators.extract import spread
from corpusloom.plans.corpus import build_corpus
from corpusloom.sources.readers import list_lines, read_pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- sources and extraction ----------------------------------------------------------------------

query("read_pages", "SELECT page_id AS idx, url, length(html) AS html_chars FROM pages")(
    lambda s, sf: read_pages(s, f"{sf}/pages.parquet").select(
        "idx", "url", F.length("html").alias("html_chars")
    )
)


@query(
    "read_line_list",
    "WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || '  # note  ' || chr(10) || "
    "' kept ', chr(10))) AS raw FROM documents), "
    f"k AS (SELECT doc_id, regexp_replace(raw, '^[{B.SPACE_CLASS}]+|[{B.SPACE_CLASS}]+$', '', 'g') "
    "AS line FROM l) SELECT doc_id, line FROM k WHERE line <> '' AND NOT starts_with(line, '#')",
)
def _line_list(s, sf):
    text = F.concat("text", F.lit("\n  # note  \n kept "))
    lines = B.table(s, sf, "documents").select(
        "doc_id", F.explode(F.split(text, "\n")).alias("raw")
    )
    return list_lines(lines, F.col("raw")).select("doc_id", "line")


query("extract_title", f"SELECT page_id AS idx, {B.TITLE_SQL} AS title FROM pages")(
    lambda s, sf: E.extract_title(B.pages(s, sf)).select("idx", "title")
)

query(
    "strip_boilerplate",
    "SELECT page_id AS idx, trim(regexp_replace(replace(replace(regexp_replace("
    "regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), "
    "'(?s)<nav>.*?</nav>|<!--.*?-->|<footer>.*?(?:</footer>|$)', '', 'g'), '<[^>]*>', '', 'g'), "
    "'&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages",
)(
    lambda s, sf: E.strip_boilerplate(B.pages(s, sf)).select(
        "idx", F.btrim(F.regexp_replace("body_text", r"[\t\n\f\r ]+", " ")).alias("body")
    )
)

query("extract_content", f"SELECT page_id AS idx, {B.CONTENT_SQL} AS content FROM pages")(
    lambda s, sf: E.extract_content(B.pages(s, sf)).select("idx", "content")
)

_NOISY = (
    "'skip TO main content ' || text || chr(10) || 'xx Skip to the  content yy' || chr(10) || "
    "'Click here to go Subscribe to our list  Follow us on Web ' || text"
)


@query(
    "clean_text",
    f"WITH r AS (SELECT doc_id, {_NOISY} AS t FROM documents) SELECT doc_id, "
    f"regexp_replace(regexp_replace("
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i).*?Skip to .*?content\s*', '', 'g'), "
    r"'(?i)Click here to \w+\s*', '', 'g'), '(?i)Subscribe to \w+ \w+\s*', '', 'g'), "
    r"'(?i)Follow us on \w+\s*', '', 'g'), '\s+', ' ', 'g'), "
    f"'^[{B.SPACE_CLASS}]+|[{B.SPACE_CLASS}]+$', '', 'g') AS content FROM r",
)
def _clean_text(s, sf):
    return B.table(s, sf, "documents").select(
        "doc_id", clean_text(F.expr(_NOISY)).alias("content")
    )


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"

query(
    "extract_links",
    f"WITH l AS (SELECT page_id AS idx, unnest({_HREFS}) AS href, "
    f"unnest(range(len({_HREFS}))) AS pos FROM pages) "
    "SELECT idx, CAST(pos AS INTEGER) AS pos, href, TRUE AS in_boilerplate FROM l",
)(lambda s, sf: E.extract_links(B.pages(s, sf), "raw").select("idx", "pos", "href", "in_boilerplate"))

query(
    "extract_links_content_scope",
    "SELECT page_id AS idx, html AS href FROM pages WHERE regexp_matches(html, "
    "'(?s)</nav>.*<a href')",
)(lambda s, sf: E.extract_links(B.pages(s, sf), "content").select("idx", "href"))

query("link_count", f"SELECT page_id AS idx, len({_HREFS}) AS link_count FROM pages")(
    lambda s, sf: E.link_count(B.pages(s, sf)).select("idx", "link_count")
)

query(
    "extract_pages", f"WITH {B.EXTRACTED_SQL} SELECT * FROM x WHERE content <> ''"
)(lambda s, sf: E.extract_pages(B.pages(s, sf)))

query(
    "non_empty_content",
    f"WITH {B.DOCS_SQL} SELECT idx FROM docs WHERE regexp_matches(content, '[^{B.SPACE_CLASS}]')",
)(lambda s, sf: E.non_empty_content(B.docs(s, sf)).select("idx"))

# --- URL functions -------------------------------------------------------------------------------

_OK = "NOT (url LIKE '://%' OR contains(url, '%zz'))"

query(
    "url_path",
    f"WITH {B.SPELLINGS_SQL} SELECT idx, CASE WHEN {_OK} THEN "
    "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) ELSE url END AS path, "
    f"CASE WHEN {_OK} THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) ELSE '' END "
    "AS path_or_empty FROM v",
)(
    lambda s, sf: B.spellings(s, sf).select(
        "idx",
        U.url_path(F.col("url"), "raw").alias("path"),
        U.url_path(F.col("url"), "empty").alias("path_or_empty"),
    )
)

query("url_is_valid", f"WITH {B.SPELLINGS_SQL} SELECT idx, {_OK} AS valid FROM v")(
    lambda s, sf: B.spellings(s, sf).select("idx", U.url_is_valid(F.col("url")).alias("valid"))
)

_RULES = {
    "normalize_url_fragment": (U.UrlRules(remove_fragment=True), {"fragment": True}),
    "normalize_url_query": (U.UrlRules(remove_query=True), {"query": True}),
    "normalize_url_sort_query": (U.UrlRules(sort_query=True), {"sort": True}),
    "normalize_url_www": (U.UrlRules(remove_www=True), {"www": True}),
    "normalize_url_trailing": (U.UrlRules(remove_trailing=True), {"trailing": True}),
    "normalize_url_lowercase": (U.UrlRules(lowercase=True), {"lower": True}),
    "normalize_url": (
        U.CRAWL_RULES,
        {"fragment": True, "sort": True, "www": True, "trailing": True, "lower": True},
    ),
}
for _name, (_rules, _flags) in _RULES.items():
    query(
        _name,
        f"WITH {B.SPELLINGS_SQL}, {B.normalized_sql(**_flags)} SELECT idx, canonical FROM c",
    )(
        lambda s, sf, rules=_rules: B.spellings(s, sf).select(
            "idx", U.normalize_url(F.col("url"), rules).alias("canonical")
        )
    )

_CANON = (
    f"WITH {B.SPELLINGS_SQL}, "
    + B.normalized_sql(fragment=True, sort=True, www=True, trailing=True, lower=True)
)

query("canonical_url", f"{_CANON} SELECT idx, coalesce(canonical, url) AS canonical FROM c")(
    lambda s, sf: B.spellings(s, sf).select("idx", U.canonical_url(F.col("url")).alias("canonical"))
)

# --- duplicates ----------------------------------------------------------------------------------

query(
    "mark_duplicates",
    f"{_CANON} SELECT idx, canonical, canonical IS NULL OR row_number() OVER "
    "(PARTITION BY canonical ORDER BY idx) > 1 AS is_duplicate FROM c",
)(lambda s, sf: D.mark_duplicates(B.spellings(s, sf)).select("idx", "canonical", "is_duplicate"))

query(
    "dedup_urls",
    f"{_CANON} SELECT idx, url, canonical FROM c WHERE canonical IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY idx) = 1",
)(lambda s, sf: D.dedup_urls(B.spellings(s, sf)))

query(
    "canonical_map",
    f"{_CANON} SELECT url, canonical FROM c WHERE canonical IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY idx) = 1",
)(lambda s, sf: D.canonical_map(B.spellings(s, sf)))

query(
    "duplicate_count",
    f"{_CANON} SELECT count(*) - count(DISTINCT canonical) AS duplicate_count FROM c",
)(lambda s, sf: D.duplicate_count(B.spellings(s, sf)))

query("seen_url_count", f"{_CANON} SELECT count(DISTINCT canonical) AS seen_url_count FROM c")(
    lambda s, sf: D.seen_url_count(B.spellings(s, sf))
)

query(
    "duplicate_groups",
    f"{_CANON} SELECT canonical, count(*) AS members, min(idx) AS first_idx, "
    "arg_min(url, idx) AS first_url FROM c WHERE canonical IS NOT NULL GROUP BY canonical",
)(lambda s, sf: D.duplicate_groups(B.spellings(s, sf)))

query(
    "duplicate_members",
    f"{_CANON} SELECT canonical, count(*) OVER w AS members, idx, url, "
    "idx = min(idx) OVER w AS is_first FROM c WHERE canonical IS NOT NULL "
    "WINDOW w AS (PARTITION BY canonical)",
)(lambda s, sf: D.duplicate_members(B.spellings(s, sf)))


@query(
    "is_seen",
    f"{_CANON}, k AS (SELECT DISTINCT canonical FROM c WHERE idx % 10 = 0 AND starts_with(url, 'https')) "
    "SELECT idx, canonical IS NULL OR canonical IN (SELECT canonical FROM k) AS is_seen FROM c",
)
def _is_seen(s, sf):
    seen = B.urls(s, sf).filter(F.col("url").startswith("https"))
    return D.is_seen(B.spellings(s, sf), seen).select("idx", "is_seen")


# --- links ---------------------------------------------------------------------------------------

# One link of every kind per page; what becomes of each is written out in the SQL.
_LINK_KINDS = (
    ("'/docs/p' || CAST(page_id AS VARCHAR(20))", "NULL", "o || '/docs/p' || i"),
    ("'https://external.invalid/x'", "'other_host'", "'https://external.invalid/x'"),
    ("'/files/' || CAST(page_id AS VARCHAR(20)) || '.PDF'", "'file_extension'", "o || '/files/' || i || '.PDF'"),
    ("'#sec' || CAST(page_id AS VARCHAR(20))", "'same_page_fragment'", "b"),
    ("'/login?u=' || CAST(page_id AS VARCHAR(20))", "'blocked_path'", "o || '/login?u=' || i"),
    ("'mailto:a@example.com'", "'absolute_without_host'", "'mailto:a@example.com'"),
    ("'not-a-valid-url'", "'malformed_relative'", "d || 'not-a-valid-url'"),
    ("'../up/./' || CAST(page_id AS VARCHAR(20))", "NULL", "regexp_replace(d, '([^/])/[^/]+/$', '\\1/') || 'up/' || i"),
    ("'?q=' || CAST(page_id AS VARCHAR(20))", "NULL", "p || '?q=' || i"),
    ("'//cdn.invalid/a.png'", "'other_host'", "s || '//cdn.invalid/a.png'"),
    ("'/bad%zz'", "'unparsable'", "NULL"),
    ("'/é t?a=b c'", "NULL", "o || '/%C3%A9%20t?a=b c'"),
)
_LINKS_SQL = "WITH q AS (SELECT page_id AS idx, CAST(page_id AS VARCHAR) AS i, url, " \
    "regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o, regexp_extract(url, '^([a-z]+:)', 1) AS s, " \
    "regexp_extract(url, '^([^?#]*)', 1) AS p, regexp_extract(url, '^([^#]*)', 1) AS b, " \
    "regexp_extract(url, '^([^?#]*/)', 1) AS d FROM pages), k AS (" + " UNION ALL ".join(
        f"SELECT idx, {k} AS pos, {reason} AS reason, {target} AS resolved FROM q"
        for k, (_, reason, target) in enumerate(_LINK_KINDS)
    ) + ")"


def _links(s, sf):
    listed = F.array(*[F.expr(e) for e, _, _ in _LINK_KINDS])
    pages = spread(B.table(s, sf, "pages").select("page_id", "url"))
    return pages.select(
        F.col("page_id").alias("idx"), "url", F.posexplode(listed).alias("pos", "href")
    )


query(
    "should_follow_link",
    f"{_LINKS_SQL} SELECT idx, pos, reason, reason IS NULL AS follow FROM k",
)(
    lambda s, sf: L.should_follow_link(_links(s, sf)).select(
        "idx", "pos", "reason", "follow"
    )
)

query("resolve_link", f"{_LINKS_SQL} SELECT idx, pos, resolved FROM k")(
    lambda s, sf: L.resolve_link(_links(s, sf), fragment=False).select("idx", "pos", "resolved")
)

query(
    "link_follow_reasons",
    f"{_LINKS_SQL} SELECT coalesce(reason, 'followed') AS reason, count(*) AS links FROM k GROUP BY 1",
)(
    lambda s, sf: L.should_follow_link(_links(s, sf))
    .groupBy(F.coalesce("reason", F.lit("followed")).alias("reason"))
    .agg(F.count("*").alias("links"))
)

_GRAPH_SQL = (
    f"WITH l AS (SELECT page_id AS idx, url, unnest({_HREFS}) AS href, "
    f"unnest(range(len({_HREFS}))) AS pos FROM pages), "
    "g AS (SELECT idx, CAST(pos AS INTEGER) AS pos, href, "
    "regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(replace(replace(url_encode(href), "
    "'%2F', '/'), '%2C', ','), '%40', '@') AS resolved FROM l)"
)
query("link_graph", f"{_GRAPH_SQL} SELECT idx, pos, resolved, TRUE AS follow FROM g")(
    lambda s, sf: L.link_graph(B.pages(s, sf), "raw").select("idx", "pos", "resolved", "follow")
)


@query(
    "new_links_only",
    f"{_GRAPH_SQL}, c AS (SELECT idx, pos, lower(regexp_replace(resolved, '://www[.]', '://')) AS canonical FROM g), "
    "f AS (SELECT canonical, idx, pos FROM c QUALIFY row_number() OVER "
    "(PARTITION BY canonical ORDER BY idx, pos) = 1) "
    "SELECT canonical, idx, pos FROM f WHERE NOT regexp_matches(canonical, '/[a-m][^/]*$')",
)
def _new_links(s, sf):
    graph = L.link_graph(B.pages(s, sf), "raw")
    seen = graph.select(F.col("resolved").alias("url")).filter(
        U.normalize_url(F.col("url")).rlike(r"/[a-m][^/]*\z")
    )
    return D.new_links_only(graph, seen).select("canonical", "idx", "pos")


@query(
    "allowed_domain",
    "WITH h AS (SELECT page_id AS idx, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, url FROM pages) "
    "SELECT idx FROM h WHERE host IN (SELECT host FROM h WHERE ends_with(url, '.html'))",
)
def _allowed_domain(s, sf):
    nodes = B.urls(s, sf)
    return L.allowed_domain(nodes, nodes.filter(F.col("url").endswith(".html")).select("url")).select("idx")


def _robots_sql(flags: str) -> str:
    agent = f"regexp_matches(trim(line), '{flags}^user-agent:\\s*\\*$')"
    shut = f"regexp_matches(trim(line), '{flags}^disallow:\\s*/$')"
    return (
        f"WITH {B.ROBOTS_SQL}, f AS (SELECT host, line_no, {shut} AS shut, max(CASE WHEN {agent} "
        "THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS opened FROM r), "
        "x AS (SELECT DISTINCT host FROM f WHERE shut AND opened = 1) "
        f"SELECT page_id AS idx FROM pages WHERE {B._HOST} NOT IN (SELECT host FROM x)"
    )


query("robots_allowed", _robots_sql("(?i)"))(
    lambda s, sf: L.robots_allowed(B.urls(s, sf), B.robots(s, sf)).select("idx")
)
query("robots_allowed_literal", _robots_sql(""))(
    lambda s, sf: L.robots_allowed(B.urls(s, sf), B.robots(s, sf), literal=True).select("idx")
)

# --- crawls --------------------------------------------------------------------------------------

_DEPTH = 6


def _bfs_sql(key: str) -> str:
    """Pages with one address are one page, the first of them."""
    return (
        f"WITH RECURSIVE {B.EDGES_SQL}, "
        f"w AS (SELECT page_id, min(page_id) OVER (PARTITION BY {key}) AS first FROM pages), "
        "b AS (SELECT first AS idx, 1 AS depth FROM w WHERE page_id = 0 "
        "UNION SELECT w.first, b.depth + 1 FROM b JOIN e ON e.src = b.idx JOIN w ON w.page_id = e.dst "
        f"WHERE b.depth < {_DEPTH}), "
        "m AS (SELECT idx, min(depth) AS depth FROM b GROUP BY idx)"
    )


_BFS = _bfs_sql("split_part(url, '#', 1)")


def _seeds(s, sf):
    return B.urls(s, sf).filter("idx = 0").select("url")


def _visited(s, sf, rules=None, depth=_DEPTH):
    return C.crawl_bfs(B.urls(s, sf), B.edges(s, sf), _seeds(s, sf), depth, rules)


query("crawl_bfs", f"{_BFS} SELECT idx, depth FROM m")(
    lambda s, sf: _visited(s, sf).select("idx", "depth")
)


@query(
    "crawl_bfs_canonical",
    _bfs_sql(
        "rtrim(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '://www[.]', '://'), '/') "
        "|| '?' || split_part(split_part(url, '#', 1), '?', 2)"
    )
    + " SELECT idx, depth FROM m",
)
def _crawl_canonical(s, sf):
    """Links spelled differently from the pages they mean."""
    spelled = B.edges(s, sf).withColumn(
        "dst_url", F.concat(F.upper(F.regexp_replace("dst_url", "#.*", "")), F.lit("#x"))
    )
    return C.crawl_bfs(B.urls(s, sf), spelled, _seeds(s, sf), _DEPTH, U.CRAWL_RULES).select(
        "idx", "depth"
    )


query("depth_limit", f"{_BFS} SELECT idx, depth FROM m WHERE depth <= 3")(
    lambda s, sf: C.depth_limit(_visited(s, sf), 3).select("idx", "depth")
)
query("crawl_summary", f"{_BFS} SELECT depth, count(*) AS pages FROM m GROUP BY depth")(
    lambda s, sf: C.crawl_summary(_visited(s, sf))
)
query("page_count", f"WITH {B.EXTRACTED_SQL} SELECT count(*) AS page_count FROM x WHERE content <> ''")(
    lambda s, sf: C.page_count(E.extract_pages(B.pages(s, sf)))
)


@query(
    "build_corpus",
    f"WITH {B.EXTRACTED_SQL} SELECT idx, title, url, content, 1 AS depth FROM x WHERE content <> '' "
    "QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY idx) = 1",
)
def _build_corpus(s, sf):
    """Every page is a seed, as the links of these pages lead to none of them."""
    seeds = B.urls(s, sf).select("url")
    built = build_corpus(
        B.pages(s, sf), seeds, B.generated(), max_depth=3, dedup=False, link_scope="raw"
    )
    return built.select("idx", "title", "url", "content", "depth")
