"""Quality functions, filters, reports and the fetch-log profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import bindings as B
from corpusloom.functions import quality as Q
from corpusloom.functions.text import count_words, rfc3339
from corpusloom.operators import profile as P
from corpusloom.operators import quality as O
from corpusloom.operators.extract import extract_pages
from corpusloom.plans.corpus import scrape_with_quality

QUERIES: dict = {}
SQL: dict[str, str] = {}

_DIGITS = 9


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- the metrics in SQL --------------------------------------------------------------------------

_S = B.SPACE_CLASS
_FENCE = r"```[\s\S]*?```"
_WORDS = f"len(regexp_extract_all(content, '[^{_S}]+'))"
_CODE = (
    f"(len(regexp_extract_all(content, '{_FENCE}')) + len(regexp_extract_all("
    f"regexp_replace(content, '{_FENCE}', '', 'g'), '`[^`]+`')) // 3)"
)
_HEADERS = r"len(regexp_extract_all(content, '(?m)^#{1,6}\s+.+'))"
_LINES = "len(string_split(content, chr(10)))"
_EMPTY = (
    f"len(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '[^{_S}]')))"
)
_BOILER = " + ".join(
    f"{len(p)} * len(regexp_extract_all(content, '(?i){p}'))" for p in Q.BOILERPLATE
)
_RATIO = (
    f"CASE WHEN strlen(content) = 0 THEN 0.0::DOUBLE ELSE greatest(strlen(content) - ({_BOILER}), 0)"
    "::DOUBLE / strlen(content)::DOUBLE END"
)
_TITLED = "title NOT IN ('', 'Untitled')"


def _thirds(name: str) -> str:
    return (
        f"CASE WHEN {name} >= 3 THEN 1.0::DOUBLE WHEN {name} > 0 THEN {name}::DOUBLE / 3.0::DOUBLE "
        "ELSE 0.0::DOUBLE END"
    )


_SCORE = (
    "CASE WHEN words >= 500 THEN 1.0::DOUBLE WHEN words >= 100 THEN words::DOUBLE / 500.0::DOUBLE "
    f"ELSE 0.0::DOUBLE END * 0.3::DOUBLE + {_thirds('code')} * 0.2::DOUBLE + "
    f"{_thirds('headers')} * 0.15::DOUBLE + least(ratio, 1.0::DOUBLE) * 0.15::DOUBLE + "
    "CASE WHEN titled THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.1::DOUBLE"
)
_ENGLISH = (
    f"len(list_filter(regexp_extract_all(lower(content), '[^{_S}]+'), lambda x: x IN ("
    + ", ".join(f"'{w}'" for w in Q.ENGLISH_WORDS)
    + ")))"
)
_HINTS = " + ".join(
    [f"contains(lower(content), '{h}')::INTEGER" for h in Q.NAVIGATION_HINTS]
    + [f"contains(lower(title), '{h}')::INTEGER * 2" for h in Q.NAVIGATION_HINTS]
)
_MDLINKS = r"len(regexp_extract_all(content, '\[([^\]]+)\]\([^)]+\)'))"
_NAV = (
    f"({_HINTS} + CASE WHEN words > 0 AND {_MDLINKS}::DOUBLE / words > 0.3 THEN 1 ELSE 0 END) >= 2"
)
_FOUND = "list_filter(['404', 'not found', 'error'], lambda p: contains(lower(content), p))"
_BLANK = f"NOT regexp_matches(content, '[^{_S}]')"
_ISSUES = f"""list_filter([
  CASE WHEN words < 50 THEN {{'type': 'word_count', 'severity': 'warning',
    'description': 'Content has fewer words than recommended minimum'}} END,
  CASE WHEN NOT titled THEN {{'type': 'missing_title', 'severity': 'error',
    'description': 'Page is missing a title'}} END,
  CASE WHEN {_BLANK} THEN {{'type': 'empty_content', 'severity': 'error',
    'description': 'Page has no content'}} END,
  CASE WHEN len(found) > 0 THEN {{'type': 'blacklisted_content', 'severity': 'warning',
    'description': 'Content contains blacklisted pattern' || CASE WHEN len(found) > 1 THEN 's: '
      ELSE ': ' END || array_to_string(found, ', ')}} END], lambda x: x IS NOT NULL)"""
_TAGS = """array_to_string(list_filter([
  CASE WHEN code > 0 THEN 'technical' END,
  CASE WHEN words > 1000 THEN 'long-form' WHEN words < 200 THEN 'short-form' END,
  CASE WHEN headers > 0 THEN 'structured' END,
  CASE WHEN words >= 500 AND code >= 2 THEN 'comprehensive' END,
  CASE WHEN ratio < 0.3 THEN 'low-content' END], lambda x: x IS NOT NULL), ',')"""


def metrics_sql(source: str = "docs") -> str:
    """CTEs ending in ``s``: one row per text with everything derived from it."""
    return (
        f"m AS (SELECT idx, url, title, content, {_WORDS} AS words, {_CODE} AS code, "
        f"{_HEADERS} AS headers, {_LINES} AS lines, {_EMPTY} AS empty, {_RATIO} AS ratio, "
        f"{_TITLED} AS titled, {_FOUND} AS found FROM {source}), "
        f"s AS (SELECT *, {_SCORE} AS score, CASE WHEN {_ENGLISH} > words // 20 THEN 'en' "
        f"ELSE 'unknown' END AS language, {_NAV} AS nav, {_ISSUES} AS issues, {_TAGS} AS tags FROM m)"
    )


_M = f"WITH {B.DOCS_SQL}, {metrics_sql()}"


def scored(s, sf):
    return O.analyze_content(B.docs(s, sf))


def _r(column, name: str):
    return F.round(column, _DIGITS).alias(name)


# --- scalars -------------------------------------------------------------------------------------


def scalar(name: str, sql: str, column) -> None:
    query(name, f"{_M} SELECT idx, {sql} AS {name} FROM s")(
        lambda s, sf: B.docs(s, sf).select("idx", column().alias(name))
    )


_text, _title = (lambda: F.col("content")), (lambda: F.col("title"))
scalar("word_count", "words", lambda: count_words(_text()))
scalar("code_block_count", "code", lambda: Q.code_block_count(_text()))
scalar("header_count", "headers", lambda: Q.header_count(_text()))
scalar("has_headers", "headers > 0", lambda: Q.header_count(_text()) > 0)
scalar("has_title", "titled", lambda: Q.has_title(_title()))
scalar(
    "content_ratio",
    f"round(ratio, {_DIGITS})",
    lambda: F.round(Q.content_ratio(_text()), _DIGITS),
)
scalar("detect_language", "language", lambda: Q.detect_language(_text()))
scalar("is_navigation_page", "nav", lambda: Q.is_navigation_page(_title(), _text()))

query(
    "line_metrics",
    f"{_M} SELECT idx, lines AS total_lines, empty AS empty_lines, "
    f"round(empty::DOUBLE / lines, {_DIGITS}) AS empty_line_ratio FROM s",
)(
    lambda s, sf: B.docs(s, sf).select(
        "idx",
        Q.total_lines(_text()).alias("total_lines"),
        Q.empty_lines(_text()).alias("empty_lines"),
        _r(Q.empty_line_ratio(_text()), "empty_line_ratio"),
    )
)

query(
    "extract_metrics",
    f"{_M} SELECT idx, words AS word_count, code AS code_block_count, 0 AS image_count, "
    "0 AS link_count, headers AS header_count, lines AS total_lines, empty AS empty_lines, "
    f"round(ratio, {_DIGITS}) AS content_ratio, titled AS has_title, "
    f"round(empty::DOUBLE / lines, {_DIGITS}) AS empty_line_ratio, headers > 0 AS has_headers FROM s",
)(
    lambda s, sf: O.extract_metrics(B.docs(s, sf))
    .drop("url", "title", "content")
    .withColumns(
        {c: F.round(c, _DIGITS) for c in ("content_ratio", "empty_line_ratio")}
    )
)

query("quality_score", f"{_M} SELECT idx, round(score, {_DIGITS}) AS score FROM s")(
    lambda s, sf: scored(s, sf).select("idx", _r(F.col("quality.score"), "score"))
)

query(
    "quality_score_weights",
    f"{_M} SELECT idx, round({_SCORE.replace('0.3::DOUBLE + ', '0.5::DOUBLE + ', 1).replace('0.1::DOUBLE', '0.05::DOUBLE')}, "
    f"{_DIGITS}) AS score FROM s",
)(
    lambda s, sf: O.analyze_content(
        B.docs(s, sf), weights=Q.QualityWeights(words=0.5, title=0.05)
    ).select("idx", _r(F.col("quality.score"), "score"))
)

query(
    "detect_issues",
    f"{_M}, i AS (SELECT idx, unnest(issues) AS issue, unnest(range(len(issues))) AS pos FROM s) "
    "SELECT idx, CAST(pos AS INTEGER) AS pos, issue.type AS type, issue.severity AS severity, "
    "issue.description AS description FROM i",
)(
    lambda s, sf: B.docs(s, sf)
    .select("idx", F.posexplode(Q.detect_issues(_title(), _text())).alias("pos", "issue"))
    .select("idx", "pos", "issue.*")
)

query("generate_tags", f"{_M} SELECT idx, tags FROM s")(
    lambda s, sf: scored(s, sf).select("idx", F.array_join("quality.tags", ",").alias("tags"))
)

query(
    "analyze_content",
    f"{_M} SELECT idx, url, title, round(score, {_DIGITS}) AS score, words AS word_count, "
    "code AS code_block_count, 0 AS image_count, 0 AS link_count, "
    f"round(empty::DOUBLE / lines, {_DIGITS}) AS empty_line_ratio, round(ratio, {_DIGITS}) AS content_ratio, "
    "titled AS has_title, headers > 0 AS has_headers, nav AS is_navigation_page, language, "
    "array_to_string(list_transform(issues, lambda i: i.type || '/' || i.severity), ',') AS issues, tags FROM s",
)(
    lambda s, sf: scored(s, sf)
    .select("idx", "url", "title", "quality.*")
    .withColumns(
        {
            **{c: F.round(c, _DIGITS) for c in ("score", "content_ratio", "empty_line_ratio")},
            "issues": F.array_join(
                F.transform("issues", lambda i: F.concat(i["type"], F.lit("/"), i["severity"])), ","
            ),
            "tags": F.array_join("tags", ","),
        }
    )
)

query(
    "extract_code_blocks",
    f"WITH {B.DOCS_SQL}, b AS (SELECT idx, "
    r"unnest(regexp_extract_all(content, '```(\w*)\n([\s\S]*?)```', 1)) AS lang, "
    r"unnest(regexp_extract_all(content, '```(\w*)\n([\s\S]*?)```', 2)) AS code, "
    r"unnest(range(len(regexp_extract_all(content, '```(\w*)\n([\s\S]*?)```')))) AS pos FROM docs) "
    "SELECT idx, CAST(pos AS INTEGER) AS pos, CASE WHEN lang = '' THEN 'text' ELSE lang END AS language, "
    "code AS content, len(string_split(code, chr(10))) AS line_count FROM b",
)(lambda s, sf: O.extract_code_blocks(B.docs(s, sf)))

query(
    "code_language_counts",
    f"WITH {B.DOCS_SQL}, b AS (SELECT "
    r"unnest(regexp_extract_all(content, '```(\w*)\n([\s\S]*?)```', 1)) AS lang, "
    r"unnest(regexp_extract_all(content, '```(\w*)\n([\s\S]*?)```', 2)) AS code FROM docs) "
    "SELECT CASE WHEN lang = '' THEN 'text' ELSE lang END AS language, count(*) AS blocks, "
    "CAST(sum(len(string_split(code, chr(10)))) AS BIGINT) AS lines FROM b GROUP BY 1",
)(lambda s, sf: O.code_language_counts(B.docs(s, sf)))

query(
    "page_metadata",
    f"{_M} SELECT idx, words AS word_count, TIMESTAMP '2024-06-01 12:00:00' AS last_modified, "
    "'text/html' AS content_type FROM s",
)(
    lambda s, sf: O.page_metadata(B.docs(s, sf), B.generated()).select(
        "idx",
        "metadata.word_count",
        F.col("metadata.last_modified").cast("timestamp_ntz").alias("last_modified"),
        "metadata.content_type",
    )
)

# --- filters -------------------------------------------------------------------------------------

_KEEP = "score >= 0.5 AND words >= 50 AND len(found) = 0"
_SKIP = (
    "(score < 0.3 OR nav OR len(list_filter(issues, lambda i: i.severity = 'error')) > 0)"
)

query("quality_filter", f"{_M} SELECT idx FROM s WHERE {_KEEP}")(
    lambda s, sf: O.quality_filter(scored(s, sf)).select("idx")
)
query("should_skip", f"{_M} SELECT idx, {_SKIP} AS skip FROM s")(
    lambda s, sf: scored(s, sf).select(
        "idx",
        Q.should_skip(
            F.col("quality.score"), F.col("quality.is_navigation_page"), F.col("quality.issues")
        ).alias("skip"),
    )
)
query("skip_filter", f"{_M} SELECT idx FROM s WHERE NOT {_SKIP}")(
    lambda s, sf: O.skip_filter(scored(s, sf)).select("idx")
)
query("language_filter", f"{_M} SELECT idx FROM s WHERE language = 'en'")(
    lambda s, sf: O.language_filter(scored(s, sf), "en").select("idx")
)

_X = f"WITH {B.EXTRACTED_SQL}, {metrics_sql('x')}"
_PAGE_RULES = Q.QualityRules(min_score=0.3, min_word_count=50)
query(
    "scrape_with_quality",
    f"{_X} SELECT idx, url, title, content, round(score, {_DIGITS}) AS score, words AS word_count "
    "FROM s WHERE content <> '' AND score >= 0.3 AND words >= 50 AND len(found) = 0",
)(
    lambda s, sf: scrape_with_quality(B.pages(s, sf), B.generated(), _PAGE_RULES).select(
        "idx", "url", "title", "content", _r(F.col("quality.score"), "score"), "metadata.word_count"
    )
)

# --- reports -------------------------------------------------------------------------------------

_STATS = (
    "count(*) AS total_pages, count(*) FILTER (score >= 0.4) AS passed_pages, "
    "count(*) FILTER (score < 0.4) AS failed_pages, round(avg(score), 6) AS average_score, "
    "CAST(sum(words) // count(*) AS BIGINT) AS average_word_count"
)


query("quality_stats", f"{_M} SELECT {_STATS} FROM s")(
    lambda s, sf: O.quality_stats(scored(s, sf)).withColumn(
        "average_score", F.round("average_score", 6)
    )
)


def _ranked(rows):
    return rows.select("idx", "url", "title", _r(F.col("quality.score"), "score"))


for _name, _direction, _fn in (
    ("top_pages", "DESC", O.top_pages),
    ("worst_pages", "ASC", O.worst_pages),
):
    query(
        _name,
        f"{_M} SELECT idx, url, title, round(score, {_DIGITS}) AS score FROM s "
        f"ORDER BY s.score {_direction}, idx LIMIT 10",
    )(lambda s, sf, fn=_fn: _ranked(fn(scored(s, sf), 10)))
    query(
        f"{_name}_site",
        f"{_X} SELECT idx, url, title, round(score, {_DIGITS}) AS score FROM s "
        f"ORDER BY s.score {_direction}, idx LIMIT 10",
    )(lambda s, sf, fn=_fn: _ranked(fn(O.analyze_content(extract_pages(B.pages(s, sf))), 10)))


query(
    "common_issues",
    f"{_M}, i AS (SELECT unnest(issues).type AS issue_type FROM s) "
    "SELECT issue_type, count(*) AS count FROM i GROUP BY 1",
)(lambda s, sf: O.common_issues(scored(s, sf)))

query(
    "tag_counts",
    f"{_M}, i AS (SELECT unnest(string_split(tags, ',')) AS tag FROM s WHERE tags <> '') "
    "SELECT tag, count(*) AS count FROM i GROUP BY 1",
)(lambda s, sf: O.tag_counts(scored(s, sf)))

query("language_counts", f"{_M} SELECT language, count(*) AS count FROM s GROUP BY 1")(
    lambda s, sf: O.language_counts(scored(s, sf))
)


@query(
    "quality_report",
    f"{_M}, st AS (SELECT {_STATS} FROM s), "
    "tp AS (SELECT string_agg(url, ' ' ORDER BY score DESC, idx) AS top_pages FROM "
    "(SELECT * FROM s ORDER BY score DESC, idx LIMIT 10)), "
    "wp AS (SELECT string_agg(url, ' ' ORDER BY score, idx) AS worst_pages FROM "
    "(SELECT * FROM s ORDER BY score, idx LIMIT 10)), "
    "ic AS (SELECT unnest(issues).type AS t FROM s), "
    "ig AS (SELECT t, count(*) AS n FROM ic GROUP BY t), "
    "ii AS (SELECT string_agg(t || '=' || n, ' ' ORDER BY n DESC, t) AS common_issues FROM ig) "
    f"SELECT st.*, top_pages, worst_pages, common_issues, '{B.GENERATED_TEXT}' AS generated_at "
    "FROM st, tp, wp, ii",
)
def _quality_report(s, sf):
    def urls(name):
        return F.array_join(F.transform(name, lambda p: p["url"]), " ").alias(name)

    return O.quality_report(scored(s, sf), B.generated()).select(
        "stats.total_pages",
        "stats.passed_pages",
        "stats.failed_pages",
        F.round("stats.average_score", 6).alias("average_score"),
        "stats.average_word_count",
        urls("top_pages"),
        urls("worst_pages"),
        F.array_join(
            F.transform(
                "common_issues",
                lambda i: F.concat(i["issue_type"], F.lit("="), i["count"].cast("string")),
            ),
            " ",
        ).alias("common_issues"),
        rfc3339(F.col("generated_at")).alias("generated_at"),
    )


# --- fetch log -----------------------------------------------------------------------------------

_PROFILE = (
    "count(*) AS pages_scraped, CAST(sum(bytes) AS BIGINT) AS total_bytes, "
    "count(*) FILTER (had_error) AS errors, "
    "(epoch_us(max(ts)) - epoch_us(min(ts))) * 1000 AS total_duration_ns, "
    "CAST(sum(duration_ns) // count(*) AS BIGINT) AS average_ns"
)
query("crawl_profile", f"WITH {B.LOG_SQL} SELECT {_PROFILE} FROM log")(
    lambda s, sf: P.crawl_profile(B.fetch_log(s, sf))
)
query(
    "crawl_profile_by_hour",
    f"WITH {B.LOG_SQL} SELECT hour(ts) AS hour, {_PROFILE} FROM log GROUP BY 1",
)(
    lambda s, sf: P.crawl_profile(
        B.fetch_log(s, sf).withColumn("hour", F.hour("ts")), ("hour",)
    )
)


def _seconds_sql(ns: str) -> str:
    return (
        f"CAST(({ns}) // 1000000000 AS VARCHAR) || rtrim(rtrim('.' || lpad(CAST(({ns}) % 1000000000 "
        "AS VARCHAR), 9, '0'), '0'), '.') || 's'"
    )


def _duration_sql(ns: str) -> str:
    return (
        f"CASE WHEN {ns} = 0 THEN '0s' WHEN {ns} < 1000 THEN CAST({ns} AS VARCHAR) || 'ns' "
        f"WHEN {ns} < 1000000 THEN CAST({ns} // 1000 AS VARCHAR) || rtrim(rtrim('.' || lpad(CAST({ns} % 1000 "
        "AS VARCHAR), 3, '0'), '0'), '.') || 'µs' "
        f"WHEN {ns} < 1000000000 THEN CAST({ns} // 1000000 AS VARCHAR) || rtrim(rtrim('.' || lpad(CAST({ns} % 1000000 "
        "AS VARCHAR), 6, '0'), '0'), '.') || 'ms' "
        f"WHEN {ns} < 60000000000 THEN {_seconds_sql(ns)} "
        f"WHEN {ns} < 3600000000000 THEN CAST({ns} // 60000000000 AS VARCHAR) || 'm' || {_seconds_sql(f'{ns} % 60000000000')} "
        f"ELSE CAST({ns} // 3600000000000 AS VARCHAR) || 'h' || CAST(({ns} // 60000000000) % 60 AS VARCHAR) || 'm' || "
        f"{_seconds_sql(f'{ns} % 60000000000')} END"
    )


query(
    "crawl_profile_lines",
    f"WITH {B.LOG_SQL}, t AS (SELECT {_PROFILE} FROM log), "
    "l AS (SELECT 0 AS part, 0 AS sort_key, 'Performance Report' || chr(10) || '==================' "
    f"|| chr(10) || chr(10) || 'Total Duration: ' || {_duration_sql('total_duration_ns')} || chr(10) || "
    f"'Pages Scraped: ' || pages_scraped || chr(10) || 'Average Time per Page: ' || {_duration_sql('average_ns')} "
    "|| chr(10) || 'Total Data Downloaded: ' || total_bytes || ' bytes (' || "
    "printf('%.2f', total_bytes / 1048576.0::DOUBLE) || ' MB)' || chr(10) || 'Errors Encountered: ' || errors "
    "|| chr(10) || chr(10) || 'Page Timing Details:' AS text FROM t "
    "UNION ALL SELECT 1, row_number() OVER (ORDER BY idx) - 1, 'Page ' || row_number() OVER (ORDER BY idx) "
    f"|| ': ' || {_duration_sql('duration_ns')} FROM log) SELECT part, sort_key, text FROM l",
)(lambda s, sf: P.crawl_profile_lines(B.fetch_log(s, sf)).select("part", "sort_key", "text"))
