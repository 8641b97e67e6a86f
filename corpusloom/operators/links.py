"""Link resolution, follow rules, robots rules and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.functions.text import trim_space
from corpusloom.operators.distributed import pinned, salted_lookup
from corpusloom.operators.extract import links_of, scan_pages

# Endings of resolved paths that are not pages.
SKIP_EXTENSIONS = (
    "pdf", "jpg", "jpeg", "png", "gif", "zip", "tar", "gz", "mp4", "avi", "mov",
)

# Path parts that are not content.
SKIP_PATHS = ("/login", "/register", "/api/", "/admin/", "/search")

# Why a link is not followed, in the order the rules are tried.
REASONS = (
    "unparsable",
    "malformed_relative",
    "absolute_without_host",
    "other_host",
    "file_extension",
    "same_page_fragment",
    "blocked_path",
)


def _resolve(base: Column, link: Column) -> Column:
    """Parts of ``link`` resolved against ``base``; both are parsed URLs."""
    own = (link["scheme"] != "") | (link["authority"] != "")
    bare = ~own & (link["path"] == "") & ~link["marked"]

    def merge(paths: Column) -> Column:
        ref, start = paths["ref"], paths["start"]
        return (
            F.when(paths["own"] | ref.startswith("/"), ref)
            .when(ref == "", start)
            .otherwise(F.concat(F.regexp_replace(start, r"[^/]*\z", ""), ref))
        )

    paths = F.struct(
        own.alias("own"),
        U.escaped_path(link["path"]).alias("ref"),
        U.escaped_path(base["path"]).alias("start"),
    )
    return F.struct(
        F.when(link["scheme"] != "", link["scheme"]).otherwise(base["scheme"]).alias("scheme"),
        F.when(own, link["authority"]).otherwise(base["authority"]).alias("authority"),
        U.let(U.let(paths, merge), U.remove_dot_segments).alias("path"),
        link["opaque"].alias("opaque"),
        F.when(bare, base["query"]).otherwise(link["query"]).alias("query"),
        F.when(bare, base["query"] != "").otherwise(link["marked"]).alias("marked"),
        F.when(bare & (link["fragment"] == ""), base["fragment"])
        .otherwise(link["fragment"])
        .alias("fragment"),
        (own & link["slashes"]).alias("slashes"),
        (base["valid"] & link["valid"]).alias("valid"),
    )


def _printed(parts: Column, fragment: bool) -> Column:
    """A resolved URL as text; NULL when base or link does not parse."""
    scheme = F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":"))).otherwise("")
    slashes = F.when(
        (parts["authority"] != "") | (parts["slashes"] & (parts["path"] != "")), F.lit("//")
    ).otherwise("")
    body = F.when(parts["opaque"] != "", parts["opaque"]).otherwise(
        F.concat(slashes, parts["authority"], parts["path"])
    )
    query = F.when(parts["marked"], F.concat(F.lit("?"), parts["query"])).otherwise("")
    printed = F.concat(scheme, body, query)
    if fragment:
        frag = parts["fragment"]
        printed = F.concat(
            printed,
            F.when(frag != "", F.concat(F.lit("#"), U.escaped_fragment(frag))).otherwise(""),
        )
    return F.when(parts["valid"], printed)


def resolve(base: Column, link: Column, fragment: bool = True) -> Column:
    """RFC 3986 reference resolution; NULL when base or link does not parse.

    ``fragment=False`` prints the address a crawler requests.
    """
    return U.let(
        F.struct(U.parse_url(base).alias("base"), U.parse_url(link).alias("link")),
        lambda x: U.let(_resolve(x["base"], x["link"]), lambda r: _printed(r, fragment)),
    )


def link_verdict(base: Column, link: Column) -> Column:
    """Struct ``resolved, reason, follow``; ``reason`` is the first failing rule or NULL.

    ``base`` is a parsed URL (:func:`corpusloom.functions.urls.parse_url`), ``link`` is text.
    """

    def judge(x: Column) -> Column:
        own, parsed, found = x["base"], x["link"], x["found"]
        no_scheme = parsed["scheme"] == ""
        malformed = no_scheme & (
            F.contains(link, F.lit("://"))
            | ((F.octet_length(link) > 10) & ~link.rlike(r"\A[/#?]|[./]"))
        )
        path = x["path"]
        checks = (
            ~parsed["valid"],
            malformed,
            ~no_scheme & (U.host_of(parsed["authority"]) == ""),
            U.host_of(found["authority"]) != U.host_of(own["authority"]),
            F.lower(path).rlike(rf"\.(?:{'|'.join(SKIP_EXTENSIONS)})\z"),
            (found["fragment"] != "") & (path == U.path_of(own, F.lit(""), "empty")),
            path.rlike("|".join(SKIP_PATHS)),
        )
        reason = F.when(checks[0], F.lit(REASONS[0]))
        for check, label in zip(checks[1:], REASONS[1:]):
            reason = reason.when(check, F.lit(label))
        return U.let(
            F.struct(_printed(found, False).alias("resolved"), reason.alias("reason")),
            lambda v: F.struct(
                v["resolved"].alias("resolved"),
                v["reason"].alias("reason"),
                v["reason"].isNull().alias("follow"),
            ),
        )

    def with_path(x: Column) -> Column:
        return U.let(
            F.struct(
                x["base"].alias("base"),
                x["link"].alias("link"),
                x["found"].alias("found"),
                U.percent_decode(x["found"]["path"]).alias("path"),
            ),
            judge,
        )

    def with_target(x: Column) -> Column:
        return U.let(
            F.struct(
                x["base"].alias("base"),
                x["link"].alias("link"),
                _resolve(x["base"], x["link"]).alias("found"),
            ),
            with_path,
        )

    return U.let(F.struct(base.alias("base"), U.parse_url(link).alias("link")), with_target)


def resolve_link(
    df: DataFrame,
    base: str = "url",
    link: str = "href",
    name: str = "resolved",
    fragment: bool = True,
) -> DataFrame:
    """Add the resolved link."""
    return df.withColumn(name, resolve(F.col(base), F.col(link), fragment))


def should_follow_link(df: DataFrame, base: str = "url", link: str = "href") -> DataFrame:
    """Add ``resolved``, ``reason`` and ``follow``.

    The verdict leaves through a generator, below which no filter on it can be pushed: it is worked
    out once per link even when followed links are filtered or joined afterwards.
    """
    return _judged(df.withColumn("_base", U.let(F.col(base), U.parse_url)), link)


def _judged(df: DataFrame, link: str) -> DataFrame:
    verdict = F.array(link_verdict(F.col("_base"), F.col(link)))
    return df.select(*[c for c in df.columns if c != "_base"], F.inline(verdict))


def link_graph(pages: DataFrame, scope: str = "content") -> DataFrame:
    """Edges ``idx, url, pos, href, resolved, reason, follow`` of the link graph."""
    return graph_of(scan_pages(pages, ("links",)), scope)


def graph_of(scanned: DataFrame, scope: str = "content") -> DataFrame:
    """The link graph of scanned pages; a page's own URL is parsed once, not once per link."""
    based = scanned.select("idx", "url", U.let(F.col("url"), U.parse_url).alias("_base"), "links")
    return _judged(links_of(based, scope).drop("in_boilerplate"), "href")


def allowed_domain(df: DataFrame, seeds: DataFrame, url: str = "url", seed: str = "url") -> DataFrame:
    """Rows whose host is the host of a seed. A host may hold any share of the rows."""
    hosts = seeds.select(U.host(F.col(seed)).alias("_host")).distinct()
    keyed = pinned(df, "_host", U.host(F.col(url)))
    return salted_lookup(keyed, hosts, ["_host"], F.col(url), "left_semi").drop("_host")


def disallowed_hosts(robots: DataFrame, literal: bool = False) -> DataFrame:
    """Hosts whose robots lines shut everyone out of everything.

    Input ``host, line_no, line``. A ``user-agent: *`` line switches the rule on for the rest of the
    file, so a host is closed exactly when its last ``disallow: /`` comes after its first such
    line: two combinable aggregates, no window. ``literal`` accepts lower-case spellings only.
    """
    flags = "" if literal else "(?i)"
    line = trim_space(F.col("line"))

    def value(field: str) -> Column:
        return trim_space(F.regexp_replace(line, rf"\A{flags}{field}:", ""))

    agent = line.rlike(r"(?i)\Auser-agent:")
    disallow = line.rlike(r"(?i)\Adisallow:")
    return (
        robots.groupBy("host")
        .agg(
            F.min(F.when(agent & (value("user-agent") == "*"), F.col("line_no"))).alias("_open"),
            F.max(F.when(disallow & (value("disallow") == "/"), F.col("line_no"))).alias("_shut"),
        )
        .filter(F.col("_shut") > F.col("_open"))
        .select("host")
    )


def robots_allowed(
    pages: DataFrame, robots: DataFrame, url: str = "url", literal: bool = False
) -> DataFrame:
    """Pages of hosts that are not closed; hosts without robots lines are open."""
    closed = disallowed_hosts(robots, literal).withColumnRenamed("host", "_host")
    keyed = pinned(pages, "_host", U.host(F.col(url)))
    return salted_lookup(keyed, closed, ["_host"], F.col(url), "left_anti").drop("_host")
