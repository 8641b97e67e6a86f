"""URL parsing, normalisation and reference resolution as column expressions.

Plain string functions split a URL. The parts are bound once per row with :func:`let`, so nothing
is parsed twice. Strings that are not URLs give NULL from :func:`normalize_url` and false from
:func:`url_is_valid`.

Deviation: percent escapes of bytes that are not UTF-8 are decoded to U+FFFD when a path has to
be re-encoded (trailing slash removed, or the path holds characters that need escaping).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
# What nearly every URL looks like; anything else is examined part by part.
_ORDINARY = (
    r"\A(?:https?://[A-Za-z0-9.\-]+(?::[0-9]*)?)?(?:/[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/]*)?"
    r"(?:\?[\x21\x22\x24-\x7E]*)?(?:#[\x21-\x24\x26-\x7E]*)?\z"
)
# Characters each component keeps unescaped when it is printed again (besides A-Za-z0-9-_.~).
_KEEP_PATH = "$&+,/:;=@"
_KEEP_FRAGMENT = "$&+,/:;=?@!()*"
_KEEP_HOST = "!$&'()*+,;=:[]<>\""
_KEEP_USER = "$&+,;="

# A path that prints as itself, with or without its last slash.
_PLAIN_PATH = r"\A[A-Za-z0-9\-_.~$&+,/:;=@]*\z"
_ENCODED_PATH = r"\A[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]%/]*\z"
_ENCODED_FRAGMENT = r"\A[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]%/?]*\z"


# An absolute URL whose parts all print as themselves; the host has more than www. in it.
_SIMPLE = r"\Ahttps?://(?:[Ww]{3}\.)?+[A-Za-z0-9.\-]+(?::[0-9]*)?(?:/[A-Za-z0-9\-_.~$&+,/:;=@]*)?"
_SIMPLE_FRAGMENT = r"(?:#[\x21-\x24\x26-\x7E]*)?"


@dataclass(frozen=True)
class UrlRules:
    """Which normalisation steps to apply."""

    remove_fragment: bool = False
    remove_query: bool = False
    sort_query: bool = False
    remove_www: bool = False
    remove_trailing: bool = False
    lowercase: bool = False


#: What a crawl uses unless told otherwise.
CRAWL_RULES = UrlRules(
    remove_fragment=True,
    sort_query=True,
    remove_www=True,
    remove_trailing=True,
    lowercase=True,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    Keeps expression trees linear in size where a plain expression would repeat its input, and
    keeps the optimizer from copying that input when it moves filters around.
    """
    return F.transform(F.array(value), body)[0]


def _after(text: Column, head: Column, skip: int) -> Column:
    """What follows ``head`` and ``skip`` more characters."""
    return F.substring(text, F.length(head) + (skip + 1), F.lit(2147483647))


def _cut(url: Column, use: Callable[[Column], Column]) -> Column:
    """Split a URL with plain string functions, one step at a time, and hand ``use`` the pieces."""

    def fragmentless(x: Column) -> Column:
        bare = F.substring_index(x["front"], "?", 1)
        return let(
            F.struct(
                x["front"].alias("front"),
                bare.alias("bare"),
                F.regexp_extract(bare, _SCHEME, 1).alias("scheme"),
            ),
            schemeless,
        )

    def schemeless(x: Column) -> Column:
        named = x["scheme"] != ""
        rest = F.when(named, _after(x["bare"], x["scheme"], 1)).otherwise(x["bare"])
        return let(
            F.struct(
                x["front"].alias("front"),
                x["bare"].alias("bare"),
                x["scheme"].alias("scheme"),
                rest.alias("rest"),
            ),
            rooted,
        )

    def rooted(x: Column) -> Column:
        rest, named = x["rest"], x["scheme"] != ""
        slashes = rest.startswith("//") & (named | ~rest.startswith("///"))
        auth = F.when(slashes, F.substring_index(F.substring(rest, 3, 2147483647), "/", 1))
        return let(
            F.struct(
                x["scheme"].alias("scheme"),
                rest.alias("rest"),
                slashes.alias("slashes"),
                F.coalesce(auth, F.lit("")).alias("authority"),
                F.contains(x["front"], F.lit("?")).alias("marked"),
                F.when(
                    F.contains(x["front"], F.lit("?")), _after(x["front"], x["bare"], 1)
                ).otherwise("").alias("query"),
                F.when(F.contains(url, F.lit("#")), _after(url, x["front"], 1))
                .otherwise("")
                .alias("fragment"),
            ),
            use,
        )

    return let(F.struct(F.substring_index(url, "#", 1).alias("front")), fragmentless)


def parse_url(url: Column) -> Column:
    """Struct of undecoded parts, parser flags and validity; NULL parts for NULL."""

    def parts(x: Column) -> Column:
        opaque = (x["scheme"] != "") & (x["rest"] != "") & ~x["rest"].startswith("/")
        path = F.when(x["slashes"], _after(x["rest"], x["authority"], 2)).otherwise(x["rest"])
        return F.struct(
            F.lower(x["scheme"]).alias("scheme"),
            x["authority"].alias("authority"),
            F.when(opaque, F.lit("")).otherwise(path).alias("path"),
            F.when(opaque, x["rest"]).otherwise(F.lit("")).alias("opaque"),
            x["query"].alias("query"),
            x["fragment"].alias("fragment"),
            # A question mark, possibly with nothing after it, before any fragment.
            x["marked"].alias("marked"),
            # A lone trailing question mark, which survives printing.
            (x["marked"] & (x["query"] == "")).alias("force_query"),
            (x["slashes"] & (x["scheme"] != "")).alias("slashes"),
            F.when(url.rlike(_ORDINARY), F.lit(True))
            .otherwise(~_is_broken(url, x, opaque))
            .alias("valid"),
        )

    return _cut(url, parts)


def host_of(authority: Column) -> Column:
    """Host with port, user info dropped, case kept, escapes decoded."""
    return percent_decode(
        F.when(
            F.contains(authority, F.lit("@")), F.regexp_replace(authority, r"\A.*@", "")
        ).otherwise(authority)
    )


def host(url: Column) -> Column:
    """Host of a URL; empty when there is none."""
    return let(url, lambda u: _cut(u, lambda x: host_of(x["authority"])))


def percent_decode(text: Column) -> Column:
    """Percent decoding that leaves ``+`` alone; NULL on a broken escape."""
    return F.when(
        F.contains(text, F.lit("%")),
        F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))),
    ).otherwise(text)


def _encode(text: Column, keep: str) -> Column:
    """Percent encoding that keeps unreserved characters and ``keep``."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("%7E"), F.lit("~"))
    if "*" not in keep:
        encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    for char in keep:
        if char != "*":
            encoded = F.replace(encoded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return encoded


def _is_broken(url: Column, x: Column, opaque: Column) -> Column:
    auth = x["authority"]
    user = F.regexp_extract(auth, r"\A(.*)@", 1)
    hostport = F.regexp_replace(auth, r"\A.*@", "")
    bad_user = ~user.rlike(r"\A[A-Za-z0-9\-._:~!$&'()*+,;=%@]*\z") | user.rlike(_BAD_ESCAPE)
    bad_host = (
        hostport.rlike(r"[ \\^`{|}]|%(?![89A-Fa-f][0-9A-Fa-f]|25)")
        | F.when(
            hostport.startswith("["), ~hostport.rlike(r"\A\[.*\](?::[0-9]*)?\z")
        ).otherwise(hostport.rlike(r":(?![0-9]*\z)[^:]*\z"))
    )
    return (
        url.rlike(r"\A[^#]*[\x00-\x1F\x7F]")
        | ((x["scheme"] == "") & url.rlike(r"\A[^/?#]*:"))
        | (~opaque & x["rest"].rlike(_BAD_ESCAPE) & ~auth.rlike(_BAD_ESCAPE))
        | x["fragment"].rlike(_BAD_ESCAPE)
        | bad_user
        | bad_host
    )


def url_is_valid(url: Column) -> Column:
    """True for strings a URL parser accepts; NULL for NULL."""
    return let(url, lambda u: let(parse_url(u), lambda p: p["valid"]))


def path_of(parts: Column, raw: Column, on_error: str) -> Column:
    fallback = raw if on_error == "raw" else F.when(raw.isNotNull(), F.lit(""))
    return F.when(parts["valid"], percent_decode(parts["path"])).otherwise(fallback)


def url_path(url: Column, on_error: str = "raw") -> Column:
    """Decoded path. Invalid URLs give themselves (``raw``) or an empty string (``empty``)."""
    if on_error not in ("raw", "empty"):
        raise ValueError(f"on_error must be 'raw' or 'empty', not {on_error!r}")
    return let(url, lambda u: let(parse_url(u), lambda p: path_of(p, u, on_error)))


def escaped_path(path: Column) -> Column:
    """A raw path as a URL printer writes it."""
    return F.when(path.rlike(_ENCODED_PATH), path).otherwise(_encode(percent_decode(path), _KEEP_PATH))


def _trimmed_path(path: Column) -> Column:
    """Drop exactly one trailing slash, but never the root's."""

    def reprint(decoded: Column) -> Column:
        return F.when(
            (decoded != "/") & decoded.endswith("/"),
            _encode(F.regexp_replace(decoded, r"/\z", ""), _KEEP_PATH),
        ).otherwise(escaped_path(path))

    return (
        F.when(path == "/", path)
        .when(
            path.rlike(_PLAIN_PATH),
            F.when(path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path),
        )
        .otherwise(let(percent_decode(path), reprint))
    )


def escaped_fragment(frag: Column) -> Column:
    return F.when(frag.rlike(_ENCODED_FRAGMENT), frag).otherwise(
        _encode(percent_decode(frag), _KEEP_FRAGMENT)
    )


def sorted_query(text: Column) -> Column:
    """Parameters by key, values of one key in their order; broken pairs are left out."""
    pairs = F.filter(F.split(text, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    decoded = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.try_url_decode(F.regexp_extract(p, r"\A([^=]*)", 1)).alias("key"),
            i.alias("pos"),
            F.try_url_decode(F.regexp_extract(p, r"\A[^=]*=([\s\S]*)\z", 1)).alias("value"),
        ),
    )
    usable = F.filter(decoded, lambda p: p["key"].isNotNull() & p["value"].isNotNull())

    def encode(value: Column) -> Column:
        return F.replace(
            F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
        )

    printed = F.transform(
        F.array_sort(usable), lambda p: F.concat(encode(p["key"]), F.lit("="), encode(p["value"]))
    )
    return F.when(text == "", F.lit("")).otherwise(F.array_join(printed, "&"))


def _printed_authority(auth: Column, remove_www: bool) -> Column:
    def name_of(text: Column) -> Column:
        odd = (F.octet_length(text) != F.length(text)) | F.contains(text, F.lit("%"))
        printed = F.when(odd, _encode(text, _KEEP_HOST)).otherwise(text)
        if not remove_www:
            return printed
        return F.when(
            F.lower(F.left(text, F.lit(4))) == "www.", F.substring(printed, 5, 2147483647)
        ).otherwise(printed)

    user = F.regexp_extract(auth, r"\A(.*)@", 1)
    first = _encode(percent_decode(F.regexp_extract(user, r"\A([^:]*)", 1)), _KEEP_USER)
    rest = _encode(percent_decode(F.regexp_extract(user, r"\A[^:]*:(.*)\z", 1)), _KEEP_USER)
    printed_user = F.concat(
        first, F.when(F.contains(user, F.lit(":")), F.concat(F.lit(":"), rest)).otherwise("")
    )
    return F.when(
        F.contains(auth, F.lit("@")),
        F.concat(printed_user, F.lit("@"), name_of(host_of(auth))),
    ).otherwise(name_of(percent_decode(auth)))


def _printed_url(parts: Column, rules: UrlRules) -> Column:
    path = _trimmed_path(parts["path"]) if rules.remove_trailing else escaped_path(parts["path"])
    auth = _printed_authority(parts["authority"], rules.remove_www)

    def body_of(pieces: Column) -> Column:
        slashes = F.when(
            (pieces["auth"] != "") | (parts["slashes"] & (pieces["path"] != "")), F.lit("//")
        ).otherwise("")
        return F.concat(slashes, pieces["auth"], pieces["path"])

    body = F.when(parts["opaque"] != "", parts["opaque"]).otherwise(
        let(F.struct(auth.alias("auth"), path.alias("path")), body_of)
    )
    prefix = F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":"))).otherwise("")
    printed = F.concat(prefix, body)
    mark = F.when(parts["force_query"], F.lit("?")).otherwise("")
    if rules.remove_query:
        printed = F.concat(printed, mark)
    elif rules.sort_query:
        tail = let(
            sorted_query(parts["query"]),
            lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(mark),
        )
        printed = F.concat(
            printed, F.when(parts["query"] == "", mark).otherwise(tail)
        )
    else:
        printed = F.concat(
            printed,
            F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise(mark),
        )
    if not rules.remove_fragment:
        frag = parts["fragment"]
        printed = F.concat(
            printed,
            F.when(frag != "", F.concat(F.lit("#"), escaped_fragment(frag))).otherwise(""),
        )
    return F.lower(printed) if rules.lowercase else printed


def normalize_url(url: Column, rules: UrlRules = CRAWL_RULES) -> Column:
    """Canonical spelling under ``rules``; NULL when the URL does not parse.

    Most URLs have nothing to decode or encode and no query; they skip the parser.
    """
    simple = _SIMPLE + (_SIMPLE_FRAGMENT if rules.remove_fragment else "") + r"\z"

    def printed(u: Column) -> Column:
        parsed = let(parse_url(u), lambda p: F.when(p["valid"], _printed_url(p, rules)))
        return F.when(u.rlike(simple), _printed_simple(u, rules)).otherwise(parsed)

    return let(url, printed)


def _printed_simple(url: Column, rules: UrlRules) -> Column:
    text = F.substring_index(url, "#", 1)
    if rules.remove_www:
        text = F.regexp_replace(text, r"\A(https?://)[Ww]{3}\.", "$1")
    if rules.remove_trailing:
        text = F.regexp_replace(text, r"\A(https?://[^/]++/.*)/\z", "$1")
    return F.lower(text) if rules.lowercase else text


def canonical_url(url: Column, rules: UrlRules = CRAWL_RULES) -> Column:
    """Normalised URL, or the input itself when it does not parse."""
    return F.coalesce(normalize_url(url, rules), url)


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``; the result is empty or starts with a slash."""
    start = F.struct(F.lit("/").alias("text"), F.lit(True).alias("first"))

    def step(acc: Column, segment: Column) -> Column:
        text, first = acc["text"], acc["first"]
        body = F.substring(text, 2, 2147483647)
        at_root = ~F.contains(body, F.lit("/"))
        popped = F.struct(
            F.when(at_root, F.lit("/"))
            .otherwise(F.concat(F.lit("/"), F.regexp_replace(body, r"/[^/]*\z", "")))
            .alias("text"),
            (first | at_root).alias("first"),
        )
        kept = F.struct(text.alias("text"), F.lit(False).alias("first"))
        added = F.struct(
            F.concat(text, F.when(first, F.lit("")).otherwise("/"), segment).alias("text"),
            F.lit(False).alias("first"),
        )
        return F.when(segment == ".", kept).when(segment == "..", popped).otherwise(added)

    walked = F.aggregate(F.split(path, "/"), start, step, lambda acc: acc["text"])
    walked = F.concat(walked, F.when(path.rlike(r"(?:\A|/)\.\.?\z"), F.lit("/")).otherwise(""))
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return (
        F.when(path == "", path)
        .when(path.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), F.regexp_replace(walked, r"\A//", "/"))
        .otherwise(rooted)
    )
