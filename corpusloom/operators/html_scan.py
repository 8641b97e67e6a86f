"""One pass over one page's markup: the only per-row Python in the library.

Spark has no HTML functions, so tag nesting is resolved here and nowhere else. The scan knows only
what the fixed selectors need: tag names, classes, ids, ``data-title`` and ``a[href]``. Cleaning,
scoring, link resolution and everything after it are column expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape
from html.entities import html5

# Elements removed before the content is read.
STRIP_SELECTORS = (
    "script", "style", "nav", "footer", "header",
    ".navigation", ".sidebar", ".menu", ".breadcrumb", ".toc", ".table-of-contents",
    ".related", ".tags", ".metadata", ".comments", ".social-share", ".advertisement", ".ads",
)

# Where the content is looked for, in order.
CONTENT_SELECTORS = (
    "main", ".main", "#main", ".content", "#content", ".main-content",
    "article", ".article", ".documentation", ".docs", ".doc-content",
    ".post-content", ".entry-content", ".page-content", ".body-content",
    ".markdown-body", ".wiki-content",
)

# Where the title is looked for, in order, before the data-title attribute.
TITLE_SELECTORS = ("title", "h1", ".page-title", ".main-title", ".doc-title")
NO_TITLE = "Untitled"

# How many combinations of tag, class and id a scanner remembers.
_KINDS = 4096
_NOTHING: tuple = ()

# Content shorter than this many bytes does not end the search.
ENOUGH_BYTES = 100

# The Unicode White_Space set.
_SPACE = "".join(
    map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000))
)

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript".split())
_ESCAPABLE = frozenset(("title", "textarea"))
_HEAD = frozenset(
    "html head title meta link style script base noscript template noframes".split()
)
# End tags of these leave the elements opened after them open.
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section "
    "summary table ul xmp".split()
)
# Start tag -> (open elements it ends, elements that stop the search for them).
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_P_SCOPE = frozenset(
    "html body table td th caption button object applet marquee template".split()
)
_CELL_SCOPE = frozenset("table td th caption".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(/?)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
)
_ATTRIBUTE = re.compile(
    r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?"
)
_ATTRIBUTE_ENTITY = re.compile(
    r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))"
)
_END_TAG = {
    tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in sorted(_RAW_TEXT | _ESCAPABLE)
}


@dataclass
class Scan:
    """What one page yields."""

    title: str
    content: str
    body: str
    links: list[tuple[str, bool]]


def _decode_attribute(value: str) -> str:
    if "&" not in value:
        return value

    def decode(match: re.Match) -> str:
        text = match.group()
        known = text[1] == "#" or text[1:] in html5
        return unescape(text) if known else text

    return _ATTRIBUTE_ENTITY.sub(decode, value)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


class _Selectors:
    """Tag, class and id selectors looked up by name."""

    def __init__(self, selectors):
        self.tags, self.classes, self.ids = {}, {}, {}
        for rank, selector in enumerate(selectors):
            table, name = (
                (self.classes, selector[1:])
                if selector[0] == "."
                else (self.ids, selector[1:]) if selector[0] == "#" else (self.tags, selector)
            )
            table.setdefault(name, []).append(rank)

    def match(self, tag: str, classes: list[str], ident: str) -> list[int]:
        ranks = list(self.tags.get(tag, ()))
        for name in classes:
            ranks += self.classes.get(name, ())
        return ranks + list(self.ids.get(ident, ())) if ident else ranks


def make_scanner(
    content_selectors=CONTENT_SELECTORS,
    strip_selectors=STRIP_SELECTORS,
    title_selectors=TITLE_SELECTORS,
):
    """A function from markup to :class:`Scan` for the given selector lists."""
    content_of = _Selectors(content_selectors)
    strip_of = _Selectors(strip_selectors)
    title_of = _Selectors(title_selectors)
    # Few combinations of tag, class and id make up most of any corpus.
    known: dict[tuple[str, str, str], tuple[bool, list[int], list[int]]] = {}

    def kinds(tag: str, class_text: str, ident: str) -> tuple[bool, list[int], list[int]]:
        key = (tag, class_text, ident)
        found = known.get(key)
        if found is None:
            classes = class_text.split()
            found = (
                bool(strip_of.match(tag, classes, ident)),
                title_of.match(tag, classes, ident),
                content_of.match(tag, classes, ident),
            )
            if len(known) >= _KINDS:
                known.clear()
            known[key] = found
        return found

    def scan(markup: str) -> Scan:
        markup = markup.replace("\r\n", "\n").replace("\r", "\n")
        raw: list[str] = []  # all text, in order
        kept: list[str] = []  # text outside stripped elements
        # open elements: (tag, strips, [content span], [title span]); None where one ended below others
        stack: list[tuple | None] = []
        depths: defaultdict[str, list[int]] = defaultdict(list)  # where the elements of each tag are
        stripped = 0
        content_spans: list[list[list[int]]] = [[] for _ in content_selectors]
        title_spans: list[list[int] | None] = [None for _ in title_selectors]
        data_title: str | None = None
        links: list[tuple[str, bool]] = []
        body_start: int | None = None

        def text(piece: str, decode: bool) -> None:
            nonlocal body_start
            if not piece:
                return
            if decode and "&" in piece:
                piece = unescape(piece)
            if body_start is None and decode and (not stack or stack[-1][0] not in _ESCAPABLE):
                if not piece.strip("\t\n\f\r "):
                    return
                body_start = len(kept)
            raw.append(piece)
            if not stripped:
                kept.append(piece)

        def finish(element: tuple | None) -> None:
            nonlocal stripped
            if element is None:
                return
            tag, strips, spans, heads = element
            depths[tag].pop()  # elements of one tag end in the order of their depth
            stripped -= strips
            for span in spans:
                span[1] = len(kept)
            for span in heads:
                span[1] = len(raw)

        def close(depth: int) -> None:
            while len(stack) > depth or stack and stack[-1] is None:
                finish(stack.pop())

        def innermost(tags) -> int:
            return max([places[-1] for tag in tags if (places := depths.get(tag))], default=-1)

        def find(tags, stops) -> int | None:
            """Depth of the innermost of ``tags`` unless one of ``stops`` is further in."""
            depth = innermost(tags)
            return depth if depth >= 0 and depth >= innermost(stops) else None

        def open_tag(tag: str, attribute_text: str, empty: bool) -> None:
            nonlocal stripped, data_title, body_start
            if body_start is None and (tag == "body" or tag not in _HEAD):
                body_start = len(kept)
            if tag in _CLOSES_P and (depth := find(("p",), _P_SCOPE)) is not None:
                close(depth)
            if tag in _ENDS and (depth := find(*_ENDS[tag])) is not None:
                close(depth)
            if attribute_text:
                attributes = _attributes(attribute_text)
                strips, titles, contents = kinds(
                    tag, attributes.get("class", ""), attributes.get("id", "")
                )
                if data_title is None and "data-title" in attributes:
                    data_title = _decode_attribute(attributes["data-title"])
                if tag == "a" and "href" in attributes:
                    links.append(
                        (_decode_attribute(attributes["href"]), bool(stripped or strips))
                    )
            else:
                strips, titles, contents = kinds(tag, "", "")
            spans, heads = _NOTHING, _NOTHING
            if titles:
                heads = [[len(raw), -1] for rank in titles if title_spans[rank] is None]
                fresh = [rank for rank in titles if title_spans[rank] is None]
                for rank, span in zip(fresh, heads):
                    title_spans[rank] = span
            if contents and not stripped and not strips:
                spans = [[len(kept), -1] for _ in contents]
                for rank, span in zip(contents, spans):
                    content_spans[rank].append(span)
            if empty and not spans and not heads:
                return
            stripped += strips
            depths[tag].append(len(stack))
            stack.append((tag, strips, spans, heads))
            if empty:
                close(len(stack) - 1)

        def close_tag(tag: str) -> None:
            if tag in ("html", "body", "head"):
                return
            stops = () if tag in _CELL_SCOPE or tag in ("tr", "tbody") else _CELL_SCOPE
            depth = find((tag,), stops)
            if depth is None:
                return
            if tag not in _FORMATTING or depth == len(stack) - 1:
                close(depth)
                return
            # A misnested formatting element ends alone; the depths of those above it stay as they are.
            finish(stack[depth])
            stack[depth] = None

        at, size = 0, len(markup)
        while at < size:
            match = _TOKEN.search(markup, at)
            if match is None:
                text(markup[at:], True)
                break
            text(markup[at : match.start()], True)
            at = match.end()
            slash, tag, attribute_text, _ = match.groups()
            if tag is None:
                continue
            if at == size and not match.group().endswith(">"):
                break  # a tag cut off by the end of the page is dropped
            tag = tag.lower()
            if slash:
                close_tag(tag)
                continue
            open_tag(tag, attribute_text, tag in _VOID)
            if tag in _END_TAG:
                end = _END_TAG[tag].search(markup, at)
                stop = end.start() if end else size
                text(markup[at:stop], tag in _ESCAPABLE)
                at = stop
        close(0)

        content = ""
        for spans in content_spans:
            if spans:
                content = "".join("".join(kept[start:stop]) for start, stop in spans)
                if len(content.strip(_SPACE).encode()) > ENOUGH_BYTES:
                    break
        body = "" if body_start is None else "".join(kept[body_start:])

        title = NO_TITLE
        for span in title_spans:
            if span is not None and (found := "".join(raw[span[0] : span[1]])):
                title = found.strip(_SPACE)
                break
        else:
            if data_title:
                title = data_title.strip(_SPACE)
        return Scan(title, content or body, body, links)

    return scan
