"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each node has the characters and tags below it and how many of them are links; its
composite density is the characters per tag, adjusted by the logarithm of how little of it is links relative to the
page. Density sums add the densities of a node's children (text of its own counts as a child). The node with the largest sum is
the core. The smallest density on its way up to the body is the threshold: on that way, branches beside it that reach
the threshold belong to the text as well, and so does text that stands directly in a node of the way, with the inline
elements in it.

Elements that are never text (scripts, styles, forms, menus, headers, footers, asides, hidden ones, and those whose role
says so) take no part. Neither do those whose class or id names an advert, a notice, a side bar or reader comments, as a whole or as a
known compound, unless they are headings, hold an article or main element, or, on a page without these, hold most of the
unlinked text.

Nulls: a null or empty page gives an empty text. Pages cut off in the middle of a tag lose that tag. Repeated rows give
a row each; an empty table gives an empty result; other columns are ignored. A head without its end tag ends where
something stands that cannot be in a head. No step is deeper than a loop,
so nesting depth is not limited.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from math import e, log

from pyspark.sql import DataFrame

from corpusloom.llm.tasks import map_batches

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe template noframes select".split())
#: Raw text that is shown as it is written.
VERBATIM = frozenset(("xmp", "plaintext"))
DROPPED = frozenset("nav header footer aside form button dialog menu head audio video datalist fieldset label".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var ruby rb rt rp wbr br img "
    "object canvas svg g text tspan textpath math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mfenced semantics".split()
)
#: What can stand in a head; anything else ends one that is open.
IN_HEAD = frozenset("title base basefont bgsound link meta script style noscript noframes template head html".split())
CONTAINERS = frozenset(("article", "main"))
#: Element -> (open elements that its start ends, elements beyond which it does not look).
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr"}, {"table"}),
}
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side-bar aside widget widgets menu navbar "
    "nav navigation breadcrumb breadcrumbs topbar toolbar masthead footer header comment comments disqus respond reply replies "
    "commentlist share sharing social related recommended pagination pager skip-link search searchbox".split()
)
#: First parts of compound names and what follows them where the whole is no text.
_COMPOUNDS = (
    ("site main primary secondary top bottom global left right mobile", "nav navigation navbar menu footer sidebar masthead"),
    ("site main global top mobile", "header banner"),
    ("ad ads advert advertisement sponsor sponsored promo banner", "container wrapper box slot unit banner block area link links top bottom left right sidebar label space placeholder widget"),
    ("cookie cookies consent gdpr", "notice banner bar consent popup overlay message warning law info modal wall"),
    ("newsletter subscribe subscription signup login", "form box signup popup modal banner widget block wrapper section container link overlay"),
    ("user reader readers visitor guest post page article blog site facebook fb disqus", "comments replies responses thread"),
    ("comment comments respond reply replies", "list area form section wrapper container box body content meta reply thread respond widget"),
    ("share sharing social", "buttons button bar links icons share sharing box list menu widget nav follow"),
    ("related recommended", "posts articles stories content links items news list widget"),
    ("search", "form box bar field input widget toggle overlay"),
    ("nav navigation navbar menu breadcrumb breadcrumbs footer sidebar widget widgets pagination pager toolbar masthead topbar", "bar menu list links link wrapper container area widget widgets inner item items left right top bottom nav content main primary secondary"),
    ("header", "bar menu nav links top wrapper container inner widget"),
    ("modal popup overlay", "dialog content overlay window wrapper container backdrop box"),
)
COMPOUNDS = frozenset(f"{a}-{b}" for firsts, seconds in _COMPOUNDS for a in firsts.split() for b in seconds.split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split()
)

_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))", re.S
)
_MARK = re.compile(r"""\b(class|id|role|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_JOINT = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/>]|$)", re.I)
_NUMBER = re.compile(r"(?:-?[0-9]+(?:x[0-9]+)?)+$")


def _dropped(name: str, attributes: str) -> bool:
    """Whether the element's own name, role or state says that it is never text."""
    if name in DROPPED:
        return True
    if "hidden" in attributes.lower() and _HIDDEN.search(_QUOTED.sub("", attributes)):
        return True
    if "=" not in attributes:
        return False
    for m in _MARK.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value.strip() in ROLES or key == "aria-hidden" and value == "true":
            return True
    return False


def _suspect(name: str, attributes: str) -> bool:
    """Whether a class or id, as a whole or as a known compound, names an advert, a menu or the like."""
    if "=" not in attributes or name in HEADINGS:
        return False
    for m in _MARK.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for token in (m[2] or m[3] or m[4] or "").split():
                token = _NUMBER.sub("", _JOINT.sub("-", token).strip("-").lower())
                if token in NOISE or name not in CONTAINERS and token in COMPOUNDS:
                    return True
    return False


class Page:
    """Elements in page order as parallel lists, node 0 being the body, and the text pieces between their tags.

    A piece is (node, text), or (node, None) for the border of a block. Elements that take no part are left out.
    """

    def __init__(self, html: str):
        self.parent, self.name, self.pieces = [-1], ["body"], []
        #: Open elements: (node, name, takes no part), and by name their depths.
        self.stack = [(0, "body", False)]
        self.open: dict[str, list[int]] = {}
        self.left_out = 0
        #: Elements whose class or id names them as no text.
        self.suspects: list[int] = []
        self._read(html)
        if self.suspects:
            self._leave_out()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            tag = _TAG.search(html, at)
            stop = tag.start() if tag else size
            if self.open.get("head") and html[at:stop].strip():
                self._close("head")
            if stop > at and not self.left_out:
                self.pieces.append((self.stack[-1][0], unescape(html[at:stop])))
            if not tag:
                return
            at, name = tag.end(), (tag[2] or "").lower()
            if name and not tag[1] and name not in IN_HEAD and self.open.get("head"):
                self._close("head")
            if not name or name in ("html", "body"):
                continue
            if tag[1]:
                self._close(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
            elif name in VERBATIM:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                if not self.left_out:
                    node = self.stack[-1][0]
                    self.pieces += [(node, None), (node, html[at : end.start() if end else size]), (node, None)]
                at = end.end() if end else size
            elif name in VOID:
                if not self.left_out:
                    self.pieces.append((self.stack[-1][0], None if name == "hr" else " " if name == "br" else ""))
            else:
                self._start(name, tag[3])

    def _inline(self, name: str) -> bool:
        """Whether the element flows with the text around it, as all parts of a formula or drawing do."""
        return name in INLINE or bool(self.open.get("svg") or self.open.get("math"))

    def _border(self, name: str) -> None:
        if not self.left_out and not self._inline(name):
            self.pieces.append((self.stack[-1][0], None))

    def _pop(self) -> str:
        _, name, silent = self.stack.pop()
        self.open[name].pop()
        self.left_out -= silent
        self._border(name)
        return name

    def _close(self, name: str) -> None:
        if self.open.get(name):
            while self._pop() != name:
                pass
        elif name == "p":
            self._border(name)

    def _start(self, name: str, attributes: str) -> None:
        if self.open.get("p") and not self._inline(name):
            self._close("p")
        ends, bounds = ENDS.get(name, ((), ()))
        if held := [places for x in ends if (places := self.open.get(x))]:
            bound = max([places[-1] for x in bounds if (places := self.open.get(x))], default=0)
            # The outermost one above the innermost border, found by bisection.
            above = [places[k] for places in held if (k := bisect_right(places, bound)) < len(places)]
            while above and len(self.stack) > min(above):
                self._pop()
        self._border(name)
        silent = _dropped(name, attributes)
        self.left_out += silent
        if self.left_out:
            node = self.stack[-1][0]
        else:
            node = len(self.name)
            self.name.append(name)
            self.parent.append(self.stack[-1][0])
            if _suspect(name, attributes):
                self.suspects.append(node)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((node, name, silent))

    def _leave_out(self) -> None:
        """Take out the suspects that hold no article or main element and, where the page has none, little text.

        Little is at most half of the page's unlinked text.
        """
        size = len(self.name)
        in_link, suspect = [False] * size, set(self.suspects)
        for node in range(1, size):
            in_link[node] = self.name[node] == "a" or in_link[self.parent[node]]
        plain, holds = [0] * size, [False] * size
        for node, text in self.pieces:
            if text and not in_link[node]:
                plain[node] += len(" ".join(text.split()))
        for node in range(size - 1, 0, -1):
            up = self.parent[node]
            plain[up] += plain[node]
            holds[up] |= holds[node] or self.name[node] in CONTAINERS and node not in suspect
        gone, place = [False] * size, [0] * size
        parent, name = [-1], ["body"]
        for node in range(1, size):
            up = self.parent[node]
            little = holds[0] or plain[node] * 2 <= plain[0]
            gone[node] = gone[up] or node in suspect and not holds[node] and little
            if not gone[node]:
                place[node] = len(name)
                name.append(self.name[node])
                parent.append(place[up])
        self.pieces = [(place[node], text) for node, text in self.pieces if not gone[node]]
        self.parent, self.name = parent, name

    def core(self) -> tuple[set[int], set[int]]:
        """The tops of the subtrees that make up the main text, and the nodes of which only the own text belongs to it."""
        size = len(self.name)
        chars, tags, link_chars, link_tags, own = ([0] * size for _ in range(5))
        for node, text in self.pieces:
            if text:
                own[node] += len(" ".join(text.split()))
        in_link = [False] * size
        for node in range(1, size):
            in_link[node] = self.name[node] == "a" or in_link[self.parent[node]]
        for node in range(size - 1, -1, -1):
            chars[node] += own[node]
            link_chars[node] += own[node] if in_link[node] else 0
            if node:
                up = self.parent[node]
                chars[up] += chars[node]
                link_chars[up] += link_chars[node]
                tags[up] += tags[node] + 1
                link_tags[up] += link_tags[node] + (self.name[node] == "a")
        share = link_chars[0] / max(chars[0], 1)
        density = [_composite(*x, share) for x in zip(chars, tags, link_chars, link_tags)]
        own_density = [_composite(x, 0, 0, 0, share) for x in own]
        total = own_density[:]
        for node in range(1, size):
            total[self.parent[node]] += density[node]
        best = max(range(size), key=lambda n: (total[n], -n))
        way = [best]
        while way[-1]:
            way.append(self.parent[way[-1]])
        threshold = min([density[n] for n in way])
        on_way = set(way)
        beside = {n for n in range(1, size) if self.parent[n] in on_way and n not in on_way and density[n] >= threshold}
        return beside | {best}, {n for n in way[1:] if own[n] and own_density[n] >= threshold}

    def _with_own(self, nodes: set[int]) -> set[int]:
        """Places of the pieces of the nodes' own text, with the inline elements in the same blocks of it."""
        holder = list(range(len(self.name)))
        for node in range(1, len(holder)):
            if self.name[node] in INLINE:
                holder[node] = holder[self.parent[node]]
        places, block, found = set(), [], False
        for at, (node, text) in enumerate([*self.pieces, (0, None)]):
            if text is None:
                places.update(block if found else ())
                block, found = [], False
            elif node in nodes or holder[node] in nodes:
                block.append(at)
                found = found or node in nodes and bool(text.strip())
        return places

    def text(self) -> str:
        """The blocks of the main text, one per line."""
        chosen, partly = self.core()
        inside = [False] * len(self.name)
        for node in range(len(self.name)):
            inside[node] = node in chosen or node > 0 and inside[self.parent[node]]
        blocks, block = [], []
        with_own = self._with_own(partly) if partly else ()
        for at, (node, text) in enumerate(self.pieces):
            if text is None or not (inside[node] or at in with_own):
                blocks.append("".join(block))
                block = []
            elif text:
                block.append(text)
        blocks.append("".join(block))
        return "\n".join([x for b in blocks if (x := " ".join(b.split()))])


def _composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, scaled by how little of the node is links; ``share`` is the page's share of link text."""
    if not chars:
        return 0.0
    links, anchors, tags = max(link_chars, 1), max(link_tags, 1), max(tags, 1)
    other = max(chars - link_chars, 1)
    base = log(chars / other * link_chars + share * chars + e)
    return chars / tags * log(chars / links * (tags / anchors) + 1) / max(log(base + e - 1), 1e-9)


def extract(html: str) -> str:
    return Page(html).text() if html else ""


def _extracted(batch) -> dict:
    found = [extract(h or "") for h in batch.column("html").to_pylist()]
    own = {c: batch.column(c) for c in ("page_id", "url")}
    return own | {"text": found, "n_chars": [len(t) for t in found]}


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a map without shuffle."""
    return map_batches(pages.select("page_id", "url", "html"), _extracted, "page_id long, url string, text string, n_chars long")
