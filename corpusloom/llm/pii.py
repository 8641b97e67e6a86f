"""Offset-preserving detection of plain and disguised personal data.

Detectors run on the text as it is, which gives the base spans. Then transducers rewrite disguises: homoglyphs and
full-width forms become the ASCII characters they look like, invisible characters go, runs of spelled digits (fewer than
three where they adjoin a plus sign, digits or a dotted number) become digits, spelled plus signs, at signs and dots become the characters. Each rewriting
is a list of (source start, source end, new text) edits, so a normalised position maps back to the source characters
it came from. The same detectors run on the whole normalised text; what they find there that touches an edit and no base
span of its kind holds whole is added, beside the base span where that is a fragment of it.

All patterns take linear time. Nulls: a null text is empty and has no spans. Repeated rows give a row each; an empty
table gives an empty result; other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, texts

KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")

# Characters that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "е": "e", "Е": "E", "і": "i", "І": "I", "ј": "j", "К": "K", "М": "M", "Н": "H",
    "о": "o", "О": "O", "р": "p", "Р": "P", "с": "c", "С": "C", "ѕ": "s", "Т": "T", "у": "y", "х": "x", "Х": "X",
    "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ԛ": "q", "ѵ": "v", "ԝ": "w", "α": "a", "ο": "o", "Ο": "O", "ν": "v",
    "ı": "i", "։": ".", "․": ".", "。": ".", "．": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "＠": "@", "﹫": "@", "＋": "+", "﹢": "+", " ": " ", " ": " ", " ": " ", "　": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
# Full-width forms and the digits of some scripts follow from code points.
LOOKALIKES |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
for _zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    LOOKALIKES |= {chr(_zero + k): str(k) for k in range(10)}
# Bold, script, circled and like letters, as far as Unicode says which letter each stands for.
LOOKALIKES |= {
    chr(c): plain
    for c in (*range(0x1D400, 0x1D6A4), *range(0x24B6, 0x24EA))
    if (plain := unicodedata.normalize("NFKC", chr(c))).isascii()
}
# Spelled digits and signs.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4",
    "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "zwo": "2", "fünf": "5", "fu\u0308nf": "5", "fuenf": "5", "un": "1", "zéro": "0", "ze\u0301ro": "0",
}
_STANDS_FOR = str.maketrans({k: v for k, v in LOOKALIKES.items()})
#: The mathematical letters and digits as one range: a class of single characters beyond the first plane is searched one by one.
_ODD = re.compile("[" + "".join([re.escape(c) for c in LOOKALIKES if c <= "\uffff"]) + INVISIBLE + "\U0001d400-\U0001d7ff]")
_GONE = re.compile(f"[{INVISIBLE}]+")
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_ONE = f"(?:{_WORD}|[0-9])"
_ANY_WORD = re.compile(rf"(?i)(?<!\w){_WORD}(?!\w)")
#: Three or more single digits in a row, at least one of them in letters; checked when it is rewritten.
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:{_ONE}[ ,\-]{{1,2}}){{2,}}{_ONE}(?!\w)")
_SPELLED_ONE = re.compile(rf"(?i){_ONE}")
#: Digit words in a row, however few; rewritten where they adjoin a plus sign or digits.
_WORDS = re.compile(rf"(?i)(?<![\w@]){_WORD}(?!\w)(?:[ ,\-]{{1,2}}{_WORD}(?!\w))*+(?!@)")
_GAP = re.compile(r"[ \-]{0,2}|\.|[ \-]?[()][ \-]?")
#: An article with a further word behind it: right behind a number that is no digit.
_ARTICLE = re.compile(r"(?i)(?:one|un|uno|oh) +[^\W0-9_]")
_PLUS_BEFORE = re.compile(r"(?i)(?:\+|(?<!\w)plus)[ \-]{0,2}\(?\Z")
_DIGIT_BEFORE = re.compile(rf"[0-9](?:{_GAP.pattern})\Z")
_DIGIT_BEHIND = re.compile(rf"(?:{_GAP.pattern})[0-9]")
_OCTET = rf"(?:[0-9]{{1,3}}|{_ONE}(?:[ ,\-]{{1,2}}{_ONE}){{0,2}})"
_OCTETS = re.compile(rf"(?i)(?<![\w.@]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w@])")
_PLUS = re.compile(r"(?i)(?<!\w)plus[ \-]{1,2}(?=[0-9(])")
# At signs and dots in words.
_OTHER_ATS, _DOTS = ("arroba", "arobase", "\u00e4t", "a\u0308t"), ("dot", "punto", "point", "punkt")
_OTHER_AT, _DOT = [f"(?:{'|'.join(words)})" for words in (_OTHER_ATS, _DOTS)]
_AT = f"(?:at|{_OTHER_AT})"
_BREAK = r"(?: ++|\n)"
_OPEN, _CLOSE = r"[ ]{0,2}[\[({<][ ]?", r"[ ]?[\])}>][ ]{0,2}"
_BRACKETED_AT = re.compile(rf"(?i)(?<=[a-z0-9_%+.\-]){_OPEN}(?:{_AT}|@){_CLOSE}(?=[a-z0-9])")
_BRACKETED_DOT = re.compile(rf"(?i)(?<=[a-z0-9\-]){_OPEN}(?:{_DOT}|\.){_CLOSE}(?=[a-z0-9])")
_BARE_DOT = re.compile(rf"(?i)(?<=[a-z0-9\-]){_BREAK}dot{_BREAK}(?=[a-z0-9])")
#: A host behind an at sign that was disguised: its dots may be spelled in any of the languages or stand apart.
_HOST_DOT = rf"{_BREAK}{_DOT}{_BREAK}|{_OPEN}(?:{_DOT}|\.){_CLOSE}| \. (?=(?-i:[a-z]{{2}}))"
_HOST = re.compile(rf"[A-Za-z0-9\-]++(?:(?:(?i:{_HOST_DOT})|\.)[A-Za-z0-9\-]++)++")
_HOST_DOTS = re.compile(rf"(?i){_HOST_DOT}")
#: A bare "at" counts only before a name that goes on, maybe after plain labels, with a dot it had to spell or bracket.
_SPELLED_DOT = rf"(?:{_BREAK}{_DOT}{_BREAK}|{_OPEN}(?:{_DOT}|\.){_CLOSE})[a-z0-9]"
_BARE_AT = re.compile(rf"(?i)(?<=[a-z0-9_%+\-]){_BREAK}at{_BREAK}(?=[a-z0-9\-]++(?:\.[a-z0-9\-]++)*+{_SPELLED_DOT})")
#: The words of the other languages for it are no common words, so a plain dot will do.
_BARE_OTHER_AT = re.compile(rf"(?i)(?<=[a-z0-9_%+\-]){_BREAK}{_OTHER_AT}{_BREAK}(?=[a-z0-9\-]++(?:\.[a-z0-9]|{_SPELLED_DOT}))")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def detect(text: str) -> list[Span]:
    """The base spans, ordered by kind and start."""
    spans = _emails(text)
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(map(len, _DIGITS.findall(m[0]))) <= PHONE_DIGITS[1]:
            spans.append(("phone", m.start(), m.end()))
    return spans


class Rewritten:
    """A text after edits, with the way back: ``source(p)`` gives the source span of position ``p``."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.source_starts, self.source_ends, self.sizes = [0], [0], [len(text)], [len(text)]
        self.edited: list[tuple[int, int]] = []

    def source(self, at: int) -> tuple[int, int]:
        """Source start and end of the normalised character at ``at``."""
        k = bisect_right(self.starts, at) - 1
        first, last, size = self.source_starts[k], self.source_ends[k], self.sizes[k]
        if last - first == size:
            return first + at - self.starts[k], first + at - self.starts[k] + 1
        return first, last

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """The text with ordered, disjoint edits made on top of the earlier ones."""
        if not edits:
            return self
        out, parts, place = Rewritten(""), [], 0
        out.starts, out.source_starts, out.source_ends, out.sizes = [], [], [], []

        def add(piece: str, first: int, last: int) -> None:
            nonlocal place
            if piece:
                out.starts.append(place)
                out.source_starts.append(first)
                out.source_ends.append(last)
                out.sizes.append(len(piece))
                parts.append(piece)
                place += len(piece)

        def keep(start: int, end: int) -> None:
            k = bisect_right(self.starts, start) - 1
            while start < end:
                stop = min(end, self.starts[k] + self.sizes[k])
                whole = self.source_ends[k] - self.source_starts[k] == self.sizes[k]
                shift = self.source_starts[k] - self.starts[k]
                first, last = (start + shift, stop + shift) if whole else (self.source_starts[k], self.source_ends[k])
                add(self.text[start:stop], first, last)
                start, k = stop, k + 1

        at = 0
        for start, end, new in edits:
            keep(at, start)
            out.edited.append((place, place + len(new)))
            if end > start:
                add(new, self.source(start)[0], self.source(end - 1)[1])
            at = end
        keep(at, len(self.text))
        out.text = "".join(parts)
        moved = [(out.position(self.source(max(0, a))[0]), b - a) for a, b in self.edited if a < len(self.text)]
        out.edited += [(a, a + n) for a, n in moved]
        return out

    def position(self, source: int) -> int:
        """The first normalised position that comes from ``source`` or later."""
        k = bisect_right(self.source_starts, source) - 1
        if k < 0:
            return 0
        inside = min(source - self.source_starts[k], self.sizes[k])
        return self.starts[k] + max(0, inside)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED_RUN.finditer(text):
        ones = [SPELLED.get(x.lower(), x) for x in _SPELLED_ONE.findall(m[0])]
        if any(c.isalpha() for c in m[0]):
            edits.append((m.start(), m.end(), "".join(ones)))
    return edits


def _octets(text: str) -> list[tuple[int, int, str]]:
    """Four dotted numbers of one to three digits, of which some are in letters."""
    edits = []
    for m in _OCTETS.finditer(text):
        if any(c.isalpha() for c in m[0]):
            parts = [_SPELLED_ONE.findall(p) for p in m[0].split(".")]
            edits.append((m.start(), m.end(), ".".join("".join([SPELLED.get(x.lower(), x) for x in p]) for p in parts)))
    return edits


def _adjoining(text: str) -> list[tuple[int, int, str]]:
    """Digit words next to a plus sign, to digits or to other such words.

    A word right behind a number is its last digit, unless it can be an article and the sentence goes on.
    """
    runs = [m.span() for m in _WORDS.finditer(text)]
    near = [
        bool(
            _DIGIT_BEFORE.search(text, max(0, a - 4), a) and not _ARTICLE.match(text, a) or _PLUS_BEFORE.search(text[max(0, a - 8) : a])
            or _DIGIT_BEHIND.match(text, b)
        )
        for a, b in runs
    ]
    joined = [_GAP.fullmatch(text, a[1], b[0]) is not None for a, b in zip(runs, runs[1:])]
    for k in range(1, len(runs)):
        near[k] |= near[k - 1] and joined[k - 1]
    for k in range(len(runs) - 2, -1, -1):
        near[k] |= near[k + 1] and joined[k]
    edits = []
    for (a, b), is_near in zip(runs, near):
        # Not the end of a mail address.
        if is_near and "@" not in text[max(0, a - 64) : a].rpartition(" ")[2]:
            edits.append((a, b, "".join([SPELLED[x.lower()] for x in re.findall(r"[^ ,\-]+", text[a:b]) if x.lower() in SPELLED])))
    return edits


def _host_dots(now: Rewritten) -> list[tuple[int, int, str]]:
    """The dots of hosts behind at signs that were edited in."""
    edits = []
    for place in sorted({a for a, _ in now.edited if now.text[a : a + 1] == "@"}):
        if host := _HOST.match(now.text, place + 1):
            edits += [(m.start(), m.end(), ".") for m in _HOST_DOTS.finditer(now.text, host.start(), host.end())]
    return edits


def normalise(text: str) -> list[Rewritten]:
    """The rewritten texts, none where nothing is disguised.

    The first has spelled digits rewritten in runs of three or more, the second, if it differs, fewer as well where they
    adjoin a number: what the shorter ones break up is still found in the first.
    """
    odd = not text.isascii() and _ODD.search(text)
    signs = "[" in text or "(" in text or "{" in text or "<" in text
    low = text.lower()
    if not (odd or signs or any([x in low for x in ("dot", "plus", *_OTHER_ATS)]) or _ANY_WORD.search(text)):
        return []
    now = Rewritten(text)
    if odd:
        marks = [(m.start(), m.end(), m[0].translate(_STANDS_FOR)) for m in _ODD.finditer(text) if m[0] not in INVISIBLE]
        if all(len(new) == end - start for start, end, new in marks):
            now.text = text.translate(_STANDS_FOR)
            now.edited = [(a, b) for a, b, _ in marks]
        now = now.apply([(m.start(), m.end(), "") for m in _GONE.finditer(now.text)])
    # Longer disguises last, as they may stand on characters that were mended before.
    # Rules that look at every blank run only where the text has their words.
    low = low if now.text == text else now.text.lower()
    spelled = any([x in low for x in _DOTS])
    for rule, there in (
        (_BRACKETED_AT, signs or odd), (_BARE_AT, (signs or odd or spelled) and "at" in low), (_BARE_OTHER_AT, any([x in low for x in _OTHER_ATS]))
    ):
        if there:
            now = now.apply([(m.start(), m.end(), "@") for m in rule.finditer(now.text)])
    now = now.apply(_host_dots(now))
    for rule, there in ((_BRACKETED_DOT, signs or odd), (_BARE_DOT, "dot" in low)):
        if there:
            now = now.apply([(m.start(), m.end(), ".") for m in rule.finditer(now.text)])
    long = now.apply(_spelled(now.text))
    wide = now.apply(_octets(now.text))
    wide = wide.apply(_spelled(wide.text))
    wide = wide.apply(_adjoining(wide.text))
    both = [long] if wide.text == long.text else [long, wide]
    both = [x.apply([(m.start(), m.end(), "+") for m in _PLUS.finditer(x.text)]) for x in both]
    return [x for x in both if x.edited]


def _covered(span: Span, taken: list[Span]) -> bool:
    """Whether one of ``taken`` holds all of the span; a fragment of it does not cover it."""
    return any(a <= span[1] and span[2] <= b for _, a, b in taken)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans); positions are code points of the source."""
    base = detect(text)
    added = [span for now in normalise(text) for span in _at_edits(now)]
    if not added:
        return base, []
    by_kind = {k: [s for s in base if s[0] == k] for k in KINDS}
    return base, sorted({s for s in added if not _covered(s, by_kind[s[0]])}, key=_order)


def _at_edits(now: Rewritten) -> list[Span]:
    """What the whole rewritten text holds that touches an edit, as spans of the source."""
    edits = sorted(now.edited)
    starts, ends, furthest = [a for a, _ in edits], [], 0
    for _, end in edits:
        furthest = max(furthest, end)
        ends.append(furthest)
    added: list[Span] = []
    for kind, a, b in detect(now.text):
        before = bisect_right(starts, b)
        if before and ends[before - 1] >= a:
            added.append((kind, now.source(a)[0], now.source(b - 1)[1]))
    return added


def _order(span: Span) -> tuple:
    return KINDS.index(span[0]), span[1], span[2]


def _joined(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for kind, a, b in spans])


def _spans(batch) -> dict:
    out: dict[str, list] = {name: [] for name in (*[f"n_{k}" for k in KINDS], "base_sha256", "spans")}
    for text in texts(batch):
        base, added = find(text)
        for kind in KINDS:
            out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
        out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        out["spans"].append(_joined(sorted(base + added, key=_order) if added else base))
    return {"doc_id": batch.column("doc_id")} | out


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document; a map without shuffle."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(docs.select("doc_id", "text"), _spans, f"doc_id long, {counts}, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in angle brackets."""
    base, added = find(text)
    parts, at = [], 0
    for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


def _redact(batch) -> dict:
    out = {c: batch.column(c) for c in batch.schema.names}
    return out | {"text": [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]}


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``; ``n_chars``, where there, follows."""
    names = [c if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    done = map_batches(plain, _redact, plain.schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done
