"""Licence scans: Aho-Corasick finds tags and phrases, a shunting-yard parser evaluates tag expressions.

The text is reduced to its words (ASCII lower-cased). Phrases are matched on whole words in one pass of the automaton
over the joined words: the base phrases, further notices of the method, and the words of the identifier tag. A tag's words
are located in the source, where hyphens have to join them and a colon has to follow; the expression after it
is read there and evaluated with ``and``, ``or``, ``with`` and brackets. A later-version mark (``+``) belongs to its identifier.

The score says how freely the text may be used: 1 for public domain, 0.9 for permissive notices, down to 0.1 for terms
that forbid it, 0 where nothing is found. ``or`` leaves the choice (the largest), ``and`` binds to all (the
smallest), ``with`` goes halfway towards 1 because an exception loosens the terms; several finds bind together.

Nulls: a null text is empty (no words, no labels, score 0). Malformed expressions count their identifiers as bound
together. Repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import ahocorasick
from pyspark.sql import DataFrame

from corpusloom.llm.tasks import map_batches, texts

# Phrases and labels of the base contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices the method adds.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl",
    "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0 1 0": "cc0",
    "creative commons zero": "cc0", "the unlicense": "unlicense", "released into the public domain": "public-domain",
    "all rights reserved": "proprietary", "proprietary and confidential": "proprietary",
}
# Fixed value: the identifier tag, its words.
TAG = "spdx license identifier"
# How freely a label may be used.
FREEDOM = {
    "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "bsl": 0.9, "zlib": 0.9,
    "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.1,
}
UNKNOWN_FREEDOM = 0.5
#: Operator -> how tightly it binds.
BINDING = {"or": 1, "and": 2, "with": 3}

_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Every phrase has one of these; a text without any of them needs no automaton.
_HINTS = (b"licens", b" cc", b"rights", b"domain", b"clause", b"redistribution", b"permission", b"creative", b"proprietary")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
_COMMENT_END = re.compile(r"\*/|-->|\n|\r")
#: A version or clause number and what qualifies it (``only``, ``clause``, a country), or a later-version mark alone.
_VERSION = re.compile(r"-v?[0-9][0-9.]*(?:[-+].*)?$|\+$")
#: A word in the source, and what stands between the words of a tag and after it.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TAG_SIGNS = ["-", "-", ":"]


def words_of(text: str) -> bytes:
    """The lower-case words of a text, separated by single spaces, one space at either end."""
    found = text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()
    return b" " + b" ".join(found) + b" " if found else b" "


@cache
def _automaton():
    """One automaton over ' phrase ' for every phrase. Latin-1 carries bytes through as characters."""
    automaton = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: None}.items():
        automaton.add_word(f" {phrase} ", (phrase, label))
    automaton.make_automaton()
    return automaton


def label_of(identifier: str) -> str:
    """The licence family of an identifier: lower case, version and clause numbers off."""
    name = _VERSION.sub("", identifier.lower())
    return "cc0" if name.startswith("cc0") else name


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators after their operands; brackets that do not match are left out."""
    out, waiting = [], []
    for token in tokens:
        low = token.lower()
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        elif low in BINDING:
            while waiting and BINDING.get(waiting[-1], 0) >= BINDING[low]:
                out.append(waiting.pop())
            waiting.append(low)
        else:
            out.append(token)
    return out + [t for t in reversed(waiting) if t != "("]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """(labels, freedom) of an expression; an exception after ``with`` has no label of its own."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(tokens):
        if token in BINDING and len(stack) > 1:
            (right, after), (left, before) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, (before + 1) / 2))
            else:
                stack.append((left | right, max(before, after) if token == "or" else min(before, after)))
        elif token not in BINDING:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN_FREEDOM)))
    if not stack:
        return set(), 1.0
    return set().union(*[labels for labels, _ in stack]), min(value for _, value in stack)


def expression(line: str) -> list[str]:
    """Tokens of the expression a line begins with; words that follow it are left out."""
    tokens, depth, operand = [], 0, True
    for m in _TOKEN.finditer(line):
        token = m[0].rstrip(".") or m[0]
        if token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif token.lower() in BINDING:
            if operand:
                break
            operand = True
        elif operand:
            operand = False
        else:
            break
        tokens.append(token)
    while tokens and (tokens[-1].lower() in BINDING or tokens[-1] == "("):
        tokens.pop()
    return tokens


def tag_ends(text: str, tags: list[int]) -> Iterator[int]:
    """Where the expressions of the tags begin in the source; ``tags`` are numbers of their first words, ascending."""
    found, number = _WORD.finditer(text), 0
    for tag in tags:
        words = list(islice(found, tag - number, tag - number + 3))
        number = tag + 3
        signs = [text[a.end() : b.start()] for a, b in zip(words, words[1:])]
        end = words[-1].end()
        if [*signs, text[end : end + 1]] == _TAG_SIGNS:
            yield end + 1


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    joined = words_of(text)
    n_words = joined.count(b" ") - 1 if len(joined) > 1 else 0
    n_base, first, last, base, labels, freedom = 0, None, None, set(), set(), []
    if any([hint in joined for hint in _HINTS]):
        counted, at = 0, 0
        notices: list[tuple[int, int, str]] = []
        tags: list[int] = []
        for end, (phrase, label) in _automaton().iter(joined.decode("latin-1")):
            start = end - len(phrase) - 1
            if phrase in BASE or phrase == TAG:
                counted += joined.count(b" ", at, start) if start >= at else -joined.count(b" ", start, at)
                at = start
            if phrase == TAG:
                tags.append(counted)
                continue
            if phrase in BASE:
                n_base += 1
                first = counted if first is None else min(first, counted)
                last = counted if last is None else max(last, counted)
                base.add(label)
            notices.append((start, end, label))
        # A longer notice speaks for the shorter ones inside it.
        notices.sort(key=lambda n: (n[0], -n[1]))
        reach = -1
        for _, end, label in notices:
            if end > reach:
                labels.add(label)
                freedom.append(FREEDOM.get(label, UNKNOWN_FREEDOM))
                reach = end
        for start in tag_ends(text, tags):
            stop = _COMMENT_END.search(text, start)
            found, value = evaluate(expression(text[start : stop.start() if stop else len(text)]))
            if found:
                labels |= found
                freedom.append(value)
    labels |= base
    score = min(freedom) if freedom else 0.0
    return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scans(batch) -> dict:
    rows = [scan(t) for t in texts(batch)]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    return {"doc_id": batch.column("doc_id")} | {n: [r[k] for r in rows] for k, n in enumerate(names)}


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence finds of every document; a map without shuffle."""
    return map_batches(docs.select("doc_id", "text"), _scans, f"doc_id long, {_COLUMNS}")
