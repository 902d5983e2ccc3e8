"""Semantic page text and titles.

One streaming pass per page with the standard library's tokenizer: a stack of open
elements decides which of the open fragments a piece of text belongs to. Text of a
paragraph inside a section is reported for both, as in a tree search for both tags.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import arrow_function
from lorebase import fixed

_SEMANTIC = frozenset(fixed.SEMANTIC_TAGS)
_STRIPPED = frozenset(fixed.STRIPPED_TAGS)
_VOID = frozenset(fixed.VOID_TAGS)
_UNSEEN = frozenset(("script", "style", "template"))
_ATTR = re.compile(fixed.BOILERPLATE_ATTR, re.IGNORECASE)


class _Fragments(HTMLParser):
    """Collects, in start-tag order, the text pieces of every wanted element."""

    def __init__(self, wanted: frozenset[str], removed: frozenset[str], by_attr: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.removed, self.by_attr = wanted, removed, by_attr
        self.open: list[tuple[str, bool, int | None]] = []  # name, hidden, fragment slot
        self.found: list[tuple[str, list[str]]] = []
        self.everything: list[str] = []

    def _hidden(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in self.removed:
            return True
        if not self.by_attr:
            return False
        return any(name in ("class", "id") and value and _ATTR.search(value) for name, value in attrs)

    def handle_starttag(self, tag, attrs):
        hidden = bool(self.open and self.open[-1][1]) or self._hidden(tag, attrs)
        slot = None
        if tag in self.wanted and not hidden:
            slot = len(self.found)
            self.found.append((tag, []))
        if tag not in _VOID:
            self.open.append((tag, hidden, slot))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        piece = data.strip()
        if not piece or (self.open and (self.open[-1][1] or self.open[-1][0] in _UNSEEN)):
            return
        self.everything.append(piece)
        for _, _, slot in self.open:
            if slot is not None:
                self.found[slot][1].append(piece)


def _read(html: str, wanted: frozenset[str], removed: frozenset[str] = frozenset(), by_attr: bool = False) -> _Fragments:
    parser = _Fragments(wanted, removed, by_attr)
    parser.feed(html)
    parser.close()
    return parser


def page_text(html: str) -> str:
    parsed = _read(html, _SEMANTIC, _STRIPPED, by_attr=True)
    parts = [text for text in ("".join(pieces) for _, pieces in parsed.found) if len(text) > fixed.MIN_FRAGMENT_CHARS]
    return "\n".join(parsed.everything) if len(parts) < fixed.MIN_SEMANTIC_PARTS else "\n\n".join(parts)


def page_title(html: str) -> str:
    found = _read(html, frozenset(("title", "h1"))).found
    for wanted in ("title", "h1"):
        for tag, pieces in found:
            if tag == wanted:
                return "".join(pieces)
    return ""


def body_text(html: str) -> str:
    """All visible text, one line per piece; for linked HTML bodies."""
    parser = _LinkedBody()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.pieces)


class _LinkedBody(HTMLParser):
    """Raw text pieces outside script, style and noscript, white space included."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not any(t in ("script", "style", "noscript", "template") for t in self.open):
            self.pieces.append(data)


@arrow_function(T.StringType())
def extract_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text, na_action="ignore")


@arrow_function(T.StringType())
def extract_title(pages: pd.Series) -> pd.Series:
    return pages.map(page_title, na_action="ignore")


class _Numbers(HTMLParser):
    """Numbers the starts and the ends of elements in one pass, and where the text pieces lie between them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []  # pre, post, tag, removed by itself
        self.pieces: list[dict] = []
        self.open: list[list] = []
        self.ends, self.raw = 0, False

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.ends += 1
            self.open.pop()[1] = self.ends

    def handle_starttag(self, tag, attrs):
        if tag in _UNSEEN:
            self.raw = tag != "template"
        elif tag not in _VOID:
            marked = any(name in ("class", "id") and value and _ATTR.search(value) for name, value in attrs)
            self.elements.append([len(self.elements) + 1, 0, tag, bool(marked or tag in _STRIPPED)])
            self.open.append(self.elements[-1])

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        self.raw = False
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][2] == tag:
                return self._close(depth)

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self.raw:
            self.pieces.append({"starts": len(self.elements), "ends": self.ends, "text": piece})

    def close(self) -> None:
        super().close()
        self._close(0)


OUTLINE = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("pre", T.IntegerType()), T.StructField("post", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("own", T.BooleanType()),
    ]))),
    T.StructField("pieces", T.ArrayType(T.StructType([
        T.StructField("starts", T.IntegerType()), T.StructField("ends", T.IntegerType()), T.StructField("text", T.StringType()),
    ]))),
])


def page_outline(html: str | None) -> dict:
    parser = _Numbers()
    parser.feed(html or "")
    parser.close()
    names = ("pre", "post", "tag", "own")
    return {"elements": [dict(zip(names, e, strict=True)) for e in parser.elements], "pieces": parser.pieces}


@arrow_function(OUTLINE)
def outline(pages: pd.Series) -> pd.DataFrame:
    found = [page_outline(page) for page in pages]
    return pd.DataFrame({"elements": [f["elements"] for f in found], "pieces": [f["pieces"] for f in found]})
