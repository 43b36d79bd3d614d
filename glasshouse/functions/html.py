"""Markup that patterns cannot read: blocks, visible text, anchors and visible elements, by the standard library's parser.

The parsers run in Arrow batches (mapInArrow, Arrow-backed UDFs), one page at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glasshouse.functions import lexicon as L

_BLOCKS = set("address article aside blockquote br body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIP = set("script style noscript template head svg".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())


#: Bytes of markup that are Python strings at once, whatever a batch holds.
STEP_BYTES = 1 << 20


def steps(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """Where pieces of about STEP_BYTES begin, and how many pages each has."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + STEP_BYTES, side="right")))
        yield at, end - at
        at = end


def each(pages: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each page, null as an empty one; no more than a piece is made Python strings at once."""
    return pa.concat_arrays([pa.array([f(x or "") for x in pages.slice(at, n).to_pylist()], kind) for at, n in steps(pages)] or [pa.array([], kind)])


class _Blocks(HTMLParser):
    def __init__(self, skip: set[str], blocks: set[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.breaks, self.depth, self.out, self.now = skip, blocks, 0, [], []

    def end_block(self) -> None:
        text = clean(" ".join(self.now))
        if text:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.skip and tag not in _VOID:
            self.depth += 1
        if tag in self.breaks:
            self.end_block()

    def handle_endtag(self, tag):
        if tag in self.skip and self.depth:
            self.depth -= 1
        if tag in self.breaks:
            self.end_block()

    def handle_data(self, data):
        if not self.depth:
            self.now.append(data)


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def clean(text: str) -> str:
    return " ".join(_CONTROL.sub(" ", text).split())


def nfkd_lower(text: str) -> str:
    """NFKD without combining marks, white space collapsed, lower case."""
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).split()).lower()


def blocks_of(page: str) -> list[str]:
    p = _Blocks(_SKIP, _BLOCKS)
    p.feed(page or "")
    p.close()
    p.end_block()
    return p.out


def visible_of(page: str) -> str:
    """All visible text as one string, without block bounds."""
    p = _Blocks({"script", "style", "noscript", "template"}, set())
    p.feed(page or "")
    p.close()
    p.end_block()
    return " ".join(p.out)


@F.arrow_udf(ArrayType(StringType()))
def blocks(pages: pa.Array) -> pa.Array:
    return each(pages, blocks_of, pa.list_(pa.string()))


@F.arrow_udf(StringType())
def visible(pages: pa.Array) -> pa.Array:
    return each(pages, visible_of, pa.string())


@F.arrow_udf(StringType())
def nfkd(texts: pa.Array) -> pa.Array:
    return each(texts, nfkd_lower, pa.string())


class Anchor(NamedTuple):
    href: str
    text: str
    label: str
    title: str


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Anchor] = []
        self.open: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.finish()
            self.open = {k: v or "" for k, v in attrs} | {"\0": []}

    def handle_data(self, data):
        if self.open is not None:
            self.open["\0"].append(data)

    def handle_endtag(self, tag):
        if tag == "a":
            self.finish()

    def finish(self) -> None:
        if self.open is not None:
            self.out.append(Anchor(self.open.get("href", ""), clean(" ".join(self.open["\0"])), self.open.get("aria-label", ""), self.open.get("title", "")))
            self.open = None


def anchors_of(page: str) -> list[Anchor]:
    p = _Anchors()
    p.feed(page or "")
    p.close()
    p.finish()
    return p.out


class _Elements(HTMLParser):
    """Elements that may be a banner's container: signature, visibility and text."""

    def __init__(self, container: re.Pattern, vendors: list[tuple[str, re.Pattern]], ancestors: int):
        super().__init__(convert_charrefs=True)
        self.container, self.vendors, self.most = container, vendors, ancestors
        self.stack: list[tuple[str, bool, dict | None]] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        style = re.sub(r"\s+", "", values.get("style", "").lower())
        hidden = (
            "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(re.search(L.HIDDEN_CLASS, values.get("class", ""), re.I))
            or bool(re.search(r"display:none|visibility:hidden|opacity:0(?![.\d])", style))
        )
        found = None
        name = f"{values.get('id', '')} {values.get('class', '')}".strip()
        if name and tag not in L.NONVISUAL_TAGS:
            signature = f'<{tag} id="{values.get("id", "")}" class="{values.get("class", "")}">'
            vendor = next((v for v, p in self.vendors if p.search(signature)), None)
            contains = bool(self.container.search(name))
            if vendor or contains:
                found = {"vendor": vendor, "container": contains, "hidden": hidden or any(h for _, h, _ in self.stack[-self.most :]), "text": [self.get_starttag_text() or ""]}
                self.found.append(found)
        self._text(self.get_starttag_text() or "")
        if tag not in _VOID:
            self.stack.append((tag, hidden, found))

    def _text(self, piece: str) -> None:
        for _, _, f in self.stack:
            if f is not None:
                f["text"].append(piece)

    def handle_data(self, data):
        self._text(data)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break


def banner_elements(page: str, containers: list[str], vendors: dict[str, list[str]], ancestors: int = L.BANNER_ANCESTORS) -> list[dict]:
    p = _Elements(re.compile("|".join(map(re.escape, containers)), re.I), [(v, re.compile(x, re.I)) for v, xs in vendors.items() for x in xs], ancestors)
    p.feed(page or "")
    p.close()
    return [f | {"text": " ".join(f["text"])} for f in p.found]
