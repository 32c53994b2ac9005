"""Markup to blocks: one row per leaf block of a document, in order, with what the cleaners ask of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that make a block, that show nothing, that have no end.
BLOCK = frozenset("p div section article main aside nav header footer h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure figcaption dl dt dd form hr body".split())
SKIP = frozenset("script style iframe object embed title head template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LITERARY = re.compile(r"(?i)poem|poetry|verse|stanza|cast|character|stage|note|footnote|endnote|chapter|title|(?:^|[-_\s])line(?:$|[-_\s])")

SCHEMA = "book long, doc_index long, block_no long, tag string, level long, text string, classes string, ident string, within string, links long, images long, src string, alt string, breaks long"


class _Blocks(HTMLParser):
    """Collects leaf blocks; text between two block tags is one block of the innermost open element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[tuple[str, str, str]] = []
        self.skip = 0
        self.start()

    def start(self) -> None:
        self.text: list[str] = []
        self.links = self.images = self.breaks = 0
        self.src = self.alt = ""

    def flush(self) -> None:
        raw = "".join(self.text)
        whole = re.sub(r"[^\S\n]*\n[^\S\n]*", "\n", raw).strip() if any(t == "pre" for t, _, _ in self.open) else "\n".join(x for x in (" ".join(p.split()) for p in raw.split("\x00")) if x)
        if whole or self.images:
            tag, classes, ident = self.open[-1] if self.open else ("body", "", "")
            self.rows.append({"tag": tag, "level": int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0, "text": whole, "classes": classes, "ident": ident, "within": " ".join(t for t, _, _ in self.open[:-1]), "links": self.links, "images": self.images, "src": self.src, "alt": self.alt, "breaks": self.breaks})
            if self.open:
                self.open[-1] = (tag, classes, "")  # an id goes to an element's first block
        self.start()

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in SKIP:
            self.skip += tag not in VOID
        elif self.skip:
            return
        elif tag == "br":
            self.breaks += 1
            self.text.append("\x00")
        elif tag == "img":
            self.images += 1
            self.src, self.alt = self.src or at.get("src") or at.get("href") or "", self.alt or at.get("alt") or at.get("title") or ""
        elif tag == "a":
            self.links += 1
        elif tag in BLOCK:
            self.flush()
            if tag in ("p", "li", "tr", "td") and any(t == tag for t, _, _ in self.open[-1:]):
                self.open.pop()  # unclosed
            if tag not in VOID:
                self.open.append((tag, " ".join(c for c in (at.get("class") or "").split() if LITERARY.search(c)), at.get("id") or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in BLOCK:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def parse(markup: str | None) -> list[dict]:
    """Blocks of a document: tag, level, text (lines kept at <br> and in <pre>), literary classes, id, open ancestors, links, images, breaks."""
    reader = _Blocks()
    reader.feed(markup or "")
    reader.close()
    reader.flush()
    return reader.rows


def blocks(docs: DataFrame) -> DataFrame:
    """Documents (book, doc_index, html) -> block rows. A null or empty document has none."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"book": book, "doc_index": doc, "block_no": n, **r} for book, doc, html in zip(b["book"], b["doc_index"], b["html"], strict=True) for n, r in enumerate(parse(html))]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("book", "doc_index", "html").mapInPandas(run, SCHEMA)
