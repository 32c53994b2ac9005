"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Features of a block are its own and its ancestors' tags, the words of their class, id
and role, and its text: length, punctuation, links, telling words. The field is trained
on labelled pages that labelled_pages() writes from a parameter, a seed: page layouts of
many makes, each block written together with its label. Pages are decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import crf
from quire.llm.common import slices, stored, with_rid
from quire.llm.dom import Block, blocks

PAGES = 500
SEED = 11
#: Positions of pages that are decoded at once; a longer page is decoded by itself.
CELLS = 30_000
#: Words that tell of what is around the main text.
TELLING = re.compile(r"(?i)\b(cookies?|subscribe|newsletter|copyright|rights reserved|advertisement|sponsored|promoted|log ?in|sign (?:in|up)|register|password|e-?mail|comments?|repl(?:y|ies)|share|follow|privacy|terms|related|read more|menu|home|contact|about us|search|submit|posted by|said|accept|previous|next)\b|©|»|«")


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for k, b in enumerate(page):
        n = len(b.text)
        words = b.text.count(" ") + 1
        link = b.linked / n
        size = "0" if n < 15 else "1" if n < 40 else "2" if n < 100 else "3" if n < 250 else "4"
        dense = "0" if link == 0 else "1" if link < 0.3 else "2" if link < 0.8 else "3"
        f = ["bias", f"t:{b.tag}", f"size:{size}", f"link:{dense}", f"size-link:{size}{dense}", f"t-link:{b.tag}:{dense}"]
        f += b.context
        if b.up:
            f.append(f"up:{b.up}>{b.tag}")
        f.append("end" if b.text[-1] in ".!?…\"”»:;" else "no-end")
        f.append(f"commas:{min(3, b.text.count(','))}")
        if words <= 30:
            f += sorted({"w:" + re.sub(r"\s+", " ", m.lower().rstrip("s")) for m in (x[0] for x in TELLING.finditer(b.text))})
        if k == 0:
            f.append("first")
        if k == len(page) - 1:
            f.append("last")
        out.append(f)
    return out


#: What training pages are made of. Containers of the main text, then of what is not.
_MAIN = ("article", "main", "article", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-text"', 'section class="story"', 'div role="main"', 'div class="{r}"', 'td class="text"', "div")
_AROUND = {
    "nav": ("nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="breadcrumbs"', 'div role="navigation"', 'div class="topbar"'),
    "header": ("header", 'div class="header"', 'div id="masthead"', 'div class="site-title"', 'header class="{r}"', 'div role="banner"'),
    "aside": ("aside", 'div class="sidebar"', 'div id="right-column"', 'div class="widget"', 'aside class="{r}"', 'div class="related"', 'section class="recommended"', 'div role="complementary"'),
    "ad": ('div class="ad"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div id="banner"', 'aside class="ad"', 'div class="ads {r}"', 'section class="promotion"'),
    "notice": ('div class="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div id="consent"', 'div class="banner"', 'div class="newsletter"', 'div class="popup"', 'div class="modal"', 'section class="notice"', 'p class="notice"', 'div role="alert"'),
    "form": ("form", 'form class="search"', 'form class="subscribe"', 'form id="login"', 'div class="form"'),
    "comments": ('section class="comments"', 'div id="comments"', 'div class="comment"', 'ol class="commentlist"', 'div class="reader-comments"', 'div class="discussion"', 'div class="replies"', 'section id="responses"', 'aside class="comments"', 'div class="user-comments"'),
    "footer": ("footer", 'div class="footer"', 'div id="foot"', 'div class="copyright"', 'footer class="{r}"', 'div role="contentinfo"'),
    "share": ('div class="share"', 'div class="social"', 'ul class="tags"', 'div class="byline meta"', 'div class="pagination"'),
}
_SHORT = {
    "notice": ("We use cookies to make this site better.", "Subscribe to our newsletter", "Accept all", "This site uses cookies. Read our privacy policy.", "Please log in to read on."),
    "footer": ("© 2024 {w}", "Copyright {w}. All rights reserved.", "Terms and privacy", "Contact us", "{w}.com · {w} {w} {w}."),
    "form": ("Your e-mail", "Search", "Sign up", "Password", "Submit", "Name"),
    "comments": ("{w} said: {s}", "Reply", "3 comments", "Posted by {w}", "{s}", "{s} {s}"),
    "ad": ("Advertisement", "Sponsored: {s}", "{s}", "{s}", "Buy {w} now"),
    "share": ("Share this", "Tags: {w}, {w}", "By {w} {w}", "Previous", "Next"),
    "aside": ("Related", "Read more", "{s}", "Most read", "{w} {w} {w}"),
    "header": ("{w} {w}", "Home", "{s}", "The {w} daily"),
    "nav": ("Home", "About us", "Contact", "{w}", "{w} {w}"),
}
_SYLLABLES = "an ba ce do er fi ga hu in jo ka le mo nu or pa qui ra se ti un ve wa ya zo thé größ ción".split()


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text of a block, 1 for main text)]) of n pages, the same for the same arguments."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    sentence = lambda lo=3, hi=18: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice("...?!")
    pages = []
    for _ in range(n):
        labels: list[tuple[str, int]] = []

        def leaf(tag: str, text: str, y: int, inner: str | None = None, end: bool = True) -> str:
            labels.append((text, y))  # noqa: B023
            return f"<{tag}>{inner if inner is not None else text}" + (f"</{tag.split()[0]}>" if end else "")

        def around(kind: str) -> str:
            shell = rng.choice(_AROUND[kind]).replace("{r}", word())
            parts = []
            for _ in range(rng.randint(1, 2 if kind in ("ad", "header") else 5)):
                if kind in ("nav", "aside") and rng.random() < 0.75:
                    t = rng.choice([word(), f"{word()} {word()}", sentence(2, 8)])
                    parts.append(leaf(rng.choice(["li", "li", "div", "p"]), t, 0, f'<a href="/{word()}">{t}</a>'))
                else:
                    t = rng.choice(_SHORT[kind])
                    while "{w}" in t or "{s}" in t:
                        t = t.replace("{w}", word(), 1).replace("{s}", sentence(), 1)
                    if len(parts) == 0 and rng.random() < 0.4:  # the container's own text
                        labels.append((t, 0))  # noqa: B023
                        parts.append(t)
                        break
                    parts.append(leaf(rng.choice(["p", "div", "h3", "li", "label", "p"] if kind == "form" else ["p", "div", "h2", "p", "li"]), t, 0) if kind != "form" or rng.random() < 0.8 else leaf("p", t, 0))
            if shell.startswith("nav") and rng.random() < 0.6:
                parts = ["<ul>", *parts, "</ul>"]
            return f"<{shell}>" + "".join(parts) + f"</{shell.split()[0]}>"

        def main() -> str:
            shell = rng.choice(_MAIN).replace("{r}", word())
            parts = []
            title = rng.choice([sentence(1, 3), sentence(4, 10), " ".join(word() for _ in range(rng.randint(1, 8)))])
            if rng.random() < 0.85:
                tag = rng.choice(["h1", "h1", "h2"])
                t = leaf(tag, title, 1)
                parts.append(f"<header>{t}</header>" if rng.random() < 0.12 else t)
            if rng.random() < 0.5:  # an unclosed paragraph with bold type
                t = rng.choice([title, " ".join(sentence() for _ in range(rng.randint(1, 5)))])
                parts.append(leaf("p", t, 1, f"<b>{t}<br>", end=False))
            for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
                kind = rng.random()
                t = " ".join(sentence(*((1, 2) if rng.random() < 0.1 else (3, 18))) for _ in range(rng.choice([1, 1, 2, 4, 7])))
                if kind < 0.72:
                    w = t.split(" ")
                    k = rng.randrange(len(w))
                    inner = " ".join([*w[:k], f'<a href="/{word()}">{w[k]}</a>', *w[k + 1 :]]) if rng.random() < 0.15 else t
                    parts.append(leaf("p", t, 1, inner, end=rng.random() < 0.9))
                elif kind < 0.8:
                    parts.append(leaf(rng.choice(["h2", "h3", "h4"]), sentence(1, 6).rstrip("."), 1))
                elif kind < 0.86:
                    parts.append("<ul>" + "".join(leaf("li", sentence(1, 9), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
                elif kind < 0.9:
                    parts.append("<blockquote>" + leaf("p", t, 1) + "</blockquote>")
                elif kind < 0.93:
                    parts.append("<table><tr>" + "".join(leaf("td", f"{word()} {rng.randint(0, 99)}", 1) for _ in range(3)) + "</tr></table>")
                elif kind < 0.95:
                    parts.append(leaf("pre", t, 1))
                else:
                    parts.append(around(rng.choice(["ad", "share", "notice", "aside", "form"])))
            if rng.random() < 0.15:
                parts.append(around(rng.choice(["comments", "footer", "share"])))
            return f"<{shell}>" + "".join(parts) + f"</{shell.split()[0]}>"

        some = lambda *kinds: [around(k) for k in kinds if rng.random() < 0.55]
        body = [*some("notice", "header", "nav", "ad", "form", "aside"), main(), *some("share", "ad", "comments", "aside", "notice", "form", "nav", "footer")]
        if rng.random() < 0.2:
            body = ['<div class="wrapper">', *body, "</div>"]
        pages.append(("<html><head><title>x</title></head><body>" + "".join(body) + ("</body></html>" if rng.random() < 0.9 else ""), labels))
    return pages


def _arrays(pages: list[list[list[str]]], index: dict[str, int], grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat positions, their features, and the mask of a batch."""
    length = max(1, max(map(len, pages), default=1))
    mask = np.zeros((len(pages), length), bool)
    rows, cols = [], []
    for p, page in enumerate(pages):
        mask[p, : len(page)] = True
        for k, fs in enumerate(page):
            for f in fs:
                c = index.setdefault(f, len(index)) if grow else index.get(f)
                if c is not None:
                    rows.append(p * length + k)
                    cols.append(c)
    return np.array(rows, np.int64), np.array(cols, np.int64), mask


@lru_cache(maxsize=4)
def train(n: int = PAGES, seed: int = SEED, rounds: int = 70) -> tuple:
    """(feature numbers, weights, transitions, begin), from n labelled pages."""
    found, gold = [], []
    for page, labels in labelled_pages(n, seed):
        got = blocks(page)
        # a block's label goes by its text and order: the reader may merge or part what was written
        at, y = 0, []
        for b in got:
            k = next((k for k in range(at, len(labels)) if " ".join(labels[k][0].split()) == b.text), None)
            y.append(labels[k][1] if k is not None else 0)
            at = k + 1 if k is not None else at
        found.append(features(got))
        gold.append(y)
    index: dict[str, int] = {}
    rows, cols, mask = _arrays(found, index, True)
    y = np.zeros(mask.shape, np.int64)
    for k, g in enumerate(gold):
        y[k, : len(g)] = g
    counts = np.bincount(cols, minlength=len(index))
    keep = counts[cols] >= 4
    weights, trans, begin = crf.train(rows[keep], cols[keep], y, mask, len(index), 2, rounds=rounds, l2=3e-4)
    return {f: k for f, k in index.items() if counts[k] >= 4}, weights, trans, begin


def decode(pages: list[list[Block]], model: tuple) -> list[np.ndarray]:
    """1 for the blocks of main text, page by page."""
    index, weights, trans, begin = model
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    lo = 0
    while lo < len(order):  # pages of like length together, so many cells at a time
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= CELLS:
            hi += 1
        part, lo = order[lo:hi], hi
        rows, cols, mask = _arrays([features(pages[k]) for k in part], index, False)
        emit = np.stack([np.bincount(rows, weights[cols, j], mask.size) for j in range(2)], axis=1).reshape(*mask.shape, 2)
        best = crf.viterbi(emit, mask, trans, begin)
        for k, p in enumerate(part):
            out[p] = best[k, : len(pages[p])]
    return out


def _extract(model: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html", 4_000_000):
                pages = [blocks(t, model[0]) for t in b.column("html").to_pylist()]
                texts = ["\n\n".join(x.text for x, y in zip(p, best, strict=True) if y) for p, best in zip(pages, decode(pages, model), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["rid", "page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) -> rid, page_id, url, text, n_chars.

    One row per input row, no shuffle. A null, empty or textless page has the text ''.
    Blocks of main text come in page order, white space inside of them as one space,
    joined by two line ends. A very long page takes time in proportion. Repeated rows
    are so many rows, and an empty table gives none.
    """
    rows = with_rid(stored(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))).select("rid", "page_id", "url", "html")
    return rows.mapInArrow(_extract(train()), "rid long, page_id long, url string, text string, n_chars long")
