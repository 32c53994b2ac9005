"""Ordered documents of a book: probe, rule-based kinds, window passes, sections.

A spine is a table (book, doc_index, ...) in reading order. All but the probe's regex
flattening and its count over nested divs are projections and windows partitioned by book.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window as W

from quire.functions.patterns import found, test
from quire.functions.text import clean_text, display_title, html_unescape, title_key, word_count

#: Markup without text, the probe's caps, and the vocabularies of apparatus.
DROP = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<iframe.*?</iframe>|<object.*?</object>"
HEADING = r"(?is)<(h[1-6])[^>]*>(.*?)</h[1-6]>"
CLASS = r"""(?is)\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)?[^>]*>")
SAMPLE = 9000
CONTENTS_HEADING = r"^((the\s+)?principal\s+contents|series\s+contents|alphabetical\s+list\s+of\s+titles|list\s+of\s+essays\s+(in\s+)?alphabetical\s+order)$"
SHORT_CONTENTS_HEADING = r"^((list\s+of\s+)?illustrations|contents|table\s+of\s+contents)$"
CONTENTS_LEAD = r"^((the\s+)?principal\s+contents|(list\s+of\s+)?illustrations)\b"
COLLECTION_TITLE = r"\b(the\s+)?(collected|complete)\s+works\s+of\b|\b[a-z][a-z .'-]+\s+(collected|complete)\s+works\b"
LISTING = ("the books", "on the fourfold root of the principle of sufficient reason", "the world as will and idea", "schopenhauer by thomas whittaker", "schopenhauer by elbert hubbard", "arthur schopenhauer by william wallace")
GALLERY = r"\bthe\s+books\b|\bexplore science and philosophy with delphi classics\b|\bbeautifully illustrated\b|\bcomprehensive editions\b|\bbonus texts\b"
GALLERY_PHRASES = ("delphi classics", "born in", "modern maps", "market town", "village", "beautifully illustrated", "comprehensive editions", "bonus texts", "explore science and philosophy with delphi classics")
CATALOGUE_HEADING = r"^((the\s+)?(delphi\s+classics\s+)?catalogue|catalog|(complete\s+)?catalogue\s+of\s+(english\s+)?titles|project\s+gutenberg.*|full\s+project\s+gutenberg.*license)$"
PUBLISHER = (
    r"\bdelphi classics\b",
    r"\bproject gutenberg\b",
    r"\bexplore science and philosophy with delphi classics\b",
    r"\bthe delphi classics catalogue\b",
    r"\bthe books\b",
    r"\bcomplete catalogue\b|\bcatalogue of english titles\b",
    r"\bwww\.delphiclassics\.com\b|\bdelphiclassics\.com\b",
    r"\bfacebook\.com/delphiebooks\b|\btwitter\.com/delphiclassics\b",
    r"\bsubscribe\b|\bnewsletter\b|\bbuying direct\b|\binstant updates\b",
    r"\binterested in .{1,80}\?",
    r"\bcomprehensive editions\b|\bbeautifully illustrated\b|\bbonus texts\b",
    r"\bereaders?\b|\bexplore our wide range\b",
    r"\bcopyright\b|\ball rights reserved\b",
    r"\bapp store\b|\bgoogle play\b|\bkindle\b|\bebook\b|\bisbn\b",
)
PUBLISHER_PHRASE = r"\bexplore science and philosophy with delphi classics\b|\bthe delphi classics catalogue\b|\bdelphi classics,\s*\d{4}\.?\s*all rights reserved\b"
WRAPPER = (r"\bthe\s+project\s+gutenberg\s+ebook\s+of\b", r"\*+\s*start\s+of\s+the\s+project\s+gutenberg\s+ebook\b")
LICENSE = r"full project gutenberg.*license|project gutenberg.*license"
LICENSE_HEADING = r"gutenberg|project gutenberg.*license|full.*license|end of the project gutenberg"
FRONT_WORDS = ("preface", "introduction", "foreword", "editor")
BOUNDARY_KINDS = ("division", "major_work", "backmatter")


def flat_text(markup: Column) -> Column:
    return clean_text(html_unescape(F.regexp_replace(markup, "<[^>]*>", " ")))


def div_breaks(markup: str) -> int:
    """How many divs, nested ones too, hold two <br> or more and under 1600 characters of text; counts to 2."""
    blocks = at = breaks = width = 0
    open_: list[tuple[int, int]] = []
    for m in TAG.finditer(markup + "</div>" * len(re.findall("(?i)<div", markup))):
        width += sum(len(w) + 1 for w in unescape(markup[at : m.start()]).split())
        at = m.end()
        name = (m[2] or "").lower()
        if name == "br":
            breaks += not m[1]
        elif name == "div" and not m[1]:
            open_.append((breaks, width))
        elif name == "div" and open_:
            b, w = open_.pop()
            blocks += breaks - b >= 2 and width - w - 1 < 1600
            if blocks == 2:
                break
    return blocks


@F.pandas_udf(IntegerType())
def _div_breaks(markup: pd.Series) -> pd.Series:
    return markup.map(lambda h: 0 if h is None else div_breaks(h)).astype("int32")


def probe(pages: DataFrame, per_book: int = 10) -> DataFrame:
    """Pages (page_id, url, html) -> (book, doc_index, name, tag, heading, n_headings, license_headings, text, n_chars, n_words, links, images, poetry, drama).

    ``per_book`` neighbouring pages are one book. A null page has no text and no heading.
    Three signs make poetry: a class of verse on one of the first 500 tags, two of all
    paragraphs and divs with two breaks or more, or a run of six short paragraphs among
    the first 200.
    """
    html = F.regexp_replace(F.coalesce("html", F.lit("")), DROP, "")
    rows = pages.select(F.expr(f"page_id div {per_book}").alias("book"), (F.col("page_id") % per_book).alias("doc_index"), F.col("url").alias("name"), html.alias("h"))
    paragraphs = F.transform(F.slice(F.split("h", "(?i)<p[ >]"), 2, 2**30), lambda p: F.split_part(p, F.lit("</p>"), F.lit(1)))
    texts = F.transform(F.slice("ps", 1, 200), lambda p: flat_text(F.concat(F.lit("<p>"), p)))
    # one letter for each paragraph that isn't blank: s for a short one without a final period
    letters = F.array_join(F.transform(texts, lambda t: F.when(t == "", F.lit("")).when((F.length(t) >= 2) & (F.length(t) <= 64) & ~F.endswith(t, F.lit(".")), F.lit("s")).otherwise(F.lit("x"))), "")
    broken = F.size(F.filter("ps", lambda p: (F.regexp_count(F.lower(p), F.lit("<br")) >= 2) & (F.length(flat_text(p)) < 1600)))
    tags = F.slice(F.regexp_extract_all("h", F.lit(r"(?s)<[a-zA-Z][^>]*>"), F.lit(0)), 1, 500)
    classes = F.array_join(F.transform(tags, lambda t: F.regexp_extract(t, CLASS, 1)), " ")
    headings = F.transform(F.regexp_extract_all("h", F.lit(HEADING), F.lit(2)), flat_text)
    rows = rows.withColumn("ps", paragraphs).withColumn("hs", F.filter(headings, lambda t: t != "")).withColumn("text", flat_text(F.col("h")))
    rows = rows.withColumn("verse", F.rlike(letters, F.lit("s{6}")) | test(classes, "poetry_class")).withColumn("broken", broken)
    nested = ~F.col("verse") & (F.col("broken") < 2) & (F.regexp_count(F.lower("h"), F.lit("<br")) >= 2)
    rows = rows.withColumn("broken", F.col("broken") + _div_breaks(F.when(nested, F.col("h"))))
    return rows.select(
        "book",
        "doc_index",
        "name",
        F.lower(F.regexp_extract("h", HEADING, 1)).alias("tag"),
        F.coalesce(F.get("hs", F.lit(0)), F.lit("")).alias("heading"),
        F.size("hs").cast("long").alias("n_headings"),
        F.size(F.filter("hs", lambda t: found(t, LICENSE_HEADING))).cast("long").alias("license_headings"),
        "text",
        F.length("text").cast("long").alias("n_chars"),
        word_count(F.col("text")).alias("n_words"),
        F.regexp_count(F.lower("h"), F.lit("<a[ >]")).cast("long").alias("links"),
        F.regexp_count(F.lower("h"), F.lit("<img[ >/]")).cast("long").alias("images"),
        (F.col("verse") | (F.col("broken") >= 2)).alias("poetry"),
        F.exists("hs", lambda t: test(t, "cast", "match")).alias("drama"),
    )


def heading_list(pages: DataFrame, per_book: int = 10) -> DataFrame:
    """All headings of each page in order, as 'Hn: text' joined by ' | '; those without text are left out."""
    rows = pages.select(F.expr(f"page_id div {per_book}").alias("book"), (F.col("page_id") % per_book).alias("doc_index"), F.regexp_replace(F.coalesce("html", F.lit("")), DROP, "").alias("h"))
    tags, texts = (F.regexp_extract_all("h", F.lit(HEADING), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(tags, F.transform(texts, flat_text), lambda tag, t: F.when(t != "", F.concat(F.upper(tag), F.lit(": "), t)))
    return rows.select("book", "doc_index", F.array_join(F.array_compact(pairs), " | ").alias("headings"))


def apparatus_hits(heading: Column, text: Column) -> Column:
    """How many of the publisher's 14 signs a heading and the start of the text show."""
    whole = F.concat(F.lower(heading), F.lit(" "), F.substring(F.lower(text), 1, 2500))
    return sum((found(whole, p).cast("int") for p in PUBLISHER), F.lit(0))


def classify(probed: DataFrame) -> DataFrame:
    """Adds kind, remove, confidence and major_title by the ordered rules.

    Five rules end the matter: contents, gallery, publisher, wrapper, licence. After
    those, promotion and local contents set ``remove``, and the heading decides the kind
    without touching it, but for plays and verse, which are kept.
    """
    heading, n = F.col("heading"), F.col("n_chars")
    sample = F.substring("text", 1, SAMPLE)
    low = F.lower(sample)
    bare = F.regexp_replace(heading, "^[ .]+|[ .]+$", "")
    start = F.concat(heading, F.lit(" "), F.substring(sample, 1, 1200))
    blob = (n <= 6000) & F.contains(low, F.lit("contents")) & F.contains(low, F.lit("version 1")) & (F.contains(low, F.lit("the biographies")) | F.contains(low, F.lit("the essays")))
    blob = blob & found(sample, COLLECTION_TITLE) & (sum((F.contains(low, F.lit(p)).cast("int") for p in LISTING), F.lit(0)) >= 3)
    contents = found(bare, CONTENTS_HEADING) | (found(bare, SHORT_CONTENTS_HEADING) & (n < 12000)) | (~found(bare, SHORT_CONTENTS_HEADING) & (found(F.substring(sample, 1, 500), CONTENTS_LEAD) | blob))
    phrase = F.lit(False)
    for p in GALLERY_PHRASES:
        phrase = phrase | F.contains(low, F.lit(p))
    gallery = (F.col("doc_index") <= 20) & (n <= 1800) & (found(bare, r"^the\s+books$") | found(low, GALLERY)) & ((F.col("images") > 0) | phrase)
    whole = F.concat(F.lower(bare), F.lit(" "), F.substring(low, 1, 2500))
    publisher = found(bare, CATALOGUE_HEADING) | ((n < 20000) & ((apparatus_hits(bare, sample) >= 2) | found(whole, PUBLISHER_PHRASE)))
    wrapper = found(start, WRAPPER[0]) & found(start, WRAPPER[1]) & (n < 5000)
    licensed = found(start, LICENSE)
    license_only = licensed & (n >= 8000) & (F.col("n_headings") > 0) & (F.col("license_headings") == F.col("n_headings"))
    rule = F.when(contents, "contents").when(gallery, "gallery").when(publisher, "publisher").when(wrapper, "wrapper").when(licensed & (n < 8000), "license").when(license_only, "license-only")
    promo = test(sample, "promo") & (n < 3500)
    toc = test(heading, "local_toc", "match") & (F.regexp_count(sample, F.lit(" ")) < 800)
    title = (heading != "") & ~test(heading, "chapter", "match") & ~test(heading, "promo") & (F.col("tag") == "h1") & (F.length(heading) < 100)
    by_heading = (
        F.when(test(heading, "frontmatter", "match"), "frontmatter")
        .when(test(heading, "backmatter", "match"), "backmatter")
        .when(test(heading, "divisions", "match"), "division")
        .when(test(heading, "cast", "match") | F.col("drama"), "play")
        .when(F.col("poetry"), "poetry")
        .when(title, "major_work")
    )
    front = F.lit(False)
    for w in FRONT_WORDS:
        front = front | F.contains(low, F.lit(w))
    kind = F.coalesce(by_heading, F.when(toc, "local_toc"), F.when(promo, "promo"), F.when(front & (F.col("doc_index") < 5), "frontmatter"), F.lit("chapter"))
    sure = F.when(toc, 0.80).when(promo, 0.78).otherwise(0.0)
    out = probed.withColumn("rule", rule).withColumn("by_heading", by_heading)
    early = F.col("rule").isNotNull()
    out = out.withColumn("kind", F.when(F.col("rule") == "contents", "local_toc").when(early, "promo").otherwise(kind))
    out = out.withColumn("remove", F.when(early, True).when(F.coalesce(F.col("by_heading").isin("play", "poetry"), F.lit(False)), False).otherwise(promo | toc))
    rates = {"contents": 0.90, "gallery": 0.88, "publisher": 0.94, "wrapper": 0.96, "license": 0.95, "license-only": 0.92}
    confidence = sure
    for name, rate in rates.items():
        confidence = F.when(F.coalesce(F.col("rule") == name, F.lit(False)), rate).otherwise(confidence)
    out = out.withColumn("confidence", confidence)
    titled = ~early & F.coalesce(F.col("by_heading").isin("frontmatter", "backmatter", "division", "major_work"), F.lit(False))
    return out.withColumn("major_title", F.when(titled, heading)).drop("by_heading")


def _so_far(book: str = "book"):
    return W.partitionBy(book).orderBy("doc_index").rowsBetween(W.unboundedPreceding, -1)


def drop_orphan_media(docs: DataFrame) -> DataFrame:
    """Removes short pictures without headings that follow a removed gallery in an unbroken chain, before any real work.

    Takes (book, doc_index, kind, remove, rule, n_chars, n_headings, images). A candidate
    goes if the last row before it that is no candidate or a gallery is a removed gallery and no kept
    work came yet.
    """
    real = ~F.col("remove") & (F.col("kind") == "major_work")
    candidate = ~real & (F.col("doc_index") <= 25) & (F.col("images") > 0) & (F.col("n_headings") == 0) & (F.col("n_chars") < 350)
    gallery = F.coalesce(F.col("remove") & (F.col("rule") == "gallery"), F.lit(False))
    seen = F.coalesce(F.max(real.cast("int")).over(_so_far()), F.lit(0)) == 1
    after = F.coalesce(F.last(F.when(~candidate | gallery, gallery), ignorenulls=True).over(_so_far()), F.lit(False))
    out = docs.withColumn("orphan", candidate & after & ~seen)
    return out.withColumn("kind", F.when(F.col("orphan"), "promo").otherwise(F.col("kind"))).withColumn("remove", F.col("remove") | F.col("orphan"))


def demote_late_frontmatter(docs: DataFrame) -> DataFrame:
    """Front matter that comes after a kept work, play, poem or back matter is a chapter."""
    real = ~F.col("remove") & F.col("kind").isin("major_work", "play", "poetry", "backmatter")
    late = ~F.col("remove") & (F.col("kind") == "frontmatter") & (F.coalesce(F.max(real.cast("int")).over(_so_far()), F.lit(0)) == 1)
    return docs.withColumn("late", late).withColumn("kind", F.when(F.col("late"), "chapter").otherwise(F.col("kind")))


def carry_forward(docs: DataFrame) -> DataFrame:
    """Adds current_work and current_division as they stand before each document.

    A kept division sets both, a kept work or back matter the work. Takes major_title.
    """
    title = F.nullif(display_title(F.col("major_title")), F.lit(""))
    division = F.when(~F.col("remove") & (F.col("kind") == "division"), title)
    work = F.when(~F.col("remove") & F.col("kind").isin(*BOUNDARY_KINDS), title)
    return docs.withColumn("current_work", F.last(work, ignorenulls=True).over(_so_far())).withColumn("current_division", F.last(division, ignorenulls=True).over(_so_far()))


def section(docs: DataFrame, query: str) -> DataFrame:
    """The documents of the first division, work or back matter of each book whose title's key is the query's.

    It ends before the next division if it is one, else before the next of the three.
    Takes major_title and heading. Books without such a title give no rows.
    """
    key = title_key(F.lit(query))
    hit = F.col("kind").isin(*BOUNDARY_KINDS) & ((title_key(display_title(F.col("major_title"))) == key) | (title_key(display_title(F.col("heading"))) == key)) & (key != "")
    book = W.partitionBy("book")
    rows = docs.withColumn("start", F.min(F.when(hit, F.col("doc_index"))).over(book))
    rows = rows.withColumn("start_kind", F.max(F.when(F.col("doc_index") == F.col("start"), F.col("kind"))).over(book))
    ends = F.when(F.col("start_kind") == "division", F.col("kind") == "division").otherwise(F.col("kind").isin(*BOUNDARY_KINDS))
    rows = rows.withColumn("end", F.min(F.when((F.col("doc_index") > F.col("start")) & ends, F.col("doc_index"))).over(book))
    return rows.where((F.col("doc_index") >= F.col("start")) & (F.col("end").isNull() | (F.col("doc_index") < F.col("end"))))


def within_budget(docs: DataFrame, budget: int) -> DataFrame:
    """Kept documents of each book until the words before one reach the budget (0: all)."""
    before = F.coalesce(F.sum(F.when(~F.col("remove"), F.col("n_words"))).over(_so_far()), F.lit(0))
    rows = docs.withColumn("words_before", before).where(~F.col("remove"))
    return rows.where(F.col("words_before") < budget) if budget > 0 else rows


def override(docs: DataFrame, decisions: DataFrame, threshold: float = 0.86) -> DataFrame:
    """External decisions by (book, doc_index): they replace kind and titles at any confidence, and remove only from the threshold on."""
    d = decisions.select("book", "doc_index", F.col("kind").alias("d_kind"), F.col("remove").alias("d_remove"), F.col("confidence").alias("d_confidence"))
    rows = docs.join(d, ["book", "doc_index"], "left")
    has = F.col("d_confidence").isNotNull()
    return rows.withColumn("kind", F.coalesce(F.nullif("d_kind", F.lit("")), "kind")).withColumn("remove", F.when(has, F.col("d_remove") & (F.col("d_confidence") >= threshold)).otherwise(F.col("remove"))).drop("d_kind", "d_remove", "d_confidence")
