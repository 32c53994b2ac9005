"""Books put together from fragments: routing, title pages, contents, one HTML document each."""

from __future__ import annotations

from collections.abc import Mapping
from html import escape
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_text, html_escape
from quire.plans.settings import DEFAULTS

#: A front-matter fragment, titles of collections in both word orders.
FRONT = r'<section[^>]+class="[^"]*\bdoc-frontmatter\b'
WORKS_OF = r"(?i)^\s*(Complete|Collected)\s+Works\s+of\s+(.+?)\s*$"
OF_WORKS = r"(?i)^\s*(.+?)\s+(Collected|Complete)\s+Works\s*$"


def title_page(title: Column) -> Column:
    """The title page's inner markup: a collection's parts apart, any other title as a heading."""
    t = clean_text(title)
    div = lambda c, x: F.concat(F.lit(f'<div class="title-{c}">'), x, F.lit("</div>"))
    works = lambda x: F.concat(F.initcap(x), F.lit(" Works"))
    return (
        F.when(F.rlike(t, F.lit(WORKS_OF)), F.concat(div("collection", works(F.regexp_extract(t, WORKS_OF, 1))), div("of", F.lit("of")), div("author", html_escape(F.regexp_extract(t, WORKS_OF, 2)))))
        .when(F.rlike(t, F.lit(OF_WORKS)), F.concat(div("author", html_escape(F.regexp_extract(t, OF_WORKS, 1))), div("collection", works(F.regexp_extract(t, OF_WORKS, 2)))))
        .otherwise(F.concat(F.lit("<h1>"), html_escape(title), F.lit("</h1>")))
    )


def compose(fragments: DataFrame, books: DataFrame, contents: DataFrame, settings: Mapping[str, Any] | None = None, back: DataFrame | None = None) -> DataFrame:
    """Fragments (book, seq, html), books (book, title), contents (book, html) -> (book, html).

    Front matter goes before the body, each in its order. A book without fragments has
    an empty body; without contents it has no contents page. Settings add a half title,
    a subtitle and a source note or leave the title page out; ``back`` (book, html) is
    a second table of contents after the body.
    """
    s = {**DEFAULTS, **(settings or {})}
    front = F.rlike("html", F.lit(FRONT))
    join = lambda keep: F.array_join(F.transform(F.filter(F.col("fs"), keep), lambda x: x["html"]), "\n")
    parts = fragments.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("seq", "html", front.alias("front")))).alias("fs"))
    parts = parts.select("book", join(lambda x: x["front"]).alias("front"), join(lambda x: ~x["front"]).alias("body"))
    rows = books.select("book", "title").join(parts, "book", "left").join(contents.select("book", F.col("html").alias("toc")), "book", "left")
    rows = rows.join(back.select("book", F.col("html").alias("back")), "book", "left") if back is not None else rows.withColumn("back", F.lit(""))
    page = lambda classes, x, end="": F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f'<section class="{classes}"><h1>Contents</h1>'), x, F.lit(f"</section>{end}"))).otherwise(F.lit(""))
    title = html_escape(F.col("title"))
    nothing = F.lit("")
    half = F.concat(F.lit('<section class="frontmatter half-title-page"><h1>'), title, F.lit("</h1></section>\n")) if s["include_half_title_page"] else nothing
    sub = f'<div class="subtitle">{escape(s["title_page_subtitle"])}</div>' if s["title_page_subtitle"].strip() else ""
    named = F.concat(F.lit('<section class="frontmatter title-page">'), title_page(F.col("title")), F.lit(f"{sub}</section>\n")) if s["include_title_page"] else nothing
    note = F.lit(f'<section class="frontmatter source-page"><p class="no-indent">{escape(s["source_note_text"])}</p></section>\n' if s["include_source_note"] and s["source_note_text"].strip() else "")
    html = F.concat(
        F.lit('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'), title, F.lit('</title>\n<link rel="stylesheet" href="style.css">\n</head>\n<body>\n'), half, named, note,
        page("frontmatter toc-page", F.col("toc"), "\n"), F.coalesce("front", nothing), F.lit('\n<main class="main">\n'), F.coalesce("body", nothing), F.lit("\n"), page("toc-page back-toc-page", F.col("back"), "\n"), F.lit("</main>\n</body>\n</html>"),
    )
    return rows.select("book", html.alias("html"))


def write(books: DataFrame, path: str) -> None:
    """A folder per book, its document as text."""
    books.select("book", F.col("html").alias("value")).write.mode("overwrite").partitionBy("book").option("lineSep", "\n").text(path)
