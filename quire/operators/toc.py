"""Tables of contents: usable entries, levels, page numbers, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.patterns import found
from quire.functions.text import display_title, html_escape, title_key, toc_title

#: Fixed value: titles of a source's own contents pages.
SOURCE_CONTENTS = r"^((the\s+)?principal\s+contents\.?|series\s+contents|alphabetical\s+list\s+of\s+titles|(list\s+of\s+)?illustrations)$"


def usable(entries: DataFrame, targets: DataFrame | None = None, book_title: Column | None = None, simple: bool = False) -> DataFrame:
    """Entries (book, seq, level, title, target_id, kind, source_level) worth printing.

    Blank titles, source contents and the book's own title go; simple tables keep the
    source's top level if there is one, else level 1; targets must exist. Of entries
    with one key the first that is left stays, and a table of one entry is none.
    """
    key = title_key(display_title(F.col("title")))
    rows = entries.withColumn("key", key).where((key != "") & ~found(display_title(F.col("title")), SOURCE_CONTENTS))
    if book_title is not None:
        rows = rows.where(F.col("key") != title_key(book_title))
    if simple:
        top = F.max((F.col("source_level") == 1).cast("int")).over(W.partitionBy("book")) == 1
        rows = entries.withColumn("key", key).withColumn("top", top).where((key != "") & ~found(display_title(F.col("title")), SOURCE_CONTENTS))
        if book_title is not None:
            rows = rows.where(F.col("key") != title_key(book_title))
        rows = rows.where(F.when(F.col("top"), (F.col("source_level") == 1) & ~F.col("kind").isin("frontmatter", "backmatter")).otherwise(F.col("level") <= 1)).drop("top")
    if targets is not None:
        rows = rows.join(targets.select("book", "target_id").distinct(), ["book", "target_id"], "left_semi")
    first = F.row_number().over(W.partitionBy("book", "key").orderBy("seq"))
    rows = rows.withColumn("n", first).where("n = 1").drop("n")
    return rows.withColumn("n", F.count("*").over(W.partitionBy("book"))).where("n > 1").drop("n")


def level(simple: bool = False) -> Column:
    return F.lit(1) if simple else F.greatest(F.lit(1), F.least(F.col("level"), F.lit(4)))


def item(simple: bool = False, numbered: bool = False) -> Column:
    """The markup of one entry; with page numbers from a column page_no that may be null."""
    title, target = html_escape(toc_title(F.col("title"))), html_escape(F.col("target_id"))
    head = F.concat(F.lit('<li class="toc-level-'), level(simple).cast("string"), F.lit(" toc-kind-"), html_escape(F.col("kind")))
    if not numbered:
        return F.concat(head, F.lit('"><a href="#'), target, F.lit('">'), title, F.lit("</a></li>"))
    missing = F.when(F.col("page_no").isNull(), F.lit(" toc-missing-page")).otherwise(F.lit(""))
    return F.concat(head, missing, F.lit('"><a href="#'), target, F.lit('"><span class="toc-entry-title">'), title, F.lit('</span><span class="toc-leader" aria-hidden="true"></span><span class="toc-page-number">'), F.coalesce(F.col("page_no").cast("string"), F.lit("")), F.lit("</span></a></li>"))


def markup(entries: DataFrame, simple: bool = False, numbered: bool = False) -> DataFrame:
    """(book, html): each book's entries in order as one list."""
    classes = f"toc-list toc-{'simple' if simple else 'hierarchical'}{' toc-explicit' if numbered else ''}"
    items = F.array_sort(F.collect_list(F.struct("seq", item(simple, numbered).alias("li"))))
    body = F.array_join(F.transform(items, lambda x: x["li"]), "\n")
    return entries.groupBy("book").agg(F.concat(F.lit(f'<ol class="{classes}">\n'), body, F.lit("\n</ol>")).alias("html"))


def page_numbers(links: DataFrame, entries: DataFrame, first_body: DataFrame) -> DataFrame:
    """Links (book, page, y, x, target_id, target_page) -> (book, target_id, page_no).

    The first link to a target in reading order decides; page 1 is the first body page
    (book, first_page), or the earliest target where that is unknown.
    """
    wanted = links.join(entries.select("book", "target_id").distinct(), ["book", "target_id"], "left_semi")
    at = wanted.groupBy("book", "target_id").agg(F.min_by("target_page", F.struct("page", "y", "x")).alias("at"))
    at = at.join(first_body, "book", "left").withColumn("earliest", F.min("at").over(W.partitionBy("book")))
    return at.select("book", "target_id", F.greatest(F.lit(1), F.col("at") - F.coalesce("first_page", "earliest") + 1).cast("long").alias("page_no"))


def duplicates(lines: DataFrame, least: int = 4) -> DataFrame:
    """Lines (book, line) of printed contents -> (book, key, n) of the titles that come ``least`` times or more; leaders are cut."""
    key = title_key(F.regexp_replace("line", r"\.{2,}\s*\d+\s*$", ""))
    return lines.select("book", key.alias("key")).where("key not in ('', 'contents')").groupBy("book", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_page(lines: DataFrame) -> DataFrame:
    """(book, numbers, different): books in whose contents eight numbers or more are two different ones at most."""
    number = F.regexp_extract("line", r"\.{2,}\s*(\d+)\s*$", 1)
    return lines.select("book", number.alias("no")).where("no <> ''").groupBy("book").agg(F.count("*").alias("numbers"), F.countDistinct("no").alias("different")).where("numbers >= 8 and different <= 2")
