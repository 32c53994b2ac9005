"""Checks that need a whole book or its layout: body start, folios, openers, title pages, contents window, fonts, images.

Lines are (book, page, line_no, text, y, size, font); pages count from 1. Pages'
texts are made once per book and page and joined back, so every check is an
aggregation or a window partitioned by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.patterns import found
from quire.functions.text import PT_PER_MM, clean_text, hex_color, title_key, word_count
from quire.operators.quality import finding

#: A contents page, a folio, an editor's line, pages that are looked at as images.
CONTENTS = r"\bCONTENTS\b|\bContents\b"
FOLIO = r"(?i)^([0-9]+|[ivxlcdm]+)$"
EDITOR_WORDS = r"\b(Dostoevsky|Dostoyevsky|published|publication|novel|novella|story|tale|poem|play|work|author|translator|editor|unfinished|fragment|prologue|exile|arrest|Siberia)\b"
EDITOR_LINE = r"^(A\s+(sketch|note|account|fragment)\b.{0,140}\b(author|translator|editor|published|exile|arrest|execution|Siberia)\b|[A-Z][\w'’:\-\s]{1,80}\s+(was|were|is|are)\s+(first\s+)?(published|written|composed|inspired|a|an)\b|(The|This)\s+(novel|novella|story|tale|poem|play|work)\b.{0,140}\b(was|is|deals|concerns|features|published|written|inspired)\b)"
SAMPLED = (0, 1, 2, 3, 4, 5, 8, 12, 20, 30, 50, 100)


def page_texts(lines: DataFrame) -> DataFrame:
    """(book, page, text, n_lines, last): a page's lines as one text, and its last line."""
    ls = F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("t"))))
    rows = lines.where(F.trim("text") != "").groupBy("book", "page").agg(ls.alias("ls"))
    return rows.select("book", "page", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("text"), F.size("ls").alias("n_lines"), F.element_at("ls", -1)["t"].alias("last"))


def first_body(lines: DataFrame, low: float = 760.0, scan: int = 30, reach: int = 12) -> DataFrame:
    """(book, first_page): after the last contents page of the first 30, the first of 12 pages with a line '1' below ``low``."""
    texts = page_texts(lines)
    after = texts.groupBy("book").agg(F.coalesce(F.max(F.when((F.col("page") <= scan) & F.rlike("text", F.lit(CONTENTS)), F.col("page"))), F.lit(0)).alias("after"))
    ones = lines.where((F.trim("text") == "1") & (F.col("y") > low)).join(after, "book").where((F.col("page") > F.col("after")) & (F.col("page") <= F.col("after") + reach))
    return ones.groupBy("book").agg(F.min("page").alias("first_page"))


def running_heads(lines: DataFrame, runner_pt: float, top: float = 95.0, most: int = 14) -> DataFrame:
    """(book, page) of pages with a small line of 14 words at most near the top that is no folio."""
    t = clean_text(F.col("text"))
    return lines.where((F.col("y") <= top) & (t != "") & ~F.rlike(t, F.lit(FOLIO)) & (F.col("size") <= runner_pt + 1.2) & (word_count(t) <= most)).select("book", "page").distinct()


def runner_rules(lines: DataFrame, first: DataFrame, settings: dict, width: float) -> DataFrame | None:
    """(book, page, x0, x1, y, weight, r, g, b): one rule per body page with a running head; None for other layouts."""
    if settings["runner_layout"].strip().lower() != "right_title_full_rule" or settings["runner_rule_style"].strip().lower() != "full_width":
        return None
    x0 = settings["margin_side_mm"] * PT_PER_MM
    rows = running_heads(lines, settings["runner_font_pt"]).join(first, "book", "left").where(F.col("page") >= F.coalesce("first_page", F.lit(1)))
    color = hex_color(F.lit(settings["runner_rule_color"]))
    return rows.select("book", "page", F.lit(x0).alias("x0"), F.lit(max(x0, width - x0)).alias("x1"), F.lit(settings["runner_rule_y_mm"] * PT_PER_MM).alias("y"), F.lit(settings["runner_rule_weight_pt"]).alias("weight"), color["r"].alias("r"), color["g"].alias("g"), color["b"].alias("b"))


def sampled_pages(pages: Column, most: int) -> Column:
    """Page numbers to look at as images: fixed ones that exist, and the last; at most so many."""
    fixed = F.filter(F.array(*(F.lit(p + 1).cast("long") for p in SAMPLED)), lambda p: p <= pages)
    return F.slice(F.array_distinct(F.concat(fixed, F.when(pages > 0, F.array(pages)).otherwise(F.array().cast("array<bigint>")))), 1, most)


def duplicate_title_pages(lines: DataFrame, titles: DataFrame, before: int = 12) -> DataFrame:
    """Books (book, title) with more than one page like a title page among the first pages."""
    rows = page_texts(lines).where((F.col("page") <= before) & ~F.rlike("text", F.lit(CONTENTS))).join(titles.select("book", title_key(F.col("title")).alias("k")), "book").where("k <> ''")
    like = rows.where((word_count(F.col("text")) <= 14) & F.startswith(title_key(F.col("text")), F.col("k")))
    return like.groupBy("book").agg(F.min("page").alias("page"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ", ").alias("d")).where("n > 1").select(*finding("duplicate_title_pages", F.col("d")))


def opener_pages(lines: DataFrame) -> DataFrame:
    """Display pages of eight words and three lines at most: with a printed folio, or with a page before or after that isn't blank."""
    texts = page_texts(lines)
    spine = W.partitionBy("book").orderBy("page")
    rows = texts.withColumn("before", F.lag("page").over(spine) == F.col("page") - 1).withColumn("after", F.lead("page").over(spine) == F.col("page") + 1)
    folio = F.rlike("last", F.lit(FOLIO))
    title = clean_text(F.when(folio, F.regexp_replace("text", r"\n?[^\n]*$", "")).otherwise(F.col("text")))
    rows = rows.withColumn("folio", folio).withColumn("title", title).withColumn("rows", F.col("n_lines") - F.col("folio").cast("int"))
    capitals = (F.upper("title") == F.col("title")) & (F.lower("title") != F.col("title"))
    display = capitals | F.rlike("title", F.lit(r"^[A-Z0-9][A-Z0-9'’:\-\s,;.]+$")) | ((word_count(F.col("title")) <= 4) & F.rlike("title", F.lit(r"^\p{Lu}")))
    rows = rows.where(~F.rlike("text", F.lit(CONTENTS)) & (F.col("title") != "") & (word_count(F.col("title")) <= 8) & (F.col("rows") <= 3) & display)
    why = F.filter(F.array(F.when(F.col("folio"), F.lit("carries a page number")), F.when(~F.col("folio") & F.coalesce("before", F.lit(False)), F.lit("no blank page before")), F.when(~F.col("folio") & F.coalesce("after", F.lit(False)), F.lit("no blank page after"))), lambda x: x.isNotNull())
    return rows.select("book", "page", F.explode(why).alias("d")).select(*finding("opener_pages", F.col("d")))


def contents_window(lines: DataFrame, within: int = 20, most: int = 4) -> DataFrame:
    """The lines of the contents: from the first page that says so, four pages at most among the first ones."""
    first = page_texts(lines).where((F.col("page") <= within) & F.rlike("text", F.lit(CONTENTS))).groupBy("book").agg(F.min("page").alias("start"))
    return lines.join(first, "book").where((F.col("page") >= F.col("start")) & (F.col("page") < F.col("start") + most) & (F.col("page") <= within)).drop("start")


def first_folio(lines: DataFrame, reach: int = 6) -> DataFrame:
    """Books whose first page with text after the contents prints a number other than 1 among its last four lines."""
    texts = page_texts(lines)
    after = texts.where((F.col("page") <= 20) & F.rlike("text", F.lit(CONTENTS))).groupBy("book").agg(F.max("page").alias("after"))
    body = lines.where((F.trim("text") != "") & ~F.rlike(F.trim("text"), F.lit(FOLIO))).join(after, "book").where((F.col("page") > F.col("after")) & (F.col("page") <= F.col("after") + reach)).groupBy("book").agg(F.min("page").alias("page"))
    back = F.row_number().over(W.partitionBy("book", "page").orderBy(F.desc("line_no")))
    tail = lines.where(F.trim("text") != "").join(body, ["book", "page"], "left_semi").withColumn("back", back).where("back <= 4")
    number = F.max_by(F.trim("text"), F.when(F.rlike(F.trim("text"), F.lit("^[0-9]+$")), F.col("line_no")))
    return tail.groupBy("book", "page").agg(number.alias("d")).where("d is not null and d <> '1'").select(*finding("first_body_folio", F.col("d")))


def missing_leaders(lines: DataFrame, within: int = 12) -> DataFrame:
    """Books whose early pages say Contents and have no leader with a number."""
    rows = lines.where(F.col("page") <= within).groupBy("book").agg(F.bool_or(F.contains("text", F.lit("Contents"))).alias("says"), F.bool_or(F.rlike("text", F.lit(r"\.{2,}\s*[0-9]+"))).alias("leads"), F.min("page").alias("page"))
    return rows.where("says and not leads").select(*finding("toc_page_numbers", F.lit("no leaders")))


def description_style(lines: DataFrame, body_pt: float, delta: float, low: float = 220.0) -> DataFrame:
    """Editors' lines near the top that aren't italic or are larger than the description size."""
    want = max(6.0, body_pt + delta) + 0.25
    t = clean_text(F.col("text"))
    line = (word_count(t) >= 8) & F.rlike(t, F.lit(r"^\p{Lu}")) & found(t, EDITOR_WORDS) & F.rlike(t, F.lit(EDITOR_LINE))
    return lines.where(line & (F.col("y") <= low) & (~F.contains(F.lower("font"), F.lit("ital")) | (F.col("size") > want))).select(*finding("work_description_style", F.substring(t, 1, 180)))


def missing_font(fonts: DataFrame, family: str) -> DataFrame:
    """Books (book, font) none of whose fonts is of the family."""
    bare = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    rows = fonts.groupBy("book").agg(F.bool_or(F.contains(bare(F.col("font")), bare(F.lit(family)))).alias("there"))
    return rows.where(~F.col("there")).select("book", F.lit(0).cast("long").alias("page"), F.lit("font_embedding").alias("check"), F.lit(family).alias("detail"))


def blank_artifacts(pages: DataFrame) -> DataFrame:
    """Pages (book, page, text, drawings, images) without text that show something."""
    return pages.where((clean_text(F.col("text")) == "") & ((F.col("drawings") > 0) | (F.col("images") > 0))).select(*finding("blank_page_artifacts", F.col("drawings") + F.col("images")))


def dark_pages(pixels: DataFrame, least: float = 45.0) -> DataFrame:
    """Sampled pages (book, page, grey) whose mean grey is under the limit."""
    return pixels.groupBy("book", "page").agg(F.avg("grey").alias("m")).where(F.col("m") < least).select(*finding("dark_pages", F.round("m", 1)))
