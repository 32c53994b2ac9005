"""Page-level quality checks over laid-out lines, their findings and the report.

Lines are (book, page, line_no, text) with geometry where a check needs it (y, size,
font, width). A check gives findings (book, page, check, detail); the summary, blockers
and report are aggregations of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.patterns import found
from quire.functions.text import clean_text, title_key, word_count

#: Finding lists that block delivery, marks of headings, image file names, apparatus.
BLOCKERS = ("non_trim_pages", "dark_pages", "blank_page_artifacts", "header_collisions", "line_spills", "toc_duplicates", "image_file_names", "empty_content_pages", "duplicate_title_pages", "opener_pages", "work_description_style", "first_body_folio", "source_apparatus", "visual_flags", "text_flags", "font_embedding", "orphan_pages")
HEADING_LINE = r"^[ivxlcdm]+$|^\d+$|^(chapter|part|act|scene)\b"
TAIL_HEADING = r"^(chapter|part|section|act|scene|book|canto|epilogue|prologue|appendix|introduction|preface|foreword)\b"
IMAGE_NAME = r"(?i)\b(?:img|image|pic|fig|figure)[_\- ]?[0-9]+\.(?:jpe?g|png|gif|webp)\b"
APPARATUS = r"\b(transcriber[’']?s?\s+notes?|project gutenberg|produced by|e-?text prepared by|replicate this text|non-standard spelling|variations in spelling|typographical errors)\b"
STRIP = r"^[\s.,;:!?()\[\]{}'\"“”‘’—–-]+|[\s.,;:!?()\[\]{}'\"“”‘’—–-]+$"


def bad_spill(line: Column) -> Column:
    """A line that is one lower-case letter and no Roman numeral."""
    s = F.regexp_replace(line, STRIP, "")
    return F.rlike(s, F.lit("^[a-z]$")) & ~F.rlike(s, F.lit("(?i)^[ivxlcdm]+$"))


def finding(check: str, detail: Column) -> list[Column]:
    return [F.col("book"), F.col("page"), F.lit(check).alias("check"), detail.cast("string").alias("detail")]


def line_spills(lines: DataFrame, most: int = 8) -> DataFrame:
    """Pages with stray letters, the first ones of each page joined by spaces."""
    rows = lines.where(bad_spill(F.col("text"))).withColumn("n", F.row_number().over(W.partitionBy("book", "page").orderBy("line_no"))).where(F.col("n") <= most)
    return rows.groupBy("book", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("d")).select(*finding("line_spills", F.col("d")))


def orphan_pages(lines: DataFrame, after: int = 10, most: int = 3) -> DataFrame:
    """Pages past the tenth with one to three lines of more than three letters that aren't all capitals."""
    s = F.trim("text")
    capitals = (F.upper(s) == s) & (F.lower(s) != s)
    n = F.count(F.when((F.length(s) > 3) & ~capitals, 1))
    return lines.where(F.col("page") > after).groupBy("book", "page").agg(n.alias("n")).where((F.col("n") > 0) & (F.col("n") <= most)).select(*finding("orphan_pages", F.col("n")))


def widows(lines: DataFrame) -> DataFrame:
    """On pages of three lines or more: the first of the top three lines that is under 15 letters, and the last line, unless they are headings or numbers."""
    rows = lines.withColumn("t", F.trim("text")).where("t <> ''")
    page = W.partitionBy("book", "page")
    rows = rows.withColumn("n", F.row_number().over(page.orderBy("line_no"))).withColumn("all", F.count("*").over(page)).where("all >= 3")
    # only the first short line of the page counts, and only among the top three
    short = rows.where(F.length("t") < 15).withColumn("k", F.row_number().over(page.orderBy("n"))).where("k = 1 and n <= 3 and page > 1")
    top = short.where(~found(F.col("t"), HEADING_LINE)).select(*finding("widow_lines", F.substring("t", 1, 80)))
    last = rows.where((F.col("n") == F.col("all")) & (F.length("t") > 3) & ~found(F.col("t"), HEADING_LINE)).select(*finding("widow_lines", F.substring("t", 1, 80)))
    return top.unionAll(last)


def stranded_headings(lines: DataFrame) -> DataFrame:
    """The first heading among the last four lines of a page of three lines or more."""
    rows = lines.withColumn("t", F.trim("text")).where("t <> ''")
    page = W.partitionBy("book", "page")
    rows = rows.withColumn("back", F.row_number().over(page.orderBy(F.desc("line_no")))).withColumn("all", F.count("*").over(page))
    rows = rows.where((F.col("all") >= 3) & (F.col("back") <= 4) & (F.col("page") > 1) & found(F.col("t"), TAIL_HEADING))
    return rows.groupBy("book", "page").agg(F.min_by("t", "line_no").alias("d")).select(*finding("stranded_headings", F.substring("d", 1, 100)))


def narrow_columns(blocks: DataFrame, least: float = 300.0) -> DataFrame:
    """Blocks (book, page, y, width): pages whose upper median width is under ``least`` points."""
    rows = blocks.where("y > 80 and y < 760 and width > 20").groupBy("book", "page").agg(F.array_sort(F.collect_list("width")).alias("w"))
    median = F.element_at("w", F.expr("cast(size(w) div 2 + 1 as int)"))
    return rows.withColumn("m", median).where(F.col("m") < least).select(*finding("narrow_columns", F.round("m", 1)))


def header_collisions(lines: DataFrame, least_y: float, runner_limit: float) -> DataFrame:
    """Lines (…, y, size): pages whose first body line is above ``least_y``; running heads, margins and folios don't count."""
    body = lines.where((F.trim("text") != "") & (F.col("y") >= 60) & (F.col("y") <= 790) & ~((F.col("y") < 135) & (F.col("size") <= runner_limit)))
    return body.groupBy("book", "page").agg(F.min("y").alias("y")).where(F.col("y") < least_y).select(*finding("header_collisions", F.round("y", 2)))


def image_names(lines: DataFrame, most: int = 12) -> DataFrame:
    """Pages that show file names of images, sorted."""
    names = F.regexp_extract_all("text", F.lit(IMAGE_NAME), F.lit(0))
    rows = lines.select("book", "page", F.explode(names).alias("name")).distinct()
    return rows.groupBy("book", "page").agg(F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, most), " ").alias("d")).select(*finding("image_file_names", F.col("d")))


def source_apparatus(lines: DataFrame, first_body: int = 1, pages: int = 6) -> DataFrame:
    rows = lines.where((F.col("page") >= first_body) & (F.col("page") < first_body + pages))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("book", "page").agg(clean_text(text).alias("d")).where(found(F.col("d"), APPARATUS)).select(*finding("source_apparatus", F.substring("d", 1, 240)))


def empty_pages(lines: DataFrame, title: Column, after: int = 4, most: int = 12) -> DataFrame:
    """Pages past the fourth that hold a title and little else."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    rows = lines.groupBy("book", "page").agg(clean_text(text).alias("d"), F.max(title_key(title)).alias("k"))
    return rows.where((F.col("page") > after) & (F.col("k") != "") & (word_count(F.col("d")) <= most) & F.startswith(title_key(F.col("d")), F.col("k"))).select(*finding("empty_content_pages", F.substring("d", 1, 180)))


def trim_sizes(pages: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Pages (book, page, width, height, want_width, want_height) that are off by more than the tolerance."""
    off = (F.abs(F.col("width") - F.col("want_width")) > tolerance) | (F.abs(F.col("height") - F.col("want_height")) > tolerance)
    return pages.where(off).select(*finding("non_trim_pages", F.concat_ws("x", F.round("width", 2).cast("string"), F.round("height", 2).cast("string"))))


def summary(findings: DataFrame) -> DataFrame:
    """(book, check, n, pages): findings per check, whether it blocks."""
    return findings.groupBy("book", "check").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages")).withColumn("blocks", F.col("check").isin(*BLOCKERS))


def verdict(findings: DataFrame) -> DataFrame:
    """(book, findings, blockers, blocked)."""
    hit = F.col("check").isin(*BLOCKERS)
    return findings.groupBy("book").agg(F.count("*").alias("findings"), F.count(F.when(hit, 1)).alias("blockers"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("blocked"))


def report(findings: DataFrame, most: int = 80) -> DataFrame:
    """(book, check, lines): the first ``most`` findings of each check, a line each."""
    n = F.row_number().over(W.partitionBy("book", "check").orderBy("page", "detail"))
    rows = findings.withColumn("n", n).where(F.col("n") <= most)
    line = F.concat(F.lit("- p. "), F.col("page").cast("string"), F.lit(": "), F.coalesce("detail", F.lit("")))
    return rows.groupBy("book", "check").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
