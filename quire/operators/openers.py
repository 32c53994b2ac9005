"""Openers of documents and what depends on a document's first block.

Blocks are those of the cleaner chain; documents are (book, doc_index, kind,
major_title, current_work) in spine order, current_work as the documents before left it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.patterns import test
from quire.functions.text import clean_text, display_title, title_key, word_count
from quire.operators.blocks import IMAGE_FILE
from quire.operators.cleaning import DOC, add_class, has_class

#: Kinds that open works of their own, and the largest heading level looked at by each rule.
WORK_KINDS = ("major_work", "play", "backmatter")
CONTINUED = ("major_work", "play", "backmatter", "division")
FEW_WORDS, RICH_CONTENTS = 10, 5


def image_dimension(raw: Column) -> Column:
    """The number that a width or height begins with; null if it begins with none."""
    return F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def clear_generic_alt(alt: Column) -> Column:
    """An image's words, or nothing if they are but a camera's file name."""
    return F.when(F.rlike(F.lower(F.trim(F.coalesce(alt, F.lit("")))), F.lit(IMAGE_FILE)), F.lit("")).otherwise(F.coalesce(alt, F.lit("")))


def first_blocks(blocks: DataFrame) -> DataFrame:
    """Each document's first block with text or an image."""
    shows = (clean_text(F.col("text")) != "") | (F.col("images") > 0)
    at = F.row_number().over(W.partitionBy(*DOC).orderBy("block_no"))
    return blocks.where(shows).withColumn("_k", at).where("_k = 1").drop("_k")


def repeated_titles(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """(book, doc_index, block_no, text) of first blocks that only say the work's title again, in documents that go on with it."""
    goes_on = docs.where(F.col("current_work").isNotNull() & ~F.col("kind").isin(*CONTINUED)).select(*DOC, "current_work")
    first = first_blocks(blocks).where(F.col("tag").isin("p", "div"))
    same = (word_count(F.col("text")) <= FEW_WORDS) & (title_key(F.col("text")) == title_key(F.col("current_work")))
    return first.join(goes_on, list(DOC)).where(same).select(*DOC, "block_no", "text")


def _opener(tag: str, *classes: str) -> list[Column]:
    return [F.lit(-1).cast("long").alias("block_no"), F.lit(tag).alias("tag"), F.col("_title").alias("text"), F.lit(" ".join((*classes, "formal-opener", "synthetic-opener"))).alias("classes")]


def synthetic_openers(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Headings to put before documents that open a new work which none of their own headings names."""
    key = F.coalesce(title_key(F.col("current_work")), F.lit(""))
    due = docs.withColumn("_title", display_title(F.col("major_title"))).where((F.coalesce("_title", F.lit("")) != "") & F.col("kind").isin(*WORK_KINDS) & ((key == "") | (key != title_key(F.col("_title")))))
    heads = blocks.where(F.col("level").between(1, 2)).select(*DOC, F.lower(clean_text(F.col("text"))).alias("_head"))
    named = due.join(heads, list(DOC)).where(F.contains("_head", F.lower("_title"))).select(*DOC).distinct()
    return due.join(named, list(DOC), "left_anti").select(*DOC, *_opener("h1", "major-work"))


def front_openers(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Headings to put before front matter that has a title and no heading with it."""
    due = docs.withColumn("_title", display_title(F.col("major_title"))).where((F.col("kind") == "frontmatter") & (F.coalesce("_title", F.lit("")) != ""))
    heads = blocks.where(F.col("level").between(1, 3)).select(*DOC, title_key(F.col("text")).alias("_key"))
    named = due.withColumn("_key", title_key(F.col("_title"))).join(heads, [*DOC, "_key"], "left_semi").select(*DOC)
    return due.join(named, list(DOC), "left_anti").select(*DOC, *_opener("h2", "frontmatter-opener"))


def merge_preformatted(blocks: DataFrame, name: str = "pre-verse-block") -> DataFrame:
    """Neighbouring blocks of preformatted verse become one, the first, lines in order."""
    member = has_class(name)
    order = W.partitionBy(*DOC).orderBy("block_no")
    rows = blocks.withColumn("_m", member).withColumn("_run", F.sum((~F.col("_m") | ~F.coalesce(F.lag("_m").over(order), F.lit(False))).cast("int")).over(order))
    run = W.partitionBy(*DOC, "_run").orderBy("block_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("_text", F.array_join(F.collect_list("text").over(run), "\n")).withColumn("_first", F.min("block_no").over(run))
    return rows.where("block_no = _first").withColumn("text", F.when(F.col("_m"), F.col("_text")).otherwise(F.col("text"))).select(*blocks.columns)


def merge_letter_spills(pieces: Column) -> Column:
    """Inline pieces of a block: of the lone letters after a piece that doesn't end in a letter or digit, the last joins that piece."""
    def spilt(i: Column) -> Column:
        before, here = F.trim(F.get(pieces, i - 1)), F.trim(F.get(pieces, i))
        return (i > 0) & F.rlike(here, F.lit(r"^\p{L}$")) & F.coalesce(F.rlike(before, F.lit(r"[^\p{L}\p{N}]$")), F.lit(False))

    at = F.array_max(F.transform(pieces, lambda _, i: F.when(spilt(i), i).otherwise(F.lit(-1))))
    joined = F.transform(pieces, lambda x, i: F.when(i == at - 1, F.concat(x, F.trim(F.get(pieces, at)))).otherwise(x))
    return F.when(F.coalesce(at, F.lit(-1)) < 1, pieces).otherwise(F.concat(F.slice(joined, F.lit(1), at), F.slice(joined, at + 2, F.size(pieces))))


def matches_contents(docs: DataFrame, blocks: DataFrame, keys: DataFrame, headings: int = 4, words: int = 24) -> DataFrame:
    """(book, doc_index) of documents one of whose titles stands in the source's contents, keys (book, key)."""
    titles = docs.select(*DOC, F.explode(F.array("major_title", "division")).alias("t"))
    heads = blocks.where(F.col("level").between(1, 3)).withColumn("_k", F.row_number().over(W.partitionBy(*DOC).orderBy("block_no"))).where(F.col("_k") <= headings).select(*DOC, F.col("text").alias("t"))
    whole = blocks.groupBy(*DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), " ").alias("t")).where((clean_text(F.col("t")) != "") & (word_count(F.col("t")) <= words))
    found = titles.unionByName(heads).unionByName(whole).select(*DOC, title_key(F.col("t")).alias("key")).where("key <> ''")
    return found.join(keys, ["book", "key"], "left_semi").select(*DOC).distinct()


def embedded_breaks(blocks: DataFrame, name: str = "embedded-authored-work") -> DataFrame:
    """(book, doc_index) of documents that begin with an embedded work, all but the book's first of them."""
    opens = first_blocks(blocks).where(has_class(name)).select(*DOC)
    return opens.withColumn("_k", F.row_number().over(W.partitionBy("book").orderBy("doc_index"))).where("_k > 1").select(*DOC)


def forced_work(docs: DataFrame, contents: DataFrame, title: str, volume: str = "auto") -> DataFrame:
    """Documents with current_work set to the volume's title in chapters and poems of a single book.

    A collection keeps its works, and so does a book whose source contents (book, key)
    name five works or more, unless the volume is said to be single.
    """
    if not title.strip() or volume.strip().lower() == "collection":
        return docs
    rich = contents.groupBy("book").agg(F.countDistinct("key").alias("_n"))
    rows = docs.join(rich, "book", "left")
    may = F.lit(volume.strip().lower() == "single") | (F.coalesce("_n", F.lit(0)) < RICH_CONTENTS)
    chapter = F.col("kind").isin("chapter", "poetry") | test(F.coalesce("heading", F.lit("")), "chapter", "match")
    return rows.withColumn("current_work", F.when(may & chapter, display_title(F.lit(title))).otherwise(F.col("current_work"))).drop("_n")


def with_openers(blocks: DataFrame, openers: DataFrame) -> DataFrame:
    """Blocks with the openers put before their documents."""
    rows = openers.withColumn("level", F.substring("tag", 2, 1).cast("int"))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(0 if f.dataType.typeName() in ("integer", "long") else "").cast(f.dataType).alias(f.name) for f in blocks.schema]
    return blocks.unionByName(rows.select(*typed))


def mark_class(blocks: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Adds a class to every block of the given documents."""
    rows = blocks.join(docs.select(*DOC, F.lit(True).alias("_hit")), list(DOC), "left")
    return rows.withColumn("classes", F.when(F.col("_hit"), add_class(name)).otherwise(F.col("classes"))).select(*blocks.columns)
