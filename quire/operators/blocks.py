"""Blocks of a document in order: runs of verse, notes, contents, and line-level rewrites.

Runs are gaps and islands: a running sum of breaks numbers the islands, an aggregate
keeps those that are long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.patterns import found, test
from quire.functions.text import clean_text, display_title, letter_ratio, title_key, word_count

#: Phrases, vocabularies and shapes of the line predicates.
STRONG_PROMO = r"\b(delphi classics|project gutenberg license|gutenberg license|also available|other books by|more books by|subscribe|newsletter|visit our website|follow us|download our|app store|google play|goodreads|isbn)\b"
PROMO_CLASS = r"promo|advert|copyright|license|publisher|newsletter|subscribe|catalog|toc|nav"
BYLINE_ROLE = r"\b(translated|edited|selected|arranged|compiled|abridged|introduced|with an introduction)\s+by\b"
AUTHORED = r"(?i)^(.+?)\s+by\s+([A-Z][A-Za-z .,'’‘—–‐-]{2,80})$"
BOUNDARY = r"^\s*((chapter|book|part|act|scene)\s+([ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b|(the\s+)?author[’']?s\s+preface\b|preface\s+to\b|dedication\b)"
SPEECH = r"[\"'”’][,;:.!?]?\s*(said|asked|cried|replied|answered|whispered|exclaimed|thought)\b"
PRONOUN = r"\b(I|you|he|she|we|they|my|your|his|her|our|their)\b"
AUTHOR_NOTE = (r"\bAUTHOR[’'`ʼ]S\s+NOTE\b", r"^\*?\s*The\s+author\s+of\s+the\s+diary", r"\bAUTHORIAL\s+NOTE\b")
QUOTE_LED = r"^[\"'“‘—–]"
EDITORIAL = r"\b(was|were|is|are|published|appeared|written|wrote|composed|completed|novel|novella|story|tale|poem|play|drama|work|collection|translated|first|last|inspired|based|deals with|concerns|tells|features)\b"
STRONG_EDITORIAL = r"\b(published|appeared|written|wrote|composed|completed|novel|novella|story|tale|poem|play|drama|dialogue|dialogues|work|collection|translated|first|last|inspired|based|deals with|concerns|tells|features|regarded|acclaimed)\b"
BIBLIOGRAPHIC = r"\b(1[5-9]\d{2}|20\d{2}|Dostoevsky|Dostoyevsky|Tolstoy|Dickens|Balzac|Poe|Gogol|Turgenev|Plato|Socrates|Aristotle|Jowett)\b"
SUPPLEMENT = r"\b(author|translator|editor|published|publication|unfinished|fragment|prologue|novel|novella|story|poem|play|sketch|exile|arrest|execution|Siberia|writer|philosopher|antiquary|biographer|pupil|pupils)\b"
MONTH_LED = r"^(January|February|March|April|May|June|July|August|September|October|November|December)\b"
POSITION = r"\((left|right|above|below|centre|center)\)|\b(left|right|above|below):"
REFERENCE_LED = r"^(english translations|biographical and expository)\b"
REFERENCE = r"\btranslated by\b|\bselected and translated\b|\bwith introduction\b|\bvols?\.?\b|\bed\.?\b|\blibrary\b|\bphilosophical library\b|\bencyclop[a-z]* britannica\b|\bprofessor\b|\bby [A-Z][A-Za-z .'-]{2,40}\b"
CODE = r"^\s*(def|class|function|var|let|const|import|#include)\b|[{}<>]"
TITLE_PAGE = r"\b(dissertation|containing|together with|printed by|london|translated|edition|rudiments|government and society|by\s+[A-Z][A-Za-z]+|1[5-9]\d{2})\b"
IMAGE_FILE = r"^(img|image|pic|fig|figure)[_\- ]?\d+\.(jpe?g|png|gif|webp)$"
SIGNS = {
    "visual_issue": r"\b(FAIL|ISSUE|problem|warning|collision|crowd(ed|ing)?|touch(es|ing)?|misalign(ed|ment)?|wrong|broken|spill|overwide|narrow|ragged|unjustified|not justified|stranded|orphan|duplicate|blue|underlined|raw ebook|artifact|blank|empty|dark|black|cropped|oversized|missing|inappropriate)\b",
    "text_issue": r"\b(FAIL|ISSUE|problem|warning|duplicate|missing|wrong|residue|artifact|promo|publisher|caption|image|TOC|contents|chapter|heading|folio|page number|publisher-apparatus|vendor|boilerplate|catalogue|catalog|delphi classics|project gutenberg|gutenberg|subscribe|newsletter|ISBN|eBook|delphiclassics|ragged|unjustified|not justified|line spill|single-letter|blank|empty|raw ebook|blue|underlined|hyperlink|poetry|verse|drama|cast|stage direction)\b",
    "fine": r"\b(OK|PASS|passes|acceptable|clean|fine|none|no issues?|no problems?|not observed)\b",
    "fail": r"\bFAIL\b|\bISSUE\b",
}


def promotional(text: Column, classes: Column, links: Column, block: bool = False) -> Column:
    """Promotion by pattern and one more sign: a strong phrase, a telling class, links."""
    return test(text, "promo") & (F.length(text) < (2800 if block else 360)) & (found(F.lower(text), STRONG_PROMO) | found(classes, PROMO_CLASS) | (links > 0))


def authored_opener(text: Column) -> Column:
    """struct(title, author) of '<title> by <author>', or null."""
    s = display_title(text)
    title, author = display_title(F.regexp_extract(s, AUTHORED, 1)), display_title(F.regexp_extract(s, AUTHORED, 2))
    ok = F.rlike(s, F.lit(AUTHORED)) & ~found(s, BYLINE_ROLE) & (title != "") & (author != "") & (word_count(title) <= 10) & (word_count(author) <= 8)
    return F.when(ok & ~test(title, "chapter", "match") & ~test(title, "frontmatter", "match"), F.struct(title.alias("title"), author.alias("author")))


def short_caption(t: Column) -> Column:
    return (word_count(t) <= 14) & ~F.rlike(t, F.lit("[!?;:]")) & ~found(t, r"[,;:]\s+\b(I|he|she|we|they|you|it|my|his|her|their|our)\b")


def prose_or_dialogue(t: Column) -> Column:
    return (word_count(t) >= 22) | F.rlike(t, F.lit("^[\"'“‘].{8,}")) | found(t, SPEECH) | (found(t, PRONOUN) & F.rlike(t, F.lit("[.!?]$")))


def author_note(t: Column) -> Column:
    s = F.trim(t)
    return found(s, AUTHOR_NOTE[0]) | found(s, AUTHOR_NOTE[1]) | found(s, AUTHOR_NOTE[2])


def work_description(t: Column, heading: Column) -> Column:
    """An editor's words on the work under a heading."""
    s, n = clean_text(t), word_count(t)
    key, names = title_key(s), F.slice(F.filter(F.split(title_key(heading), " "), lambda w: F.length(w) > 2), 1, 3)
    titled = (F.size(names) > 0) & F.forall(names, lambda w: F.contains(key, w))
    shouted = F.rlike(F.substring(s, 1, 80), F.lit(r"\b(CHAPTER|BOOK|PART|SCENE|ACT)\b"))
    return ~author_note(s) & n.between(18, 260) & ~F.rlike(s, F.lit(QUOTE_LED)) & ~shouted & ((titled & found(s, STRONG_EDITORIAL)) | (found(s, EDITORIAL) & F.rlike(s, F.lit(BIBLIOGRAPHIC))))


def work_description_goes_on(t: Column) -> Column:
    return word_count(t).between(12, 320) & ~F.rlike(clean_text(t), F.lit(QUOTE_LED)) & ~found(clean_text(t), BOUNDARY)


def supplemental_description(t: Column) -> Column:
    s = clean_text(t)
    return word_count(s).between(8, 90) & ~F.rlike(s, F.lit(QUOTE_LED)) & ~found(F.substring(s, 1, 80), r"\b(CHAPTER|BOOK|PART|SCENE|ACT)\b") & ~F.rlike(s, F.lit(MONTH_LED)) & ~found(s, POSITION) & found(s, SUPPLEMENT)


def reference_entry(t: Column) -> Column:
    s = clean_text(t)
    years = F.regexp_count(s, F.lit(r"\b(?:1[6789][0-9]{2}|20[0-9]{2})\b"))
    return (word_count(s) >= 4) & (found(s, REFERENCE_LED) | (found(s, REFERENCE) & ((years >= 1) | (word_count(s) <= 30))))


def title_page_title(t: Column) -> Column:
    return word_count(t).between(2, 14) & ~found(t, BOUNDARY) & (letter_ratio(t) >= 0.62)


def title_page_apparatus(paragraphs: Column, work: Column) -> Column:
    """A source's own title page, from a document's paragraphs."""
    whole = clean_text(F.array_join(paragraphs, " "))
    lines = F.transform(paragraphs, clean_text)
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return (
        F.size(lines).between(3, 12) & F.forall(lines, lambda x: x != "") & title_page_title(first) & word_count(whole).between(30, 220)
        & ~F.coalesce(title_key(whole) == title_key(work), F.lit(False)) & ~F.exists(F.slice(lines, 2, 12), lambda x: word_count(x) > 70) & found(whole, TITLE_PAGE)
    )


def compact_contents(text: Column, line_array: Column, links: Column) -> Column:
    """A small table of contents inside a text, from its lines and links."""
    n = F.size(line_array)
    first = F.substring(clean_text(F.array_join(F.slice(line_array, 1, 4), " ")), 1, 220)
    short = F.size(F.filter(line_array, lambda x: word_count(x) <= 8))
    nav = F.size(F.filter(line_array, lambda x: test(x, "contents_line")))
    return (text != "") & (F.length(text) <= 2600) & found(first, r"\bcontents\b") & ((links >= 3) | ((n >= 6) & (nav >= 4) & (short / F.greatest(n, F.lit(1)) >= 0.7)))


def keep_image(policy: Column, src: Column, alt: Column, context: Column, width: Column, height: Column, standalone: Column, decision: Column, confidence: Column, threshold: float = 0.7) -> Column:
    """The image policy: switch, placeholders, plates, decision from outside, function; else the image goes."""
    name = lambda c: F.rlike(F.regexp_extract(clean_text(c), "([^/]*)$", 1), F.lit(f"(?i){IMAGE_FILE}"))
    small = F.coalesce((width <= 280) & (height <= 140), F.lit(False))
    placeholder = (name(alt) | name(src)) & standalone & (small | (context == ""))
    both = clean_text(F.concat_ws(" ", src, context))
    functional = test(both, "functional_image") | test(F.lower(src), "functional_image_src")
    plate = test(both, "plate_caption") | test(F.lower(src), "publisher_image_src")
    outside = F.coalesce(confidence >= threshold, F.lit(False))
    return F.when(policy == "keep-all", True).when(policy == "remove-all", False).when(placeholder, False).when(plate & ~functional, False).when(outside, decision).otherwise(functional)


def report_issues(t: Column, kind: str) -> Column:
    """Lines of a reviewer's report that tell of an issue: ``visual_issue`` or ``text_issue`` words, and no all-clear."""
    return F.filter(F.transform(F.split(t, "\n"), clean_text), lambda x: (x != "") & found(x, SIGNS[kind]) & (~found(x, SIGNS["fine"]) | found(x, SIGNS["fail"])))


def islands(rows: DataFrame, member: Column, book: str = "book", order: str = "line_no") -> DataFrame:
    """Rows that are members, with ``island``: one number for neighbours without a break between."""
    at = W.partitionBy(book).orderBy(order)
    return rows.withColumn("member", member).withColumn("island", F.sum(F.when(F.col("member"), 0).otherwise(1)).over(at.rowsBetween(W.unboundedPreceding, 0))).where("member").drop("member")


def verse_runs(lines: DataFrame, least: int = 4, longest: int = 76) -> DataFrame:
    """Runs of ``least`` short lines without a final period; a blank line ends one. (book, first_line, n, text)."""
    t = F.col("text")
    short = (F.length(t) >= 2) & (F.length(t) <= longest) & ~F.endswith(t, F.lit(".")) & ~test(t, "chapter", "match")
    runs = islands(lines, short).groupBy("book", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return runs.where(F.col("n") >= least).select("book", "first_line", "n", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def footnote_clusters(lines: DataFrame, least: int = 2) -> DataFrame:
    """Neighbouring lines that start with [n]; clusters of ``least`` become notes. (book, cluster, number, note_id, note)."""
    mark = r"^\[([0-9]+)\]\.?\s+"
    rows = islands(lines, F.rlike("text", F.lit(mark)))
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("book", "island"))).withColumn("cluster", F.min("line_no").over(W.partitionBy("book", "island"))).where(F.col("n") >= least)
    number = F.regexp_extract("text", mark, 1)
    return rows.select("book", "cluster", number.alias("number"), F.concat(F.lit("fn-"), number).alias("note_id"), F.regexp_replace("text", mark, "").alias("note"))


def stage_directions(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    return lines.where(F.rlike(t, F.lit(r"^\[.*\]$|^\(.*\)$")) & (F.length(t) < 240))


def cast_entries(lines: DataFrame) -> DataFrame:
    """Lines under a cast heading, up to the next act or scene, that name a person."""
    t = F.col("text")
    at = W.partitionBy("book").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("mark", F.when(test(t, "cast", "match"), True).when(test(t, "act_scene", "match"), False))
    rows = rows.withColumn("within", F.coalesce(F.last("mark", ignorenulls=True).over(at), F.lit(False))).where(F.col("within") & F.col("mark").isNull())
    entry = F.rlike(t, F.lit(r"^[A-Z][A-Z .'-]{2,35}([—–-]|,|\s{2,})")) | ((F.upper(t) == t) & (F.lower(t) != t))
    return rows.where((t != "") & (F.length(t) <= 240) & entry).drop("mark", "within")


def preformatted_verse(t: Column) -> Column:
    """Verse lines of a preformatted text, or null where it is too long or looks like code."""
    ls = F.filter(F.transform(F.split(t, "\n"), clean_text), lambda x: x != "")
    n, code = F.size(ls), F.size(F.filter(ls, lambda x: F.rlike(x, F.lit(CODE))))
    ok = n.between(1, 60) & (word_count(F.array_join(ls, " ")) <= 420) & (code < F.greatest(F.lit(2), F.floor(n / 3)))
    return F.when(ok, ls)
