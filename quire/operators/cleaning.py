"""The cleaner chain over blocks: removals, rewrites and marks, in a fixed order, with an audit.

Blocks (book, doc_index, block_no, tag, level, text, classes, ident, within, links,
images, src, alt, breaks) go in and come out; a removal is a filter whose rows also go
to the audit (book, doc_index, block_no, reason, sample). Marks add classes. Sibling
rules are windows over a document's blocks: gaps and islands, the last heading, the
neighbours. One shuffle by document serves them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.patterns import found, test
from quire.functions.text import clean_text, display_title, html_escape, resolve_src, small_caps, title_key, typography, word_count
from quire.operators import blocks as rules

#: Fixed values of the chain: openers, captions, position words, elements that are left alone.
POSITIONED = r"\((left|right|above|below|centre|center)\)"
CAPTION_LED = r"^((the )?author[’']?s |(portrait|photo|photograph|frontispiece|illustration|birthplace|grave|tomb|statue|monument|museum|translated by)\b)"
CAPTION_CLASS = r"caption|fig|image|photo|plate"
LITERAL = ("pre", "code", "kbd", "samp")
DIVIDERS = ("collection-division", "major-work", "backmatter-opener")

DOC = ("book", "doc_index")
Step = Callable[[DataFrame], DataFrame]


def _doc():
    return W.partitionBy(*DOC)


def _order():
    return _doc().orderBy("block_no")


def add_class(*names: str) -> Column:
    """The block's classes and some more, each once."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.split("classes", " "), F.array(*map(F.lit, names))), lambda x: x != "")), " ")


def mark(df: DataFrame, where: Column, *names: str) -> DataFrame:
    return df.withColumn("classes", F.when(where, add_class(*names)).otherwise(F.col("classes")))


def has_class(name: str) -> Column:
    return F.array_contains(F.split("classes", " "), name)


def drop(df: DataFrame, where: Column, reason: str) -> DataFrame:
    """Marks blocks as removed for a reason; the first reason stays."""
    return df.withColumn("removed", F.when(F.col("removed").isNull() & where, reason).otherwise(F.col("removed")))


def live(df: DataFrame) -> DataFrame:
    return df.where("removed is null")


def _heading() -> Column:
    return F.col("level") > 0


def source_contents(df: DataFrame) -> DataFrame:
    """Empties documents whose first heading is a source's contents."""
    first = F.min_by(F.when(_heading(), clean_text(F.col("text"))), F.when(_heading(), F.col("block_no"))).over(_doc())
    return drop(df, found(first, r"^((the\s+)?principal\s+contents\.?|series\s+contents|alphabetical\s+list\s+of\s+titles|(list\s+of\s+)?illustrations)$"), "Removed source contents apparatus")


def local_contents(df: DataFrame) -> DataFrame:
    """A contents heading and the list of links that follows, up to the next heading or a block without links."""
    opener = test(clean_text(F.col("text")), "local_toc", "match")
    rows = df.withColumn("_opener", opener).withColumn("_stop", F.col("_opener") | _heading() | (F.col("links") == 0))
    rows = rows.withColumn("_run", F.sum(F.col("_stop").cast("int")).over(_order())).withColumn("_led", F.max("_opener").over(W.partitionBy(*DOC, "_run")))
    rows = rows.withColumn("_links", F.sum("links").over(W.partitionBy(*DOC, "_run")))
    return drop(rows, F.col("_led") & (F.col("_links") >= 2) & (F.col("_opener") | (F.col("links") > 0)), "Removed local mini-contents").drop("_opener", "_stop", "_run", "_led", "_links")


def compact_contents(df: DataFrame) -> DataFrame:
    return drop(df, rules.compact_contents(F.col("text"), F.filter(F.split("text", "\n"), lambda x: x != ""), F.col("links")), "Removed compact local mini-contents")


def promotion(df: DataFrame) -> DataFrame:
    line = F.col("tag").isin("p", "li")
    return drop(df, F.when(line, rules.promotional(F.col("text"), F.col("classes"), F.col("links"))).otherwise(rules.promotional(F.col("text"), F.col("classes"), F.col("links"), True) & ~_heading()), "Removed promotional line")


def images(df: DataFrame, sources: DataFrame, names: DataFrame, policy: str = "functional", decisions: DataFrame | None = None) -> DataFrame:
    """Resolves images against sources (book, path, asset) and keeps those that the policy keeps.

    names (book, doc_index, name) places relative paths. A block whose image goes is
    dropped with it if it has under 700 letters; an image without a source goes too.
    """
    beside = F.concat_ws(" ", F.nullif("alt", F.lit("")), "text", F.lag("text").over(_order()), F.lead("text").over(_order()))
    rows = df.withColumn("_context", F.when(F.col("images") > 0, clean_text(beside)).otherwise("")).join(names.select(*DOC, F.col("name").alias("_name")), list(DOC), "left")
    rows = rows.withColumn("_path", F.when(F.col("src") != "", resolve_src(F.col("src"), F.coalesce("_name", F.lit("")))))
    rows = rows.join(sources.select("book", F.col("path").alias("_path"), F.col("asset").alias("_asset")), ["book", "_path"], "left")
    made = decisions.select("src", F.col("keep").alias("_keep"), F.col("confidence").alias("_sure")) if decisions is not None else None
    rows = rows.join(made, "src", "left") if made is not None else rows.withColumn("_keep", F.lit(None).cast("boolean")).withColumn("_sure", F.lit(None).cast("double"))
    nothing = F.lit(None).cast("double")
    keep = rules.keep_image(F.lit(policy), F.col("src"), F.col("alt"), F.col("_context"), nothing, nothing, (F.col("text") == "") & (F.col("images") == 1), F.col("_keep"), F.col("_sure")) & F.col("_asset").isNotNull()
    gone = (F.col("images") > 0) & ~F.coalesce(keep, F.lit(False))
    rows = drop(rows, gone & (F.length("text") < 700), "Removed image").withColumn("images", F.when(gone, 0).otherwise(F.col("images"))).withColumn("src", F.when(gone, "").when(F.col("images") > 0, F.coalesce("_asset", "src")).otherwise(F.col("src")))
    return rows.select(*df.columns)


def orphan_captions(df: DataFrame) -> DataFrame:
    t = F.col("text")
    front = F.substring(clean_text(t), 1, 240)
    able = F.col("tag").isin("figcaption", "p", "div") & (F.col("images") == 0) & (t != "") & (F.length(t) < 700)
    classed = (F.col("tag") == "figcaption") | found(F.col("classes"), CAPTION_CLASS)
    led = found(front, CAPTION_LED)
    placed = found(front, POSITIONED) & (word_count(t) <= 24)
    plate = (led | classed | ~rules.prose_or_dialogue(t)) & test(front, "plate_caption") & (classed | led | rules.short_caption(t))
    return drop(df, able & (placed | plate), "Removed orphan caption")


def empty_shells(df: DataFrame) -> DataFrame:
    return drop(df, (F.col("text") == "") & (F.col("images") == 0) & ~has_class("true-blank"), "Removed empty block")


def punctuation(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.when(F.col("tag").isin(*LITERAL), F.col("text")).otherwise(F.array_join(F.transform(F.split("text", "\n"), typography), "\n")))


def footnotes(df: DataFrame) -> DataFrame:
    """Two neighbouring blocks or more that start with a note's number become notes; bare numbers only with note classes or ids."""
    mark_ = r"^\[([0-9]+)\]\.?\s+"
    bare = r"^([0-9]+)[.)]\s+"
    meant = found(F.concat_ws(" ", "classes", "ident"), r"(^|[-_\s])(fn|footnotes?|endnotes?|notes?)($|[-_\s])")
    note = F.col("tag").isin("p", "div") & (F.rlike("text", F.lit(mark_)) | (meant & F.rlike("text", F.lit(bare))))
    rows = df.withColumn("_m", note).withColumn("_i", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(_order()))
    rows = rows.withColumn("_n", F.sum(F.col("_m").cast("int")).over(W.partitionBy(*DOC, "_i")))
    hit = F.col("_m") & (F.col("_n") >= 2)
    number = F.regexp_extract("text", r"^\[?([0-9]+)", 1)
    rows = rows.withColumn("ident", F.when(hit, F.concat(F.lit("fn-"), number)).otherwise(F.col("ident")))
    return mark(rows, hit, "footnote").withColumn("text", F.when(hit, F.regexp_replace("text", r"^(\[[0-9]+\]\.?|[0-9]+[.)])\s*", "")).otherwise(F.col("text"))).drop("_m", "_i", "_n")


def verse(df: DataFrame) -> DataFrame:
    """Blocks with two line breaks or more, preformatted verse, verse classes, and runs of four short paragraphs in documents with verse."""
    t = F.col("text")
    broken = F.col("tag").isin("p", "div") & (F.col("breaks") >= 2) & (F.length(t) < 2200) & F.contains(t, F.lit("\n"))
    pre = (F.col("tag") == "pre") & rules.preformatted_verse(t).isNotNull()
    rows = mark(df, broken | test(F.col("classes"), "poetry_class"), "verse-block")
    rows = mark(rows, pre, "verse-block", "pre-verse-block")
    poetic = F.max((has_class("verse-block")).cast("int")).over(_doc()) == 1
    short = (F.col("tag") == "p") & ~F.rlike("within", F.lit(r"\b(blockquote|table|div)\b")) & F.length(t).between(2, 76) & ~F.endswith(t, F.lit(".")) & ~test(t, "chapter", "match")
    rows = rows.withColumn("_m", short & poetic).withColumn("_i", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(_order()))
    rows = rows.withColumn("_n", F.sum(F.col("_m").cast("int")).over(W.partitionBy(*DOC, "_i")))
    return mark(rows, F.col("_m") & (F.col("_n") >= 4), "verse-block", "verse-sequence").drop("_m", "_i", "_n")


def drama(df: DataFrame) -> DataFrame:
    """Cast headings and lists, entries, acts and scenes, stage directions."""
    t = clean_text(F.col("text"))
    cast, scene = _heading() & test(t, "cast", "match"), _heading() & test(t, "act_scene", "match")
    last = F.last(F.when(_heading(), cast), ignorenulls=True).over(_order())
    within = ~_heading() & F.coalesce(last, F.lit(False)) & F.col("tag").isin("p", "div", "li", "td", "ul", "ol", "table")
    entry = within & (F.length(t) <= 240) & (F.rlike(t, F.lit(r"^[A-Z][A-Z .'-]{2,35}([—–-]|,|\s{2,})")) | ((F.upper(t) == t) & (F.lower(t) != t)))
    rows = df.withColumn("_w", within).withColumn("_e", entry)
    rows = mark(mark(rows, cast, "cast-heading", "formal-opener"), scene, "act-scene-heading")
    rows = mark(mark(rows, F.col("_w"), "cast-list"), F.col("_e"), "cast-entry")
    return mark(rows, (F.col("tag") == "p") & (F.length(t) < 240) & F.rlike(t, F.lit(r"^\[.*\]$|^\(.*\)$")), "stage-direction").drop("_w", "_e")


def promote_headings(df: DataFrame, top_level: DataFrame | None = None) -> DataFrame:
    """Short paragraphs that are headings in disguise become h2: chapters, labels in capitals after a heading, front-matter labels, and the source's top titles (book, key) that open a document."""
    t = display_title(F.col("text"))
    bare = F.regexp_replace(t, r"[ .]+$", "")
    able = F.col("tag").isin("p", "div") & ~F.rlike("within", F.lit(r"\b(blockquote|table|figcaption)\b")) & (F.col("images") == 0) & (t != "") & (F.length(t) <= 80) & (word_count(t) <= 8)
    rows = df.withColumn("_key", title_key(t)).withColumn("_first", F.row_number().over(_order()) == 1)
    rows = rows.join(top_level.select("book", F.col("key").alias("_key")).distinct().withColumn("_top", F.lit(True)), ["book", "_key"], "left") if top_level is not None else rows.withColumn("_top", F.lit(None).cast("boolean"))
    top = F.coalesce(F.col("_top"), F.lit(False)) & F.col("_first")
    chapter = test(t, "chapter", "match") | test(bare, "chapter", "match")
    label = test(bare, "frontmatter", "match") & (word_count(bare) <= 4)
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (word_count(t) <= 5) & ~F.rlike(t, F.lit("[.!?]$")) & ~F.rlike(t, F.lit("^[\"'“‘]"))
    rows = rows.withColumn("_able", able).withColumn("_h", able & (top | chapter | label))
    headed = F.coalesce(F.lag(_heading() | F.col("_h")).over(_order()), F.lit(False)) | (F.coalesce(F.max(F.col("_h").cast("int")).over(_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1)
    rows = rows.withColumn("_s", F.col("_able") & ~chapter & ~top & (label | (capitals & headed))).withColumn("_t", F.col("_able") & top).withColumn("_c", F.col("_able") & chapter & ~top)
    made = F.col("_s") | F.col("_t") | F.col("_c")
    rows = mark(mark(mark(rows, F.col("_t"), "source-top-level-title"), F.col("_s"), "chapter-section-heading"), F.col("_c"), "subdivision")
    rows = mark(rows, F.col("_c") & found(t, r"^part\b"), "part-heading")
    out = rows.withColumn("_made", made).withColumn("text", F.when(F.col("_made"), t).otherwise(F.col("text"))).withColumn("tag", F.when(F.col("_made"), "h2").otherwise(F.col("tag"))).withColumn("level", F.when(F.col("_made"), 2).otherwise(F.col("level")))
    return out.select(*df.columns)


def descriptions(df: DataFrame, within: int = 12) -> DataFrame:
    """Editorial paragraphs right after a work's opener, as one run; an author's note there is marked apart.

    A run starts at the first describing paragraph among the next ``within`` blocks with
    nothing else before it but a subtitle, and goes on while paragraphs continue it.
    """
    opener = _heading() & has_class("major-work")
    rows = df.withColumn("_o", F.sum(opener.cast("int")).over(_order()))
    at = W.partitionBy(*DOC, "_o").orderBy("block_no")
    rows = rows.withColumn("_k", F.row_number().over(at) - 1).withColumn("_title", F.first("text").over(at))
    inside = (F.col("_o") > 0) & (F.col("_k") > 0) & (F.col("_k") <= within)
    t = clean_text(F.col("text"))
    short = (word_count(t) <= 8) & ~found(t, r"\b(CHAPTER|BOOK|PART|ACT|SCENE)\b")
    subtitle = inside & (F.col("_k") == 1) & short & (F.col("tag").isin("p", "h2", "h3", "h4"))
    starts = inside & (F.col("tag") == "p") & rules.work_description(t, F.col("_title"))
    rows = rows.withColumn("_sub", subtitle).withColumn("_start", starts).withColumn("_note", inside & (F.col("tag") == "p") & rules.author_note(t))
    lead = F.min(F.when(F.col("_start"), F.col("_k"))).over(W.partitionBy(*DOC, "_o"))
    rows = rows.withColumn("_lead", lead)
    fits = F.when(F.col("_k") < F.col("_lead"), F.col("_sub") | F.col("_note")).when(F.col("_k") == F.col("_lead"), True).otherwise((F.col("tag") == "p") & rules.work_description_goes_on(t))
    rows = rows.withColumn("_fits", (F.col("_k") == 0) | (inside & F.coalesce(fits, F.lit(False))))
    rows = rows.withColumn("_broken", F.sum((~F.col("_fits")).cast("int")).over(at))
    run = (F.col("_o") > 0) & F.col("_lead").isNotNull() & (F.col("_broken") == 0) & (F.col("_k") >= F.col("_lead"))
    rows = rows.withColumn("_run", run)
    rows = mark(mark(rows, F.col("_run"), "work-description", "editorial-description", "no-indent"), F.col("_sub") & ~F.col("_run"), "work-subtitle", "no-indent")
    rows = mark(rows, F.col("_note") & (F.col("_broken") == 0) & ~F.col("_run"), "author-note", "no-indent")
    rows = mark(rows, F.col("_run") & (F.col("_k") == F.col("_lead")), "work-description-start")
    ends = F.col("_run") & ~F.coalesce(F.lead("_run").over(at), F.lit(False))
    return mark(rows.withColumn("_end", ends), F.col("_end"), "work-description-end").select(*df.columns)


def drop_caps(df: DataFrame, within: int = 6) -> DataFrame:
    """The first ordinary paragraph among the six blocks after a chapter heading starts with a drop cap, unless speech or another heading comes first."""
    opener = F.col("level").between(1, 3) & has_class("subdivision")
    rows = df.withColumn("_o", F.sum(opener.cast("int")).over(_order()))
    at = W.partitionBy(*DOC, "_o").orderBy("block_no")
    t = clean_text(F.col("text"))
    rows = rows.withColumn("_k", F.row_number().over(at) - 1)
    prefatory = (word_count(t) <= 12) & ~F.rlike(t, F.lit("[.!?][\"')\\]]?$"))
    special = F.rlike("classes", F.lit("work-description|work-subtitle|no-indent|stage-direction|cast-list"))
    paragraph = (F.col("tag") == "p") & (F.col("_k") > 0) & (F.col("_k") <= within) & (F.col("_o") > 0)
    speech = paragraph & F.rlike(t, F.lit("^[\"'“]"))
    able = paragraph & ~speech & ~prefatory & ~special & ~rules.reference_entry(t)
    rows = rows.withColumn("_a", F.when(able, F.lit("a")).when(speech, F.lit("s")))
    first = F.min_by("_a", F.when(F.col("_a").isNotNull(), F.col("_k"))).over(W.partitionBy(*DOC, "_o"))
    place = F.min(F.when(F.col("_a").isNotNull(), F.col("_k"))).over(W.partitionBy(*DOC, "_o"))
    rows = rows.withColumn("_hit", (first == "a") & (F.col("_k") == place) & F.rlike(t, F.lit(r"^\p{L}")))
    return mark(rows, F.coalesce(F.col("_hit"), F.lit(False)), "drop-cap-paragraph").select(*df.columns)


def separators(df: DataFrame) -> DataFrame:
    """Blank blocks before and after the openers of works, divisions and back matter."""
    opener = F.col("level").between(1, 2) & F.exists(F.split("classes", " "), lambda x: x.isin(*DIVIDERS))
    blank = lambda side: F.struct(F.lit(f"true-blank major-opener-separator {side}-major-opener").alias("c"), F.lit(-1 if side == "before" else 1).alias("d"))
    here = F.struct(F.lit(None).cast("string").alias("c"), F.lit(0).alias("d"))
    rows = df.withColumn("_x", F.explode(F.when(opener, F.array(blank("before"), here, blank("after"))).otherwise(F.array(here))))
    new = F.col("_x.d") != 0
    cols = {"block_no": F.col("block_no") * 3 + F.col("_x.d"), "tag": F.when(new, "div").otherwise(F.col("tag")), "level": F.when(new, 0).otherwise(F.col("level")), "text": F.when(new, "").otherwise(F.col("text")), "classes": F.when(new, F.col("_x.c")).otherwise(F.col("classes")), "ident": F.when(new, "").otherwise(F.col("ident"))}
    return rows.select(*(cols[c].alias(c) if c in cols else F.col(c) for c in df.columns))


def heading_classes(df: DataFrame, folded: DataFrame) -> DataFrame:
    """Puts the heading fold's classes and ids on their blocks; headings that the fold dropped go."""
    f = folded.select(*DOC, "block_no", F.col("classes").alias("_c"), F.col("ident").alias("_id"))
    rows = df.join(f, [*DOC, "block_no"], "left")
    rows = drop(rows, _heading() & F.col("_c").isNull(), "Removed repeated or blank heading")
    rows = rows.withColumn("classes", F.when(F.col("_c").isNotNull(), F.trim(F.concat_ws(" ", "classes", "_c"))).otherwise(F.col("classes"))).withColumn("ident", F.coalesce("_id", "ident"))
    return rows.select(*df.columns)


#: The chain up to the heading fold, and after it; each step sees what the one before left.
BEFORE: tuple[Step, ...] = (source_contents, local_contents, compact_contents, promotion, orphan_captions, empty_shells, punctuation, footnotes, verse, compact_contents, drama, promote_headings)
AFTER: tuple[Step, ...] = (descriptions, drop_caps, empty_shells)


def clean(blocks: DataFrame, steps: tuple[Step, ...] = BEFORE) -> tuple[DataFrame, DataFrame]:
    """(blocks that stay, audit of those that went). Removed rows stay in the plan until its end, out of the later steps' windows."""
    rows, gone = blocks.withColumn("removed", F.lit(None).cast("string")), None
    for step in steps:
        rows = step(rows)
        if step in (source_contents, local_contents, compact_contents, promotion, orphan_captions, empty_shells):
            out = rows.where("removed is not null")
            gone = out if gone is None else gone.unionByName(out)
            rows = live(rows)
    audit = gone.select(*DOC, "block_no", F.col("removed").alias("reason"), F.substring(clean_text(F.col("text")), 1, 220).alias("sample")) if gone is not None else None
    return rows.drop("removed"), audit


def markup(caps: bool = True) -> Column:
    """A block's markup: verse by lines, a drop cap around the first letter, images before their text."""
    t = html_escape(F.col("text"))
    shown = F.when(F.lit(caps) & ~_heading() & ~F.col("tag").isin(*LITERAL), small_caps(t)).otherwise(t)
    lines = F.array_join(F.transform(F.filter(F.split(t, "\n"), lambda x: x != ""), lambda x: F.concat(F.lit('<span class="verse-line">'), x, F.lit("</span>"))), "")
    first = F.when(has_class("drop-cap-paragraph"), F.regexp_replace(shown, r"^(\p{L})", '<span class="drop-cap">$1</span>')).otherwise(F.regexp_replace(shown, "\n", "<br>"))
    body = F.when(has_class("verse-block"), lines).otherwise(first)
    image = F.when(F.col("images") > 0, F.concat(F.lit('<img src="'), html_escape(F.col("src")), F.lit('">'))).otherwise(F.lit(""))
    tag = F.when(F.col("tag").isin("td", "th", "tr", "body") | has_class("verse-block"), F.lit("div")).otherwise(F.col("tag"))
    attrs = F.concat(F.when(F.col("classes") != "", F.concat(F.lit(' class="'), html_escape(F.col("classes")), F.lit('"'))).otherwise(""), F.when(F.col("ident") != "", F.concat(F.lit(' id="'), html_escape(F.col("ident")), F.lit('"'))).otherwise(""))
    return F.concat(F.lit("<"), tag, attrs, F.lit(">"), image, body, F.lit("</"), tag, F.lit(">"))


def fragments(blocks: DataFrame, docs: DataFrame, caps: bool = True) -> DataFrame:
    """Blocks and documents (book, doc_index, kind, current_work) -> (book, seq, html, printable): one section each.

    A document without a block that shows something has no fragment. ``caps`` sets
    small capitals outside of headings.
    """
    lit = F.struct("block_no", markup(caps).alias("m"))
    shows = F.bool_or((F.col("text") != "") | (F.col("images") > 0))
    opens = F.min_by(F.exists(F.split("classes", " "), lambda x: x.isin(*DIVIDERS, "frontmatter-opener")), F.when(F.col("text") != "", F.col("block_no")))
    verse_in = F.bool_or(has_class("verse-block"))
    body = blocks.groupBy(*DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(lit)), lambda x: x["m"]), "\n").alias("body"), shows.alias("shows"), opens.alias("opens"), verse_in.alias("verse")).where("shows")
    rows = body.join(docs.select(*DOC, "kind", "current_work"), list(DOC), "left")
    classes = F.concat_ws(" ", F.lit("epub-doc"), F.concat(F.lit("doc-"), "kind"), F.when(F.col("opens"), "starts-major-work"), F.when(F.col("verse"), "contains-poetry"))
    work = F.when(F.col("current_work").isNotNull(), F.concat(F.lit(' data-current-work="'), html_escape(F.col("current_work")), F.lit('"'))).otherwise(F.lit(""))
    marker = F.when(F.col("current_work").isNotNull() & ~F.coalesce("opens", F.lit(False)), F.concat(F.lit('<span class="set-current-work">'), html_escape(F.col("current_work")), F.lit("</span>\n"))).otherwise(F.lit(""))
    return rows.select("book", F.col("doc_index").alias("seq"), F.concat(F.lit('<section class="'), classes, F.lit('"'), work, F.lit(">\n"), marker, F.col("body"), F.lit("\n</section>")).alias("html"))
