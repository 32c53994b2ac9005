"""Books from pages: probe, classify, clean, fold headings, contents, documents, as one plan."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import display_title
from quire.operators import cleaning, compose, headings, openers, spine, toc
from quire.plans.dag import Plan, Stage
from quire.plans.settings import DEFAULTS
from quire.sources import html


def _scan(o: dict[str, Any]) -> dict[str, Any]:
    docs = spine.demote_late_frontmatter(spine.drop_orphan_media(spine.classify(spine.probe(o["pages"], o["per_book"]))))
    return {"docs": docs}


def _clean(o: dict[str, Any]) -> dict[str, Any]:
    kept = o["docs"].where("not remove").select("book", "doc_index", "kind", "major_title")
    raw = o["pages"].select(F.expr(f"page_id div {o['per_book']}").alias("book"), (F.col("page_id") % o["per_book"]).alias("doc_index"), "html")
    steps = tuple(x for x in cleaning.BEFORE if o["settings"]["smart_punctuation"] or x is not cleaning.punctuation)
    rows, audit = cleaning.clean(html.blocks(raw.join(kept, ["book", "doc_index"], "left_semi")), steps)
    return {"blocks": openers.merge_preformatted(rows), "audit": audit}


def _open(o: dict[str, Any]) -> dict[str, Any]:
    """Titles said again go, openers that no heading gives come. Reads the blocks four times, so a cache should hold them."""
    rows, docs = o["blocks"], spine.carry_forward(o["docs"]).where("not remove").select("book", "doc_index", "kind", "major_title", "current_work")
    again = openers.repeated_titles(rows, docs)
    audit = o["audit"].unionByName(again.select("book", "doc_index", "block_no", F.lit("Removed duplicate current-work title line").alias("reason"), F.substring("text", 1, 220).alias("sample")))
    rows = rows.join(again.select("book", "doc_index", "block_no"), ["book", "doc_index", "block_no"], "left_anti").select(*rows.columns)
    new = openers.synthetic_openers(rows, docs).unionByName(openers.front_openers(rows, docs))
    return {"blocks": openers.with_openers(rows, new), "audit": audit}


def _fold(o: dict[str, Any]) -> dict[str, Any]:
    docs = spine.carry_forward(o["docs"]).select("book", "doc_index", "kind", "major_title", F.col("current_division").alias("division"))
    heads = o["blocks"].where("level > 0").join(docs, ["book", "doc_index"])
    section = F.array_contains(F.split("classes", " "), "chapter-section-heading")
    folded = headings.fold(heads.select("book", "doc_index", "block_no", "level", "text", F.nullif("ident", F.lit("")).alias("id"), "kind", "major_title", "division", section.alias("section"), F.lit(False).alias("source_top")))
    rows = cleaning.heading_classes(o["blocks"].withColumn("removed", F.lit(None).cast("string")), folded)
    rows = cleaning.descriptions(cleaning.live(rows))
    rows = cleaning.separators(cleaning.drop_caps(rows) if o["settings"]["drop_caps"] else rows).drop("removed")
    return {"folded": folded, "marked": rows}


def _contents(entries: DataFrame, mode: str) -> DataFrame:
    simple = mode == "simple"
    return toc.markup(toc.usable(entries, simple=simple), simple)


def _compose(o: dict[str, Any]) -> dict[str, Any]:
    s = o["settings"]
    docs = spine.carry_forward(o["docs"]).select("book", "doc_index", "kind", F.coalesce(display_title(F.col("major_title")), "current_work").alias("current_work"))
    fragments = cleaning.fragments(o["marked"], docs, s["small_caps"])
    entries = o["folded"].where("toc_level is not null").select("book", (F.col("doc_index") * 1_000_000 + F.col("block_no")).alias("seq"), F.col("toc_level").alias("level"), F.col("toc_title").alias("title"), F.col("ident").alias("target_id"), F.col("toc_kind").alias("kind"), F.lit(0).alias("source_level"))
    named = F.lit(s["title"]) if s["title"].strip() else F.concat(F.lit("Book "), F.col("book").cast("string"))
    books = o["docs"].groupBy("book").agg(F.first(named).alias("title"))
    back = s["back_toc_mode"].strip().lower()
    back = _contents(entries, back) if back in ("simple", "hierarchical") else None
    return {"fragments": fragments, "entries": entries, "books": compose.compose(fragments, books, _contents(entries, s["toc_mode"]), s, back)}


def plan(openers_too: bool = False) -> Plan:
    """Stages over pages (page_id, url, html); books are ``per_book`` pages each. ``openers_too`` adds the stage that makes missing openers."""
    out = Plan()
    out.add(Stage("scan", _scan))
    out.add(Stage("clean", _clean, ("scan",)))
    if openers_too:
        out.add(Stage("openers", _open, ("clean",)))
    out.add(Stage("fold", _fold, ("openers" if openers_too else "clean",)))
    out.add(Stage("compose", _compose, ("fold",)))
    return out


def build(pages: DataFrame, per_book: int = 10, openers_too: bool = False, values: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """All outputs by name: docs, blocks, audit, folded, marked, fragments, entries, books.

    Of the settings in ``values`` the plan follows smart_punctuation, drop_caps,
    small_caps, toc_mode (only "simple" is simple), back_toc_mode, title (else "Book n")
    and the half title, title page, subtitle and source note; the others shape the
    stylesheet. Those not given have their defaults.
    """
    return plan(openers_too).run({"pages": pages, "per_book": per_book, "settings": {**DEFAULTS, **(values or {})}})
