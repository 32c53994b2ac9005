"""The print stylesheet as a table of rules filled from settings."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Ligature settings as font features; anything else is as common.
LIGATURES = {"none": "none", "all": "common-ligatures discretionary-ligatures historical-ligatures", "discretionary": "common-ligatures discretionary-ligatures", "common": "common-ligatures"}

#: (selector, declarations); braces name settings or derived values.
RULES = (
    ("@page", "size: {trim_size}; margin: {margin_top_mm}mm {margin_side_mm}mm {margin_bottom_mm}mm"),
    ("@page blank", "margin: 0"),
    ("@page title", "margin: {front_margin_top_mm}mm {margin_side_mm}mm {front_margin_bottom_mm}mm"),
    ("@page front", "margin: {front_margin_top_mm}mm {margin_side_mm}mm {front_margin_bottom_mm}mm; @bottom-center {{ content: counter(page, lower-roman); font-size: {front_folio_font_pt}pt }}"),
    ("@page body", "margin-top: {body_top_mm}mm; @bottom-center {{ content: counter(page); font-size: {folio_font_pt}pt }}"),
    ("@page body:left", "@top-left {{ content: {left_runner}; font-size: {left_pt}pt; letter-spacing: {runner_letter_spacing_em}em }}"),
    ("@page body:right", "@top-right {{ content: {right_runner}; font-size: {right_pt}pt; letter-spacing: {runner_letter_spacing_em}em }}"),
    ("@page opener", "margin-top: {margin_top_mm}mm"),
    ("@page nofolio", "margin-top: {margin_top_mm}mm"),
    ("body", "font-family: {font_stack}; font-size: {body_size_pt}pt; line-height: {line_height}; color: {text_color}; font-weight: {body_font_weight}; hyphens: {hyphens}; text-align: {align}; font-variant-ligatures: {ligatures}"),
    ("p", "margin: 0; text-indent: {paragraph_indent_em}em; widows: 2; orphans: 2"),
    ("h1 + p, h2 + p, h3 + p", "text-indent: 0; widows: 5; orphans: 2"),
    ("h1, h2, h3, h4, h5, h6", "break-after: avoid; widows: 2; orphans: 2"),
    (".set-current-work", "string-set: work content(); display: none"),
    (".true-blank", "page: blank; break-before: page; break-after: page"),
    (".major-work", "page: opener; break-before: page; font-size: {major_work_font_pt}pt; margin: {major_opener_top_margin_mm}mm 0 {major_opener_bottom_margin_mm}mm; text-align: center"),
    (".collection-division", "page: opener; break-before: page; font-size: {collection_division_font_pt}pt; margin: {major_opener_top_margin_mm}mm 0 {major_opener_bottom_margin_mm}mm; text-align: center"),
    (".subdivision", "font-size: {subdivision_font_pt}pt; margin: {subdivision_margin_top_mm}mm 0 {subdivision_margin_bottom_mm}mm; text-align: center"),
    (".part-heading", "font-size: {part_heading_font_pt}pt; margin-bottom: {part_heading_margin_bottom_mm}mm"),
    (".chapter-section-heading", "font-size: {chapter_section_font_pt}pt; margin: {chapter_section_margin_top_mm}mm 0 {chapter_section_margin_bottom_mm}mm"),
    ("h3", "font-size: {h3_font_pt}pt"),
    (".minor-heading", "font-size: {minor_heading_font_pt}pt"),
    (".work-description", "font-style: italic; font-size: {description_pt}pt; text-indent: 0"),
    (".work-description-end", "margin-bottom: {work_description_bottom_margin_mm}mm"),
    (".author-note", "margin-bottom: {author_note_bottom_margin_mm}mm"),
    (".no-indent", "text-indent: 0"),
    ("blockquote", "margin: 0 {blockquote_side_margin_mm}mm; font-size: {blockquote_font_percent}%"),
    (".verse-block", "max-width: {verse_max_width_mm}mm; margin: {verse_block_margin_top_mm}mm auto {verse_block_margin_bottom_mm}mm; font-size: {verse_pt}pt; line-height: {verse_line_height}; text-align: left"),
    (".verse-line", "display: block; padding-left: {verse_hanging_indent_em}em; text-indent: -{verse_hanging_indent_em}em"),
    (".cast-list", "max-width: {cast_max_width_mm}mm; line-height: {cast_line_height}"),
    (".stage-direction", "font-style: italic; text-indent: 0"),
    (".footnote", "font-size: 0.85em; text-indent: 0"),
    (".drop-cap", "float: left; font-size: 3em; line-height: 0.8; padding-right: 0.06em"),
    (".small-caps", "font-variant-caps: all-small-caps"),
    (".toc-list", "list-style: none; line-height: {toc_line_height}"),
    (".toc-page h1", "font-size: {toc_title_font_pt}pt"),
    (".toc-list li", "margin-bottom: {toc_entry_gap_mm}mm"),
    (".toc-level-1", "font-size: {toc_level_1_font_pt}pt"),
    (".toc-level-2", "font-size: {toc_level_2_font_pt}pt; margin-left: 4mm"),
    (".toc-level-3", "font-size: {toc_level_3_font_pt}pt; margin-left: 8mm"),
    (".toc-level-4", "font-size: {toc_level_4_font_pt}pt; margin-left: 12mm"),
    (".title-page h1", "font-size: {title_page_font_pt}pt"),
    (".title-collection", "font-size: {title_page_collection_font_pt}pt"),
    (".title-of", "font-size: {title_page_of_font_pt}pt"),
    (".half-title-page h1", "font-size: {half_title_page_font_pt}pt"),
    ("img", "max-width: 100%"),
    ("table", "width: 100%; border-collapse: collapse"),
)


def derived(settings: Mapping[str, Any]) -> dict[str, Any]:
    """Settings and what follows from them: body top, description and verse sizes, runners, switches."""
    s = dict(settings)
    body = float(s["body_size_pt"])
    title = '"' + str(s["title"]).replace('"', '\\"') + '"'
    left_title = s["runner_layout"].strip().lower().startswith("left")
    return s | {
        "body_top_mm": round(s["margin_top_mm"] + s["runner_body_clearance_mm"], 3),
        "description_pt": round(max(6.0, body + s["work_description_font_delta_pt"]), 3),
        "verse_pt": round(max(6.0, body + s["verse_font_size_delta_pt"]), 3),
        "left_pt": s["runner_left_font_pt"] or s["runner_font_pt"],
        "right_pt": s["runner_right_font_pt"] or s["runner_font_pt"],
        "left_runner": title if left_title else "string(work)",
        "right_runner": "string(work)" if left_title else title,
        "hyphens": "auto" if s["hyphenate"] else "manual",
        "align": "justify" if s["justify_prose"] else "left",
        "ligatures": LIGATURES.get(s["ligature_setting"], LIGATURES["common"]),
    }


def rules(spark: SparkSession, settings: Mapping[str, Any]) -> DataFrame:
    """(seq, selector, declarations)."""
    values = derived(settings)
    return spark.createDataFrame([(k, a, b.format(**values)) for k, (a, b) in enumerate(RULES)], "seq long, selector string, declarations string")


def css(settings: Mapping[str, Any], font_faces: str = "") -> str:
    values = derived(settings)
    return "\n".join(filter(None, [font_faces, *(f"{a} {{ {b.format(**values)} }}" for a, b in RULES)])) + "\n"
