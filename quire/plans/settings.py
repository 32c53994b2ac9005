"""Settings in three layers, and the automatic fixes that move them within bounds."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The settings' defaults by name.
DEFAULTS: dict[str, Any] = {
    "title": "", "author": "", "volume_mode": "auto", "trim_size": "A4",
    "body_size_pt": 11.6, "line_height": 1.23, "font_stack": '"EB Garamond", "Cormorant Garamond", Garamond, Georgia, serif',
    "embed_font_files": True, "font_dir": "fonts", "embedded_font_family": "EB Garamond", "embedded_font_regular": "EBGaramond-wght.ttf",
    "embedded_font_italic": "EBGaramond-Italic-wght.ttf", "embedded_font_weight": "400 800", "text_color": "#111", "body_font_weight": "400",
    "hyphenate": True, "justify_prose": True, "drop_caps": True, "small_caps": True, "ligature_setting": "common", "footnote_handling": "auto",
    "margin_top_mm": 24.0, "margin_side_mm": 22.0, "margin_bottom_mm": 25.0, "front_margin_top_mm": 25.0, "front_margin_bottom_mm": 24.0,
    "runner_font_pt": 9.4, "runner_left_font_pt": None, "runner_right_font_pt": None, "runner_letter_spacing_em": 0.04, "runner_rule_gap_mm": 3.2,
    "runner_body_clearance_mm": 7.0, "runner_rule_y_mm": 17.0, "runner_title_top_mm": 8.5, "runner_rule_weight_pt": 0.45, "runner_rule_color": "#222",
    "runner_layout": "right_title_full_rule", "runner_rule_style": "full_width", "runner_collection_transform": "uppercase", "runner_work_transform": "none",
    "folio_font_pt": 10.0, "front_folio_font_pt": 9.3, "paragraph_indent_em": 1.25, "blockquote_side_margin_mm": 10.0, "blockquote_font_percent": 96.0,
    "major_opener_top_margin_mm": 55.0, "major_opener_bottom_margin_mm": 15.0, "major_work_description_gap_mm": 3.0, "major_work_font_pt": 23.5,
    "collection_division_font_pt": 25.0, "work_description_font_delta_pt": -1.0, "work_description_bottom_margin_mm": 7.0, "author_note_bottom_margin_mm": 7.0,
    "part_heading_font_pt": 11.6, "part_heading_margin_bottom_mm": 6.0, "chapter_section_font_pt": 11.6, "chapter_section_margin_top_mm": 5.0,
    "chapter_section_margin_bottom_mm": 3.0, "subdivision_font_pt": 14.8, "subdivision_margin_top_mm": 10.0, "subdivision_margin_bottom_mm": 5.0,
    "h3_font_pt": 13.0, "minor_heading_font_pt": 11.4, "toc_mode": "auto", "back_toc_mode": "off", "toc_title_font_pt": 19.0, "toc_level_1_font_pt": 11.4,
    "toc_level_2_font_pt": 10.5, "toc_level_3_font_pt": 10.0, "toc_level_4_font_pt": 9.7, "toc_line_height": 1.11, "toc_entry_gap_mm": 2.9,
    "verse_max_width_mm": 128.0, "verse_line_height": 1.15, "verse_hanging_indent_em": 1.4, "verse_block_margin_top_mm": 4.0, "verse_block_margin_bottom_mm": 5.0,
    "verse_font_stack": "", "verse_font_size_delta_pt": -0.4, "cast_max_width_mm": 132.0, "cast_line_height": 1.16, "image_policy": "functional",
    "smart_punctuation": True, "rule_pack_dir": "rules", "rule_packs": "generic_epub.yaml", "write_ai_rule_suggestions": True, "include_half_title_page": False,
    "include_title_page": True, "half_title_page_font_pt": 22.0, "title_page_font_pt": 30.0, "title_page_collection_font_pt": 21.0, "title_page_of_font_pt": 14.0,
    "title_page_subtitle": "", "include_source_note": False, "source_note_text": "Prepared as a single-page A4 print interior from the supplied EPUB source.",
    "major_opener_blank_before": True, "major_opener_blank_after": True, "strict": False, "no_sample_requirement": False,
}

#: Automatic fixes as (check or feedback, pattern, setting, step, most); a step of True switches on.
FIXES = (
    ("header_collisions", None, "runner_body_clearance_mm", 2.0, 14.0),
    (None, r"body-typography|justif|ragged|word spacing|river|paragraph|indent|line spill|single-letter|broken word|narrow|overwide|crowd", "justify_prose", True, None),
    (None, r"body-typography|justif|ragged|word spacing|river|paragraph|indent|line spill|single-letter|broken word|narrow|overwide|crowd", "hyphenate", True, None),
    (None, r"body-typography|justif|ragged|word spacing|river|paragraph|indent|line spill|single-letter|broken word|narrow|overwide|crowd", "line_height", 0.025, 1.32),
    (None, r"chapter/title|chapter title|work title|major work|chapter|heading|opener|stranded|too close", "subdivision_margin_bottom_mm", 1.2, 8.0),
    (None, r"chapter/title|chapter title|work title|major work|chapter|heading|opener|stranded|too close", "major_opener_bottom_margin_mm", 2.0, 22.0),
    (None, r"\bTOC\b|contents|leader|duplicate|page number|page-number", "toc_line_height", 0.02, 1.2),
    (None, r"\bTOC\b|contents|leader|duplicate|page number|page-number", "toc_entry_gap_mm", 0.4, 4.8),
)


def coerce(name: str, value: Any) -> Any:
    """A config value in the type of the setting's default; as it is if that fails or the default is None."""
    default = DEFAULTS.get(name)
    try:
        if isinstance(default, bool):
            return value.strip().lower() in ("1", "true", "yes", "y", "on") if isinstance(value, str) else bool(value)
        for kind in (float, int, str):
            if isinstance(default, kind):
                return kind(value)
    except (TypeError, ValueError):
        pass
    return value


def read_config(path: str) -> dict[str, Any]:
    """A flat JSON or YAML mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    if data is not None and not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data or {}


def resolve(config: Mapping[str, Any] | None = None, cli: Mapping[str, Any] | None = None) -> tuple[dict[str, Any], list[str]]:
    """(settings, unknown config keys): flags that are not None over the config over the defaults."""
    config, out = config or {}, dict(DEFAULTS)
    out |= {k: coerce(k, v) for k, v in config.items() if k in DEFAULTS}
    out |= {k: v for k, v in (cli or {}).items() if k in DEFAULTS and v is not None}
    return out, [k for k in config if k not in DEFAULTS]


def precedence(defaults: DataFrame, config: DataFrame, cli: DataFrame) -> DataFrame:
    """The same over tables (name, value): (name, value, layer, overridden); keys without a default are left out."""
    rows = defaults.select("name", F.col("value").alias("d")).join(config.select("name", F.col("value").alias("c")), "name", "left").join(cli.select("name", F.col("value").alias("f")), "name", "left")
    layer = F.when(F.col("f").isNotNull(), "cli").when(F.col("c").isNotNull(), "config").otherwise("default")
    value = F.coalesce("f", "c", "d")
    return rows.select("name", value.alias("value"), layer.alias("layer"), F.coalesce(value != F.col("d"), F.lit(False)).alias("overridden"))


def unknown_keys(defaults: DataFrame, config: DataFrame) -> DataFrame:
    return config.join(defaults, "name", "left_anti").select("name")


def bump(old: Column, step: Column, most: Column) -> Column:
    """The next value: a step up, rounded to three digits, at most the bound; the old one if that is no more."""
    new = F.least(most, F.round(old + step, 3))
    return F.when(new > old + 0.0001, new).otherwise(old)


def auto_fix(settings: dict[str, Any], checks: set[str], feedback: str) -> tuple[dict[str, Any], list[str]]:
    """(settings, names that moved): applies every fix whose check or feedback pattern is there."""
    out, moved = dict(settings), []
    for check, pattern, name, step, most in FIXES:
        if not (check in checks if check else re.search(pattern, feedback, re.I)):
            continue
        new = True if step is True else min(most, round(float(out[name]) + step, 3))
        if new is True and not out[name] or new is not True and new > out[name] + 0.0001:
            out[name] = new
            moved.append(name)
    return out, moved


def fix_until_still(settings: dict[str, Any], build, passes: int = 1) -> tuple[dict[str, Any], int]:
    """Builds, reads (checks, feedback), fixes, and builds again, ``passes`` times more at most. (settings, builds)."""
    for n in range(passes + 1):
        checks, feedback = build(settings)
        fixed, moved = auto_fix(settings, set(checks), feedback)
        if not moved or n == passes:
            return settings, n + 1
        settings = fixed
    return settings, passes + 1


def table(spark: SparkSession, settings: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in settings.items()], "name string, value string")


def catalog(spark: SparkSession, settings: Mapping[str, Any]) -> DataFrame:
    """(name, type, default, value, overridden) of all settings."""
    rows = [(k, type(d).__name__, None if d is None else str(d), None if settings.get(k) is None else str(settings[k]), settings.get(k) != d) for k, d in DEFAULTS.items()]
    return spark.createDataFrame(rows, "name string, type string, default string, value string, overridden boolean")
