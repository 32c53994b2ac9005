"""The pattern registry: named regexes, extended by rule packs, matched in three modes.

Patterns are plain strings that Java's and RE2's regex engines read alike; all ignore
case. ``search`` finds a pattern anywhere, ``match`` at the start, ``full`` over the
whole value. A rule pack adds alternatives to a pattern as they are, without anchors,
so a mode belongs to the place of use and not to the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The registry's patterns by name.
PATTERNS: dict[str, str] = {
    "promo": r"(delphi classics|also available|other books by|more books by|subscribe|newsletter|visit our website|follow us|kindle|ebook|smashwords|gutenberg license|project gutenberg license|catalogue|catalog|advertisement|promotion|publisher's note to the reader|download our|copyrighted images? removed|copyright|all rights reserved|beautifully illustrated|comprehensive editions|bonus texts|explore (science and philosophy|our wide range)|the delphi classics catalogue|www\.|https?://|isbn|app store|google play|goodreads)",
    "backmatter": r"^(notes|endnotes|appendix|appendices|bibliography|glossary|index|letters|notebooks|biography|chronology|translator'?s notes?|editor'?s notes?|commentary|source notes?)$",
    "frontmatter": r"^(preface|foreword|introduction|prologue|author'?s note|note by the author)$",
    "local_toc": r"^(contents|table of contents|chapter list|list of chapters|illustrations|list of illustrations)$",
    "divisions": r"^(the )?(novels|short stories|stories|plays|poetry|poems|memoirs|letters|notebooks|essays|biograph(y|ies)|appendices|tales|sketches|dramas|translations|miscellanies|non[- ]fiction|verse|narrative poems|lyric poems|spurious works|epistles|greek texts)$",
    "major_work": r"^(book|part|volume)\s+[ivxlcdm0-9]+$|^(novel|play|poem|drama|story|tale)s?\b",
    "chapter": r"^(chapter|chap\.?|part|scene|act|section|proposition|article|letter|canto|book)\b|^[ivxlcdm]+$|^\d+$",
    "cast": r"^(dramatis personae|characters|persons|the persons of the play|names of the characters|the characters|cast of characters|personages)$",
    "act_scene": r"^(act|scene)\b|^act\s+[ivxlcdm0-9]+$",
    "plate_caption": r"(delphi classics|decorative title|title illustration|frontispiece|title page of the first edition|first edition|standalone plate|plate page|portrait of|author portrait|photographic portrait|photograph of|photo of|pictured above|\b(the )?author[’']?s (birthplace|parents|father|mother|family|home|house|grave|tomb|portrait)\b|\b(birthplace|parents|father|mother|family|grave|tomb|statue|monument|museum)\b|\b(house|home|residence) of\b|view of .* house|monument to|\b(chekhov|turgenev|dostoevsky|dostoyevsky|tolstoy)\s+as\s+(a|an|the)?\s*(boy|child|young|young man|student|writer)\b|dostoevsky at the beginning|dostoyevsky at the beginning|beginning of (his|her) literary career|hospital for the poor|where (his|her) father worked|illustration from .* edition|engraving from .* edition|painting by|\btranslated by\b)",
    "functional_image": r"(map|diagram|chart|table|figure|rune|inscription|alphabet|script|seal|facsimile|manuscript|author-?drawn|drawn by the author|drawing|plan|musical notation|score|see (the )?(figure|map|diagram|chart|drawing|plan)|dotted lines|following figure|shown below|shown above|as follows|the accompanying|illustrated below|engraving below|symbol|glyph|sign)",
    "functional_image_src": r"(map|diagram|chart|figure|rune|inscription|alphabet|script|seal|facsimile|manuscript|drawing|plan|score|genealogy)",
    "publisher_image_src": r"(cover|frontispiece|portrait|photo|photograph|author|birthplace|house|home|grave|tomb|museum|plate|illustration|delphi|title|logo|catalog|catalogue|promo|decorative|ornament|headpiece|tailpiece|vignette|border|divider|^(?:image|fig|pic|img)[_\-]?\d)",
    "contents_line": r"^(contents|chapter|letter|act|scene|book|part|volume|section|[ivxlcdm]+|\d+|(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(st|nd|rd|th)?\.?)\b",
    "poetry_class": r"poem|poetry|stanza|verse|line|canto|song|epigram|sonnet|ode",
    "roman": r"^[ivxlcdm]+$",
}

#: The keys of rule packs and the patterns they extend.
PACK_KEYS: dict[str, str] = {
    "promo_patterns": "promo",
    "backmatter_patterns": "backmatter",
    "frontmatter_patterns": "frontmatter",
    "local_toc_headings": "local_toc",
    "collection_divisions": "divisions",
    "major_work_hints": "major_work",
    "chapter_headings": "chapter",
    "cast_headings": "cast",
    "plate_caption_patterns": "plate_caption",
    "functional_image_clues": "functional_image",
    "functional_image_src_clues": "functional_image_src",
    "publisher_image_src_clues": "publisher_image_src",
    "local_contents_line": "contents_line",
    "poetry_class": "poetry_class",
}

MODES = {"search": "(?i)(?:{})", "match": "(?i)^(?:{})", "full": "(?i)^(?:{})$"}


class InvalidRule(ValueError):
    """A rule pack holds something that is no regex."""


@dataclass
class Registry:
    """Patterns by name; a copy per session, so that one job's rules don't reach another's."""

    patterns: dict[str, str] = field(default_factory=lambda: dict(PATTERNS))

    def get(self, name: str) -> str:
        return self.patterns[name]

    def update(self, name: str, pattern: str) -> None:
        re.compile(pattern)
        self.patterns[name] = pattern

    def extend(self, key: str, rules: Iterable[str]) -> bool:
        """Adds the rules that the pattern does not have yet; False where that leaves nothing to add."""
        name = PACK_KEYS.get(key)
        if name is None:
            return False
        rules = [r for r in (str(x).strip() for x in rules) if r]
        for r in rules:
            try:
                re.compile(r)
            except re.error as e:
                raise InvalidRule(f"{key}: {r}: {e}") from e
        old = self.patterns[name]
        new = f"(?:{old})|(?:{'|'.join(rules)})"
        if not rules or old.endswith(f")|(?:{'|'.join(rules)})"):  # the same pack again
            return False
        self.patterns[name] = new
        return True

    def apply(self, pack: Mapping[str, str | list[str]]) -> list[str]:
        """Applies a rule pack; returns the keys that changed a pattern, in the order of the registry."""
        out = []
        for key in PACK_KEYS:
            rules = pack.get(key) or []
            if self.extend(key, [rules] if isinstance(rules, str) else rules):
                out.append(key)
        return out

    def test(self, column: Column, name: str, mode: str = "search") -> Column:
        return F.coalesce(F.rlike(column, F.lit(MODES[mode].format(self.patterns[name]))), F.lit(False))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, p) for n, p in self.patterns.items()], "name string, pattern string")


REGISTRY = Registry()


def test(column: Column, name: str, mode: str = "search") -> Column:
    """Whether a pattern of the built-in registry is found in the column; null is false."""
    return REGISTRY.test(column, name, mode)


def found(column: Column, pattern: str) -> Column:
    """Whether a regex is found, case ignored; null is false."""
    return F.coalesce(F.rlike(column, F.lit(f"(?i)(?:{pattern})")), F.lit(False))
