"""The heading fold: roles, ids and contents entries from headings in reading order.

What a heading is depends on the work and division that the headings before it left
behind, so a book's headings are folded in order, one book to a task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.patterns import PATTERNS
from quire.functions.text import display_title, title_key, word_count
from quire.operators.blocks import authored_opener
from quire.operators.identity import take_id

#: Headings that are a source's own contents, classes by role.
SOURCE_CONTENTS = re.compile(r"(?i)^((the\s+)?principal\s+contents\.?|series\s+contents|alphabetical\s+list\s+of\s+titles|(list\s+of\s+)?illustrations)$")
CLASSES = {
    "division": "collection-division formal-opener",
    "backmatter": "backmatter-opener formal-opener",
    "frontmatter": "frontmatter-opener formal-opener",
    "section": "chapter-section-heading",
    "authored": "subdivision story-work-opener embedded-authored-work",
    "work": "major-work formal-opener",
    "subdivision": "subdivision",
    "minor": "minor-heading",
}
_IS = {k: re.compile(f"(?i){PATTERNS[k]}").match for k in ("divisions", "backmatter", "frontmatter", "chapter")}
_LONG = 90


@dataclass
class State:
    """What headings leave behind for those after them."""

    work: str | None = None
    work_key: str = ""
    division: str | None = None
    division_key: str = ""
    ids: set[str] = field(default_factory=set)

    def enter(self, text: str, key: str) -> None:
        self.work, self.work_key = text, key

    @property
    def embedded(self) -> bool:
        return bool(self.division and self.work and self.division_key != self.work_key)


def role_of(h: dict, s: State) -> str | None:
    """A heading's role under the state; None for one that only repeats the work it stands in."""
    text, key, kind, level = h["text"], h["key"], h["kind"], h["level"]
    chapter, section = bool(_IS["chapter"](text)), bool(h["section"])
    own_title = bool(h["major_key"]) and h["major_key"] == key
    division = bool(_IS["divisions"](text)) or (kind == "division" and ((bool(h["division_key"]) and h["division_key"] == key) or (own_title and not re.match(r"(?i)part\s+", text))))
    back = bool(_IS["backmatter"](text)) or kind == "backmatter"
    front = bool(_IS["frontmatter"](text)) or kind == "frontmatter"
    authored = h["author"] is not None
    plain = not chapter and not section
    if h["source_top"] and not authored and not division and s.work and key == s.work_key:
        return None
    if authored:
        major = False
    elif h["source_top"] and not chapter and not front and not back:
        major = True
    else:
        major = level == 1 and plain and not front and not s.embedded
    major = major or (own_title and kind in ("major_work", "play", "poetry", "backmatter"))
    major = major or (level == 2 and bool(s.division) and plain and len(text) < _LONG and not s.embedded)
    if division:
        return "division"
    if back:
        return "backmatter"
    if front and not section:
        within = s.work and not _IS["frontmatter"](s.work.rstrip(" ."))
        return "front-section" if within else "frontmatter"
    if authored:
        return "authored"
    if major:
        return "work"
    if section:
        return "section"
    return "subdivision" if level == 2 or s.embedded else "minor"


def entry_of(h: dict, role: str, s: State, embedded: bool) -> tuple[int, str] | None:
    """(level, kind) of a heading's contents entry under the state it left, if it gets one."""
    chapter = bool(_IS["chapter"](h["text"]))
    inner = bool(s.division)
    if role == "division":
        return 1, "division"
    if role in ("backmatter", "work", "authored"):
        return (1 if h["source_top"] or not inner else 2), ("backmatter" if role == "backmatter" else "work")
    if role == "frontmatter":
        return (2 if inner else 1), "frontmatter"
    if chapter and h["level"] == 2:
        return (3 if inner else 2), "chapter"
    if role == "subdivision" and h["level"] == 2 and not chapter and len(h["text"]) < _LONG and not embedded:
        return (3 if inner else 2), "work"
    return None


def step(h: dict, s: State) -> dict | None:
    """One heading: its row of results, and the state moved on. None for headings that go."""
    if not h["text"] or SOURCE_CONTENTS.match(h["text"]):
        return None
    embedded, role = s.embedded, role_of(h, s)
    if role is None:
        return None
    shown = h["title"] if role == "authored" else h["text"]
    shown_key = h["title_key"] if role == "authored" else h["key"]
    if role == "division":
        s.division, s.division_key = h["text"], h["key"]
    elif role in ("backmatter", "frontmatter", "authored", "work"):
        s.enter(shown, shown_key)
        if role == "work" and h["source_top"]:
            s.division, s.division_key = None, ""
    ident = h["id"]
    if ident and ident not in s.ids:
        s.ids.add(ident)
    else:
        ident = take_id(shown, s.ids)
    classes = CLASSES["section" if role == "front-section" else role]
    if re.match(r"(?i)part\b", h["text"]) and _IS["chapter"](h["text"]):
        classes += " part-heading"
    entry = entry_of(h, role, s, embedded)
    title = f"{h['title']} by {h['author']}" if role == "authored" else h["text"]
    return {"ident": ident, "role": role, "classes": classes, "toc_level": entry and entry[0], "toc_kind": entry and entry[1], "toc_title": title if entry else None, "current_work": s.work, "current_division": s.division}


_OUT = "book long, doc_index long, block_no long, ident string, role string, classes string, toc_level long, toc_kind string, toc_title string, current_work string, current_division string"


def fold(headings: DataFrame) -> DataFrame:
    """Headings (book, doc_index, block_no, level, text, id, kind, major_title, division, section, source_top) -> roles, ids, entries, state after each.

    Headings that repeat the work they stand in, blank ones and a source's contents
    have no row. Keys and by-lines are computed in the JVM; only the fold is Python.
    """
    t = F.col("text")
    opener = authored_opener(t)
    rows = headings.select(
        "book", "doc_index", "block_no", "level", display_title(t).alias("text"), "id", "kind", title_key(display_title(t)).alias("key"), title_key(F.col("major_title")).alias("major_key"),
        title_key(F.col("division")).alias("division_key"), opener["title"].alias("title"), opener["author"].alias("author"), title_key(opener["title"]).alias("title_key"), "section", "source_top",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        for h in pdf.sort_values(["doc_index", "block_no"], kind="stable").astype(object).where(lambda x: x.notna(), None).to_dict("records"):
            row = step(h, state)
            if row:
                out.append({"book": h["book"], "doc_index": h["doc_index"], "block_no": h["block_no"], **row})
        names = [c.split()[0] for c in _OUT.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"toc_level": "Int64"})

    return rows.groupBy("book").applyInPandas(run, _OUT)


def title_only(fragments: DataFrame, book_title) -> DataFrame:
    """Fragments (text, longest_block_words, has_media, part_heading) that hold a title and no body."""
    text, key, own = F.col("text"), title_key(F.col("text")), title_key(book_title)
    n = word_count(text)
    tail = F.trim(F.substring(key, F.length(own) + 1, 100_000))
    titled = (own != "") & (((key == own) & (n <= 14)) | (F.startswith(key, own) & (n <= 18) & tail.isin("", "a novel", "novel", "book")))
    return fragments.where(~F.col("has_media") & ((text == "") | (~F.col("part_heading") & (titled | ((n <= 20) & (F.col("longest_block_words") <= 10))))))
