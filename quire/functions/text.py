"""Scalar text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter of a word, phrases that name an edition, noble titles, sizes in points.
W = r"\p{L}\p{N}_"
WORD = rf"[{W}](?:[{W}'-]*[{W}])?"
EDITION = rf"(^|[^{W}])(deluxe print interior|a novel|a story|a tale|a play)($|[^{W}])"
NOBLE = ("graf", "graaf", "count", "countess", "sir", "dame", "lord", "lady", "baron", "baroness")
PT_PER_MM = 72.0 / 25.4
A4 = (595.276, 841.890)
SIZES = {"a3": (297.0 * PT_PER_MM, 420.0 * PT_PER_MM), "a4": A4, "a5": (148.0 * PT_PER_MM, 210.0 * PT_PER_MM), "a6": (105.0 * PT_PER_MM, 148.0 * PT_PER_MM), "letter": (8.5 * 72.0, 11.0 * 72.0), "legal": (8.5 * 72.0, 14.0 * 72.0)}


def clean_text(c: Column) -> Column:
    """White space runs to one space, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def slugify(c: Column, fallback: str = "section") -> Column:
    """Lower-case ASCII letters and digits, all else one hyphen; apostrophes vanish."""
    s = F.regexp_replace(F.replace(F.lower(clean_text(c)), F.lit("'"), F.lit("")), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def title_key(c: Column) -> Column:
    """What two spellings of one title have in common: no footnote stars, edition phrases, punctuation or case."""
    s = F.regexp_replace(F.lower(clean_text(c)), r"\[\*+\]", "")
    for _ in range(2):  # a phrase's end can be the next one's start
        s = F.regexp_replace(s, EDITION, "$1$3")
    return clean_text(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(clean_text(c), F.lit(WORD)).cast("long")


def display_title(c: Column) -> Column:
    return clean_text(F.regexp_replace(clean_text(c), r"\[\*+\]", ""))


def letter_ratio(c: Column) -> Column:
    """Upper-case letters among all letters; 0 without letters."""
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(r"\p{Lu}")), F.regexp_count(c, F.lit(r"\p{L}"))), F.lit(0.0))


def title_case(c: Column) -> Column:
    """Capitals from titles that are mostly upper case; in others, spaced dashes."""
    ratio, lead = letter_ratio(c), F.rlike(c, F.lit(rf"^[A-ZÀ-ÖØ-Þ]{{2,}}($|[^{W}])"))
    words = F.transform(F.split(clean_text(F.lower(c)), " "), lambda w: F.when(F.rlike(w, F.lit(r"^\p{L}")), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100_000))).otherwise(w))
    spaced = clean_text(F.regexp_replace(c, "[-—–]+", " - "))
    return F.when(F.regexp_count(c, F.lit(r"\p{L}")) == 0, c).when((ratio > 0.7) | ((ratio > 0.4) & lead), F.array_join(words, " ")).otherwise(spaced)


def toc_title(c: Column) -> Column:
    return title_case(display_title(c))


def author_name(c: Column) -> Column:
    """'Last, Given, rest' to 'Given rest Last'; noble titles go from the rest and from the front."""
    noble = lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", "").isin(*NOBLE)
    bare = F.regexp_replace(clean_text(c), "^[ ,;]+|[ ,;]+$", "")
    parts = F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(p)), lambda p: p != "")
    rest = F.filter(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), lambda p: ~noble(p))
    turned = F.when(F.size(parts) >= 2, F.array_join(F.concat(F.slice(parts, 2, 1), rest, F.slice(parts, 1, 1)), " ")).otherwise(bare)
    words = F.filter(F.split(clean_text(turned), " "), lambda w: w != "")
    # the first word that is no title, or the last one
    start = F.array_position(F.transform(words, noble), F.lit(False))
    start = F.when(start == 0, F.size(words)).otherwise(start)
    return F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(F.slice(words, F.greatest(start.cast("int"), F.lit(1)), F.greatest(F.size(words), F.lit(1))), " "))


def file_title(c: Column) -> Column:
    """A title from a path: the stem, with spaces for underscores and hyphens."""
    stem = F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.coalesce(F.nullif(display_title(F.regexp_replace(stem, "[_-]", " ")), F.lit("")), F.lit("Untitled"))


def html_escape(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(c, F.lit("")))


def html_unescape(c: Column) -> Column:
    """The references that occur in flat pages; the ampersand's last."""
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def lines(c: Column) -> Column:
    """Cleaned lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), clean_text), lambda x: x != "")


def resolve_src(src: Column, doc: Column) -> Column:
    """An image's path from its reference in a document: unquoted, without fragment, relative to the document."""
    raw = F.replace(F.split_part(F.coalesce(src, F.lit("")), F.lit("#"), F.lit(1)), F.lit("+"), F.lit("%2B"))
    path = F.coalesce(F.try_url_decode(raw), raw)
    folder = F.regexp_extract(doc, "^(.*)/[^/]*$", 1)
    joined = F.when(F.startswith(path, F.lit("/")) | (folder == ""), path).otherwise(F.concat(folder, F.lit("/"), path))
    root = F.startswith(joined, F.lit("/"))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & root, acc).otherwise(F.concat(acc, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    out = F.concat(F.when(root, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    return F.when(path == "", F.lit("")).otherwise(F.coalesce(F.nullif(out, F.lit("")), F.lit(".")))


def css_points(c: Column) -> Column:
    """A CSS length in points; null if it is none."""
    s = F.lower(F.trim(c))
    shape = r"^([0-9]+(?:\.[0-9]+)?)(mm|cm|in|pt)?$"
    unit = F.regexp_extract(s, shape, 2)
    factor = F.when(unit == "mm", PT_PER_MM).when(unit == "cm", 10.0 * PT_PER_MM).when(unit == "in", 72.0).otherwise(1.0)
    return F.when(F.rlike(s, F.lit(shape)), F.regexp_extract(s, shape, 1).try_cast("double") * factor)


def trim_size(c: Column) -> Column:
    """struct(width, height, label) in points: a named size, two lengths, or A4; turned if it says landscape."""
    label = F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("A4"))
    name = F.lower(clean_text(label))
    wide = F.contains(name, F.lit("landscape"))
    bare = F.trim(F.replace(F.replace(name, F.lit(" landscape"), F.lit("")), F.lit(" portrait"), F.lit("")))
    lengths = F.filter(F.transform(F.filter(F.split(bare, r"\s+|x"), lambda p: p != ""), css_points), lambda p: p.isNotNull())
    two = F.size(lengths) >= 2
    width, height = F.when(two, F.get(lengths, F.lit(0))).otherwise(A4[0]), F.when(two, F.get(lengths, F.lit(1))).otherwise(A4[1])
    known = F.lit(False)
    for k, (w, h) in SIZES.items():
        width, height, known = F.when(bare == k, w).otherwise(width), F.when(bare == k, h).otherwise(height), known | (bare == k)
    turn = wide & (width < height)
    return F.struct(F.when(turn, height).otherwise(width).alias("width"), F.when(turn, width).otherwise(height).alias("height"), F.when(known | two, label).otherwise(F.lit("A4")).alias("label"))


def sample_budget(pages: Column) -> Column:
    return F.when(pages <= 0, F.lit(0)).otherwise(F.greatest(F.lit(6000), pages * 700)).cast("long")


def hex_color(c: Column) -> Column:
    """struct(r, g, b) of 0 to 1 from #rgb or #rrggbb; anything else is black."""
    s = F.regexp_replace(clean_text(c), "^#+", "")
    s = F.when(F.length(s) == 3, F.regexp_replace(s, "(.)", "$1$1")).otherwise(s)
    ok = F.rlike(s, F.lit("^[0-9A-Fa-f]{6}$"))
    part = lambda k: F.when(ok, F.conv(F.substring(s, k, 2), 16, 10).cast("double") / 255.0).otherwise(0.0)
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def coerce_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on")


def small_caps(c: Column) -> Column:
    """Known abbreviations in a span of small capitals, where white space or punctuation follows."""
    one = r"[Aa]\.?[Mm]|[Pp]\.?[Mm]|[Bb]\.?[Cc]|[Aa]\.?[Dd]|[Bb][Cc][Ee]|[Cc][Ee]|[Nn]\.?[Bb]|[Pp]\.?[Ss]"
    return F.regexp_replace(c, rf"(^|[^{W}])({one})([\s.,;:])", '$1<span class="small-caps">$2</span>$3')


def typography(c: Column) -> Column:
    """Plain spaces, ellipses and dashes."""
    s = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[ \t\r\f\x0B]+", " ")
    s = F.regexp_replace(F.replace(s, F.lit("..."), F.lit("…")), r"\s+--\s+", " — ")
    for _ in range(2):  # matches share a letter
        s = F.regexp_replace(s, rf"([{W}])--([{W}])", "$1—$2")
    return s
