"""The scalar functions of quire.functions.text once more, as DuckDB expressions for the SQL twins."""

from __future__ import annotations

from quire.functions import patterns
from quire.functions.text import EDITION, NOBLE, WORD, A4, PT_PER_MM, SIZES, W


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def slug(x: str, fallback: str = "section") -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(replace(lower({clean(x)}), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), {q(fallback)})"


def key(x: str) -> str:
    s = rf"regexp_replace(lower({clean(x)}), '\[\*+\]', '', 'g')"
    for _ in range(2):
        s = rf"regexp_replace({s}, {q(EDITION)}, '\1\3', 'g')"
    return clean(rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')")


def words(x: str) -> str:
    return f"len(regexp_extract_all({clean(x)}, {q(WORD)}))::bigint"


def display(x: str) -> str:
    return clean(rf"regexp_replace({clean(x)}, '\[\*+\]', '', 'g')")


def count(x: str, regex: str) -> str:
    return f"len(regexp_extract_all({x}, {q(regex)}))"


def ratio(x: str) -> str:
    return rf"(case when {count(x, r'\p{L}')} = 0 then 0.0 else {count(x, r'\p{Lu}')}::double / {count(x, r'\p{L}')} end)"


def title_case(x: str) -> str:
    caps = rf"array_to_string(list_transform(string_split({clean(f'lower({x})')}, ' '), lambda w: case when regexp_matches(w, '^\p{{L}}') then upper(substr(w, 1, 1)) || substr(w, 2) else w end), ' ')"
    lead = f"regexp_matches({x}, {q(rf'^[A-ZÀ-ÖØ-Þ]{{2,}}($|[^{W}])')})"
    return rf"case when {count(x, r'\p{L}')} = 0 then {x} when {ratio(x)} > 0.7 or ({ratio(x)} > 0.4 and {lead}) then {caps} else {clean(f'''regexp_replace({x}, '[-—–]+', ' - ', 'g')''')} end"


def escape(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def unescape(x: str) -> str:
    out = x
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def test(x: str, name: str, mode: str = "search") -> str:
    return f"coalesce(regexp_matches({x}, {q(patterns.MODES[mode].format(patterns.PATTERNS[name]))}), false)"


def found(x: str, regex: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(f'(?i)(?:{regex})')}), false)"


def points(x: str) -> str:
    shape = q(r"^([0-9]+(?:\.[0-9]+)?)(mm|cm|in|pt)?$")
    s = f"lower(trim({x}))"
    return f"(case when regexp_matches({s}, {shape}) then try_cast(regexp_extract({s}, {shape}, 1) as double) * case regexp_extract({s}, {shape}, 2) when 'mm' then {PT_PER_MM!r}::double when 'cm' then {10.0 * PT_PER_MM!r}::double when 'in' then 72.0::double else 1.0::double end end)"


def values(rows: list[tuple], names: str, alias: str = "t") -> str:
    """A literal table."""
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else q(v) if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) {alias}({names})"


__all__ = [n for n in dir() if n[0] != "_"] + ["A4", "NOBLE", "SIZES"]
