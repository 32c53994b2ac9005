"""Personal data: regexes propose spans, checksums confirm them, context adjusts the score.

Four base kinds (email, ip, card, phone) are fixed by pattern and check. Further
kinds (iban, ssn, passport, birth date) are accepted from a score: the pattern's
own, more for a passed checksum, more for a context word close by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import rows_of

#: The base kinds in the order of ties, and what comes after them.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "passport", "birth_date")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# As given, but for a look-behind and possessive runs: neither changes a match, both keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])")
_BIRTH = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[0-1][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-1]?[0-9][./](?:19|20)[0-9]{2})(?![0-9])")
#: Characters on either side of a span in which a context word counts.
CONTEXT = 48


def luhn(digits: str) -> bool:
    """Luhn's check: from the right, every second digit doubled, digit sums end in 0."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod 97-10: the first four characters moved last, letters as 10 to 35, leaves 1."""
    s = code.replace(" ", "").upper()
    rest = 0
    for c in s[4:] + s[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; goes from @ to @, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, kind, end) of the four base kinds, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Further kinds: pattern, score of the pattern alone, checksum and its worth, context words and their worth.
_MORE: tuple[tuple[str, re.Pattern, float, Callable[[str], bool] | None, float, re.Pattern, float], ...] = (
    ("iban", _IBAN, 0.1, mod97, 0.6, re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"), 0.2),
    ("ssn", _SSN, 0.4, None, 0.0, re.compile(r"(?i)\b(?:ssn|social security|sozialversicherung|seguridad social)\b"), 0.4),
    ("passport", _PASSPORT, 0.1, None, 0.0, re.compile(r"(?i)\b(?:passport|reisepass|pasaporte|passeport)\b"), 0.5),
    ("birth_date", _BIRTH, 0.2, None, 0.0, re.compile(r"(?i)\b(?:born|birth|dob|geboren|geburtsdatum|nacimiento|naissance)\b"), 0.5),
)
ACCEPT = 0.5


def more_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, rank of the kind, end, score) of the further kinds that reach ACCEPT."""
    out = []
    for name, pattern, own, check, worth, words, near in _MORE:
        for m in pattern.finditer(text):
            score = own
            if check:
                if not check(m[0]):
                    continue
                score += worth
            if words.search(text, max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)):
                score += near
            if score >= ACCEPT:
                out.append((m.start(), KINDS.index(name), m.end(), score))
    return out


_SOME_DIGIT = re.compile(r"[0-9]")


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Base spans and further spans of one text, in code points."""
    if not text or ("@" not in text and not _SOME_DIGIT.search(text)):
        return [], []
    return base_spans(text), more_spans(text)


def _joined(found) -> str:
    return ",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in found)


_OUT = "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, score double"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(7)]
        for text in b.column("text").to_pylist():
            base, more = spans(text)
            counts = [0, 0, 0, 0]
            for x in base:
                counts[x[1]] += 1
            score = max([1.0] * bool(base) + [x[3] for x in more], default=0.0)
            for col, v in zip(cols, (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted([*base, *(x[:3] for x in more)])), score), strict=True):
                col.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
        names = ["rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "score"]
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), *map(pa.array, cols, kinds)], names=names)


def digest(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) -> rid, doc_id, counts per base kind, base_sha256, spans, score.

    One row per input row, each text on its own, no shuffle. A null or empty text has
    no spans: counts 0, the hash of the empty string, spans '' and score 0.
    """
    return rows_of(docs, "text").mapInArrow(_batches, _OUT)
