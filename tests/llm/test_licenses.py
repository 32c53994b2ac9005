"""Rules, gates, priorities and suppression of the license scan against a plain implementation."""

import random
import re

from quire.llm import licenses


def test_rules():
    table = licenses.rules()
    assert len(table) > 300 and len(licenses.NOTICES) + len(licenses.FAMILIES) + 2 * len(licenses.CC_PARTS) >= 200
    for label, regex, word, _, weight, _ in table:
        re.compile(regex)
        assert "'" not in regex + word + label and 0 < weight < 1 and re.fullmatch(r"[^\x00-\x1f\x21-\x2f\x3a-\x60\x7b-\x7f]+", word)
    for word in {w for _, _, w, _, _, _ in table}:
        assert word == word.lower()


def plain(text):
    """(n_words, detections that stay as (start, end, label, base), labels) by the rules' definition."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = " " + " ".join(words) + " "
    found = []
    for label, regex, word, priority, _, base in licenses.rules():
        if word in norm:
            for m in re.finditer(rf"(?<= )(?:{regex})(?= )", norm):
                a = norm.count(" ", 0, m.start()) - 1
                found.append((a, a + m[0].count(" ") + 1, priority, label, base))
    stay = []
    for d in found:
        over = [e for e in found if not e[4] and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and e[1] - e[0] > d[1] - d[0]))]
        if d[4] or not over:
            stay.append(d)
    return len(words), stay


def test_against_the_definition(spark):
    rng = random.Random(7)
    samples = []
    for _, regex, _, _, _, _ in licenses.rules():  # texts near the rules: optional parts out, first alternatives
        t = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", regex))
        t = re.sub(r"\(\?![^)]*\)|\?|\{[^}]*\}|\(\?:|\)", "", re.sub(r"\[([^\]])[^\]]*\]", r"\1", t)).replace(r"\S+", "thing").replace("\\", "")
        samples.append(t)
    texts = [*samples, None, "", " .,; ", "no license here", "All RIGHTS reserved"]
    for _ in range(500):
        parts = [rng.choice(samples) if rng.random() < 0.7 else " ".join(rng.choice("under the of version 2 0 3 or later gnu licence".split()) for _ in range(3)) for _ in range(rng.randint(1, 5))]
        t = rng.choice([" ", ". ", " - ", "\n"]).join(parts)
        texts.append(t.upper() if rng.random() < 0.2 else t)
    texts += [" ".join(samples), "cc by " * 3000 + "gpl", "Kopyright LİCENSE copyrıght réservés tous droits réservés"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = set()
    for k, t in enumerate(texts):
        n, stay = plain(t)
        base = [d[0] for d in stay if d[4]]
        labels = sorted({d[3] for d in stay})
        seen |= set(labels)
        assert (got[k].n_words, got[k].n_base, got[k].labels) == (n, len(base), ",".join(labels)), t
        assert (got[k].first_word, got[k].last_word) == (min(base, default=None), max(base, default=None))
    assert len(seen) > 150


def test_clashing_columns_and_repeats(spark):
    rows = [(1, "MIT License", "x", 5, 6), (1, "MIT License", "x", 5, 6), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, norm string, found long, rid long")
    assert sorted((r.doc_id or 0, r.labels, r.n_words) for r in licenses.scan(df).collect()) == [(0, "", 0), (1, "mit", 2), (1, "mit", 2)]
