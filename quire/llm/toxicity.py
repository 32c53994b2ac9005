"""Toxicity by a linear-chain conditional random field over tokens.

Documents carry one label each, so tokens are labelled first: in a toxic training
document, a token is toxic if its word or its beginning stands far more often in toxic
than in clean training documents. A two-label field with features of the token, its
neighbours and the label before is trained on those tokens, in windows of 32. Scoring
takes a whole text as one chain: forward-backward gives each token's probability, a
document's score is a logistic function of what those add up to, and tokens above one
half are the offending offsets.

Training is bounded: at most SAMPLE documents of either label, drawn by a hash of
doc_id, SAMPLE_BYTES of text in all, and of their windows at most BLOCKS with and
BLOCKS without a toxic token, every so many of them. Scoring is not.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from quire.llm import crf
from quire.llm.common import release, rows_of, slices, stored, with_rid

#: Labelled documents of either label that training may see, bytes of their texts and of one of them, and windows of either kind.
SAMPLE = 1500
SAMPLE_BYTES, TEXT_BYTES = 32_000_000, 2_000_000
BLOCKS = 5000
LENGTH = 32
_TOKEN = re.compile(r"\w+")


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def lower(text: str) -> str:
    """Lower case of as many characters, so that offsets stay."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=20_000)
def _parts(word: str) -> list[str]:
    """Features of a word by itself: the word, its beginnings, its ending."""
    return ["w" + word, *(f"{k}{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k), "e" + word[-3:]]


class Model:
    """Weights by feature, and all that scoring needs."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], trans: np.ndarray, begin: np.ndarray, logistic: np.ndarray):
        self.weights, self.trans, self.begin, self.logistic = weights, trans, begin, logistic
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 3))

    def words(self, tokens: list[str]) -> np.ndarray:
        """Numbers of tokens; a new word's emissions (own, as the one before, as the one after) are summed once."""
        known, out = self.known, np.empty(len(tokens), np.int64)
        if len(known) > 500_000:
            known.clear()
        for k, w in enumerate(tokens):
            number = known.get(w)
            if number is None:
                number = known[w] = len(known)
                if number >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                own = before = after = 0.0
                for f in _parts(w):
                    if v := self.weights.get(f):
                        own, before, after = own + v[0], before + v[1], after + v[2]
                self.table[number] = own, before, after
            out[k] = number
        return out

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all tokens of all texts, each text a chain, and where each text's begin."""
        bias = self.weights.get("bias", (0.0, 0.0, 0.0))[0]
        numbers = [self.words(_TOKEN.findall(lower(text))) for text in texts]
        first = np.append(0, np.cumsum([len(x) for x in numbers])).astype(np.int64)
        e = self.table[np.concatenate([np.zeros(0, np.int64), *numbers])]
        gap = e[:, 0] + bias
        inner = np.ones(len(gap) + 1, bool)  # whether a token has one before it in its text
        inner[first] = False
        after = np.flatnonzero(inner[:-1])
        gap[after] += e[after - 1, 1]
        gap[after - 1] += e[after, 2]
        return crf.chain_marginals(gap, first, self.trans, self.begin, LENGTH), first

    def scores(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(p, at) @ self.logistic, -30, 30)))


def evidence(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What a document's marginals add up to: (1, largest, log of 1 + sum, share of tokens over one half)."""
    sizes = np.diff(at)
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    has = sizes > 0
    if has.any():
        begin = at[:-1][has]
        out[has, 1] = np.maximum.reduceat(p, begin)
        out[has, 2] = np.log1p(np.add.reduceat(p, begin))
        out[has, 3] = np.add.reduceat((p > 0.5).astype(float), begin) / sizes[has]
    return out


def label_tokens(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """The features whose tokens are toxic in a toxic document.

    They are over 12 times as common in toxic documents, and in so many of them that
    chance alone, at the share of toxic documents, would do that once in 10,000 times.
    """
    counts = (Counter(), Counter())
    for words, y in zip(texts, toxic, strict=True):
        counts[int(y)].update({f for w in set(words) for f in _parts(w) if f[0] == "w" or "3" < f[0] <= "9"})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least = max(3.0, np.log(1e-4) / np.log(n1 / (n1 + n0)))
    return {f for f, c in counts[1].items() if c >= least and (c + 0.1) / n1 > 12 * (counts[0][f] + 0.1) / n0}


def _windows(tokens: list[list[str]], toxic: np.ndarray) -> list[tuple[list[str], list[int]]]:
    """Windows of tokens with their labels: BLOCKS of either kind at most, every so many in place of the first ones."""
    telling = label_tokens(tokens, toxic)
    marked: dict[str, int] = {}
    found: tuple[list, list] = ([], [])
    for words, y in zip(tokens, toxic, strict=True):
        for w in set(words) if y else ():
            if w not in marked:
                marked[w] = int(any(f in telling for f in _parts(w)))
        for lo in range(0, len(words), LENGTH):
            part = words[lo : lo + LENGTH]
            labels = [marked[w] for w in part] if y else [0] * len(part)
            found[any(labels)].append((part, labels))
    return [b for kind in found for b in kind[:: max(1, -(-len(kind) // BLOCKS))]]


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 60) -> Model:
    """Trains on whole texts and their labels; without both labels a model that scores everything low."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model({}, np.zeros((2, 2)), np.zeros(2), np.array([-3.0, 0, 0, 0]))
    one: dict[str, str] = {}  # one string per distinct word
    tokens = [[one.setdefault(w, w) for w in _TOKEN.findall(lower(t))] for t in texts]
    chosen = _windows(tokens, toxic)
    del tokens, one
    # words by number, and each word's features by number
    number: dict[str, int] = {}
    word = np.full((len(chosen), LENGTH), -1, np.int64)
    y = np.zeros((len(chosen), LENGTH), np.int64)
    for k, (part, labels) in enumerate(chosen):
        word[k, : len(part)] = [number.setdefault(w, len(number)) for w in part]
        y[k, : len(part)] = labels
    mask = word >= 0
    times = np.bincount(word[mask], minlength=len(number))
    common: Counter = Counter()
    for w, c in zip(number, times.tolist(), strict=True):
        for f in _parts(w):
            common[f] += c
    features: dict[str, int] = {"bias": 0}
    own = [[features.setdefault(f, len(features)) for f in _parts(w) if common[f] >= 3] for w in number]
    lead = np.array([own[k][0] if own[k] and common["w" + w] >= 3 else -1 for k, w in enumerate(number)], np.int64)
    names = list(features)
    sides = {mark: {int(f): features.setdefault(mark + names[f], len(features)) for f in np.unique(lead[lead >= 0])} for mark in "<>"}
    at = np.flatnonzero(mask)
    w = word.ravel()[at]
    sizes = np.array([len(x) for x in own])
    begin_of = np.cumsum(sizes) - sizes
    flat = np.array([f for x in own for f in x], np.int64)
    rows, cols = [at, np.repeat(at, sizes[w])], [np.zeros(len(at), np.int64), flat[np.repeat(begin_of[w] - (np.cumsum(sizes[w]) - sizes[w]), sizes[w]) + np.arange(int(sizes[w].sum()))]]
    for mark, shift in (("<", -1), (">", 1)):
        near = np.full_like(word, -1)
        if shift < 0:
            near[:, 1:] = word[:, :-1]
        else:
            near[:, :-1] = word[:, 1:]
        f = np.where(near.ravel()[at] >= 0, lead[near.ravel()[at]], -1)
        table = np.zeros(len(names), np.int64)
        table[list(sides[mark])] = list(sides[mark].values())
        rows.append(at[f >= 0])
        cols.append(table[f[f >= 0]])
    weights, trans, begin = crf.train(np.concatenate(rows), np.concatenate(cols), y, mask, len(features), 2, rounds=rounds)
    gap = weights[:, 1] - weights[:, 0]
    learned: dict[str, list[float]] = {}
    for f, k in features.items():
        side = 1 if f[0] == "<" else 2 if f[0] == ">" else 0
        if abs(gap[k]) > 1e-3:
            learned.setdefault(f[1:] if side else f, [0.0, 0.0, 0.0])[side] = float(gap[k])
    model = Model({f: tuple(v) for f, v in learned.items()}, trans, begin, np.zeros(4))
    x = np.concatenate([evidence(*model.tag(texts[lo : lo + 200])) for lo in range(0, len(texts), 200)])
    a, m, v = np.zeros(4), np.zeros(4), np.zeros(4)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    for step in range(1, 1501):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (weight * (toxic - p)) - 1e-4 * a
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        a = a + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    model.logistic = a
    model.known, model.table = {}, np.zeros((1024, 3))
    return model


_models: dict[str, Model] = {}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on labelled rows that are not held out, within the bounds above; once for the same rows."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id"))).distinct()
    drawn = None
    for y in (0, 1):
        part = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic"), F.col("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(size <= TEXT_BYTES).join(F.broadcast(drawn), "doc_id").orderBy(*order).limit(2 * sample)
    # so many rows at most, hence the window over all of them
    texts = texts.withColumn("upto", F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("upto") <= SAMPLE_BYTES).orderBy(*order)
    got = texts.select("text", "toxic").toArrow()
    texts, toxic = [t or "" for t in got.column("text").to_pylist()], np.array(got.column("toxic").to_pylist(), bool)
    del got
    key = hashlib.sha256()
    for t, y in zip(texts, toxic.tolist(), strict=True):
        key.update(hashlib.sha256(t.encode()).digest() + bytes([y]))
    if key.hexdigest() not in _models:
        _models.clear()
        _models[key.hexdigest()] = fit(texts, toxic)
        _parts.cache_clear()
        release(docs.sparkSession)
    return _models[key.hexdigest()]


def _score(sent, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                texts = [t or "" for t in b.column("text").to_pylist()]
                p, at = model.tag(texts)
                score = model.scores(p, at)
                cols = [b.column("rid"), b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                names = ["rid", "doc_id", "score", "predicted"]
                if spans:
                    cols.append(pa.array([offending(t, p[a:z]) for t, a, z in zip(texts, at[:-1], at[1:], strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def offending(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens over one half: their offsets in code points of the text and highest probability."""
    out: list[dict] = []
    if not (p > 0.5).any():
        return out
    last = -2
    for k, m in enumerate(_TOKEN.finditer(lower(text))):
        if p[k] > 0.5:
            if k == last + 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[k]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            last = k
    return out


def score(docs: DataFrame, labels: DataFrame, spans: bool = True, sample: int = SAMPLE) -> DataFrame:
    """Documents (doc_id, text) and labels (doc_id, toxic) -> rid, doc_id, score, predicted[, spans].

    One row per input row. A score depends on the text alone; null and empty texts have
    the score of no evidence, under one half. Labels other than 0 and 1 and labels
    without a document are passed over; without both labels nothing is toxic. Repeated
    rows and texts have equal scores. A very long text is one chain like any other. An
    empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    out = "rid long, doc_id long, score double, predicted int" + (", spans array<struct<start:int,end:int,p:double>>" if spans else "")
    return rows_of(docs, "text").mapInArrow(_score(sent, spans), out)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As score(), with held_out and the offending spans as one string, start:end joined by commas."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return score(docs, labels).select("rid", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", spans.alias("spans"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns."""
    docs = stored(docs)
    gone = score(docs, labels, spans=False).where("predicted = 1").select(F.col("rid").alias("__rid"))
    return with_rid(docs, "__rid").join(gone, "__rid", "left_anti").drop("__rid")
