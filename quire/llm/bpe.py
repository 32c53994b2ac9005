"""BPE encoding and decoding through a table of distinct words.

1. Texts are split once into the tokenizer's pre-tokens ("words") in chunks of whole
   documents. A chunk keeps a vocabulary of its own, most frequent word first, and
   each document becomes the positions' vocabulary numbers, packed. Both are written,
   dealt by chunk.
2. The chunks' vocabularies are dealt by word: all places that ask for a word meet in
   one task, whose table of distinct words encodes it once.
3. The ids go back to the chunks that asked for them; every chunk puts them to its
   documents by position. The documents' rows don't move for that.
4. A chunk's different ids are joined to their pieces: the id-to-piece table has as many
   rows as the vocabulary, it is sent to all tasks and the join is theirs, in Arrow.

A word is at most once in a chunk's vocabulary, so the commonest word comes to its task
as often as there are chunks, and no more. A chunk is closed at CHUNK_CHARS characters,
so a task holds one chunk however large the corpus is; only a longer document makes a
larger chunk. A chunk's words for one task travel as one row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise_by, partitions, rows_of

CHUNK_CHARS = 24_000_000
#: Words a task remembers with their ids; at more it begins anew.
MEMO = 1_000_000
#: Fixed values of the vocabulary: its special tokens and its pre-token pattern.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Outside of these characters the library itself splits the text: here Python's
#: classes are its own, texts are in NFC, and lower case needs no context.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u017f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read(path: str) -> str:
    """The tokenizer's own JSON; what tasks get is this, not the path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Splitter:
    """Text to words, as the tokenizer's normaliser and pre-tokenizer split it."""

    def __init__(self, text: str):
        self.text, self.tok = text, None

    def _by_library(self, text: str) -> list[str]:
        if self.tok is None:
            from tokenizers.pre_tokenizers import Split  # the pattern alone: byte-level letters come with encoding
            from tokenizers import Regex

            self.tok = load(self.text)
            pattern = json.loads(self.text)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.split = Split(Regex(pattern), "removed", invert=True)
        return [w for w, _ in self.split.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and (parts := _SPECIAL.split(text))[1:]:
            # odd parts are the special tokens themselves; \0 marks them off from their letters as words
            return [w for k, p in enumerate(parts) if p for w in (["\0" + p] if k % 2 else self(p))]
        if _UNUSUAL.search(text):
            return self._by_library(text)
        return _WORD.findall(text.lower())


def pack(a: np.ndarray) -> bytes:
    """Numbers under 2^30: one byte under 128, two under 2^14, else four; lengths, then the planes."""
    one, two = a < 1 << 7, a < 1 << 14
    kinds = np.where(one, 0, np.where(two, 1, 2))
    first = np.where(one, a, np.where(two, 128 + (a >> 8), 192 + (a >> 24))).astype(np.uint8)
    low = a[kinds > 0] & 255
    high = a[kinds == 2]
    return np.array([len(a), len(low), len(high)], "<u4").tobytes() + first.tobytes() + low.astype(np.uint8).tobytes() + ((high >> 8) & 0xFFFF).astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, m, h = np.frombuffer(data, "<u4", 3)
    first = np.frombuffer(data, np.uint8, n, 12).astype(np.int64)
    out = first.copy()
    some, most = first >= 128, first >= 192
    low = np.frombuffer(data, np.uint8, m, 12 + n)
    out[some] = ((first[some] & 63) << 8) | low
    if h:
        out[most] = ((first[most] & 63) << 24) | (np.frombuffer(data, "<u2", h, 12 + int(n) + int(m)).astype(np.int64) << 8) | low[most[some]]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, dict, list]]:
    """(chunk id, word -> number, [(rid, doc_id, numbers)]); the same for each run over a partition."""
    split = Splitter(text)
    words: defaultdict = defaultdict()
    words.default_factory = words.__len__
    docs: list[tuple[int, int | None, np.ndarray]] = []
    chars = 0
    for b in batches:
        for rid, doc_id, t in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
            found = split(t or "")
            docs.append((rid, doc_id, np.fromiter(map(words.__getitem__, found), np.int32, len(found))))
            chars += len(t or "") + 64
            if chars >= CHUNK_CHARS:
                yield docs[0][0], words, docs
                words, docs, chars = defaultdict(), [], 0
                words.default_factory = words.__len__
    if docs:
        yield docs[0][0], words, docs


def _ranks(words: dict, docs: list) -> np.ndarray:
    """Number -> place by count, ties by first appearance."""
    counts = np.bincount(np.concatenate([np.zeros(0, np.int32), *(a for _, _, a in docs)]), minlength=len(words))
    order = np.argsort(-counts, kind="stable")
    out = np.empty(len(words), np.int64)
    out[order] = np.arange(len(words))
    return out


_SPLIT = "chunk long, task int, words string, ranks binary, rid long, doc_id long, numbers binary"


def _split(sent, tasks: int):
    """Rows of documents -> rows of chunks' vocabularies (words by task) and of documents (numbers)."""
    kinds = {"chunk": pa.int64(), "task": pa.int32(), "words": pa.string(), "ranks": pa.binary(), "rid": pa.int64(), "doc_id": pa.int64(), "numbers": pa.binary()}

    def rows(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def run(batches):
        for chunk, words, docs in _chunks(batches, sent.value):
            rank = _ranks(words, docs)
            task = np.fromiter((zlib.crc32(w.encode()) % tasks for w in words), np.int64, len(words))
            order = np.argsort(task, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(task[order])) + 1, len(order)) if len(order) else []
            all_words, lo = list(words), 0
            of, lists, ranks = [], [], []
            for hi in ends:
                at = order[lo:hi]
                of.append(int(task[at[0]]))
                lists.append("\n".join([all_words[k] for k in at]))
                ranks.append(pack(rank[at]))
                lo = hi
            yield rows(len(of), chunk=[chunk] * len(of), task=of, words=lists, ranks=ranks)
            del all_words, order, task
            for lo in range(0, len(docs), 2000):
                part = docs[lo : lo + 2000]
                yield rows(len(part), chunk=[chunk] * len(part), rid=[d[0] for d in part], doc_id=[d[1] for d in part], numbers=[pack(rank[d[2]]) for d in part])

    return run


class WordTable:
    """Distinct words and their ids; each is encoded when it first comes."""

    def __init__(self, text: str):
        self.tok = load(text)
        self.ids: dict[str, list[int]] = {"\0" + s: [self.tok.token_to_id(s)] for s in SPECIAL}

    def __call__(self, words: list[str]) -> list[list[int]]:
        if len(self.ids) > MEMO:
            self.ids = dict(islice(self.ids.items(), len(SPECIAL)))
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.ids.update(zip(part, (e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [self.ids[w] for w in words]


_ENCODED = "chunk long, ranks binary, counts binary, ids binary"


def _encode(sent):
    """A task's share of the vocabularies -> for each chunk ranks, ids a word and ids."""

    def run(batches):
        table = WordTable(sent.value)
        for b in batches:
            for chunk, words, ranks in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "ranks")), strict=True):
                found = table(words.split("\n"))
                counts = pack(np.fromiter(map(len, found), np.int64, len(found)))
                ids = pack(np.array([i for x in found for i in x], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.array([x], pa.binary()) for x in (ranks, counts, ids))], names=["chunk", "ranks", "counts", "ids"])

    return run


def piece_table(text: str) -> list[str]:
    """The id-to-piece table, by id."""
    vocab = load(text).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def _pieces(text: str) -> pa.Table:
    """The same as a table: a row for each id of the vocabulary."""
    pieces = piece_table(text)
    return pa.table({"id": pa.array(range(len(pieces)), pa.int64()), "piece": pa.array(pieces, pa.string())})


def _assemble(sent_pieces, whole: bool):
    names = ["rid", "doc_id", "n_tokens", *(("ids", "decoded") if whole else ("ids_sha256", "decoded_sha256"))]

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        read = lambda c: np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in words.column(c).to_pylist() if x is not None)])
        number, count, flat = read("ranks"), read("counts"), read("ids")
        joined = pa.table({"id": np.unique(flat)}).join(sent_pieces.value, "id", join_type="inner", use_threads=False)
        piece = dict(zip(joined.column("id").to_pylist(), joined.column("piece").to_pylist(), strict=True))
        decimal = dict(zip(piece, map(str, piece), strict=True))
        order = np.argsort(number)
        begin, count = (np.cumsum(count) - count)[order], count[order]
        out: list[tuple] = []
        for data in docs.column("numbers").to_pylist():
            a = unpack(data)
            c = count[a]
            ids = flat[np.repeat(begin[a] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))].tolist()
            decoded = " ".join(map(piece.__getitem__, ids))
            if whole:
                out.append((len(ids), ids, decoded))
            else:
                out.append((len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        cols = [[x[k] for x in out] for k in range(3)]
        kinds = (pa.int64(), pa.list_(pa.int32()) if whole else pa.string(), pa.string())
        return pa.Table.from_arrays([docs.column("rid"), docs.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return run


def _run(docs: DataFrame, path: str | None, whole: bool, schema: str) -> DataFrame:
    spark = docs.sparkSession
    text = read(path or default_path())
    sent, pieces, tasks = spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(_pieces(text)), partitions(spark)
    parts = materialise_by(rows_of(docs, "text").mapInArrow(_split(sent, tasks), _SPLIT), "chunk", "split-texts")
    vocab = parts.where("task is not null").select("chunk", "task", "words", "ranks")
    encoded = vocab.repartition(tasks, "task").mapInArrow(_encode(sent), _ENCODED)
    numbers = parts.where("rid is not null").select("chunk", "rid", "doc_id", "numbers")
    return numbers.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_assemble(pieces, whole), schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents (doc_id, text) -> rid, doc_id, n_tokens, ids, decoded.

    Ids as the tokenizers library gives without special tokens added, decoded text as
    its decode() gives with special tokens kept. A null or empty text has no tokens
    and decodes to ''. Special tokens written out in a text are found as the library
    finds them. Rows stay apart even if they are equal. A very long text makes a chunk
    by itself. An empty table gives no rows.
    """
    return _run(docs, path, True, "rid long, doc_id long, n_tokens long, ids array<int>, decoded string")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(rid, ids) -> rid, decoded: every id is joined to its piece, pieces are put together by position.

    Ids that are null or not in the vocabulary have no piece; null and empty lists decode to ''.
    """
    pieces = rows.sparkSession.createDataFrame(_pieces(read(path or default_path())))
    at = rows.select("rid", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(pieces), "id", "left")  # bounded by the vocabulary
    got = at.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("at"))
    return got.select("rid", F.array_join(F.transform("at", lambda x: x["piece"]), " ").alias("decoded"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As encode(), with the sha256 of the ids (decimal, joined by a space) and of the decoded text."""
    return _run(docs, path, False, "rid long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
