"""Suffix-array dedup: removes every byte that a repeated 200-byte string covers.

Suffix arrays are built per shard. A shard must hold all places of a string it is to
judge, so strings are dealt by content: every 200-byte window has an anchor, the
32-byte gram in it with the smallest hash (leftmost of equals). Equal windows have
equal anchors at the same offset. Consecutive windows with one anchor are a segment,
and a document is a run of segments, each known by its anchor's hash and the 128-bit
digest of its own bytes.

1. One row per segment. Anchors that occur once settle their windows: not repeated.
   A stretch of a short period (blanks, rulers) repeats itself: its windows are found
   at once and only those of its first period go on, to meet other documents.
2. Where all segments of an anchor are alike, all their windows are repeated.
3. Of the other anchors, each different segment is fetched once, and a shard of them
   gets a suffix array by induced sorting. A window is repeated if it shares 200 bytes
   with a neighbour in it (permuted common prefixes), or its segment is there twice.
4. An anchor with too many different segments for one shard (a passage in very many
   documents) is dealt anew by content. Equal windows have their anchor at the same
   place, so each segment is cut into a few pieces by that place, and a piece's new
   anchor is the hash of the bytes that all windows of such a piece share. Pieces are
   settled as segments are; those whose anchor still has too many are cut again, down
   to single windows, which are equal where their anchors are.

Equality of segments and of pieces is equality of 128-bit digests (XXH3, no algebra to
collide by); the rolling hash and the pieces' anchors deal them and decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, join_groups, partitions, rows_of, slices
from quire.llm.shingles import mix
from quire.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
#: Bytes of segments in one suffix array, and different segments of one anchor in one shard.
SHARD_BYTES = 4_000_000
SHARD_SEGMENTS = 512
#: Into how many pieces a segment with every place of its anchor is cut.
PIECES = 13
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_U = np.uint64


class Rolling:
    """Hashes of any stretch of a byte array from prefix sums modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, t: np.ndarray, base: int):
        power, self.inverse = self.powers(base, len(t) + 1)
        self.sums = np.zeros(len(t) + 1, _U)
        np.cumsum((t.astype(_U) + _U(1)) * power[: len(t)], out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < n:
            n = max(n, 1 << 16)
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, b, _U)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            cls._powers[base] = tuple(pair)
        return cls._powers[base]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours: the end of one block of w and the start of the next."""
    n = len(a) - w + 1
    full = np.append(a, np.full(-len(a) % w, np.iinfo(a.dtype).max, a.dtype)).reshape(-1, w)
    up = np.minimum.accumulate(full, axis=1).ravel()
    down = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def digests(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests (n x 2 longs) of stretches of a byte array."""
    whole = memoryview(np.ascontiguousarray(t))
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[a:z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _period_end(t: np.ndarray, start: int, period: int, limit: int) -> int:
    """How far the bytes from ``start`` on repeat with ``period``."""
    lo, step = start + period, 256
    while lo < limit:
        hi = min(limit, lo + step)
        differs = np.flatnonzero(t[lo:hi] != t[lo - period : hi - period])
        if len(differs):
            return lo + int(differs[0])
        lo, step = hi, 2 * step
    return limit


def _periodic(t: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, h: np.ndarray, limit: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(first window, windows, period) of stretches with a period of at most a gram, two periods of windows long.

    There the same gram is the anchor again and again, one period further each time.
    """
    step = np.where((first[1:] == last[:-1]) & (h[anchor[1:]] == h[anchor[:-1]]), anchor[1:] - anchor[:-1], 0)
    step = np.where((step > 0) & (step <= gram), step, 0)
    out, done = [], 0
    if step.any():
        chain = np.flatnonzero((step > 0) & np.append(True, step[1:] != step[:-1]))
        for k in chain.tolist():
            p, s = int(anchor[k]), int(step[k])
            if p + s + gram <= done:  # inside of the stretch before
                continue
            end = _period_end(t, p, s, int(limit[k]))
            if (n := end - length - p + 1) >= 2 * s:
                out.append((p, n, s))
                done = end
    return out


def segments(t: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Over documents laid end to end: all segments, and windows that are repeated for sure.

    Segments as (document, start in it, windows, anchor hash, digests), then
    (document, start in it, windows) of periodic stretches.
    """
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none, np.zeros((0, 2), np.int64)), (none, none, none)
    if len(t) < length:
        return nothing
    at = np.arange(len(t) - gram + 1)
    h = Rolling(t, _BASE)(at, at + gram)
    # 40 bits of the hash, then the place: the smallest is the leftmost of the smallest
    least = _window_min(((h >> _U(24)) << _U(24)) | at.astype(_U), length - gram + 1)
    anchor = (least & _U((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    doc = np.searchsorted(bounds, starts, side="right") - 1
    valid = starts + length <= bounds[doc + 1]
    change = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))

    def runs() -> tuple[np.ndarray, np.ndarray]:
        new = valid & (change | ~np.append(False, valid[:-1]))
        return np.flatnonzero(new), np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1

    first, last = runs()
    if not len(first):
        return nothing
    found = _periodic(t, first, last, anchor[first], h, bounds[doc[first] + 1], length, gram)
    for p, n, s in found:
        valid[p + s : p + n] = False
    if found:
        first, last = runs()
    of = doc[first]
    p, n, _ = np.array(found, np.int64).reshape(-1, 3).T
    return (of, first - bounds[of], last - first, h[anchor[first]].view(np.int64), digests(t, first, last - 1 + length)), (doc[p], p - bounds[doc[p]], n)


_KINDS = "anchor long, seg long, seg2 long"
_SEGMENTS = f"{_KINDS}, rid long, start int, n int"


def _texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column end to end, and where each row begins."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = _texts(b.column("text"))
            rids, lo = b.column("rid").to_numpy(), 0
            while lo < len(rids):  # a few MB at a time; a place has 24 bits, longer documents go piece by piece
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (1 << 21), side="right")) - 1)
                a, z = int(bounds[lo]), int(bounds[hi])
                for p in range(a, max(z - length + 1, a + 1), 1 << 23):  # pieces of one document overlap by a window less a byte
                    q = min(z, p + (1 << 23) + length - 1)
                    cut = np.clip(bounds[lo : hi + 1], p, q) - p
                    (doc, start, n, anchor, seg), (p_doc, p_start, p_n) = segments(data[p:q], cut, length, gram)
                    if len(doc):
                        nothing = pa.nulls(len(p_doc), pa.int64())  # sure windows have no anchor
                        doc, start, n = np.append(doc, p_doc), np.append(start, p_start), np.append(n, p_n)
                        start = start + np.where(p > bounds[lo + doc], p - bounds[lo + doc], 0)
                        keys = [pa.concat_arrays([pa.array(x), nothing]) for x in (anchor, seg[:, 0], seg[:, 1])]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array(rids[lo + doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "seg", "seg2", "rid", "start", "n"])
                lo = hi

    return run


def _pieces(length: int, gram: int, width: int):
    """Parts of segments -> their pieces: windows whose anchor's places differ by less than ``width``."""
    names = ["anchor", "seg", "seg2", "rid", "base", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "bytes", 500_000)):
            t, bounds = _texts(b.column("bytes"))
            at = np.arange(len(t) - gram + 1)
            h = Rolling(t, _BASE)(at, at + gram) >> _U(24)
            # the leftmost of the smallest in the first window, as in segments()
            place = np.array([np.argmin(h[k : k + length - gram + 1]) for k in bounds[:-1].tolist()], np.int64)
            n = b.column("n").to_numpy().astype(np.int64)
            high, low = place // width, (place - n + 1) // width
            many = high - low + 1
            of = np.repeat(np.arange(len(n)), many)
            piece = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
            # a window's place in the part is the anchor's there less the anchor's in the window
            least, most = piece * width, np.minimum((piece + 1) * width - 1, length - gram)
            first, last = place[of] - np.minimum(place[of], most), place[of] - np.maximum((place - n + 1)[of], least)
            begin, whole = bounds[of], memoryview(np.ascontiguousarray(t))
            common = zip((begin + place[of] - least).tolist(), (begin + place[of] - most + length).tolist(), piece.tolist(), strict=True)
            anchor = np.array([xxhash.xxh3_64_intdigest(whole[x:y], k) for x, y, k in common], _U).view(np.int64)
            seg = digests(t, begin + first, begin + last + length)
            rid, base, start = (b.column(c).to_numpy()[of] for c in ("rid", "base", "start"))
            cols = [anchor, seg[:, 0], seg[:, 1], rid, base, (start + first).astype(np.int32), (last - first + 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=names)

    return run


def _judge(parts: list[tuple], length: int) -> Iterator[tuple]:
    """Suffix array over some segments -> (rid, start, n) of repeated windows."""
    texts = [np.frombuffer(x[3], np.uint8) for x in parts]
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    t = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    owned = np.zeros(len(t), bool)
    for b, x in zip(begin, texts, strict=True):
        t[b : b + len(x)] = x
        t[b : b + len(x)] += 2
        t[b + len(x)] = 1
        owned[b : b + len(x) - length + 1] = True
    sa = suffix_array(t, 258, length)
    prefix = permuted_common_prefixes(t, sa, owned, -(-length // 8) * 8)
    long = prefix >= length
    again = long.copy()
    again[sa[:-1][long[sa[1:]]]] = True
    for k, (rid, start, n, _) in enumerate(parts):
        mine = again[begin[k] : begin[k] + n]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
        for a, z in edge.reshape(-1, 2):
            yield rid, start + int(a), int(z - a)


def _shards(length: int):
    names = ["rid", "start", "n"]
    kinds = [pa.int64(), pa.int32(), pa.int32()]

    def out(parts):
        rows = list(_judge(parts, length))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, key = [], 0, None
        for b in batches:
            for anchor, *rest in zip(*(b.column(c).to_pylist() for c in ("anchor", "rid", "start", "n", "bytes")), strict=True):
                if anchor != key and size >= SHARD_BYTES:
                    yield out(parts)
                    parts, size = [], 0
                key = anchor
                parts.append(tuple(rest))
                size += len(rest[3])
        if parts:
            yield out(parts)

    return run


_PLACE, _KEY = ["rid", "start", "n"], ["anchor", "seg", "seg2"]


def _settle(keep: Scratch, segments: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What equal segments settle: one row of each kind of segment that may share windows with others, and (rid, start, n) of those repeated whole."""
    info = segments.groupBy("anchor").agg(F.count("*").alias("c"), *(f(x).alias(f"{f.__name__}_{x}") for x in ("seg", "seg2") for f in (F.min, F.max))).where("c > 1")
    info = keep(info.select("anchor", "c", F.expr("min_seg = max_seg and min_seg2 = max_seg2").alias("alike")), "anchors")
    shared = keep(join_groups(segments, info, ["anchor"], "c"), "shared-segments")
    keep.drop(info)
    mixed = shared.where("not alike")
    # of equal segments any one will do; the table settles which
    one = [F.first(x).alias(x) for x in segments.columns if x not in _KEY]
    kinds = keep(mixed.groupBy(*_KEY).agg(F.count("*").alias("m"), *one, F.max("c").alias("c")), "kinds")
    twice = join_groups(mixed.select(*_KEY, *_PLACE), kinds.where("m > 1").select(*_KEY, "m"), _KEY, "m")
    return kinds, [shared.where("alike").select(*_PLACE), twice.select(*_PLACE)]


def _mark(keep: Scratch, kinds: DataFrame, many: DataFrame) -> tuple[DataFrame, bool]:
    """Kinds marked as crowded where their anchor is one of ``many``, and whether there is any; anchors of many kinds are few, so they are sent to all tasks."""
    many = keep(many.select("anchor", F.lit(True).alias("crowded")), "crowded")
    marked = kinds.join(F.broadcast(many), "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    return marked, not many.isEmpty()


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Documents (doc_id, text) -> (rid, start, n): runs of byte positions at which a repeated string of ``length`` starts."""
    return _repeated(rows_of(docs, "text"), length, gram, shard_segments)


def _repeated(rows: DataFrame, length: int, gram: int, shard_segments: int) -> DataFrame:
    n_parts, keep = partitions(rows.sparkSession), Scratch()
    everything = keep(rows.select("rid", "text").mapInArrow(_anchors(length, gram), _SEGMENTS), "segments")
    sure = keep(everything.where("anchor is null").select(*_PLACE), "periodic")
    kinds, found = _settle(keep, everything.where("anchor is not null"))
    keep.drop(everything)
    many = kinds.where(F.col("c") > shard_segments).groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > shard_segments)
    kinds, some = _mark(keep, kinds, many)
    wanted = kinds.groupBy("rid").agg(F.collect_list(F.struct("anchor", "start", "n", "crowded")).alias("w"))  # at most the segments of one document
    cut = rows.select("rid", F.col("text").cast("binary").alias("text")).join(wanted, "rid").select("rid", F.explode(F.transform("w", lambda w: F.struct(w.alias("w"), F.substring("text", w["start"] + 1, w["n"] + length - 1).alias("bytes")))).alias("x"))
    parts = cut.select("x.w.anchor", "x.w.crowded", "rid", "x.w.start", "x.w.n", "x.bytes")
    if some:
        cut = keep(parts, "cut")
        parts, again = _deal_anew(keep, cut.where("crowded").select("rid", F.col("start").alias("base"), "n", "bytes"), length, gram, shard_segments)
        parts, found = cut.where("not crowded").drop("crowded").unionByName(parts), [*found, *again]
    judged = keep(parts.repartition(n_parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_shards(length), "rid long, start int, n int"), "judged")
    out = sure
    for part in (*found, judged):
        out = out.unionByName(part)
    return keep.finish(out, "repeated")


def _deal_anew(keep: Scratch, cut: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Segments of crowded anchors (rid, base, n, bytes) -> pieces to judge, of anchors with at most ``most``, and what is settled before."""
    width, found, few = length - gram + 1, [], []
    left = cut.withColumn("start", F.col("base"))

    def with_bytes(pieces: DataFrame) -> DataFrame:
        bytes_ = F.substring("bytes", F.col("start") - F.col("base") + 1, F.col("n") + length - 1)
        return cut.drop("n").join(pieces, ["rid", "base"]).select("anchor", "rid", "base", "start", "n", bytes_.alias("bytes"))

    some = True
    while some and width > 1:
        width = -(-width // PIECES)
        pieces = keep(left.select("rid", "base", "start", "n", "bytes").mapInArrow(_pieces(length, gram, width), f"{_KINDS}, rid long, base int, start int, n int"), "pieces")
        # equal pieces are counted before they meet by anchor: those of a passage are very many
        kinds = keep(pieces.groupBy(*_KEY).agg(F.count("*").alias("m"), *(F.first(x).alias(x) for x in ("rid", "base", "start", "n"))), "kinds")
        found.append(join_groups(pieces.select(*_KEY, *_PLACE), kinds.where("m > 1").select(*_KEY, "m"), _KEY, "m").select(*_PLACE))
        anchors = keep(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "anchors")
        kinds, some = _mark(keep, kinds, anchors.where(F.col("k") > most))
        few.append((kinds if width == 1 else kinds.where("not crowded")).join(anchors.select("anchor"), "anchor"))
        left = with_bytes(kinds.where("crowded"))
    pieces = few[0]
    for x in few[1:]:
        pieces = pieces.unionByName(x)
    return with_bytes(pieces).drop("base"), found


def _intervals(runs: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal stretches that runs of windows cover, by row and start."""
    sizes = np.diff(runs.offsets.to_numpy())
    flat = runs.flatten()
    start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
    row = np.repeat(np.arange(len(runs)), sizes)
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + n - 1 + length)[order]
    far = np.maximum.accumulate((row << 40) + end) if len(row) else end
    new = np.append(True, (row[1:] != row[:-1]) | ((row[1:] << 40) + start[1:] > far[:-1]))[: len(row)]
    first = np.flatnonzero(new)
    return row[first], start[first], (far - (row << 40))[np.append(first[1:], len(row))[: len(first)] - 1]


def _removal(length: int):
    names = ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            runs = b.column("runs")
            row, start, end = _intervals(runs.fill_null([]) if runs.null_count else runs, length)
            removed = np.bincount(row, end - start, len(texts)).astype(np.int64)
            edges = np.searchsorted(row, np.arange(len(texts) + 1))
            kept = list(texts)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, z = edges[k], edges[k + 1]
                ends, starts = [0, *end[a:z].tolist()], [*start[a:z].tolist(), len(texts[k])]
                kept[k] = b"".join([texts[k][x:y] for x, y in zip(ends, starts, strict=True)])
            cols = [pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(removed), pa.array(np.diff(edges).astype(np.int64)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), *cols], names=names)

    return run


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Documents (doc_id, text) -> rid, doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    One row per input row. Texts are UTF-8 bytes, a null one is empty; a text under
    ``length`` bytes stays whole. What remains need not be whole characters. Equal rows
    are each other's repetition. A very long text is worked on in pieces. An empty
    table gives no rows.
    """
    rows = rows_of(docs, "text")
    runs = _repeated(rows, length, gram, shard_segments).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return rows.join(runs, "rid", "left").mapInArrow(_removal(length), "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """As remove(), with the remaining bytes' sha256 in place of the bytes."""
    return remove(docs).select("rid", "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
