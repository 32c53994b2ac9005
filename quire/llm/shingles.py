"""Word shingles of whole texts as hashes, in array operations over a batch.

A word is known by its 128-bit digest (XXH3, no algebra to collide by), a shingle by a
linear form of its words' digests. The first 64 bits make the sets, the other 64 bits
are there to confirm what two sets have in common.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (splitmix64's last steps)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _factors(words: int) -> np.ndarray:
    """Odd factors of a shingle's words and, last, of a short text's number of words; a row for each lane."""
    return (mix(np.arange(1, 2 * words + 3, dtype=_U)) | _U(1)).reshape(2, words + 1)


def shingle_sets(col: pa.Array, words: int = WORDS, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """(hashes, offsets) or with two lanes (hashes, offsets, checks).

    The sorted distinct shingles of row k are hashes[offsets[k]:offsets[k+1]]. Words are
    runs of anything but space and \\t..\\r, after lower-casing A-Z. A text with fewer
    words than a shingle is one shingle; one without words has none.
    """
    texts = [(t or b"").lower().split() for t in col.cast(pa.binary()).to_pylist()]  # on bytes: A-Z, space and \t..\r only
    count = np.fromiter(map(len, texts), np.int64, len(texts))
    found = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(texts))), _U).reshape(-1, 2)
    del texts
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(found)) - first[of] + words <= count[of]
    few = np.flatnonzero((count > 0) & (count < words))
    of = np.concatenate([of[whole], few])
    sums = []
    for lane in range(lanes):
        h, factor = np.ascontiguousarray(found[:, lane]), _factors(words)[lane]
        full = np.zeros(len(h), _U)
        if len(h) >= words:
            for k in range(words):
                full[: len(h) - words + 1] += h[k : len(h) - words + 1 + k] * factor[k]
        short = count[few].astype(_U) * factor[words]
        for k in range(words - 1):
            has = count[few] > k
            short[has] += h[first[few[has]] + k] * factor[k]
        sums.append(mix(np.concatenate([full[whole], short])))
    hashes = sums[0]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    keep = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))[: len(of)]
    hashes, of = hashes[keep], of[keep]
    offsets = np.searchsorted(of, np.arange(len(count) + 1))
    return (hashes, offsets, sums[1][order][keep]) if lanes == 2 else (hashes, offsets)
