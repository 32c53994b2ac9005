"""MinHash near-dedup with odd sketches.

1. A document's distinct five-word shingles give its size, a 128-bit digest of the
   set, 128 MinHash samples in 32 bands of 4, and an odd sketch: each sample flips one
   bit of 1024. Equal sets are one class from here on, with one representative.
2. Representatives that share a band are a bucket. Each is paired with the smallest of
   its bucket; of these partners it keeps the one whose sketch is closest (XOR and
   population count), and that link is confirmed on full sets.
3. Links join up to components. A bucket may still span several of them. Its members
   outside of its largest component are dealt to blocks, all its members to blocks of
   their own, and each pair of blocks is a cell: sketches tell which members can have a
   partner in another component, and for these the sets are compared, all of a cell at
   once. Only links that connect something new are written, never the pairs of a group,
   and the largest component is never held against itself.

A pair of similarity 0.75 shares a band with probability 1 - (1 - 0.75^4)^32, all but
5 in a million. Sketches only discard what is below 0.5 by estimate: five standard
deviations. A bucket of any size is dealt to tasks cell by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, join_groups, partitions, rows_of, slices, stored, with_rid
from quire.llm.components import components, discard_components
from quire.llm.shingles import mix, shingle_sets

BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: Links have 100 * intersection >= PERCENT * union; sketches discard below LEAST.
PERCENT = 75
LEAST = 0.5
#: Members of a block, and shingles of its members; a leader's members are dealt in the same portions.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Ids that may be broadcast (8 MB); more of them are joined by shuffling. The result is the same.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_FP = "rid long, doc_id long, n long, s1 long, s2 long, bands array<long>, sketch binary"


def minhashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Samples (documents x 128) of the sets that have members."""
    out = np.empty((len(offsets) - 1, len(_SEEDS)), _U)
    for k, seed in enumerate(_SEEDS):
        x = hashes * seed
        out[:, k] = np.minimum.reduceat(x ^ (x >> _U(29)), offsets[:-1])
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x SKETCH_BITS / 8 bytes): each (sample, its number) flips one bit."""
    bit = (mix(samples ^ _SEEDS) % _U(SKETCH_BITS)).astype(np.int64)
    flat = np.bincount((bit + np.arange(len(samples))[:, None] * SKETCH_BITS).ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(flat.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing sketch bits; 0 where the sketches are as good as unrelated."""
    rest = 1 - 2 * np.minimum(differing, SKETCH_BITS * 0.49) / SKETCH_BITS
    return 1 + SKETCH_BITS * np.log(rest) / (4 * len(_SEEDS))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            hashes, offsets = shingle_sets(b.column("text"))
            n = np.diff(offsets)
            has = n > 0
            s1, s2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
            bands, sketches = np.zeros((len(n), BANDS), _U), [None] * len(n)
            if len(hashes):
                at = np.append(offsets[:-1][has], len(hashes))
                s1[has], s2[has] = np.add.reduceat(mix(hashes), at[:-1]), np.add.reduceat(mix(hashes ^ _SEEDS[0]), at[:-1])
                samples = minhashes(hashes, at)
                key = np.zeros((len(samples), BANDS), _U) + np.arange(BANDS, dtype=_U)
                for r in range(ROWS):
                    key = mix(key * _U(31) + samples[:, r::ROWS])
                bands[has] = key
                for k, x in zip(np.flatnonzero(has), odd_sketches(samples), strict=True):
                    sketches[k] = x.tobytes()
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * BANDS).astype(np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, pa.array(sketches, pa.binary())], names=["rid", "doc_id", "n", "s1", "s2", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts -> their sets; a shingle is (hash, check), sixteen bytes."""
    for whole in batches:
        for b in slices(whole, "text"):
            hashes, offsets, checks = shingle_sets(b.column("text"), lanes=2)
            both = np.stack([hashes, checks], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([both[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["id", "shingles"])


def _linked(common: np.ndarray, a, b) -> np.ndarray:
    return 100 * common >= PERCENT * (a + b - common)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _U).reshape(-1, 2)


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leader, its own first -> confirmed links (u, v)."""
    leader, own, check = None, None, None
    for b in batches:
        u, v = [], []
        for lead, node, data in zip(*(b.column(c).to_pylist() for c in ("leader", "id", "shingles")), strict=True):
            s = _set(data)
            if node == lead:
                leader, own, check = lead, np.ascontiguousarray(s[:, 0]), np.ascontiguousarray(s[:, 1])
            elif lead == leader and len(s):
                at = np.minimum(np.searchsorted(own, s[:, 0]), len(own) - 1)
                common = int(((own[at] == s[:, 0]) & (check[at] == s[:, 1])).sum())
                if _linked(common, len(own), len(s)):
                    u.append(node)
                    v.append(lead)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


_CELL = ("bucket", "i", "j")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a cell with sketches -> those that may have a partner in another component.

    ``mine`` marks the members that are to be held against all others of the cell.
    """
    for key, g in _groups(batches, _CELL):
        sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g["id"]), -1)
        comp, n, mine = np.array(g["comp"]), np.array(g["n"]), np.array(g["mine"], bool)
        flag = np.zeros(len(n), bool)
        for k in np.flatnonzero(mine):
            ok = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= PERCENT * np.maximum(n, n[k]))
            at = np.flatnonzero(ok)
            at = at[estimate(np.bitwise_count(sketch[at] ^ sketch[k]).sum(axis=1)) >= LEAST]
            if len(at):
                flag[k] = flag[at] = True
        at = np.flatnonzero(flag)
        cols = [[key[0]] * len(at), [key[1]] * len(at), [key[2]] * len(at), [g["id"][k] for k in at], [g["comp"][k] for k in at]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(mine[at])], names=[*_CELL, "id", "comp", "mine"])


def _groups(batches, by: tuple[str, ...]) -> Iterator[tuple[tuple, dict]]:
    """Rows sorted by ``by`` -> (key, columns as lists) of each group; a group is one cell at most."""
    key, held = None, None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        for row in range(b.num_rows):
            k = tuple(cols[c][row] for c in by)
            if k != key:
                if held:
                    yield key, held
                key, held = k, {c: [] for c in cols}
            for c, values in cols.items():
                held[c].append(values[row])
    if held:
        yield key, held


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open members of a cell with sets -> links that connect different components."""
    for _, g in _groups(batches, _CELL):
        sets = [_set(x) for x in g["shingles"]]
        n = np.array([len(s) for s in sets])
        ids, mine = np.array(g["id"]), np.array(g["mine"], bool)
        every = np.concatenate(sets)
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.append(0, (every[order[1:]] != every[order[:-1]]).any(axis=1))
        code = np.empty(len(every), np.int64)
        code[order] = np.cumsum(new)
        del every, sets, order, new
        begin = np.cumsum(n) - n
        _, comp = np.unique(np.array(g["comp"]), return_inverse=True)
        mark = np.zeros(len(code) + 1, np.int64)
        u, v = [], []
        for k in np.argsort(np.bincount(comp)[comp], kind="stable"):  # small components first
            if (comp == comp[k]).all():
                break
            if not mine[k]:
                continue
            own = code[begin[k] : begin[k] + n[k]]
            mark[own] = 1
            common = np.add.reduceat(mark[code], begin)
            mark[own] = 0
            for other in np.flatnonzero(_linked(common, n, n[k]) & (comp != comp[k])):
                if comp[other] != comp[k]:
                    u.append(int(ids[k]))
                    v.append(int(ids[other]))
                    comp[comp == comp[other]] = comp[k]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _best_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sketches -> pairs that can be links, with their estimate."""
    for b in batches:
        if not b.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sketch", "l_sketch"))
        n, m = b.column("n").to_numpy(), b.column("l_n").to_numpy()
        est = estimate(np.bitwise_count(one ^ two).sum(axis=1))
        ok = (est >= LEAST) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(ok)) for c in ("id", "n", "leader")), pa.array(est[ok])], names=["id", "n", "leader", "est"])


def _portions(members: str, shingles: str):
    """Into how many blocks so many members with so many shingles go."""
    return F.greatest(F.ceil(F.col(members) / F.lit(BLOCK)), F.ceil(F.col(shingles) / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) -> rid, doc_id, n_shingles, class_id, component_id, kept, component.

    One row per input row. Documents are linked if 100 * intersection >= 75 * union of
    their shingle sets; those without words (null and empty texts too) with nothing,
    not even each other. class_id is the smallest doc_id with the same set,
    component_id the smallest doc_id reachable (null ids are passed over), kept marks
    the rows that carry it; a document without words has its own. component is one
    number for all rows of a component. Repeated rows are rows of one class. A very
    long text is one set, held by one task at a time. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n_parts, keep = partitions(spark), Scratch()
    rows = rows_of(docs, "text")
    fp = keep(rows.mapInArrow(_fingerprints, _FP), "fingerprints")
    worded = fp.where("n > 0")
    digest = ["n", "s1", "s2"]
    classes = keep(worded.groupBy(*digest).agg(F.min("rid").alias("cls"), F.min("doc_id").alias("class_id"), F.count("*").alias("c")), "classes")
    reps = keep(worded.join(classes.select(F.col("cls").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("id"), "n", "bands", "sketch"), "representatives")
    at = reps.select("id", "n", F.explode("bands").alias("bucket"))
    buckets = keep(at.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("c")).where("c > 1"), "leaders")
    shared = keep(join_groups(at, buckets, ["bucket"], "c"), "buckets")
    ids = keep(shared.select("id").distinct(), "candidates")
    few = ids.count() <= BROADCAST_IDS
    wanted = ids.select(F.col("id").alias("rid"))
    sets = keep(rows.select("rid", "text").join(F.broadcast(wanted) if few else wanted, "rid", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "sets")
    info = keep(reps.select("id", "n", "sketch").join(F.broadcast(ids) if few else ids, "id", "left_semi"), "sketches")
    keep.drop(reps)
    # each member with the closest of its buckets' leaders
    pairs = keep(shared.where("id <> leader").select("id", "leader").distinct(), "pairs")
    leads = keep(pairs.groupBy("leader").agg(F.count("*").alias("c")).join(info.select(F.col("id").alias("leader"), F.col("n").alias("l_n"), F.col("sketch").alias("l_sketch")), "leader"), "lead-sketches")
    close = join_groups(pairs, leads, ["leader"], "c").join(info, "id").mapInArrow(_best_pairs, "id long, n long, leader long, est double")
    best = keep(close.groupBy("id", "n").agg(F.max(F.struct("est", "leader")).alias("x")).select("id", "n", F.col("x.leader").alias("leader")), "best")
    keep.drop(pairs, leads)
    per = keep(best.groupBy("leader").agg(F.count("*").alias("c"), F.sum("n").alias("w")).select("leader", "c", _portions("c", "w").alias("portions")), "portions")
    dealt = join_groups(best, per, ["leader"], "c").select("id", "leader", F.pmod(F.xxhash64("id"), "portions").alias("salt"))
    heads = per.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("salt"))
    sent = dealt.unionByName(heads).join(sets, "id").repartition(n_parts, "leader", "salt").sortWithinPartitions("leader", "salt", F.col("id") != F.col("leader"))
    first = keep(sent.select("leader", "id", "shingles").mapInArrow(_with_leader, "u long, v long"), "links-1")
    stars = components(first)
    # buckets that span several components
    spread = keep(shared.select("bucket", "id", "n").join(stars.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp")), "spread")
    keep.drop(shared)
    sizes = spread.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    spans = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("m").alias("c"), F.sum("w").alias("w"), F.max(F.struct("m", "comp", "w")).alias("x")).where("k > 1")
    spans = spans.select("bucket", "c", "w", F.col("x.comp").alias("largest"), (F.col("c") - F.col("x.m")).alias("rest"), (F.col("w") - F.col("x.w")).alias("rest_w"))
    spans = keep(spans.select("bucket", "c", "largest", _portions("c", "w").alias("of_all"), _portions("rest", "rest_w").alias("of_rest")), "spans")
    spread = join_groups(spread, spans, ["bucket"], "c")
    place = spread.select("bucket", "id", "comp", "of_all", "of_rest", F.pmod(F.xxhash64("id"), "of_all").alias("at"), F.when(F.col("comp") != F.col("largest"), F.pmod(F.xxhash64("id", F.lit(1)), "of_rest")).alias("own"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cells = F.transform(upto("of_rest"), lambda i: F.struct(i.alias("i"), F.col("at").alias("j")))
    cells = F.when(F.col("own").isNull(), cells).otherwise(F.array_union(cells, F.transform(upto("of_all"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))))
    in_cells = place.select("bucket", "id", "comp", "own", F.explode(cells).alias("x")).select("bucket", "x.i", "x.j", "id", "comp", F.coalesce(F.col("own") == F.col("x.i"), F.lit(False)).alias("mine"))
    still = in_cells.join(info, "id").repartition(n_parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_open, "bucket long, i long, j long, id long, comp long, mine boolean")
    still = keep(still, "open")
    # the same open members in several bands are looked at once
    once = still.groupBy(*_CELL).agg(F.sum(F.xxhash64("id", "mine").cast("decimal(38,0)")).alias("h"), F.count("*").alias("k")).groupBy("h", "k").agg(F.min(F.struct(*_CELL)).alias("x")).select("x.*")
    second = still.join(once, list(_CELL)).join(sets, "id").repartition(n_parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_close, "u long, v long")
    second = keep(second, "links-2")
    final = components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second))
    labelled = keep(classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").select(*digest, "c", "class_id", F.coalesce("component", "cls").alias("component")), "labelled")
    smallest = keep(labelled.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("many")), "smallest")
    known = keep(join_groups(labelled, smallest, ["component"], "many").select(*digest, "c", "class_id", "component", "component_id"), "known")
    out = join_groups(worded.select("rid", "doc_id", *digest), known, digest, "c")
    out = out.select("rid", "doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "component")
    wordless = fp.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("rid").alias("component"))
    result = keep.finish(out.unionByName(wordless), "near-duplicates")
    discard_components(stars, final)
    return result


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("rid", "doc_id", "n_shingles", "component_id", "kept", "class_id")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each component, all columns: the smallest doc_id's row, of several the one with the smallest rid."""
    docs = stored(docs)
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("component").agg(F.min("rid").alias("__rid")).select("__rid")
    return with_rid(docs, "__rid").join(kept, "__rid", "left_semi").drop("__rid")
