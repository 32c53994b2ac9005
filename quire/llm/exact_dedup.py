"""Exact dedup by deterministic block naming.

A text (A-Z lower-cased, UTF-8) is cut into fixed-size blocks. All blocks of the
corpus are sorted and named by their rank among the different ones; then the names
of adjacent blocks are paired, pairs are sorted and named in the same way, and so
on until each document has one name. Two documents with as many blocks have the
same name exactly when all their blocks are equal: names come from comparing
contents, so there is nothing to collide.

Sorting is a range partitioning on (key, row), so a block that a third of all rows
share is spread over several partitions; a name is the rank in the partition plus
what the partitions before it hold, less one where a partition goes on with the key
that the one before it ended with. Only those counts and edge digests (two per
partition) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, join_groups, partitions, rows_of, stored, with_rid

BLOCK = 8192
_DOC = "rid long, doc_id long, sha binary, n_blocks int, left int, idx int"


def _blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "doc_id", "sha", "n_blocks", "left", "idx", "h", "block"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for rid, doc_id, text in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                t = (text or b"").lower()  # on bytes: A-Z only
                n = max(1, -(-len(t) // block))
                sha = hashlib.sha256(t).digest()
                for k in range(n):
                    part = t[k * block : (k + 1) * block]
                    for c, v in zip(cols, (rid, doc_id, None if k else sha, n, n, k, hashlib.blake2b(part, digest_size=16).digest(), part), strict=True):
                        c.append(v)
                size += len(t)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
                    cols, size = [[] for _ in names], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def _ranks(same: tuple[str, ...]):
    """Sorted rows -> their document columns, partition and rank in it; at the end a row with the edges."""
    keep = ["rid", "doc_id", "sha", "n_blocks", "left", "idx"]

    def digest(b: pa.RecordBatch, row: int) -> bytes:
        h = hashlib.sha256()
        for c in same:
            v = b.column(c)[row].as_py()
            h.update(v if isinstance(v, bytes) else b"%d;" % v)
        return h.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, rank, last, first_edge, last_edge, more = TaskContext.get().partitionId(), -1, None, None, None, 0
        names = [*keep, "pid", "rank", "first_edge", "last_edge"]
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in same:
                col = b.column(c)
                new[1:] |= pc.not_equal(col.slice(1), col.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or any(b.column(c)[0].as_py() != v for c, v in zip(same, last, strict=True))
            last = [b.column(c)[b.num_rows - 1].as_py() for c in same]
            first_edge = first_edge or digest(b, 0)
            last_edge = digest(b, b.num_rows - 1)
            at = rank + np.cumsum(new)
            rank = int(at[-1])
            more += pc.sum(pc.greater(b.column("left"), 1)).as_py() or 0
            nothing = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.full(b.num_rows, pid)), pa.array(at), nothing, nothing], names=names)
        if rank >= 0:
            row = [None, more, None, None, None, None, pid, rank + 1, first_edge, last_edge]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return run


def name(rows: DataFrame, order: tuple[str, ...], same: tuple[str, ...], label: str, keep: Scratch) -> tuple[DataFrame, int]:
    """Adds ``name``, the same integer for rows that agree in ``same``, in the order of ``order``.

    Also returns how many rows belong to documents with more than one block left.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order[:1], *(order[1:] if order[0] != "h" else ()), "rid", "idx").sortWithinPartitions(*order)
    ranked = keep(dealt.mapInArrow(_ranks(same), f"{_DOC}, pid long, rank long, first_edge binary, last_edge binary"), label)
    base, offsets, before, more = 0, [], None, 0
    for e in sorted(ranked.where("rid is null").select("doc_id", "pid", "rank", "first_edge", "last_edge").collect(), key=lambda e: e.pid):
        goes_on = before is not None and before == bytes(e.first_edge)
        offsets.append((e.pid, base - goes_on))
        base, before, more = base + e.rank - goes_on, bytes(e.last_edge), more + e.doc_id
    places = F.broadcast(spark.createDataFrame(offsets, "pid long, base long"))  # a row per partition
    named = ranked.where("rid is not null").join(places, "pid").withColumn("name", F.col("base") + F.col("rank"))
    return named.select("rid", "doc_id", "sha", "n_blocks", "left", "idx", "name"), more


def identities(docs: DataFrame, block: int = BLOCK, keep: Scratch | None = None) -> DataFrame:
    """Documents (doc_id, text) -> rid, doc_id, sha, n_blocks, name: equal texts have equal (n_blocks, name)."""
    keep = keep or Scratch()
    rows = rows_of(docs, "text").mapInArrow(_blocks(block), f"{_DOC}, h binary, block binary")
    named, more = name(rows, ("h", "block"), ("block",), "names-0", keep)
    done = named.where("left = 1")
    level = 0
    while more:
        level += 1
        odd = F.col("idx") % 2 == 1
        pairs = (
            named.where("left > 1")
            .groupBy("rid", F.shiftright("idx", 1).alias("pair"))
            .agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("n_blocks").alias("n_blocks"), F.max("left").alias("left"), F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"))
            .select("rid", "doc_id", "sha", "n_blocks", F.shiftright(F.col("left") + 1, 1).alias("left"), F.col("pair").alias("idx"), "a", "b")
        )
        named, more = name(pairs, ("a", "b"), ("a", "b"), f"names-{level}", keep)
        done = done.unionByName(named.where("left = 1"))
    return done.select("rid", "doc_id", "sha", "n_blocks", "name")


def dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents (doc_id, text) -> rid, doc_id, keep_id, group_size, kept, text_sha256.

    One row per input row. Null and empty texts are equal. Of equal texts the row with
    the largest doc_id is kept (a null id is smallest; among rows with that same id the
    one with the largest rid), so just one of each group. A very long text is so many
    blocks, wherever they go. An empty table gives no rows.
    """
    keep = Scratch()
    ids = identities(docs, block, keep)
    groups = keep(ids.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")), "groups")
    out = join_groups(ids, groups, ["n_blocks", "name"], "group_size")
    out = out.select("rid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return keep.finish(out, "identities")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that dedup() keeps, all columns."""
    docs = stored(docs)
    kept = dedup(docs).where("kept").select(F.col("rid").alias("__rid"))
    return with_rid(docs, "__rid").join(kept, "__rid", "left_semi").drop("__rid")


#: The same rows in DuckDB's SQL.
SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
"""
