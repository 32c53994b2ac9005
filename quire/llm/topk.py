"""Exact top-k by inner product: columnar branch and bound.

Vectors become integers floor(1024 * x). A tile of candidates is held dimension by
dimension (vertically); scores of a group of queries are accumulated block by block
of dimensions. After each block a candidate stays only if its score so far plus the
product of both remaining norms (an upper bound for what the other dimensions can
add) reaches the query's k-th best score; the survivors are compacted and only they
go on. Dimensions with the largest mass in the queries come first.

Queries are dealt to blocks of a bounded size, in rows and in bytes. One block at a
time is fetched, sent to all tasks and given up again; each task returns its own best
k per query, and what a block's tasks found is written before the next one goes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm.common import materialise, stored, with_rid

SCALE = 1024
#: Queries of a block, and bytes of their components.
QUERY_BLOCK, QUERY_BYTES = 20_000, 32_000_000
TILE = 2048
GROUP = 512
DIMS = 16
_BIG = np.iinfo(np.int64).max
_OUT = "q_rid long, query_id long, score long, vec_id long, rid long"


def _matrix(col: pa.ListArray) -> np.ndarray:
    """Rows of scaled components, floored; shorter rows are filled up with 0."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    sizes = np.diff(col.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _fit(m: np.ndarray, dims: int) -> np.ndarray:
    return m[:, :dims] if m.shape[1] >= dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def _rest(m: np.ndarray, starts: list[int]) -> list[np.ndarray]:
    """Norms of what comes after each block of dimensions, a little too large."""
    tail = np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]
    return [np.sqrt(tail[:, s]) * (1 + 1e-9) + 1e-6 if s < m.shape[1] else np.zeros(len(m)) for s in starts]


class Best:
    """The k best (score, vec_id, rid) of each query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vec, self.null, self.rid = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, q, score, vec, null, rid) -> None:
        if not len(q):
            return
        q, score, vec, null, rid = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.vec, vec), (self.null, null), (self.rid, rid)))
        order = np.lexsort((rid, vec, null, ~score, q))  # ~ has no overflow
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q = order[place < self.k], q[place < self.k]
        self.q, self.score, self.vec, self.null, self.rid = q, score[order], vec[order], null[order], rid[order]
        last = place[place < self.k] == self.k - 1
        self.least[q[last]] = self.score[last]


def _search(best: Best, queries: np.ndarray, q_rid: np.ndarray, m: np.ndarray, vec, null, rid) -> None:
    """Adds what a tile of candidates holds for all queries of the block."""
    dims = queries.shape[1]
    starts = list(range(0, dims, DIMS)) or [0]
    upto = [min(dims, s + DIMS) for s in starts]
    vertical = np.ascontiguousarray(m.T)
    c_rest = _rest(m, upto)
    own = {int(r): k for k, r in enumerate(rid)}
    for lo in range(0, len(queries), GROUP):
        part = queries[lo : lo + GROUP]
        q_rest, least = _rest(part, upto), best.least[lo : lo + GROUP]
        score = np.zeros((len(part), len(m)))
        for k, r in enumerate(q_rid[lo : lo + GROUP]):
            if int(r) in own:
                score[k, own[int(r)]] = -np.inf
        qi = ci = s = None
        for b, (start, end) in enumerate(zip(starts, upto, strict=True)):
            if qi is None:
                score += part[:, start:end] @ vertical[start:end]
                stay = score + q_rest[b][:, None] * c_rest[b][None, :] >= least[:, None]
                stay &= score > -np.inf
                if end == dims or stay.mean() < 0.25:
                    qi, ci = np.nonzero(stay)
                    s = score[qi, ci]
            else:
                s = s + np.einsum("ij,ji->i", part[qi, start:end], vertical[start:end, ci])
                stay = s + q_rest[b][qi] * c_rest[b][ci] >= least[qi]
                qi, ci, s = qi[stay], ci[stay], s[stay]
        best.add(qi + lo, s.astype(np.int64), vec[ci], null[ci], rid[ci])


def _exact(best: Best, queries: np.ndarray, q_rid: np.ndarray, m: np.ndarray, vec, null, rid) -> None:
    """For components too large for exact doubles: Python integers, scores held within long."""
    ints = [[int(x) for x in row] for row in m]
    for k, row in enumerate(queries):
        q = [int(x) for x in row]
        scores = np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))) for c in ints], object)
        ok = rid != q_rid[k]
        best.add(np.full(int(ok.sum()), k), scores[ok].astype(np.int64), vec[ok], null[ok], rid[ok])


def _task(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rid, q_id, queries, order = sent.value
        best = Best(len(q_rid), k)
        top = np.abs(queries).max(initial=0)
        for b in batches:
            m = _fit(_matrix(b.column("embedding")), queries.shape[1])[:, order]
            rid = b.column("rid").to_numpy()
            null = b.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            vec = b.column("vec_id").fill_null(_BIG).to_numpy()
            small = queries.shape[1] * top * np.abs(m).max(initial=0) < 2**52
            for lo in range(0, len(m), TILE):
                x = slice(lo, lo + TILE)
                (_search if small else _exact)(best, queries, q_rid, m[x], vec[x], null[x], rid[x])
        q = best.q
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_rid[q]), pa.array(q_id[q]), pa.array(best.score), pa.array(best.vec, mask=best.null), pa.array(best.rid)], names=["q_rid", "query_id", "score", "vec_id", "rid"]
        )

    return run


def topk(vectors: DataFrame, k: int = 10, every: int = 100, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Vectors (vec_id, embedding) -> query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all
    other rows. Vectors that are null or hold a null or non-finite component take no
    part; of different lengths, the shorter is filled up with zeros. A row is a query's
    own only if it is the same row: of rows with equal ids each is a query and a
    candidate to the others. Ties go to the smaller vec_id, a null id last. A query
    without candidates has no rows. Scores are exact integers whatever the size of the
    components; one beyond the range of long is held at its end. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = with_rid(stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))).where(F.col("embedding").isNotNull() & finite)
    queries = rows.where(F.col("vec_id") % every == 0)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    block = max(1, min(query_block, QUERY_BYTES // (8 * max(1, size.dims or 0))))
    blocks = -(-size.n // block)
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).toArrow()  # about a block of rows
        if not part.num_rows:
            continue
        m = _matrix(part.column("embedding"))
        order = np.argsort(-(m * m).sum(axis=0), kind="stable")
        sent = spark.sparkContext.broadcast((part.column("rid").to_numpy(), part.column("vec_id").to_numpy(), np.ascontiguousarray(m[:, order]), order))
        found = rows.mapInArrow(_task(sent, k), _OUT)
        if blocks > 1:
            found = materialise(found, "best")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("q_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB's SQL.
SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
