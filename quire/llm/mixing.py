"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document has an expected number of copies, its source's target over its
source's size. Within a source the documents are laid out in one order, their
expected copies are prefix-summed, one random offset per source is added, and a
document is emitted once for each integer boundary its own stretch crosses. So a
document gets the floor or the ceiling of its expectation, and the number taken
from any run of neighbours differs from what is expected by less than one copy.
The order is by size, hence neighbours are alike and the words taken follow the
target too.

The prefix sum is made of three parts, so that no task ever holds a source:
counts per (source, size), counts per (source, size, 4096 hash buckets), and the
rank inside one bucket. Expected copies are integers in units of 2^-28, so sums
are exact and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm.common import SPACE, materialise, stored, with_rid

#: Units of one copy in the prefix sums; 3 copies of 10^10 documents a source fit a long.
UNIT_BITS = 28


def word_count(text: Column) -> Column:
    """Words of a text: the pieces between white space, but for empty ones at its ends; 0 for a null text."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE)
    outer = (pieces[0] == "").cast("int") + ((F.element_at(pieces, -1) == "") & (F.size(pieces) > 1)).cast("int")
    return (F.size(pieces) - outer).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(skey, source_size) -> also target.

    Sources weigh ``weights`` in turn by code point, null last, and share the sum of
    all sizes. A source stops at ``cap`` times its size; what is left over goes to the
    others by weight, again and again. That ends at one level per unit of weight
    below which a source is capped: sources are taken by cap over weight, and one is
    capped as long as the level left by those before it exceeds its own ratio. One
    row per source only; integers until the last division.
    """
    big = "decimal(38,0)"
    by_name = W.orderBy("skey")
    s = sizes.withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    everything = W.partitionBy()
    s = s.withColumn("lim", (F.lit(cap) * F.col("source_size")).cast("long")).withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    before = W.orderBy(F.col("lim") / F.col("w"), "skey").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.col("all_size") - F.coalesce(F.sum("lim").over(before), F.lit(0))).withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("lim").cast(big) * F.col("left_w").cast(big) <= F.col("left").cast(big) * F.col("w").cast(big))
    free = ~F.col("capped")
    level = (F.col("all_size") - F.sum(F.when(F.col("capped"), F.col("lim")).otherwise(0)).over(everything)).cast("double") / F.sum(F.when(free, F.col("w")).otherwise(0)).over(everything).cast("double")
    return s.withColumn("target", F.when(F.col("capped"), F.col("lim").cast("double")).otherwise(F.when(F.sum(F.when(free, F.col("w")).otherwise(0)).over(everything) > 0, level * F.col("w")))).select("skey", "source_size", "target")


def mix(docs: DataFrame, seed: str = "quire-mix", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Documents (doc_id, text, source) -> rid, doc_id, size, source_size, target, copies, taken.

    One row per input row, also for empty texts (size 0, nothing to take) and a null
    source (a source of its own, last in order). Rows that are equal in doc_id, text
    and source are interchangeable. An empty table gives no rows.
    """
    # a source's key sorts by code point, null after all
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    tie = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))).cast("binary"))
    rows = materialise(
        with_rid(stored(docs.select("doc_id", "text", "source"))).select("rid", "doc_id", key.alias("skey"), word_count(F.col("text")).alias("size"), tie.alias("tie")), "mix-rows"
    ).withColumn("bucket", F.substring("tie", 1, 3))
    buckets = rows.groupBy("skey", "size", "bucket").agg(F.count("*").alias("n"))
    sizes = buckets.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    of_source = targets(sizes.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    earlier = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    at_size = sizes.select("skey", "size", F.coalesce(F.sum("n").over(earlier("skey").orderBy(F.desc("size"))), F.lit(0)).alias("at_size"))
    at_bucket = buckets.select("skey", "size", "bucket", F.coalesce(F.sum("n").over(earlier("skey", "size").orderBy("bucket")), F.lit(0)).alias("at_bucket"))
    place = at_bucket.join(at_size, ["skey", "size"]).select("skey", "size", "bucket", (F.col("at_size") + F.col("at_bucket")).alias("at"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("skey", "size", "bucket").orderBy("tie")).cast("long"))
    one = 1 << UNIT_BITS
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("skey")).cast("binary")), 1, UNIT_BITS // 4), 16, 10).cast("long")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(one)))).otherwise(F.lit(0)).cast("long")
    of_source = of_source.select("skey", "source_size", "target", expected.alias("e"), offset.alias("u"))
    end = (F.col("at") + F.col("rank")) * F.col("e") + F.col("u")
    copies = F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("e"), UNIT_BITS)
    out = ranked.join(place, ["skey", "size", "bucket"]).join(of_source, "skey")
    return out.select("rid", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as mix() takes it, all its columns kept."""
    docs = stored(docs)
    taken = mix(docs, **options).where("copies > 0").select(F.col("rid").alias("__rid"), F.col("copies").alias("__copies"))
    rows = with_rid(docs, "__rid").join(taken, "__rid")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__rid", "__copies", "__copy")


#: The same rows in DuckDB's SQL.
SQL = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')) as tie
  from documents),
s0 as (select skey, sum(size)::bigint as source_size from d group by skey),
s1 as (select *, 1 + (row_number() over (order by skey collate "binary") - 1) % 3 as w, 3 * source_size as lim,
              sum(source_size) over () as all_size from s0),
s2 as (select *, sum(w) over () as all_w,
              all_size - coalesce(sum(lim) over (order by lim / w, skey collate "binary" rows between unbounded preceding and 1 preceding), 0) as lft,
              sum(w) over () - coalesce(sum(w) over (order by lim / w, skey collate "binary" rows between unbounded preceding and 1 preceding), 0) as left_w from s1),
s3 as (select *, lim * left_w <= lft * w as capped from s2),
s4 as (select *, sum(case when capped then lim else 0 end) over () as c, sum(case when capped then 0 else w end) over () as f from s3),
s5 as (select skey, source_size, case when capped then lim::double when f > 0 then (all_size - c)::double / f::double * w end as target from s4),
s6 as (select *, case when source_size > 0 then floor(target / source_size * 268435456.0)::bigint else 0 end as e,
              ('0x' || substr(md5('quire-mix:' || skey), 1, 7))::bigint as u from s5),
r as (select d.*, row_number() over (partition by skey order by size desc, substr(tie, 1, 3), tie) as pos from d)
select doc_id, size, source_size, target,
       (((pos * e + u) >> 28) - ((pos * e - e + u) >> 28))::bigint as copies,
       ((((pos * e + u) >> 28) - ((pos * e - e + u) >> 28)) * size)::bigint as taken
from r join s6 using (skey)
"""
