"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, join_groups, materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(links: DataFrame) -> DataFrame:
    """(u, v) longs -> (node, component): the smallest node that each node with a link reaches.

    A round hooks every node's larger neighbours to its smallest one, then every
    node's smaller neighbours to the smallest of them; rounds end when nothing moves,
    after about the logarithm of the longest path. Links stay in tables, and a node
    with very many links is joined where they lie.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"), "smallest")
        large = materialise(join_groups(both, low, ["u"], "c").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "hooked")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "smallest")
        hooked = join_groups(large, lower, ["u"], "c")
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(small, "links")
        discard(edges, low, large, lower)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.quire_links = edges
    return out


def discard_components(*found: DataFrame) -> None:
    """Deletes the tables behind results of components()."""
    discard(*(f.quire_links for f in found))
