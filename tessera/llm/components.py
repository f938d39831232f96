"""Connected components of a link table, by alternating star contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, release


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of links(a, b), both bigint. Loops and repeated links are harmless.

    Each round replaces the links by ones to smaller neighbours, which keeps what is connected and at least halves the
    depth in two rounds; a hub's links are met by a join on its minimum, never gathered in one row. Rounds end when the
    links no longer change. Every round is written to the shared
    folder and deleted after the next.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        # large star: from every node to the minimum of its neighbourhood, for its larger neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node and its smaller neighbours to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        last, edges = edges, cut(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        release(last)  # a finished round is read no more
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the links still changed after the last round")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
