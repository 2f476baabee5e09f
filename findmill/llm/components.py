"""Connected components of a table of links, by alternating large and small stars.

Each round links every node's larger neighbours to its smallest one (large star) and every
node's smaller neighbours to the smallest of them (small star), until the links are stars
around the smallest node of each component.  Rounds are joins and combined aggregates; each
is written to the shared folder, so lineage stays short and nothing goes to the driver but
two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from findmill.llm.tables import forget, settled


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links(a, b)`` that is not the smallest of its component.

    Nodes are numbers; NULLs and links of a node to itself are ignored.  A node that is not
    listed is the smallest of its own component.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = settled(edges.distinct(), "links")
    last = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if sums == last:
            break
        last = sums
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settled(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
