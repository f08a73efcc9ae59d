"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolidar.llm import shared


def _star(links: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and its neighbours as m. A node of many links is reduced before the shuffle for
    its minimum; the join is one that adaptive execution splits when a node is hot."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), two long columns; root is the smallest node of its component.

    Each round moves links to smaller nodes: large stars hand a node's larger neighbours to its smallest, small stars do so
    for the smaller ones. Rounds grow with the logarithm of the longest path. Rows with a null, and a = b, are no links; no
    links give no rows. Links stay in tables: the driver reads three numbers a round.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, table = None, shared.written(links, "links")
    while True:
        state = table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before or state[0] == 0:
            break
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        following = shared.written(small, "links")
        shared.drop(table.sparkSession, table)
        before, table = state, following
    roots = table.select(F.col("v").alias("node")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
