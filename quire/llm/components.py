"""Connected components of a link table by alternating stars.

Every round is two aggregates and two joins over the links: each node's larger neighbours, then its
smaller ones, are hung on the smallest node it sees.  When nothing changes, every node points at the
smallest node of its component.  Rounds are written to the shared folder, so a lost executor costs a
round at most.  A hub's links are spread over all tasks by the partial minimum; in the joins they
are one key against one row, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stage


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long ids -> (node, root): the smallest node reachable, for every node that
    has a link to another node.  Null ids, loops and repeated links are ignored."""
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "links")
    seen = _mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
