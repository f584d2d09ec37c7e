"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpointed


def connected_components(links: DataFrame, one: str, other: str) -> DataFrame:
    """``(node, component)`` of every node with a link; a component is its least node.

    Rounds of large and small stars: every node hangs its larger neighbours, then its
    smaller ones, below the least node it knows of.  A round is a few equality joins and
    minima combined before the shuffle, it never raises the number of links, and the
    number of rounds grows with the logarithm of the longest path.  Each round is written
    to the shared checkpoint folder.  Links with a null end or between a node and itself
    link nothing.  No links give no rows.
    """
    low, high = F.least(one, other), F.greatest(one, other)
    pairs = links.where(F.col(one) != F.col(other)).select(high.alias("u"), low.alias("v"))
    pairs = checkpointed(pairs.distinct())
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        least = least.select("u", F.least("u", "low").alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u")
        large = large.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where(F.col("v") != F.col("low"))
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v"))
        pairs = checkpointed(
            small.unionByName(least.select("u", F.col("low").alias("v"))).distinct()
        )
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _mark(pairs: DataFrame) -> tuple[int, int | None]:
    """Number of pairs and a checksum of them; equal for equal sets."""
    row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
