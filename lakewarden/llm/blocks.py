"""Bounded blocks for comparing all members of a group with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_chunks(members: DataFrame, group: str, block: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """members(group, node) -> the same with the number of chunks that keeps a chunk near `block` nodes, and near `most` of a weight."""
    chunks = F.ceil(F.count("*") / block)
    if weight is not None:
        chunks = F.greatest(chunks, F.ceil(F.sum(weight) / most))
    sizes = members.groupBy(group).agg(chunks.cast("int").alias("chunks"))
    return members.join(sizes, group)


def in_blocks(chunked: DataFrame, group: str, node: str) -> DataFrame:
    """members(group, node, chunks) -> (group, i, j, side, node): a block for every pair of chunks i <= j.

    Each node goes to as many blocks as its group has chunks; in a block of two
    different chunks `side` tells them apart, so no pair is met twice.
    """
    own = chunked.withColumn("chunk", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.select(group, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.when(F.col("chunk") > F.col("other"), 1).otherwise(0).alias("side"), node)


def spanning_forest(count: int, links) -> list[tuple[int, int]]:
    """The links, in order, that join two parts not yet connected."""
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out
