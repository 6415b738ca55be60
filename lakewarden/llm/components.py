"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_path, scratch_path, shuffle_width


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def dealt_apart(least: DataFrame) -> DataFrame:
    """Dealt out by no key: the join then exchanges both of its sides itself, and the planner can split a hub's."""
    return least.repartition(shuffle_width(least.sparkSession))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = dealt_apart(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = dealt_apart(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges(a, b) -> (node, component): the least node of each component, for every node with an edge.

    Nodes may be of any ordered type.  Each round is written to the shared folder,
    so lost executors cost one round at most; a hub's edges are summed before
    they are shuffled, and joins on a hub can be split by the adaptive planner.
    """
    spark = edges.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "components")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    current, path = put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        following, next_path = put(_small_star(_large_star(current)).where("u <> v").distinct())
        state = following.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        remove_path(spark, path)
        current, path = following, next_path
        if before == (state["n"], state["x"]):
            break
        before = (state["n"], state["x"])
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
