"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; the r-th of n
rows of a source has the fractional rank (r - 1/2) / n.  In the order of
fractional ranks every stretch holds the sources in the corpus's proportions,
so cutting that order into equal stretches gives shards that match the mixture
and whose counts differ by one at most.

Both ranks are taken in two levels: rows fall into hash (or rank) ranges, counts
of the ranges are summed up, and row_number runs inside a range only.  No window
ever spans a source, so a source with a third of all rows is no hot task.

Null and odd input: the null source is a source of its own; a null text has
size 1 and the crc of no bytes; repeated rows each get a slot of their own;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash60, shuffle_width, written

#: Rows in one rank range: a window's task holds a few of these.
MOST_ROWS_A_RANGE = 50_000


def _range_count(spark, rows: int) -> int:
    """Ranges by which rows are ranked: about four a shuffle partition, more where they would grow past the bound."""
    return max(1, min(rows // 32, 4 * shuffle_width(spark)), math.ceil(rows / MOST_ROWS_A_RANGE))


def _global_rank(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """1-based rank of each row in its group by (bucket, order), bucket being monotone in the order."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket") == F.col("_b")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return local.join(offsets, cond).withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_b", "_before", "_local", "_n", *[f"_g{i}" for i in range(len(group))])


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 10) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot (its place in the shard, from 0)."""
    spark = docs.sparkSession
    raw = F.col(text_col).cast("binary")
    base = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("~")).alias("stratum"),
            F.col(source_col).cast("string").alias("source"),
            (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            hash60(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("h"),
        ),
        "shard-rows",
    )
    total = base.count()
    ranges = _range_count(spark, total)
    tie = [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    spread = ((F.col("h").cast("double") / float(1 << 60)) * ranges).cast("long")
    ranked = _global_rank(base, ["stratum"], spread, tie, "r")
    sizes = base.groupBy("stratum").agg(F.count("*").alias("stratum_n"))
    fraction = (2 * F.col("r") - 1) / (2 * F.col("stratum_n"))
    # two passes over what follows: the counts of its ranges, and the rows
    placed = written(ranked.join(sizes, "stratum").withColumn("fraction", fraction).withColumn("_all", F.lit(0)), "shard-fractions")
    placed = _global_rank(placed, ["_all"], (F.col("fraction") * ranges).cast("long"), [F.col("fraction"), F.col("stratum"), *tie], "p")
    at = F.col("p") - 1
    shard = F.expr(f"cast((p - 1) * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"((shard * cast({max(total, 1)} as bigint)) + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (at - first).cast("long")).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
