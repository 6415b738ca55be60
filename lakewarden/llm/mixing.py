"""Mixing sources to target weights by nested hash-threshold histograms.

Sizes are summed by source and by the leading digit of a 60-bit row hash.  The
running sum tells which bucket holds a source's budget; only that bucket is
split again by the next digit, until it holds one hash.  What the mix takes is
then `hash < threshold`: rows are filtered, never sorted, and each pass shuffles
sources x 1024 partial sums however many rows there are.

A source whose target exceeds its size is taken whole as often as the target
holds it, and the threshold picks the rows of one more copy.

Sources may be any number: their sizes, ranks, targets and thresholds are tables.
Up to MAX_BROADCAST_SOURCES of them are broadcast to the rows; beyond it rows and
sources are joined, each source in SALTS copies, so that a large source is dealt
to as many tasks at least.

Null and odd input: a null or empty text has size 0 and takes nothing; the null
source counts as one source, after all others.  Rows with the same id share a
hash, so repeated rows are taken together.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash60, packed, written

WORD = r"[^\x20\x09-\x0D]+"
DIGIT_BITS = 10
LEVELS = 6
#: Rows of a table of sources that is broadcast; a join beyond it.
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(totals: DataFrame) -> DataFrame:
    """totals(source, n) -> with the source's place (from 0) by code point, null last: places of ranges, then inside a range."""
    order = [F.col("source").isNull(), F.col("source")]
    ranges = written(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    # a row per range: no more than the shuffle has partitions
    before = ranges.groupBy("part").agg(F.count("*").alias("m")).select("part", F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return ranges.withColumn("inside", inside).join(F.broadcast(before), "part").select("source", "n", (F.col("before") + F.col("inside")).alias("place"))


def share_targets(weighted: DataFrame, cap: float) -> DataFrame:
    """weighted(source, n, w) -> with target: the sum of all sizes split by weight, none above cap times its size, the excess reshared by weight.

    Targets are min(cap n, level w): the level rises as sources reach their caps, a sum over the sources for each step.
    """
    whole = weighted.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("m")).first()
    level, fixed = (whole["n"] / whole["w"] if whole["m"] else 0.0), -1
    while True:
        over = F.col("n") * cap < F.col("w") * level
        seen = weighted.agg(F.count_if(over).alias("m"), F.sum(F.when(over, F.col("n"))).alias("n"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if seen["m"] in (fixed, whole["m"]):
            break
        fixed, level = seen["m"], (whole["n"] - cap * (seen["n"] or 0)) / seen["w"]
    return weighted.withColumn("target", F.least(F.col("n") * cap, F.col("w") * level).cast("double"))


def _digit(level: int) -> Column:
    return F.shiftright(F.col("h"), 60 - DIGIT_BITS * (level + 1)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long"))


def with_source_facts(rows: DataFrame, source: Column, facts: DataFrame, h: Column) -> DataFrame:
    """rows joined with facts(b_source, ..), a row per source."""
    if facts.count() <= MAX_BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), source.eqNullSafe(F.col("b_source")))
    salted = facts.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, source.eqNullSafe(F.col("b_source")) & (F.pmod(h, F.lit(SALTS)).cast("int") == F.col("b_salt"))).drop("b_salt")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """sized(source, size, h), budgets(source, budget) -> (source, threshold): the hash below which a source's rows add up nearest to its budget."""
    done = [budgets.where("budget <= 0").select("source", F.lit(0).cast("long").alias("threshold"))]
    # the prefix of each boundary bucket, and the size below it
    waiting = budgets.where("budget > 0").select(F.col("source").alias("b_source"), F.lit(0).cast("long").alias("b_prefix"), F.lit(0).cast("long").alias("below"), F.col("budget").cast("double").alias("budget"))
    for level in range(LEVELS):
        inside = with_source_facts(sized, F.col("source"), waiting, F.col("h")).where(F.shiftright("h", 60 - DIGIT_BITS * level) == F.col("b_prefix"))
        hist = inside.groupBy("b_source", "below", "budget", _digit(level).alias("digit")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 0")
        upto = F.sum("n").over(W.partitionBy("b_source").orderBy("digit"))  # 1,024 rows a source at most
        reached = hist.withColumn("upto", F.col("below") + upto).where("upto >= budget")
        first = reached.groupBy(F.col("b_source").alias("f_source")).agg(F.min(F.struct("digit", "upto", "n", "lo", "hi")).alias("x"))
        met = waiting.join(first, F.col("b_source").eqNullSafe(F.col("f_source")), "left")
        low, ends = F.col("x.upto") - F.col("x.n"), (F.col("x.lo") == F.col("x.hi")) if level < LEVELS - 1 else F.lit(True)
        nearest = F.when(F.col("budget") - low < F.col("x.upto") - F.col("budget"), F.col("x.lo")).otherwise(F.col("x.hi") + 1)
        # a source with less than its budget is taken whole
        decided = F.when(F.col("x").isNull(), F.lit(1 << 60)).when(ends, nearest)
        state = written(met.select("b_source", (F.shiftleft("b_prefix", DIGIT_BITS) + F.col("x.digit")).alias("b_prefix"), low.alias("below"), "budget", decided.cast("long").alias("threshold")), "mix-thresholds")
        done.append(state.where("threshold IS NOT NULL").select(F.col("b_source").alias("source"), "threshold"))
        waiting = state.where("threshold IS NULL").drop("threshold")
        if waiting.limit(1).count() == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def find_thresholds(sized: DataFrame, budgets: dict[str | None, float]) -> dict[str | None, int]:
    """thresholds() for a few budgets known by name."""
    listed = sized.sparkSession.createDataFrame([(s, float(b)) for s, b in budgets.items()], "source string, budget double")
    return {r["source"]: r["threshold"] for r in thresholds(sized, listed).collect()}


class MixPlan:
    """What the mix takes of each source: sizes are counted in one pass and written; facts is a row per source."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_cycle: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 8):
        self._id, self._source, self._seed = id_col, source_col, seed
        self.sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), self._hash().alias("h")), "mix-sizes")
        ranked = ranked_sources(self.sized.groupBy("source").agg(F.sum("size").alias("n")))
        weights = F.array(*[F.lit(float(w)) for w in weight_cycle])
        targets = share_targets(written(ranked.select("source", "n", weights[F.col("place") % len(weight_cycle)].alias("w")), "mix-sources"), cap)
        copies = F.when(F.col("n") > 0, F.least(F.floor(F.col("target") / F.col("n")), F.lit(int(cap)))).otherwise(0).cast("int")
        planned = written(targets.withColumn("copies", copies), "mix-targets")
        rest = F.when(F.col("copies") < cap, F.col("target") - F.col("copies") * F.col("n")).otherwise(0.0)
        cuts = thresholds(self.sized, planned.select("source", rest.alias("budget"))).select(F.col("source").alias("t_source"), "threshold")
        facts = planned.join(cuts, F.col("source").eqNullSafe(F.col("t_source")), "left")
        self.facts = written(facts.select(F.col("source").alias("b_source"), F.col("n").alias("_size"), F.col("target").alias("_target"), F.col("copies").alias("_base"), F.coalesce("threshold", F.lit(0)).alias("_threshold")), "mix-plan")

    def _hash(self) -> Column:
        return hash60(F.lit(self._seed), F.coalesce(F.col(self._id).cast("string"), F.lit("null")))

    def with_copies(self, rows: DataFrame, source: Column, h: Column) -> DataFrame:
        """rows with _size, _target (of their source) and _copies."""
        joined = with_source_facts(rows, source, self.facts, h)
        return joined.withColumn("_copies", (F.col("_base") + (h < F.col("_threshold")).cast("int")).cast("long")).drop("b_source", "_base", "_threshold")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (the source's), copies, taken."""
    plan = MixPlan(docs, **options)
    placed = plan.with_copies(plan.sized, F.col("source"), F.col("h"))
    return placed.select("doc_id", "source", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept; texts are not shuffled."""
    plan = MixPlan(docs, **options)
    placed = plan.with_copies(packed(docs, source=F.col(plan._source).cast("string"), h=plan._hash()), F.col("source"), F.col("h"))
    return placed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("row.*")
