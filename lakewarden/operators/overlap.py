"""Exact and near duplication within and across splits.

rows(path, row_num, roles, row_hash) is the row relation; extra columns pass unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aliases, similarity
from ..functions.text import first_rows, has_role

BUCKET_LIMIT = 100  # a similarity bucket with more members gives no candidates


def exact_overlap(rows: DataFrame, left: tuple[str, ...] = aliases.TRAINING, right: tuple[str, ...] = aliases.EVALUATION) -> DataFrame:
    """One row per (training row, evaluation row) of equal hash in different artifacts."""
    t = rows.where(has_role(F.col("roles"), *left)).select("row_hash", F.col("path").alias("training_artifact"), F.col("row_num").alias("training_row"))
    e = rows.where(has_role(F.col("roles"), *right)).select("row_hash", F.col("path").alias("evaluation_artifact"), F.col("row_num").alias("evaluation_row"))
    return t.join(e, "row_hash").where("training_artifact <> evaluation_artifact").withColumnRenamed("row_hash", "normalized_record_hash").withColumn("overlap_count", F.lit(1).cast("long"))


def overlap_counts(rows: DataFrame, left: tuple[str, ...] = aliases.TRAINING, right: tuple[str, ...] = aliases.EVALUATION) -> DataFrame:
    """(row_hash, findings): how many rows exact_overlap has of each hash, without making the pairs."""
    held = rows.groupBy("row_hash", "path").agg(F.count_if(has_role(F.col("roles"), *left)).alias("l"), F.count_if(has_role(F.col("roles"), *right)).alias("r"))
    return held.groupBy("row_hash").agg((F.sum("l") * F.sum("r") - F.sum(F.col("l") * F.col("r"))).alias("findings")).where("findings > 0")


def exact_duplicates(rows: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """One row per artifact and hash that occurs more than once there."""
    return (
        rows.where(has_role(F.col("roles"), *roles)).groupBy(F.col("path").alias("artifact_path"), F.col("row_hash").alias("normalized_record_hash"))
        .agg(F.sort_array(F.collect_list("row_num")).alias("duplicate_row_locations"), F.count("*").alias("duplicate_count")).where("duplicate_count > 1")
    )


def similarity_items(rows: DataFrame, text_col: str = "sim_text", shingle_size: int = 3, hashes: int = 64) -> DataFrame:
    """rows with a similarity text -> items(id, path, row_num, roles, row_hash, discriminator, text, n, sig)."""
    held = rows.where(F.coalesce(F.col(text_col), F.lit("")) != "")
    named = held.select(F.concat_ws(":", "path", "row_num").alias("id"), "path", "row_num", "roles", "row_hash", "discriminator", F.col(text_col).alias("text"), similarity.sketch_udf(shingle_size, hashes)(text_col).alias("sketch"))
    return named.select("id", "path", "row_num", "roles", "row_hash", "discriminator", "text", "sketch.n", "sketch.sig")


def banded(items: DataFrame, hashes: int = 64, bands: int = 16) -> DataFrame:
    """(id, n, band, key): an item's rows of each band, with its number of shingles; left-over hashes are not used."""
    width = max(1, hashes // bands)
    keys = F.transform(F.sequence(F.lit(0), F.lit(min(bands, hashes) - 1)), lambda b: F.xxhash64(F.slice("sig", b * width + 1, F.lit(width))))
    return items.select("id", "n", F.posexplode(keys).alias("band", "key"))


def candidate_pairs(items: DataFrame, threshold: float, hashes: int = 64, bands: int = 16, shingle_size: int = 3) -> DataFrame:
    """Pairs of items that share a band bucket of 2 to BUCKET_LIMIT members and reach the threshold.

    Buckets are counted before members meet, so a bucket beyond the limit is
    never gathered; within it a self-join makes fewer than 5,000 pairs.  Sets
    whose sizes differ by more than the threshold allows are not compared.  Pairs
    are verified under the least member of a bucket that they share: a family's
    texts are sent there once, not with every pair, and no text that meets no other
    is sent at all.  Nothing is kept in the executors' memory.
    """
    rows = banded(items, hashes, bands)
    small = rows.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("id").alias("leader")).where(F.col("m").between(2, BUCKET_LIMIT)).select("band", "key", "leader")
    members = rows.join(small, ["band", "key"])
    close = (F.col("a.n") >= F.lit(threshold) * F.col("b.n")) & (F.col("b.n") >= F.lit(threshold) * F.col("a.n"))
    pairs = members.alias("a").join(members.alias("b"), ["band", "key"]).where((F.col("a.id") < F.col("b.id")) & close).groupBy(F.col("a.id").alias("src"), F.col("b.id").alias("tgt")).agg(F.min("a.leader").alias("leader"))
    needed = pairs.select(F.col("leader").alias("owner"), F.explode(F.array("src", "tgt")).alias("id")).distinct()
    scored = pairs.groupBy("leader").cogroup(needed.join(items.select("id", "text"), "id").groupBy("owner")).applyInArrow(similarity.scores(threshold, shingle_size), "src string, tgt string, jaccard double")
    facts = items.select("id", F.struct("path", "row_num", "roles", "row_hash", "discriminator").alias("meta"))
    return scored.join(facts.select(F.col("id").alias("src"), F.col("meta").alias("source")), "src").join(facts.select(F.col("id").alias("tgt"), F.col("meta").alias("target")), "tgt").select("src", "tgt", "source", "target", "jaccard")


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs in the order of a listing: the most similar first, then by ids."""
    return pairs.orderBy(F.desc("jaccard"), "src", "tgt")


def probe(items: DataFrame, queries: DataFrame, threshold: float, hashes: int = 64, bands: int = 16, shingle_size: int = 3) -> DataFrame:
    """queries(query_id, text) against indexed items: (query_id, id, jaccard) at the threshold.

    Buckets of any size are met: a query pairs with its bucket's members only, and the
    adaptive planner splits a hot bucket of a join.  A query without shingles finds nothing.
    """
    q = queries.where("text IS NOT NULL").select(F.col("query_id").alias("id"), "text", similarity.sketch_udf(shingle_size, hashes)("text").alias("sketch")).select("id", "text", "sketch.n", "sketch.sig").where("n > 0")
    asked = banded(q, hashes, bands).drop("n").withColumnRenamed("id", "query_id")
    met = asked.join(banded(items, hashes, bands).drop("n"), ["band", "key"]).select("query_id", "id").distinct()
    texts = met.join(q.select(F.col("id").alias("query_id"), F.col("text").alias("asked")), "query_id").join(items.select("id", "text"), "id")
    return texts.withColumn("jaccard", similarity.text_jaccard_udf(shingle_size)("asked", "text")).where(F.col("jaccard") >= threshold).select("query_id", "id", "jaccard")


def oriented(pairs: DataFrame, left: tuple[str, ...], right: tuple[str, ...]) -> DataFrame:
    """Pairs with one side in each group of roles, as (left, right, jaccard); the pair's own order is tried first."""
    straight = has_role(F.col("source.roles"), *left) & has_role(F.col("target.roles"), *right)
    crossed = has_role(F.col("source.roles"), *right) & has_role(F.col("target.roles"), *left)
    return pairs.where(straight | crossed).select(F.when(straight, F.col("source")).otherwise(F.col("target")).alias("left"), F.when(straight, F.col("target")).otherwise(F.col("source")).alias("right"), "jaccard")


def _near(pairs: DataFrame, threshold: float) -> DataFrame:
    """Not equal by text nor by record, and at the threshold after rounding too."""
    return pairs.where(F.col("jaccard") < 1.0).withColumn("score", F.bround("jaccard", 4)).where(F.col("score") >= threshold)


def near_overlap(pairs: DataFrame, threshold: float) -> DataFrame:
    """One row per evaluation row with near copies in training artifacts."""
    met = _near(oriented(pairs, aliases.TRAINING, aliases.EVALUATION), threshold).where("left.row_hash <> right.row_hash AND left.path <> right.path")
    match = F.struct(F.col("left.path").alias("path"), F.col("left.row_num").alias("row"), F.col("score").alias("similarity_score"), F.lit(threshold).alias("configured_threshold"))
    key = ["evaluation_artifact", "evaluation_row"]
    matches = met.select(F.col("right.path").alias("evaluation_artifact"), F.col("right.row_num").alias("evaluation_row"), match.alias("match")).distinct()
    grouped = matches.groupBy(*key).agg(F.max("match.similarity_score").alias("similarity_score"), F.count("*").alias("overlap_count"), F.min("match").alias("first"))
    sampled = first_rows(matches, key, ["match"], {"matched_training_records": "match"})
    return grouped.join(sampled, key).select(
        *key, F.col("first.path").alias("training_artifact"), F.col("first.row").alias("training_row"), "similarity_score", F.lit(threshold).alias("configured_threshold"),
        "overlap_count", "matched_training_records", (F.col("overlap_count") > aliases.EVIDENCE_LIMIT).alias("evidence_truncated"),
    )


def near_duplicates(pairs: DataFrame, roles: tuple[str, ...], threshold: float, discriminate: bool) -> DataFrame:
    """One row per unordered pair of artifacts (an artifact with itself included) with near copies between them."""
    met = pairs.where(has_role(F.col("source.roles"), *roles) & has_role(F.col("target.roles"), *roles))
    met = _near(met, threshold).where("source.row_hash <> target.row_hash")
    if discriminate:
        met = met.where(F.col("source.discriminator").eqNullSafe(F.col("target.discriminator")))
    place = lambda side: F.struct(F.col(f"{side}.path").alias("path"), F.col(f"{side}.row_num").alias("row"))
    pair = F.sort_array(F.array(place("source"), place("target")))
    paths = F.array(F.col("pair")[0]["path"], F.col("pair")[1]["path"])
    ordered = met.select(pair.alias("pair"), "score").distinct().select(paths.alias("artifact_paths"), "pair", "score")
    counted = ordered.groupBy("artifact_paths").agg(F.count("*").alias("near_duplicate_pair_count"), F.max("score").alias("max_similarity_score"))
    affected = ordered.select("artifact_paths", F.explode("pair").alias("x")).distinct().groupBy("artifact_paths").agg(F.count("*").alias("affected_row_count"))
    sampled = first_rows(ordered, ["artifact_paths"], [F.desc("score"), "pair"], {"sample_pairs": F.struct(F.col("pair").alias("rows"), F.col("score").alias("similarity_score"))})
    return counted.join(affected, "artifact_paths").join(sampled, "artifact_paths").select(
        "artifact_paths", "near_duplicate_pair_count", "affected_row_count", "max_similarity_score", F.lit(threshold).alias("configured_threshold"), "sample_pairs", (F.col("near_duplicate_pair_count") > aliases.EVIDENCE_LIMIT).alias("evidence_truncated"),
    )
