"""Evaluation results: metrics, metadata, fingerprints and alignment with their datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.text import bare_fingerprint, first_rows, is_fingerprint, prefixed_sha

LIMIT = aliases.EVIDENCE_LIMIT
UNIT_BOUNDS = {"fraction": (0.0, 1.0), "percent": (0.0, 100.0), "nonnegative": (0.0, float("inf"))}


def with_unit_bounds(metrics: DataFrame) -> DataFrame:
    """metrics(.., value, unit, low, high): explicit bounds in order hold, else those of the unit."""
    low = F.create_map(*[x for u, (a, _) in UNIT_BOUNDS.items() for x in (F.lit(u), F.lit(a))])
    high = F.create_map(*[x for u, (_, b) in UNIT_BOUNDS.items() for x in (F.lit(u), F.lit(b))])
    explicit = F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("low") <= F.col("high"))
    return metrics.withColumn("lo", F.when(explicit, F.col("low")).otherwise(low[F.col("unit")])).withColumn("hi", F.when(explicit, F.col("high")).otherwise(high[F.col("unit")])).drop("low", "high").withColumnsRenamed({"lo": "low", "hi": "high"})


def metrics_out_of_bounds(metrics: DataFrame) -> DataFrame:
    """metrics(result_artifact, metric_name, field_path, value, low, high) whose value is outside."""
    return metrics.where("low IS NOT NULL AND high IS NOT NULL AND (value < low OR value > high)").select("result_artifact", "metric_name", F.col("value").alias("observed_value"), F.array("low", "high").alias("accepted_bounds"), "field_path")


def missing_metadata(meta: DataFrame) -> DataFrame:
    """meta(result_artifact, fields MAP of the metadata that is there) -> the groups that are missing."""
    groups = {"model_id": ("model_id",), "generation_parameters": ("generation_parameters",), "prompt_fingerprint_or_version": ("prompt_fingerprint", "prompt_version"), "dataset_fingerprint_or_version": ("dataset_fingerprint", "dataset_version"), "metric_name": ("metric_name",), "metric_definition_or_threshold": ("metric_definition", "metric_threshold"), "timestamp": ("timestamp",)}
    missing = []
    for name, members in groups.items():
        there = F.lit(False)
        for m in members:
            there = there | F.col("fields")[m].isNotNull()
        missing.append(F.when(~there, F.lit(name)))
    return meta.select("result_artifact", F.array_compact(F.array(*missing)).alias("missing_metadata_fields")).where(F.size("missing_metadata_fields") > 0)


def unmatched_fingerprints(references: DataFrame, artifacts: DataFrame) -> DataFrame:
    """references(result_artifact, artifact_type, referenced_fingerprint) that no artifact(artifact_type, path, fingerprint) has."""
    held = references.where(is_fingerprint(F.col("referenced_fingerprint"))).withColumn("bare", bare_fingerprint(F.col("referenced_fingerprint")))
    known = artifacts.select("artifact_type", bare_fingerprint(F.col("fingerprint")).alias("bare")).distinct()
    paths = artifacts.groupBy("artifact_type").agg(F.sort_array(F.collect_set("path")).alias("candidate_artifact_paths"))
    return held.join(known, ["artifact_type", "bare"], "left_anti").join(paths, "artifact_type", "left").select("result_artifact", "referenced_fingerprint", F.coalesce("candidate_artifact_paths", F.array().cast("array<string>")).alias("candidate_artifact_paths"), "artifact_type")


def alignment(dataset: DataFrame, result: DataFrame) -> DataFrame:
    """dataset(sample_id), result(sample_id), a row per record -> one row: counts, and id differences where every record has an id."""
    def facts(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("sample_id").agg(F.count("*").alias(f"{side}_n"))

    both = facts(dataset, "d").join(facts(result, "r"), "sample_id", "full_outer")  # a null id meets nothing and shows on its own side
    named = F.col("sample_id").isNotNull()
    kinds = {"missing": F.col("d_n").isNotNull() & F.col("r_n").isNull(), "unexpected": F.col("r_n").isNotNull() & F.col("d_n").isNull(), "duplicate_dataset": F.col("d_n") > 1, "duplicate_result": F.col("r_n") > 1}
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = both.agg(count("d_n").alias("dataset_count"), count("r_n").alias("result_count"), count(F.when(~named, F.coalesce("d_n", F.lit(0)) + F.coalesce("r_n", F.lit(0)))).alias("unnamed"), *[F.count_if(named & there).alias(kind) for kind, there in kinds.items()])
    differing = both.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(named & kinds[k], F.lit(k)) for k in ("missing", "unexpected")]))).alias("kind"))
    first = first_rows(differing, ["kind"], ["sample_id"], {"hashes": prefixed_sha(F.col("sample_id"))}, LIMIT)
    # at most two rows, beside the one of totals
    samples = first.agg(*[F.max(F.when(F.col("kind") == k, F.col("hashes"))).alias(f"{k}_hashes") for k in ("missing", "unexpected")])
    one = totals.withColumn("_one", F.lit(1)).join(samples.withColumn("_one", F.lit(1)), "_one")
    complete, none = F.col("unnamed") == 0, F.array().cast("array<string>")
    whole = lambda c: F.when(complete, F.col(c)).otherwise(0).cast("long")
    shown = lambda c: F.coalesce(F.when(complete, F.col(c)), none)
    return one.select("dataset_count", "result_count", whole("missing").alias("missing_ids"), whole("unexpected").alias("unexpected_ids"), whole("duplicate_dataset").alias("duplicate_dataset_ids"), whole("duplicate_result").alias("duplicate_result_ids"), shown("missing_hashes").alias("missing_id_hashes"), shown("unexpected_hashes").alias("unexpected_id_hashes"))


def unseeded_generation(parameters: DataFrame) -> DataFrame:
    """parameters(result_artifact, parameters_field, temperature DOUBLE, seed_state) with a positive temperature and no seed."""
    return parameters.where("temperature > 0 AND temperature < double('infinity') AND seed_state <> 'present'").select("result_artifact", "parameters_field", F.lit("temperature").alias("temperature_field"), F.col("temperature").alias("observed_temperature"), F.lit("seed").alias("seed_field"), "seed_state")
