"""Sample identity, labels, and references between evaluation records and retrieval corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.text import content_fields, content_state, context_references, first_filled_string, first_rows, first_scalar, has_role, identifier, json_string, plain_text, prefixed_sha, stripped

LIMIT = aliases.EVIDENCE_LIMIT


def with_sample_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sample", first_scalar(aliases.SAMPLE_ID))


def sample_id_collisions(rows: DataFrame) -> DataFrame:
    """One row per artifact and explicit sample id that two rows or more carry, under whatever field name."""
    held = with_sample_id(rows.where(has_role(F.col("roles"), *aliases.EVALUATION))).where("sample IS NOT NULL")
    return (
        held.groupBy(F.col("path").alias("artifact_path"), F.col("sample.value").alias("value"))
        .agg(F.sort_array(F.collect_set("sample.field")).alias("sample_id_fields"), F.sort_array(F.collect_list("row_num")).alias("row_locations"), F.count("*").alias("record_count"), F.countDistinct("row_hash").alias("distinct_record_count"))
        .where("record_count > 1").withColumn("sample_id_hash", prefixed_sha(F.col("value"))).drop("value")
    )


def partial_sample_ids(rows: DataFrame) -> DataFrame:
    """One row per artifact where some rows, but not all, have a sample id."""
    held = with_sample_id(rows.where(has_role(F.col("roles"), *aliases.EVALUATION)))
    grouped = held.groupBy(F.col("path").alias("artifact_path")).agg(F.count("*").alias("row_count"), F.count("sample").alias("identified_count"), F.sort_array(F.collect_set("sample.field")).alias("sample_id_fields"))
    counted = grouped.where("identified_count > 0 AND identified_count < row_count").withColumn("missing_id_count", F.col("row_count") - F.col("identified_count"))
    missing = first_rows(held.where("sample IS NULL").withColumnRenamed("path", "artifact_path"), ["artifact_path"], ["row_num", "row_hash"], {"missing_row_locations": "row_num", "missing_row_hashes": "row_hash"})
    return counted.join(missing, "artifact_path").select(
        "artifact_path", "row_count", "identified_count", "missing_id_count", F.bround(F.col("identified_count") / F.col("row_count"), 4).alias("coverage_ratio"), "sample_id_fields",
        "missing_row_locations", "missing_row_hashes", (F.col("missing_id_count") > LIMIT).alias("evidence_truncated"),
    )


def _targets() -> Column:
    """(field, sorted distinct values) of the first answer field with a value; a list counts as its scalars."""
    options = []
    for name in aliases.ANSWER:
        one = F.when(F.col("types")[name].isin("string", "integer", "number") & (stripped(F.col("texts")[name]) != ""), F.array(plain_text(F.col("texts")[name])))
        many = F.when(F.size(F.col("lists")[name]) > 0, F.array_sort(F.array_distinct(F.transform(F.col("lists")[name], lambda v: plain_text(v)))))
        values = F.coalesce(one, many)
        options.append(F.when(values.isNotNull(), F.struct(F.lit(name).alias("field"), values.alias("values"))))
    return F.coalesce(*options)


def label_conflicts(rows: DataFrame) -> DataFrame:
    """One row per equal input and context that has two or more different targets.

    Inputs in plain form and contexts without outer white space are one case; its hash
    is that of both as canonical JSON.  A target's hash is that of its text, or of the
    JSON list where it has several values.
    """
    held = rows.where(has_role(F.col("roles"), *aliases.EVALUATION)).withColumn("input", first_scalar(aliases.INPUT)).withColumn("target", _targets()).where("input IS NOT NULL AND target IS NOT NULL").withColumn("plain", plain_text(F.col("input.value")))
    case = F.concat(F.lit('{"context":'), F.col("context"), F.lit(',"input":'), json_string(F.col("plain")), F.lit("}"))
    values = F.col("target.values")
    signature = F.when(F.size(values) == 1, values[0]).otherwise(F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ","), F.lit("]")))
    # never null, which the planner would else check by hashing every text once more
    keyed = held.select(F.coalesce(F.sha2(case, 256), F.lit("")).alias("identity"), F.sha2(signature, 256).alias("target_hash"), F.struct("path", "row_num", F.col("input.field").alias("input_field"), F.col("target.field").alias("target_field")).alias("place"))
    several = keyed.groupBy("identity").agg(F.countDistinct("target_hash").alias("distinct_target_count")).where("distinct_target_count > 1")
    return (
        keyed.join(several, "identity").groupBy(F.concat(F.lit("sha256:"), "identity").alias("normalized_input_hash"), "distinct_target_count").agg(
            F.sort_array(F.collect_set("place.path")).alias("artifact_paths"), F.min("place")["input_field"].alias("input_field"), F.sort_array(F.collect_set("place.target_field")).alias("target_fields"),
            F.sort_array(F.collect_set("target_hash")).alias("target_hashes"), F.count("*").alias("record_count"), F.transform(F.array_sort(F.collect_list("place")), lambda p: F.struct(p["path"].alias("path"), p["row_num"].alias("row_num"))).alias("row_locations"),
        )
    )


def empty_inputs(rows: DataFrame) -> DataFrame:
    """One row per evaluation artifact with records whose input fields are all null or blank; chat records are left out."""
    present = F.array_compact(F.array(*[F.when(F.col("types")[n].isNotNull(), F.lit(n)) for n in aliases.INPUT]))
    blank = F.lit(True)
    for n in aliases.INPUT:
        kind = F.col("types")[n]
        blank = blank & (kind.isNull() | (kind == "null") | ((kind == "string") & (stripped(F.col("texts")[n]) == "")))
    held = rows.where(has_role(F.col("roles"), *aliases.EVALUATION)).withColumn("present", present).where((F.size("present") > 0) & blank & F.col("types")["messages"].isNull())
    fields = held.select(F.col("path").alias("artifact_path"), F.explode("present").alias("name")).groupBy("artifact_path").agg(F.sort_array(F.collect_set("name")).alias("input_fields"))
    counted = held.groupBy(F.col("path").alias("artifact_path")).agg(F.count("*").alias("affected_count")).join(fields, "artifact_path")
    first = first_rows(held.withColumnRenamed("path", "artifact_path"), ["artifact_path"], ["row_num", "row_hash"], {"row_locations": "row_num", "row_hashes": "row_hash"})
    return counted.join(first, "artifact_path").select("artifact_path", "affected_count", "input_fields", "row_locations", "row_hashes", (F.col("affected_count") > LIMIT).alias("evidence_truncated"))


def retrieval_records(rows: DataFrame) -> DataFrame:
    """Rows of retrieval artifacts with their content (first filled field, in plain form)."""
    return rows.where(has_role(F.col("roles"), "rag_document")).withColumn("content", first_filled_string(aliases.RAG_CONTENT)).withColumn("plain", plain_text(F.col("content.value")))


def duplicate_chunks(rows: DataFrame) -> DataFrame:
    """One row per normalised content that occurs in two or more retrieval records, of one artifact or several."""
    held = retrieval_records(rows).where("plain IS NOT NULL AND plain <> ''")
    keyed = held.select(F.coalesce(prefixed_sha(F.col("plain")), F.lit("")).alias("normalized_chunk_hash"), "path", "row_num", "row_hash", F.col("content.field").alias("field"))
    grouped = keyed.groupBy("normalized_chunk_hash").agg(F.count("*").alias("duplicate_count"), F.sort_array(F.collect_set("path")).alias("artifact_paths"), F.sort_array(F.collect_set("field")).alias("content_fields")).where("duplicate_count > 1")
    first = first_rows(keyed, ["normalized_chunk_hash"], ["path", "row_num", "row_hash"], {"row_locations": F.struct(F.col("path"), F.col("row_num").alias("row")), "row_hashes": "row_hash"})
    return grouped.join(first, "normalized_chunk_hash").select(
        "artifact_paths", "content_fields", "normalized_chunk_hash", "duplicate_count", F.size("artifact_paths").cast("long").alias("duplicate_artifact_count"), "row_locations", "row_hashes", (F.col("duplicate_count") > LIMIT).alias("evidence_truncated"),
    )


def chunk_id_collisions(rows: DataFrame) -> DataFrame:
    """One row per artifact and chunk id with two or more distinct contents; samples show each content first."""
    held = retrieval_records(rows).where(~has_role(F.col("roles"), "configuration")).withColumn("chunk_id", identifier("chunk_id")).where("chunk_id IS NOT NULL AND plain IS NOT NULL AND plain <> ''")
    keyed = held.select("path", prefixed_sha(F.col("chunk_id")).alias("chunk_id_hash"), "row_num", F.col("content.field").alias("field"), "row_hash", prefixed_sha(F.col("plain")).alias("content_hash"))
    many = keyed.groupBy("path", "chunk_id_hash").agg(F.count("*").alias("record_count"), F.countDistinct("content_hash").alias("distinct_content_count")).where("distinct_content_count > 1")
    nth = F.row_number().over(W.partitionBy("path", "chunk_id_hash", "content_hash").orderBy("row_num", "field"))
    place = F.row_number().over(W.partitionBy("path", "chunk_id_hash").orderBy(F.col("nth") > 1, "row_num", "field"))
    sampled = keyed.join(many.select("path", "chunk_id_hash"), ["path", "chunk_id_hash"]).withColumn("nth", nth).withColumn("place", place).where(F.col("place") <= LIMIT)
    samples = sampled.groupBy("path", "chunk_id_hash").agg(F.array_sort(F.collect_list(F.struct(F.col("row_num").alias("row"), "field", "row_hash", "content_hash"))).alias("sample_records"))
    return many.join(samples, ["path", "chunk_id_hash"]).select(F.col("path").alias("artifact_path"), F.lit("chunk_id").alias("chunk_id_field"), "chunk_id_hash", "record_count", "distinct_content_count", "sample_records", (F.size("sample_records") < F.col("record_count")).alias("evidence_truncated"))


def evaluation_references(rows: DataFrame) -> DataFrame:
    """(path, row_num, field, value): every context reference of evaluation records."""
    return rows.where(has_role(F.col("roles"), *aliases.EVALUATION)).select("path", "row_num", F.explode(context_references(aliases.CONTEXT_ID)).alias("r")).select("path", "row_num", "r.field", "r.value").distinct()


def corpus_identifiers(rows: DataFrame) -> DataFrame:
    return rows.where(has_role(F.col("roles"), "rag_document")).select("path", "row_num", F.explode(context_references(aliases.RAG_ID)).alias("r"), content_state().alias("state"), content_fields().alias("fields")).select("path", "row_num", "r.field", "r.value", "state", "fields")


def unreachable_references(rows: DataFrame) -> DataFrame:
    """One row per evaluation record with references that no retrieval record carries; nothing where there are no ids at all."""
    ids = corpus_identifiers(rows).select("value").distinct()
    lost = evaluation_references(rows).join(ids, "value", "left_anti")
    grouped = lost.groupBy(F.col("path").alias("evaluation_artifact"), F.col("row_num").alias("evaluation_row")).agg(F.countDistinct("value").alias("missing_reference_count"), F.sort_array(F.collect_set("field")).alias("reference_fields"), F.sort_array(F.collect_set(prefixed_sha(F.col("value")))).alias("missing_reference_hashes"))
    return grouped.join(ids.limit(1).select(F.lit(1).alias("any")), F.lit(1) == F.col("any"), "left_semi")


def empty_references(rows: DataFrame) -> DataFrame:
    """One row per evaluation record that refers to ids of which every retrieval record is empty."""
    by_value = corpus_identifiers(rows).groupBy("value").agg(F.bool_and(F.coalesce(F.col("state") == "empty", F.lit(False))).alias("empty"), F.sort_array(F.collect_set("path")).alias("paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields")).where("empty")
    met = evaluation_references(rows).join(by_value, "value")
    return met.groupBy(F.col("path").alias("evaluation_artifact"), F.col("row_num").alias("evaluation_row")).agg(
        F.sort_array(F.collect_set("field")).alias("reference_fields"), F.countDistinct("value").alias("empty_reference_count"), F.sort_array(F.collect_set(prefixed_sha(F.col("value")))).alias("empty_reference_hashes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("rag_artifact_paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("content_fields"),
    )
