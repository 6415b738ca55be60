"""Declared schemas against observed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.text import first_rows

CONTRACT = "path string, field string, type string, required boolean, nullable boolean, allow_extra boolean"


def contract_violations(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row per (artifact row, field, kind of violation).

    contracts (CONTRACT, a row per field; declared by hand, so broadcast) against
    rows(path, row_num, kind, types).  A record that is no object breaks its
    contract once and is not looked into.
    """
    grouped = contracts.groupBy("path").agg(F.collect_list(F.struct("field", "type", "required", "nullable")).alias("fields"), F.bool_and("allow_extra").alias("allow_extra"))
    met = rows.join(F.broadcast(grouped), "path")
    bad = met.where("kind <> 'object'").select("path", "row_num", F.lit("").alias("field"), F.lit("record_not_object").alias("violation"), F.lit("object").alias("expected"), F.col("kind").alias("observed"))
    whole = met.where("kind = 'object'")
    each = whole.select("path", "row_num", "types", F.explode("fields").alias("f")).withColumn("seen", F.col("types")[F.col("f.field")])
    fits = (F.col("f.type") == F.col("seen")) | ((F.col("f.type") == "number") & (F.col("seen") == "integer"))
    kind = (
        F.when(F.col("seen").isNull() & F.col("f.required"), F.lit("required_field_missing"))
        .when((F.col("seen") == "null") & ~F.col("f.nullable"), F.lit("null_not_allowed"))
        .when(F.col("seen").isNotNull() & (F.col("seen") != "null") & ~fits, F.lit("type_mismatch"))
    )
    broken = each.select("path", "row_num", F.col("f.field").alias("field"), kind.alias("violation"), F.col("f.type").alias("expected"), F.coalesce("seen", F.lit("missing")).alias("observed")).where("violation IS NOT NULL")
    extra = whole.where("NOT allow_extra").select("path", "row_num", F.explode(F.array_except(F.map_keys("types"), F.col("fields.field"))).alias("field"), F.lit("unexpected_field").alias("violation"), F.lit("absent").alias("expected"), F.lit("present").alias("observed"))
    return bad.unionByName(broken).unionByName(extra)


def violation_summary(violations: DataFrame) -> DataFrame:
    """One row per artifact: totals, counts by kind, the first violations in row order."""
    by_kind = violations.groupBy("path", "violation").agg(F.count("*").alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("violation", "n")))).alias("violation_counts"))
    order = ["row_num", "field", "violation", "expected", "observed"]
    item = F.struct(F.col("row_num").alias("row"), *order[1:])
    totals = violations.groupBy("path").agg(F.count("*").alias("total_violation_count"), F.countDistinct("row_num").alias("affected_row_count"))
    first = first_rows(violations, ["path"], order, {"sample_violations": item})
    return totals.join(by_kind, "path").join(first, "path").select(F.col("path").alias("artifact_path"), "total_violation_count", "affected_row_count", "violation_counts", "sample_violations", (F.col("total_violation_count") > aliases.EVIDENCE_LIMIT).alias("evidence_truncated"))
