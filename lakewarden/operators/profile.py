"""Descriptive measurements of datasets: counts, rates, coverage, lengths and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.text import first_scalar, stripped

CANONICAL_FIELDS = tuple(sorted(aliases.INPUT + aliases.ANSWER))
TOP = 20


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def counted_rows(rows: DataFrame) -> DataFrame:
    """Per artifact, in one pass: rows, rows with a sample id (in all and by its field), presence of the canonical fields,
    and code-point lengths of the first string input field."""
    marked = rows.select("path", first_scalar(aliases.SAMPLE_ID)["field"].alias("sample"), F.length(first_input()["text"]).alias("input_length"), *[F.col("types")[f].alias(f"t_{f}") for f in CANONICAL_FIELDS], *[(stripped(F.col("texts")[f]) == "").alias(f"b_{f}") for f in CANONICAL_FIELDS])
    presence = [F.count(f"t_{f}").alias(f"has_{f}") for f in CANONICAL_FIELDS]
    nulls = [F.count_if(F.col(f"t_{f}") == "null").alias(f"null_{f}") for f in CANONICAL_FIELDS]
    blanks = [F.count_if((F.col(f"t_{f}") == "string") & F.col(f"b_{f}")).alias(f"blank_{f}") for f in CANONICAL_FIELDS]
    by_field = [F.count_if(F.col("sample") == f).alias(f"by_{f}") for f in aliases.SAMPLE_ID]
    return marked.groupBy("path").agg(F.count("*").alias("row_count"), F.count("sample").alias("identified"), *by_field, *presence, *nulls, *blanks, *_lengths("input_length"))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Per artifact: distinct records, and records that occur again."""
    return rows.groupBy("path", "row_hash").agg(F.count("*").alias("n")).groupBy("path").agg(F.count("*").alias("distinct_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def row_measures(rows: DataFrame) -> DataFrame:
    """Per artifact: rows, distinct rows, duplicate rate, rows with a sample id, presence of the canonical fields."""
    both = counted_rows(rows).join(distinct_rows(rows), "path")
    return both.withColumn("exact_duplicate_rate", ratio(F.col("row_count") - F.col("distinct_rows"), F.col("row_count"))).withColumn("sample_id_coverage", ratio(F.col("identified"), F.col("row_count")))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "row_hash").agg(F.count("*").alias("group_size")).where("group_size > 1")


def _lengths(column: str) -> list[Column]:
    """Of a column of lengths: how many, the least, the most, and percentiles by nearest rank."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("long")
    return [F.count(column).alias("population"), F.min(column).cast("long").alias("min_length"), F.max(column).cast("long").alias("max_length"), rank(0.5).alias("p50_length"), rank(0.95).alias("p95_length")]


def length_measures(values: DataFrame) -> DataFrame:
    """values(path, field, text) -> code-point lengths per artifact and field; percentiles are nearest ranks."""
    return values.where("text IS NOT NULL").select("path", "field", F.length("text").alias("n")).groupBy("path", "field").agg(*_lengths("n"))


def first_input() -> Column:
    """(field, text) of the first string input field, the field named "input" for all."""
    return F.coalesce(*[F.when(F.col("types")[n] == "string", F.struct(F.lit("input").alias("field"), F.col("texts")[n].alias("text"))) for n in aliases.INPUT])


def input_texts(rows: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The first string input field of each row, or each named field."""
    if fields is None:
        return rows.select("path", first_input().alias("x")).where("x IS NOT NULL").select("path", "x.field", "x.text")
    each = F.array_compact(F.array(*[F.when(F.col("types")[n] == "string", F.struct(F.lit(n).alias("field"), F.col("texts")[n].alias("text"))) for n in fields]))
    return rows.select("path", F.explode(each).alias("x")).select("path", "x.field", "x.text")


def category_distribution(values: DataFrame, top: int = TOP) -> DataFrame:
    """values(path, field, value = canonical JSON of a scalar) -> the most frequent values by hash, with the value, and the count of the rest."""
    counted = values.where("value IS NOT NULL").groupBy("path", "field", F.sha2("value", 256).alias("value_hash")).agg(F.count("*").alias("n"), F.min("value").alias("value"))
    ranked = counted.withColumn("place", F.row_number().over(W.partitionBy("path", "field").orderBy(F.desc("n"), "value_hash")))
    head = F.col("place") <= top
    return ranked.groupBy("path", "field", F.when(head, F.col("value_hash")).alias("value_hash")).agg(F.sum("n").alias("n"), F.min(F.when(head, F.col("place"))).cast("long").alias("place"), F.min(F.when(head, F.col("value"))).alias("value"))


def ordered_fingerprint(rows: DataFrame) -> DataFrame:
    """rows(path, row_num, canon) -> SHA-256 of the records' canonical text, one line each, in row order.

    An artifact's text is gathered by one task, as its hash needs it in order;
    artifacts are bounded by the size limit under which they are read.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_num", "canon"))), lambda x: x["canon"]), "\n")
    return rows.groupBy("path").agg(F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("fingerprint"), F.count("*").alias("row_count"))
