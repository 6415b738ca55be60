"""What texts hold: leaked answers, secrets, placeholders, unfenced context.

lines(path, line_num, roles, line) is the line relation of text artifacts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.text import API_KEY, EMAIL, INTERPOLATION, PHONE, PLACEHOLDER, PRIVATE_KEY, first_filled_string, first_rows, has_role, is_trivial, plain_text, prefixed_sha, redacted, stripped

LIMIT = aliases.EVIDENCE_LIMIT
SCANNED_ROLES = (*aliases.EVALUATION, "evaluation_result", "prompt_template", "rag_document")
#: Characters of an answer by which texts are found where it has no inner word; no answer is shorter.
PROBE = aliases.SHORTEST_ANSWER
MAX_BROADCAST_ANSWERS = 50_000


def answers(rows: DataFrame) -> DataFrame:
    """(path, row_num, field, answer): the first answer field, of any artifact, that is long enough and not trivial."""
    options = [F.when(F.col("texts")[n].isNotNull() & (F.length(plain_text(F.col("texts")[n])) >= aliases.SHORTEST_ANSWER) & ~is_trivial(F.col("texts")[n]), F.struct(F.lit(n).alias("field"), plain_text(F.col("texts")[n]).alias("answer"))) for n in aliases.ANSWER]
    return rows.withColumn("found", F.coalesce(*options)).where("found IS NOT NULL").select("path", "row_num", "found.field", "found.answer")


def answer_leakage(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """answers x corpus(rag_artifact, rag_row, rag_text): texts that contain an answer, the first one per answer and artifact.

    An inner word of the answer that is whole there must be a word of the text; an
    answer without one has its first PROBE characters somewhere in the text.  Hashes of
    these meet first, without the texts, which are fetched for the pairs that met.
    """
    texts = corpus.withColumn("text_key", F.xxhash64("rag_artifact", "rag_row", "rag_text"))
    words = F.split("answer", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = found.withColumn("probe", F.when(longest.isNotNull(), F.xxhash64(longest)))
    whole = F.array_distinct(F.transform(F.split("rag_text", " "), lambda w: F.xxhash64(w)))
    met = _probed(texts.select("text_key", F.explode(whole).alias("probe")), keyed.where("probe IS NOT NULL"))
    rest = keyed.where("probe IS NULL").withColumn("probe", F.xxhash64(F.substring("answer", 1, PROBE)))
    if rest.limit(1).count():
        letters = F.split("rag_text", "")
        starts = F.when(F.length("rag_text") >= PROBE, F.sequence(F.lit(1), F.length("rag_text") - PROBE + 1)).otherwise(F.array().cast("array<int>"))
        runs = F.array_distinct(F.transform("starts", lambda i: F.xxhash64(F.array_join(F.slice("letters", i, PROBE), ""))))
        cut = texts.select("text_key", letters.alias("letters"), starts.alias("starts")).select("text_key", F.explode(runs).alias("probe"))
        met = met.unionByName(_probed(cut, rest))
    held = met.join(texts, "text_key").where(F.contains("rag_text", "answer"))
    return held.groupBy(F.col("path").alias("evaluation_artifact"), F.col("row_num").alias("evaluation_row"), F.col("field").alias("answer_field"), "rag_artifact", prefixed_sha(F.col("answer")).alias("matched_normalized_text")).agg(F.min("rag_row").alias("rag_row"))


def _probed(keys: DataFrame, answered: DataFrame) -> DataFrame:
    """Pairs of a text's key and an answer that share a probe; the answers are broadcast where they are few."""
    few = answered.limit(MAX_BROADCAST_ANSWERS + 1).count() <= MAX_BROADCAST_ANSWERS
    return keys.join(F.broadcast(answered) if few else answered, "probe").drop("probe")


def exposures(lines: DataFrame) -> DataFrame:
    """One row per artifact and kind of sensitive value: how many, where, and redacted forms."""
    held = lines.where(has_role(F.col("roles"), *SCANNED_ROLES))
    phones = F.filter(F.regexp_extract_all("line", F.lit(PHONE), F.lit(0)), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 10)
    found = {
        "private_key": F.when(F.contains("line", F.lit(PRIVATE_KEY)), F.array(F.lit(PRIVATE_KEY))).otherwise(F.array().cast("array<string>")),
        "api_key": F.regexp_extract_all("line", F.lit(API_KEY), F.lit(1)),
        "email": F.regexp_extract_all("line", F.lit(EMAIL), F.lit(0)),
        "phone": phones,
    }
    one = F.concat(*[F.transform(values, _tagged(kind)) for kind, values in found.items()])
    hits = held.select("path", "line_num", F.explode(one).alias("x")).select("path", "line_num", "x.kind", redacted(F.col("x.kind"), F.col("x.value")).alias("redacted"))
    key = ["artifact_path", "detector_type"]
    hits = hits.select(F.col("path").alias("artifact_path"), F.col("kind").alias("detector_type"), "line_num", "redacted")
    lines_of = hits.groupBy(*key, "line_num").agg(F.count("*").alias("n"))
    values_of = hits.groupBy(*key, "redacted").agg(F.count("*").alias("n"))
    counts = lines_of.groupBy(*key).agg(F.sum("n").alias("exposure_count"), F.count("*").alias("lines")).join(values_of.groupBy(*key).agg(F.count("*").alias("distinct_value_count")), key)
    samples = first_rows(lines_of, key, ["line_num"], {"sample_locations": "line_num"}).join(first_rows(values_of, key, ["redacted"], {"redacted_values": "redacted"}), key)
    return counts.join(samples, key).select(*key, "exposure_count", "distinct_value_count", "sample_locations", "redacted_values", ((F.col("lines") > LIMIT) | (F.col("distinct_value_count") > LIMIT)).alias("evidence_truncated"))


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def unresolved_placeholders(rows: DataFrame) -> DataFrame:
    """One row per evaluation record whose first filled input holds template placeholders."""
    held = rows.where(has_role(F.col("roles"), *aliases.EVALUATION)).withColumn("input", first_filled_string(aliases.INPUT)).where("input IS NOT NULL")
    hits = held.withColumn("all", F.regexp_extract_all("input.value", F.lit(PLACEHOLDER), F.lit(0))).where(F.size("all") > 0)
    kind = lambda p: F.when(p.startswith("{{"), F.lit("double_brace")).when(p.startswith("$"), F.lit("dollar_brace")).otherwise(F.lit("single_brace"))
    return hits.select(F.col("path").alias("artifact_path"), F.col("row_num").alias("row"), F.col("input.field").alias("field"), prefixed_sha(plain_text(F.col("input.value"))).alias("input_hash"), F.array_sort(F.array_distinct(F.transform("all", kind))).alias("syntax_classes"), F.size("all").cast("long").alias("detected_count"))


def unfenced_interpolations(lines: DataFrame, reach: int = 3) -> DataFrame:
    """One row per placeholder for outside context in a prompt line without a delimiter within `reach` lines."""
    held = lines.where(has_role(F.col("roles"), "prompt_template"))
    # lines of one artifact stand in order; the frame is a few lines wide
    near = F.concat_ws("\n", F.collect_list("line").over(W.partitionBy("path").orderBy("line_num").rowsBetween(-reach, reach)))
    fenced = F.lit(False)
    for marker in aliases.DELIMITERS:
        fenced = fenced | F.contains("near", F.lit(marker))
    name = lambda p: F.regexp_replace(p, r"[^A-Za-z0-9_]", "")
    found = held.withColumn("near", near).where(~fenced).select("path", "line_num", "line", F.explode(F.regexp_extract_all("line", F.lit(INTERPOLATION), F.lit(0))).alias("p")).withColumn("variable_name", name(F.col("p")))
    return found.where(F.lower("variable_name").isin(*aliases.INTERPOLATED_NAMES)).select(F.col("path").alias("prompt_artifact"), "variable_name", F.col("line_num").alias("line_number"), prefixed_sha(stripped(F.col("line"))).alias("snippet"))
