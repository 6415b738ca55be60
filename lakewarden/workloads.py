"""Catalogue of queries over the star-schema and document tables, with equivalent SQL.

Documents with even ids stand for a training split, odd ones for an evaluation split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan_workloads
from .functions import aliases
from .functions.text import json_string, plain_text, prefixed_sha
from .operators import content, contracts, identity, overlap, profile, results
from .plans.relations import table_rows, text_lines
from .sources.formats import ReadLimits, read_artifacts

QUERIES: dict = dict(scan_workloads.QUERIES)
ORACLES: dict[str, str] = dict(scan_workloads.ORACLES)


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _roles(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _split_path() -> Column:
    return F.when(F.col("doc_id") % 2 == 0, F.lit("train")).otherwise(F.lit("eval"))


def _split_roles() -> Column:
    return F.when(F.col("doc_id") % 2 == 0, _roles("training_dataset")).otherwise(_roles("evaluation_dataset"))


def _documents(spark: SparkSession, sf_dir: str, *roles: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return table_rows(docs, _split_path(), F.col("doc_id"), _roles(*roles) if roles else _split_roles(), {"text": F.col("text"), "id": F.col("doc_id")}, hash_of=F.trim("text"))


def _lean_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what hashing needs: texts are read, hashed and left behind."""
    return _read(spark, sf_dir, "documents").select(_split_path().alias("path"), F.col("doc_id").alias("row_num"), _split_roles().alias("roles"), prefixed_sha(F.trim("text")).alias("row_hash"))


HASHED = "SELECT doc_id, 'sha256:' || sha256(trim(text, ' ')) AS h FROM documents"


@_query(f"""WITH d AS ({HASHED})
SELECT t.h AS normalized_record_hash, 'train' AS training_artifact, t.doc_id AS training_row, 'eval' AS evaluation_artifact, e.doc_id AS evaluation_row, 1::BIGINT AS overlap_count
FROM d t JOIN d e ON t.h = e.h AND t.doc_id % 2 = 0 AND e.doc_id % 2 = 1""")
def train_eval_overlap(spark, sf_dir):
    return overlap.exact_overlap(_lean_split(spark, sf_dir))


def _duplicates_sql(path: str, parity: int) -> str:
    return f"""WITH d AS ({HASHED})
SELECT '{path}' AS artifact_path, h AS normalized_record_hash, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS duplicate_rows, count(*)::BIGINT AS duplicate_count
FROM d WHERE doc_id % 2 = {parity} GROUP BY h HAVING count(*) > 1"""


def _joined(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.withColumn(name, F.array_join(F.col(array).cast("array<string>"), ",")).drop(array)


@_query(_duplicates_sql("train", 0))
def duplicate_train_sample(spark, sf_dir):
    return _joined(overlap.exact_duplicates(_lean_split(spark, sf_dir), aliases.TRAINING), "duplicate_row_locations", "duplicate_rows")


@_query(_duplicates_sql("eval", 1))
def duplicate_eval_sample(spark, sf_dir):
    return _joined(overlap.exact_duplicates(_lean_split(spark, sf_dir), aliases.EVALUATION), "duplicate_row_locations", "duplicate_rows")


PLAIN = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g'), '[ \t\n]+', ' ', 'g')"


@_query(f"""WITH d AS (SELECT doc_id, {PLAIN.format('text')} AS p FROM documents)
SELECT 'sha256:' || sha256(p) AS normalized_chunk_hash, count(*)::BIGINT AS duplicate_count, count(DISTINCT doc_id % 2)::BIGINT AS duplicate_artifact_count, coalesce(min(doc_id) FILTER (doc_id % 2 = 1), min(doc_id)) AS first_row
FROM d WHERE p <> '' GROUP BY p HAVING count(*) > 1""")
def duplicate_chunk_in_corpus(spark, sf_dir):
    found = identity.duplicate_chunks(_documents(spark, sf_dir, "rag_document"))
    return found.select("normalized_chunk_hash", "duplicate_count", "duplicate_artifact_count", F.col("row_locations")[0]["row"].alias("first_row"))


@_query(f"""WITH a AS (SELECT item_id, {PLAIN.format('text')} AS answer FROM benchmark), d AS (SELECT doc_id, {PLAIN.format('text')} AS p FROM documents)
SELECT a.item_id AS evaluation_row, 'sha256:' || sha256(a.answer) AS matched_normalized_text, min(d.doc_id) AS rag_row FROM a JOIN d ON contains(d.p, a.answer) WHERE length(a.answer) >= 16 GROUP BY ALL""")
def rag_answer_leakage(spark, sf_dir):
    items = table_rows(_read(spark, sf_dir, "benchmark"), F.lit("benchmark"), F.col("item_id"), _roles("benchmark_dataset"), {"answer": F.col("text")})
    corpus = _read(spark, sf_dir, "documents").select(F.lit("corpus").alias("rag_artifact"), F.col("doc_id").alias("rag_row"), plain_text(F.col("text")).alias("rag_text"))
    return content.answer_leakage(content.answers(items), corpus).select("evaluation_row", "matched_normalized_text", "rag_row")


LINES = r"WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents)"


@_query(LINES + r""", x AS (
  SELECT doc_id, 'email' AS k, unnest(regexp_extract_all(line, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b')) AS v FROM l
  UNION ALL SELECT doc_id, 'api_key', unnest(regexp_extract_all(line, '(?i)\b(?:api_key|apikey|secret|token|password)\s*[:=]\s*([^\s]{12,})', 1)) FROM l
  UNION ALL SELECT doc_id, 'phone', unnest(list_filter(regexp_extract_all(line, '\b(?:\+\d{1,3}[-.\s])?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 10)) FROM l
  UNION ALL SELECT doc_id, 'private_key', 'BEGIN PRIVATE KEY' FROM l WHERE contains(line, 'BEGIN PRIVATE KEY')
) SELECT doc_id::VARCHAR AS artifact_path, k AS detector_type, count(*)::BIGINT AS exposure_count, count(DISTINCT v)::BIGINT AS distinct_value_count, min('<' || k || '>:sha256:' || sha256(v)) AS first_redacted FROM x GROUP BY ALL""")
def sensitive_value_exposure(spark, sf_dir):
    lines = text_lines(_read(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), _roles("rag_document"), F.col("text"))
    return content.exposures(lines).select("artifact_path", "detector_type", "exposure_count", "distinct_value_count", F.col("redacted_values")[0].alias("first_redacted"))


@_query("""SELECT d.doc_id AS evaluation_row, 1::BIGINT AS missing_reference_count, 'sha256:' || sha256(d.doc_id::VARCHAR) AS missing_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unreachable_context_id(spark, sf_dir):
    refs = table_rows(_read(spark, sf_dir, "documents").select("doc_id"), F.lit("eval"), F.col("doc_id"), _roles("evaluation_dataset"), {"doc_id": F.col("doc_id")})
    ids = table_rows(_read(spark, sf_dir, "labels").select("doc_id"), F.lit("rag"), F.col("doc_id"), _roles("rag_document"), {"doc_id": F.col("doc_id")})
    return identity.unreachable_references(refs.unionByName(ids)).select("evaluation_row", "missing_reference_count", F.col("missing_reference_hashes")[0].alias("missing_hash"))


@_query("""SELECT l.doc_id AS evaluation_row, 1::BIGINT AS empty_reference_count FROM labels l JOIN (SELECT doc_id FROM documents GROUP BY doc_id HAVING bool_and(length(text) < 200)) d USING (doc_id)""")
def empty_referenced_document(spark, sf_dir):
    """Documents under 200 characters stand for empty ones."""
    docs = _read(spark, sf_dir, "documents")
    corpus = table_rows(docs, F.lit("rag"), F.col("doc_id"), _roles("rag_document"), {"doc_id": F.col("doc_id"), "text": F.when(F.length("text") >= 200, F.lit("filled")).otherwise(F.lit(" "))})
    refs = table_rows(_read(spark, sf_dir, "labels").select("doc_id"), F.lit("eval"), F.col("doc_id"), _roles("evaluation_dataset"), {"doc_id": F.col("doc_id")})
    return identity.empty_references(refs.unionByName(corpus)).select("evaluation_row", "empty_reference_count")


@_query("""SELECT 'conversations' AS artifact_path, 'sha256:' || sha256(conv_id::VARCHAR) AS sample_id_hash, count(*)::BIGINT AS record_count FROM conversations GROUP BY conv_id HAVING count(*) > 1""")
def sample_id_collision(spark, sf_dir):
    rows = table_rows(_read(spark, sf_dir, "conversations"), F.lit("conversations"), F.col("turn"), _roles("evaluation_dataset"), {"id": F.col("conv_id"), "prompt": F.col("text")})
    return identity.sample_id_collisions(rows).select("artifact_path", "sample_id_hash", "record_count")


@_query("""SELECT 'documents' AS artifact_path, count(*)::BIGINT AS row_count, count(l.doc_id)::BIGINT AS identified_count, (count(*) - count(l.doc_id))::BIGINT AS missing_id_count, round(count(l.doc_id) / count(*), 4) AS coverage_ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def partial_sample_id_coverage(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    labelled = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample")).distinct()
    joined = docs.join(labelled, F.col("doc_id") == F.col("sample"), "left")
    rows = table_rows(joined, F.lit("documents"), F.col("doc_id"), _roles("evaluation_dataset"), {"sample_id": F.col("sample")})
    return identity.partial_sample_ids(rows).select("artifact_path", "row_count", "identified_count", "missing_id_count", "coverage_ratio")


@_query("""WITH d AS (SELECT DISTINCT o_orderkey AS k FROM orders), r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT (SELECT count(*) FROM orders)::BIGINT AS dataset_count, (SELECT count(*) FROM r)::BIGINT AS result_count, (SELECT count(*) FROM d WHERE k NOT IN (SELECT k FROM r))::BIGINT AS missing_ids, (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM d))::BIGINT AS unexpected_ids,
       0::BIGINT AS duplicate_dataset_ids, 0::BIGINT AS duplicate_result_ids, (SELECT 'sha256:' || sha256(min(k::VARCHAR)) FROM d WHERE k NOT IN (SELECT k FROM r)) AS first_missing""")
def sample_alignment_mismatch(spark, sf_dir):
    dataset = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"))
    result = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sample_id")).distinct()
    return results.alignment(dataset, result).select("dataset_count", "result_count", "missing_ids", "unexpected_ids", "duplicate_dataset_ids", "duplicate_result_ids", F.col("missing_id_hashes")[0].alias("first_missing"))


@_query(f"""WITH d AS (SELECT doc_id, {PLAIN.format('text')} AS p, source, {PLAIN.format('lang')} AS c FROM documents), k AS (
  SELECT 'sha256:' || sha256('{{"context":{{"context":' || to_json(c)::VARCHAR || '}},"input":' || to_json(p)::VARCHAR || '}}') AS h, sha256({PLAIN.format('source')}) AS t, doc_id FROM d WHERE p <> '')
SELECT h AS normalized_input_hash, count(DISTINCT t)::BIGINT AS distinct_target_count, count(*)::BIGINT AS record_count, string_agg(DISTINCT t, ',' ORDER BY t) AS target_hashes, min(doc_id) AS first_row FROM k GROUP BY h HAVING count(DISTINCT t) > 1""")
def label_inconsistency(spark, sf_dir):
    """Documents' languages stand for context, with white space around some of them; their sources for labels."""
    docs = _read(spark, sf_dir, "documents")
    context = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "lang", F.lit("\n"))).otherwise(F.col("lang"))
    rows = table_rows(docs, F.lit("eval"), F.col("doc_id"), _roles("evaluation_dataset"), {"input": F.col("text"), "label": F.col("source"), "context": context})
    return identity.label_conflicts(rows).select("normalized_input_hash", "distinct_target_count", "record_count", F.array_join("target_hashes", ",").alias("target_hashes"), F.col("row_locations")[0]["row_num"].alias("first_row"))


@_query("""SELECT 'events' AS result_artifact, event_type AS metric_name, event_id AS event_id, value AS observed_value FROM events WHERE value < 0 OR value > 100""")
def metric_out_of_bounds(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    metrics = events.select(F.lit("events").alias("result_artifact"), F.col("event_type").alias("metric_name"), F.col("event_id").cast("string").alias("field_path"), "value", F.lit("percent").alias("unit"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    found = results.metrics_out_of_bounds(results.with_unit_bounds(metrics))
    return found.select("result_artifact", "metric_name", F.col("field_path").cast("long").alias("event_id"), "observed_value")


@_query("""SELECT 'lineitem' AS result_artifact, count(*)::BIGINT AS outside FROM lineitem WHERE l_discount < 0.02 OR l_discount > 0.05""")
def metric_explicit_bounds(spark, sf_dir):
    metrics = _read(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("result_artifact"), F.lit("l_discount").alias("metric_name"), F.lit("l_discount").alias("field_path"), F.col("l_discount").alias("value"), F.lit("fraction").alias("unit"), F.lit(0.02).alias("low"), F.lit(0.05).alias("high"))
    return results.metrics_out_of_bounds(results.with_unit_bounds(metrics)).groupBy("result_artifact").agg(F.count("*").alias("outside"))


@_query(r"""SELECT 'conversations' AS artifact_path, count(*)::BIGINT AS affected_count, 'prompt' AS input_fields FROM conversations WHERE length(text) < 40 HAVING count(*) > 0""")
def empty_evaluation_input(spark, sf_dir):
    """Turns under 40 characters stand for blank inputs."""
    text = F.when(F.length("text") < 40, F.lit("  ")).otherwise(F.col("text"))
    rows = table_rows(_read(spark, sf_dir, "conversations"), F.lit("conversations"), F.col("turn"), _roles("evaluation_dataset"), {"prompt": text})
    return identity.empty_inputs(rows).select("artifact_path", "affected_count", F.array_join("input_fields", ",").alias("input_fields"))


@_query(r"""WITH d AS (SELECT doc_id, (len(string_split(text, ' the ')) - 1 + len(string_split(text, ' of ')) - 1)::BIGINT AS n, contains(text, ' the ') AS a, contains(text, ' of ') AS b FROM documents)
SELECT doc_id AS "row", n AS detected_count, CASE WHEN a AND b THEN 'dollar_brace,double_brace' WHEN a THEN 'double_brace' ELSE 'dollar_brace' END AS syntax_classes FROM d WHERE n > 0""")
def unresolved_placeholder(spark, sf_dir):
    """Documents with two common words made placeholders stand for prompts."""
    filled = F.replace(F.replace("text", F.lit(" the "), F.lit(" {{topic}} ")), F.lit(" of "), F.lit(" ${topic} "))
    rows = table_rows(_read(spark, sf_dir, "documents"), F.lit("eval"), F.col("doc_id"), _roles("evaluation_dataset"), {"prompt": filled})
    return content.unresolved_placeholders(rows).select("row", "detected_count", F.array_join("syntax_classes", ",").alias("syntax_classes"))


@_query(r"""WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, line FROM (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, ' the ', ' {context} '), '\r\n|\r|\n') AS a FROM documents))),
w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l)
SELECT doc_id::VARCHAR AS prompt_artifact, n AS line_number, len(regexp_extract_all(line, '\{context\}'))::BIGINT AS found, 'sha256:' || sha256(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS snippet FROM w WHERE contains(line, '{context}') AND NOT contains(near, '```')""")
def untrusted_context_interpolation(spark, sf_dir):
    """Documents with a common word made a placeholder stand for prompt templates."""
    lines = text_lines(_read(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), _roles("prompt_template"), F.replace("text", F.lit(" the "), F.lit(" {context} ")))
    return content.unfenced_interpolations(lines).groupBy("prompt_artifact", "line_number", "snippet").agg(F.count("*").alias("found"))


@_query("""SELECT 'nation' AS artifact_path, 'sha256:' || sha256(n_regionkey::VARCHAR) AS chunk_id_hash, count(*)::BIGINT AS record_count, count(DISTINCT n_name)::BIGINT AS distinct_content_count, count(*) > 20 AS evidence_truncated FROM nation GROUP BY n_regionkey HAVING count(DISTINCT n_name) > 1""")
def chunk_id_collision(spark, sf_dir):
    rows = table_rows(_read(spark, sf_dir, "nation"), F.lit("nation"), F.col("n_nationkey"), _roles("rag_document"), {"chunk_id": F.col("n_regionkey"), "text": F.col("n_name")})
    return identity.chunk_id_collisions(rows).select("artifact_path", "chunk_id_hash", "record_count", "distinct_content_count", "evidence_truncated")


@_query("""SELECT 'customer' AS artifact_path, count(*)::BIGINT AS total_violation_count, count(*)::BIGINT AS affected_row_count, 'type_mismatch' AS violation FROM customer HAVING count(*) > 0""")
def schema_contract_violation(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer")
    rows = table_rows(customers, F.lit("customer"), F.col("c_custkey"), _roles("training_dataset"), {c: F.col(c) for c in ("c_custkey", "c_name", "c_acctbal")})
    contract = spark.createDataFrame([("customer", "c_custkey", "string", True, False, True), ("customer", "c_name", "string", True, False, True), ("customer", "c_acctbal", "number", True, False, True)], contracts.CONTRACT)
    found = contracts.violation_summary(contracts.contract_violations(rows, contract))
    return found.select("artifact_path", "total_violation_count", "affected_row_count", F.array_join(F.map_keys("violation_counts"), ",").alias("violation"))


def _small_fingerprints(spark, sf_dir) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    n = nation.select(F.lit("nation").alias("path"), F.col("n_nationkey").alias("row_num"), F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name").alias("canon"))
    r = region.select(F.lit("region").alias("path"), F.col("r_regionkey").alias("row_num"), F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name").alias("canon"))
    return profile.ordered_fingerprint(n.unionByName(r))


FINGERPRINTS = """SELECT 'nation' AS path, 'sha256:' || sha256(string_agg(n_nationkey || '|' || n_name, chr(10) ORDER BY n_nationkey)) AS fingerprint, count(*)::BIGINT AS row_count FROM nation
UNION ALL SELECT 'region', 'sha256:' || sha256(string_agg(r_regionkey || '|' || r_name, chr(10) ORDER BY r_regionkey)), count(*)::BIGINT FROM region"""


@_query(FINGERPRINTS)
def artifact_fingerprint(spark, sf_dir):
    return _small_fingerprints(spark, sf_dir)


@_query(f"""WITH f AS ({FINGERPRINTS}) SELECT 'result-b' AS result_artifact, sha256('nation') AS referenced_fingerprint, 'nation,region' AS candidates FROM f LIMIT 1""")
def fingerprint_mismatch(spark, sf_dir):
    """Two results: one refers to nation's true fingerprint, the other to one that nothing has."""
    known = _small_fingerprints(spark, sf_dir).select(F.lit("dataset").alias("artifact_type"), "path", "fingerprint")
    true = known.where("path = 'nation'").select(F.lit("result-a").alias("result_artifact"), "artifact_type", F.col("fingerprint").alias("referenced_fingerprint"))
    false = spark.createDataFrame([("result-b", "dataset")], "result_artifact string, artifact_type string").withColumn("referenced_fingerprint", F.sha2(F.lit("nation"), 256))
    found = results.unmatched_fingerprints(true.unionByName(false), known)
    return found.select("result_artifact", "referenced_fingerprint", F.array_join("candidate_artifact_paths", ",").alias("candidates"))


@_query("""SELECT event_id::VARCHAR AS result_artifact, 'generation_parameters,metric_definition_or_threshold,model_id,prompt_fingerprint_or_version' || CASE WHEN value > 50 THEN ',timestamp' ELSE '' END AS missing FROM events""")
def missing_repro_metadata(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    fields = F.map_filter(F.create_map(F.lit("metric_name"), F.col("event_type"), F.lit("dataset_version"), F.lit("1"), F.lit("timestamp"), F.when(F.col("value") <= 50, F.lit("t"))), lambda k, v: v.isNotNull())
    found = results.missing_metadata(events.select(F.col("event_id").cast("string").alias("result_artifact"), fields.alias("fields")))
    return found.select("result_artifact", F.array_join(F.array_sort("missing_metadata_fields"), ",").alias("missing"))


@_query("""SELECT event_id::VARCHAR AS result_artifact, value AS observed_temperature, 'missing' AS seed_state FROM events WHERE value > 0 AND (props->>'k')::BIGINT % 2 = 0""")
def nondeterministic_generation_without_seed(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    parameters = events.select(F.col("event_id").cast("string").alias("result_artifact"), F.lit("params").alias("parameters_field"), F.col("value").alias("temperature"), F.when(k % 2 == 0, F.lit("missing")).otherwise(F.lit("present")).alias("seed_state"))
    return results.unseeded_generation(parameters).select("result_artifact", "observed_temperature", "seed_state")


@_query(f"""WITH d AS ({HASHED}), p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'eval' END AS path, h FROM d)
SELECT path, count(*)::BIGINT AS row_count, count(DISTINCT h)::BIGINT AS distinct_rows, round((count(*) - count(DISTINCT h)) / count(*), 6) AS exact_duplicate_rate FROM p GROUP BY path""")
def dataset_duplicate_rate(spark, sf_dir):
    found = profile.row_measures(_documents(spark, sf_dir))
    return found.select("path", "row_count", "distinct_rows", F.round("exact_duplicate_rate", 6).alias("exact_duplicate_rate"))


@_query("""SELECT 'conversations' AS path, count(*)::BIGINT AS row_count, count(*)::BIGINT AS identified, count(*)::BIGINT AS has_prompt, 0::BIGINT AS has_answer, count(*)::BIGINT AS has_label, count(*) FILTER (role IS NULL)::BIGINT AS null_label, count(*) FILTER (trim(text) = '')::BIGINT AS blank_prompt FROM conversations""")
def canonical_field_coverage(spark, sf_dir):
    rows = table_rows(_read(spark, sf_dir, "conversations"), F.lit("conversations"), F.col("turn"), _roles("training_dataset"), {"id": F.col("conv_id"), "prompt": F.col("text"), "label": F.col("role")})
    return profile.row_measures(rows).select("path", "row_count", "identified", "has_prompt", "has_answer", "has_label", "null_label", "blank_prompt")


@_query("""SELECT 'documents' AS path, 'input' AS field, count(*)::BIGINT AS population, min(length(text))::BIGINT AS min_length, max(length(text))::BIGINT AS max_length, quantile_disc(length(text), 0.5)::BIGINT AS p50_length, quantile_disc(length(text), 0.95)::BIGINT AS p95_length FROM documents WHERE text IS NOT NULL""")
def input_character_lengths(spark, sf_dir):
    return profile.length_measures(_read(spark, sf_dir, "documents").select(F.lit("documents").alias("path"), F.lit("input").alias("field"), "text"))


CATEGORIES = """WITH c AS (SELECT '{t}' AS path, '{c}' AS field, sha256('"' || {c} || '"') AS value_hash, count(*)::BIGINT AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value_hash) AS place FROM c)
SELECT path, field, CASE WHEN place <= {k} THEN value_hash END AS value_hash, sum(n)::BIGINT AS n, min(CASE WHEN place <= {k} THEN place END)::BIGINT AS place FROM r GROUP BY ALL"""


def _categories(df: DataFrame, table: str, column: str, top: int) -> DataFrame:
    value = F.concat(F.lit('"'), F.col(column), F.lit('"'))
    return profile.category_distribution(df.select(F.lit(table).alias("path"), F.lit(column).alias("field"), value.alias("value")), top).drop("value")


@_query(CATEGORIES.format(t="documents", c="source", k=20))
def categorical_distribution(spark, sf_dir):
    return _categories(_read(spark, sf_dir, "documents"), "documents", "source", 20)


@_query(CATEGORIES.format(t="part", c="p_brand", k=5))
def categorical_distribution_top5(spark, sf_dir):
    return _categories(_read(spark, sf_dir, "part"), "part", "p_brand", 5)


@_query("""SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS focus_hash, count(*)::BIGINT AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def message_focus_text(spark, sf_dir):
    """Similarity text of conversations, each a record with its messages: the user's turns in order, one line each."""
    turns = _read(spark, sf_dir, "conversations")
    message = F.concat(F.lit('{"role": '), json_string(F.col("role")), F.lit(', "content": '), json_string(F.col("text")), F.lit("}"))
    grouped = turns.select("conv_id", F.struct("turn", message.alias("m")).alias("x"), (F.col("role") == "user").alias("user")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("all"), F.count_if("user").alias("turns")).where("turns > 0")
    record = F.concat(F.lit('{"id": '), F.col("conv_id").cast("string"), F.lit(', "messages": ['), F.array_join(F.transform("all", lambda x: x["m"]), ", "), F.lit("]}\n"))
    files = grouped.select(F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.lit("jsonl").alias("kind"), _roles("evaluation_dataset").alias("roles"), record.cast("binary").alias("content"))
    found = read_artifacts(files, ReadLimits(250_000, ("user",), ("prompt",))).where("event = 'row'").select(F.col("texts")["id"].cast("long").alias("conv_id"), F.sha2("sim_text", 256).alias("focus_hash"))
    return found.join(grouped.select("conv_id", "turns"), "conv_id")


@_query("""SELECT doc_id AS "row", sha256('{"answer":' || to_json(source)::VARCHAR || ',"context":["' || lang || '"]}') AS discriminator FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def record_discriminators(spark, sf_dir):
    """Documents as cases with a context and an answer, by which near copies are told apart."""
    docs = _read(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    record = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "Context": [" '), F.col("lang"), F.lit('\\n"], "label": null, "answer": '), json_string(F.concat("source", F.lit(" "))), F.lit(', "sources": []}\n'))
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("path"), F.lit("jsonl").alias("kind"), _roles("evaluation_dataset").alias("roles"), record.cast("binary").alias("content"))
    found = read_artifacts(files, ReadLimits(250_000, ("user",), ("prompt",))).where("event = 'row'")
    return found.select(F.col("texts")["id"].cast("long").alias("row"), "discriminator")


SIMILARITY_THRESHOLD = 0.85


def _pairs(spark, sf_dir, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(_split_path().alias("path"), F.col("doc_id").alias("row_num"), _split_roles().alias("roles"), prefixed_sha(F.trim("text")).alias("row_hash"), F.lit(None).cast("string").alias("discriminator"), F.col("text").alias("sim_text"))
    return overlap.candidate_pairs(overlap.similarity_items(docs), threshold)


@_query(scan_workloads.NEAR_OVERLAP)
def train_eval_near_duplicate(spark, sf_dir):
    found = overlap.near_overlap(_pairs(spark, sf_dir), SIMILARITY_THRESHOLD)
    return found.select("evaluation_artifact", "evaluation_row", "training_row", "similarity_score", "overlap_count")


@_query(scan_workloads.near_duplicates_sql("eval", 1))
def duplicate_eval_near_duplicate(spark, sf_dir):
    found = overlap.near_duplicates(_pairs(spark, sf_dir), aliases.EVALUATION, SIMILARITY_THRESHOLD, discriminate=True)
    return found.select(F.array_join("artifact_paths", ",").alias("artifact_paths"), "near_duplicate_pair_count", "affected_row_count", "max_similarity_score")


@_query(scan_workloads.near_duplicates_sql("train", 0))
def duplicate_train_near_duplicate(spark, sf_dir):
    found = overlap.near_duplicates(_pairs(spark, sf_dir), aliases.TRAINING, SIMILARITY_THRESHOLD, discriminate=False)
    return found.select(F.array_join("artifact_paths", ",").alias("artifact_paths"), "near_duplicate_pair_count", "affected_row_count", "max_similarity_score")


@_query(scan_workloads.CROSS_ROLE)
def cross_role_pairs(spark, sf_dir):
    found = overlap.oriented(_pairs(spark, sf_dir), aliases.TRAINING, aliases.EVALUATION)
    return found.select(F.col("left.row_num").alias("training_row"), F.col("right.row_num").alias("evaluation_row"), F.round("jaccard", 9).alias("jaccard"))


@_query(scan_workloads.PROBE)
def similarity_probe(spark, sf_dir):
    """Benchmark items looked up in the index of documents."""
    docs = _read(spark, sf_dir, "documents").select(F.lit("documents").alias("path"), F.col("doc_id").alias("row_num"), _roles("training_dataset").alias("roles"), F.lit("").alias("row_hash"), F.lit(None).cast("string").alias("discriminator"), F.col("text").alias("sim_text"))
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return overlap.probe(overlap.similarity_items(docs), queries, 0.3).withColumn("jaccard", F.round("jaccard", 9))


@_query(f"""WITH d AS ({HASHED}), f AS (
  SELECT 'critical' AS severity, count(*)::BIGINT AS n FROM d t JOIN d e ON t.h = e.h AND t.doc_id % 2 = 0 AND e.doc_id % 2 = 1
  UNION ALL SELECT 'high', count(*)::BIGINT FROM (SELECT h FROM d WHERE doc_id % 2 = 1 GROUP BY h HAVING count(*) > 1)
  UNION ALL SELECT 'medium', count(*)::BIGINT FROM (SELECT h FROM d WHERE doc_id % 2 = 0 GROUP BY h HAVING count(*) > 1)) SELECT * FROM f WHERE n > 0""")
def severity_histogram(spark, sf_dir):
    rows = _lean_split(spark, sf_dir)
    found = {"critical": overlap.exact_overlap(rows), "high": overlap.exact_duplicates(rows, aliases.EVALUATION), "medium": overlap.exact_duplicates(rows, aliases.TRAINING)}
    counted = [df.select(F.lit(s).alias("severity")) for s, df in found.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).groupBy("severity").agg(F.count("*").alias("n"))
