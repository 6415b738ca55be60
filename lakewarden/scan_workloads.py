"""Catalogue of queries over files made from tables: readers, roles, whole scans and profiles, with equivalent SQL.

Files are rows (path, content), so these run wherever Spark does; each reader sees
whole tables, cut into files by a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canon import canonical_json
from .functions.similarity import hash_family
from .functions.text import json_string
from .plans import measure
from .plans.index import Index
from .plans.rules import RULES, counted, counted_fields
from .sources.config import ScanConfig, parse_config
from .sources.discovery import classified
from .sources.formats import ReadLimits, read_artifacts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _joined_lines(rows: DataFrame, path: Column, order: Column, line: Column, before: str = "", between: str = "\n", after: str = "\n") -> DataFrame:
    """(path, content): the rows' lines in order, a file for each path."""
    grouped = rows.select(path.alias("path"), F.struct(order.alias("o"), line.alias("line")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("all"))
    return grouped.select("path", F.concat(F.lit(before), F.array_join(F.transform("all", lambda x: x["line"]), between), F.lit(after)).cast("binary").alias("content"))


LIMITS = ReadLimits(250_000, ("user",), ("prompt", "input", "query"))


def _records(files: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """What a reader finds in files of one kind: (path, row_num, key, text, kind of key, row_hash)."""
    read = read_artifacts(files.select("path", F.lit(kind).alias("kind"), F.array(F.lit("training_dataset")).alias("roles"), "content"), LIMITS)
    return read.where("event = 'row'").select("path", "row_num", F.col("texts")[key].alias("key"), F.col("texts")[text].alias("text"), F.col("types")[key].alias("key_type"), "row_hash")


def _object(key: str, text: str) -> Column:
    return F.concat(F.lit(f'{{"{text}": '), json_string(F.col(text)), F.lit(f', "{key}": '), F.col(key).cast("string"), F.lit("}"))


def _records_sql(table: str, key: str, text: str, group: str, ext: str, first: int, typed: bool = True) -> str:
    shown = f"{key}::VARCHAR" if typed else f"'\"' || {key}::VARCHAR || '\"'"
    members = " || ',' || ".join(m for _, m in sorted(((key, f"'\"{key}\":' || {shown}"), (text, f"'\"{text}\":' || to_json({text})::VARCHAR"))))
    return f"""SELECT 'train_' || {group}::VARCHAR || '.{ext}' AS path, (row_number() OVER (PARTITION BY {group} ORDER BY {key}) + {first})::BIGINT AS row_num, {key}::VARCHAR AS key, {text} AS text, '{"integer" if typed else "string"}' AS key_type,
'sha256:' || sha256('{{' || {members} || '}}') AS row_hash FROM {table}"""


def _by(group: str, ext: str) -> Column:
    return F.concat(F.lit("train_"), F.col(group).cast("string"), F.lit(f".{ext}"))


@_query(_records_sql("customer", "c_custkey", "c_name", "c_nationkey", "jsonl", 0))
def scan_jsonl(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer")
    return _records(_joined_lines(customers, _by("c_nationkey", "jsonl"), F.col("c_custkey"), _object("c_custkey", "c_name")), "jsonl", "c_custkey", "c_name")


@_query(_records_sql("supplier", "s_suppkey", "s_name", "s_nationkey", "csv", 1, typed=False))
def scan_csv(spark, sf_dir):
    suppliers = _read(spark, sf_dir, "supplier")
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(',"'), F.replace("s_name", F.lit('"'), F.lit('""')), F.lit(' "'))
    return _records(_joined_lines(suppliers, _by("s_nationkey", "csv"), F.col("s_suppkey"), line, before="s_suppkey,s_name\n"), "csv", "s_suppkey", "s_name")


@_query(_records_sql("part", "p_partkey", "p_name", "p_size", "json", 0))
def scan_json(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    return _records(_joined_lines(parts, _by("p_size", "json"), F.col("p_partkey"), _object("p_partkey", "p_name"), before='{"version": 1, "examples": [', between=", ", after="]}"), "json", "p_partkey", "p_name")


@_query(_records_sql("part", "p_partkey", "p_name", "p_size", "yaml", 0))
def scan_yaml(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    line = F.concat(F.lit("- p_partkey: "), F.col("p_partkey").cast("string"), F.lit("\n  p_name: "), json_string(F.col("p_name")))
    return _records(_joined_lines(parts, _by("p_size", "yaml"), F.col("p_partkey"), line), "yaml", "p_partkey", "p_name")


@_query(_records_sql("supplier", "s_suppkey", "s_name", "s_nationkey", "toml", 0))
def scan_toml(spark, sf_dir):
    suppliers = _read(spark, sf_dir, "supplier")
    line = F.concat(F.lit("[[rows]]\ns_suppkey = "), F.col("s_suppkey").cast("string"), F.lit("\ns_name = "), json_string(F.col("s_name")))
    return _records(_joined_lines(suppliers, _by("s_nationkey", "toml"), F.col("s_suppkey"), line), "toml", "s_suppkey", "s_name")


@_query("""SELECT n_nationkey::VARCHAR AS key, n_name AS text, 'integer' AS key_type, count(*) OVER ()::BIGINT AS rows_read FROM nation""")
def scan_parquet(spark, sf_dir):
    """The nation table's own files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{sf_dir.rstrip('/')}/nation.parquet").select("path", "content")
    found = _records(files, "parquet", "n_nationkey", "n_name")
    return found.join(found.agg(F.count("*").alias("rows_read")).withColumn("one", F.lit("integer")), F.col("key_type") == F.col("one")).select("key", "text", "key_type", "rows_read")


@_query(r"""WITH d AS (SELECT doc_id, replace(replace(replace(text, ' the ', chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)
SELECT doc_id::VARCHAR || '.md' AS path, 'sha256:' || sha256(t) AS fingerprint, len(string_split(t, chr(10)))::BIGINT AS lines, length(t)::BIGINT AS n_chars FROM d""")
def scan_text(spark, sf_dir):
    """Documents as Markdown files with mixed line ends and a byte order mark."""
    text = F.concat(F.lit("﻿"), F.replace("text", F.lit(" the "), F.lit("\r\n")))
    files = _read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.cast("binary").alias("content"))
    read = read_artifacts(files.select("path", F.lit("markdown").alias("kind"), F.array(F.lit("rag_document")).alias("roles"), "content"), replace(LIMITS, fields=frozenset()))
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    # a file's facts, which an empty file, one without content and each of two by one path have too
    return read.where("event = 'document'").select("path", get("fingerprint").alias("fingerprint"), (get("line_ends").cast("long") + 1).alias("lines"), get("n_chars").cast("long").alias("n_chars"))


@_query(r"""WITH d AS (SELECT doc_id, encode(text) || CASE WHEN doc_id % 4 = 0 THEN '\x00\x00'::BLOB ELSE ''::BLOB END || CASE WHEN doc_id % 6 = 0 THEN '\xFF'::BLOB ELSE ''::BLOB END AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR || '_eval.jsonl' AS path, 'sha256:' || sha256(b) AS byte_hash, octet_length(b)::BIGINT AS byte_count, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS nul_byte_count, CASE WHEN doc_id % 6 = 0 THEN octet_length(b) - 1 END::BIGINT AS invalid_from FROM d WHERE doc_id % 4 = 0 OR doc_id % 6 = 0""")
def invalid_text_encoding(spark, sf_dir):
    """Documents as dataset files, some with NULs and some with a byte that is no UTF-8 at the end."""
    i, none = F.col("doc_id"), F.lit(bytearray())
    content = F.concat(F.col("text").cast("binary"), F.when(i % 4 == 0, F.lit(bytearray(b"\0\0"))).otherwise(none), F.when(i % 6 == 0, F.lit(bytearray(b"\xff"))).otherwise(none))
    files = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(i.cast("string"), F.lit("_eval.jsonl")).alias("path"), content.alias("content"))
    read = read_artifacts(files.select("path", F.lit("plain_text").alias("kind"), F.array(F.lit("evaluation_dataset")).alias("roles"), "content"), LIMITS)
    facts = read.where("event = 'document'").select("path", F.get_json_object("payload", "$.encoding").alias("e")).where("e IS NOT NULL")
    get = lambda name: F.get_json_object("e", f"$.{name}")
    return facts.select("path", get("byte_hash").alias("byte_hash"), get("byte_count").cast("long").alias("byte_count"), get("nul_byte_count").cast("long").alias("nul_byte_count"), get("invalid_utf8_range[0]").cast("long").alias("invalid_from"))


FOLDERS, STEMS, ENDS = ("train", "data", "evals", "results", "docs", "prompts", "runs", "src"), ("train", "corpus", "scores", "notes", "golden", "system", "leaderboard"), ("jsonl", "csv", "md", "txt", "parquet", "XYZ", "json")


def _pick(options: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(repr(o) for o in options)}][({key}) % {len(options)} + 1]"


@_query(f"""WITH p AS (SELECT p_partkey AS k, {_pick(FOLDERS, 'p_partkey')} AS folder, {_pick(STEMS, 'p_partkey // 3')} AS stem, {_pick(ENDS, 'p_partkey // 5')} AS ending FROM part),
f AS (SELECT folder || '/a/' || stem || '_' || k || '.' || ending AS path, folder, stem, CASE lower(ending) WHEN 'xyz' THEN NULL WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'plain_text' ELSE ending END AS format FROM p),
r AS (SELECT path, format, list_sort(list_filter([
  CASE WHEN format IN ('json','jsonl','csv','parquet') AND (folder = 'train' OR stem = 'train') THEN 'training_dataset' END,
  CASE WHEN format IN ('json','jsonl','csv','parquet') AND (folder = 'evals' OR stem = 'golden') THEN 'evaluation_dataset' END,
  CASE WHEN format IN ('json','jsonl','csv','parquet') AND stem = 'leaderboard' THEN 'benchmark_dataset' END,
  CASE WHEN format IN ('json','jsonl','csv','parquet') AND (folder IN ('results','runs') OR stem = 'scores') THEN 'evaluation_result' END,
  CASE WHEN format IN ('markdown','plain_text','json') AND (folder = 'prompts' OR stem = 'system') THEN 'prompt_template' END,
  CASE WHEN folder = 'docs' OR stem = 'corpus' THEN 'rag_document' END], lambda x: x IS NOT NULL)) AS roles,
  (ending_in(path, '.jsonl') OR starts_with(path, 'docs/') OR regexp_matches(path, '(^|/)golden_[^/]*\\.md$')) AND NOT contains(path, '/a/train_') AS included FROM (SELECT * FROM f))
SELECT path, format, CASE WHEN format IS NULL THEN NULL WHEN len(roles) = 0 THEN 'unknown' ELSE array_to_string(roles, ',') END AS roles, included FROM r""".replace("ending_in(path, '.jsonl')", "suffix(path, '.jsonl')"))
def artifact_roles(spark, sf_dir):
    """Formats, roles and the choice by patterns, of paths made from part keys."""
    one = lambda options, key: F.element_at(F.array(*[F.lit(o) for o in options]), (key % len(options) + 1).cast("int"))
    k = F.col("p_partkey")
    path = F.concat(one(FOLDERS, k), F.lit("/a/"), one(STEMS, F.floor(k / 3)), F.lit("_"), k.cast("string"), F.lit("."), one(ENDS, F.floor(k / 5)))
    config = ScanConfig(include=("*.jsonl", "docs/", "golden_*.md"), exclude=("**/train_*",))
    return classified(_read(spark, sf_dir, "part").select(path.alias("path")), config)


def _findings(index: Index, *rules: str) -> list[tuple[str, dict]]:
    return [(i, evidence) for i in rules for _, _, evidence in RULES[i].run(index)]


def _provenance_index(spark: SparkSession, sf_dir: str) -> Index:
    """A dataset file for each nation with a declaration of where it comes from; every fourth declares its true fingerprint."""
    nations = _read(spark, sf_dir, "nation")
    files = _joined_lines(nations, F.concat(F.lit("data/train_"), F.col("n_nationkey").cast("string"), F.lit(".jsonl")), F.col("n_nationkey"), _object("n_nationkey", "n_name"))
    declared = []
    for r in nations.select("n_nationkey", "n_name").orderBy("n_nationkey").collect():  # 25 rows
        k, row = r["n_nationkey"], canonical_json({"n_nationkey": r["n_nationkey"], "n_name": r["n_name"]})
        values = {"required": ["license", "version"], "source": {"type": "local", "ref": f"data/train_{k + 5}.jsonl" if k % 5 else "data"}, "fingerprint": measure.sha256_hex(row if k % 4 == 0 else row + "x")}
        declared.append({"path": f"data/train_{k}.jsonl", "roles": ["training_dataset"], "provenance": values | ({"license": "MIT"} if k % 2 else {}) | ({"version": "1"} if k % 3 else {})})
    return Index.of_files(spark, files, parse_config({"artifacts": declared}))


@_query("""SELECT 'data/train_' || n_nationkey || '.jsonl' AS artifact_path, CASE WHEN n_nationkey % 2 = 0 THEN 'license' ELSE '' END || CASE WHEN n_nationkey % 6 = 0 THEN ',' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN 'version' ELSE '' END AS missing_fields FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0""")
def required_metadata_missing(spark, sf_dir):
    found = _findings(_provenance_index(spark, sf_dir), "provenance.required_metadata_missing")
    return spark.createDataFrame([(e["artifact_path"], ",".join(e["missing_fields"])) for _, e in found], "artifact_path string, missing_fields string")


PRINT = "sha256('{\"n_name\":' || to_json(n_name)::VARCHAR || ',\"n_nationkey\":' || n_nationkey || '}%s')"


@_query(f"""SELECT 'data/train_' || n_nationkey || '.jsonl' AS artifact_path, 'sha256:' || {PRINT % 'x'} AS declared_fingerprint, 'sha256:' || {PRINT % ''} AS observed_fingerprint FROM nation WHERE n_nationkey % 4 <> 0""")
def manifest_fingerprint_mismatch(spark, sf_dir):
    found = _findings(_provenance_index(spark, sf_dir), "provenance.manifest_fingerprint_mismatch")
    return spark.createDataFrame([(e["artifact_path"], e["declared_fingerprint"], e["observed_fingerprint"]) for _, e in found], "artifact_path string, declared_fingerprint string, observed_fingerprint string")


@_query("""SELECT 'data/train_' || a.n_nationkey || '.jsonl' AS artifact_path, CASE WHEN a.n_nationkey % 5 = 0 THEN 'not_file' ELSE 'missing' END AS source_status, 'sha256:' || sha256(CASE WHEN a.n_nationkey % 5 = 0 THEN 'data' ELSE 'data/train_' || (a.n_nationkey + 5) || '.jsonl' END) AS source_ref_hash
FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 5 WHERE a.n_nationkey % 5 = 0 OR b.n_nationkey IS NULL""")
def local_source_unresolved(spark, sf_dir):
    found = _findings(_provenance_index(spark, sf_dir), "provenance.local_source_unresolved")
    return spark.createDataFrame([(e["artifact_path"], e["source_status"], e["source_ref_hash"]) for _, e in found], "artifact_path string, source_status string, source_ref_hash string")


@_query("""WITH d AS (SELECT c_nationkey AS k, c_custkey AS i, c_custkey % 7 = 0 AS empty FROM customer)
SELECT 'rag/corpus_' || k || '.jsonl' AS artifact_path, 'empty' AS state, count(*) FILTER (empty)::BIGINT AS empty_record_count, count(*)::BIGINT AS row_count FROM d GROUP BY k HAVING bool_or(empty)
UNION ALL SELECT 'rag/blank_' || r_regionkey || '.md', 'empty', 0, 0 FROM region UNION ALL SELECT 'rag/torn_' || r_regionkey || '.json', 'corrupted', 0, 0 FROM region""")
def empty_or_corrupted_document(spark, sf_dir):
    """Customers as retrieval records, every seventh blank; blank texts and torn documents beside them."""
    customers = _read(spark, sf_dir, "customer").withColumn("text", F.when(F.col("c_custkey") % 7 == 0, F.lit("  ")).otherwise(F.col("c_name")))
    files = _joined_lines(customers, F.concat(F.lit("rag/corpus_"), F.col("c_nationkey").cast("string"), F.lit(".jsonl")), F.col("c_custkey"), _object("c_custkey", "text"))
    regions = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("k"))
    more = regions.select(F.concat(F.lit("rag/blank_"), "k", F.lit(".md")).alias("path"), F.lit(bytearray(b" \n\t")).alias("content")).unionByName(regions.select(F.concat(F.lit("rag/torn_"), "k", F.lit(".json")).alias("path"), F.lit(bytearray(b'{"a": [1')).alias("content")))
    test = spark.createDataFrame([("eval.jsonl", bytearray(b'{"prompt": "p"}\n'))], "path string, content binary")
    index = Index.of_files(spark, files.unionByName(more).unionByName(test), ScanConfig())
    found = _findings(index, "rag.empty_or_corrupted_document")
    return spark.createDataFrame([(e["artifact_path"], e["state"], e["empty_record_count"], e["row_count"]) for _, e in found], "artifact_path string, state string, empty_record_count long, row_count long")


def _joined_pieces(rows: DataFrame, path: Column, part: Column, order: Column, line: Column) -> DataFrame:
    """(path, part, content): the rows' lines in order, a piece for each path and part; a task holds one piece at a time."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        piece = lambda: pa.RecordBatch.from_pylist([{"path": now[0], "part": now[1], "content": b"".join(held)}], pa.schema([("path", pa.string()), ("part", pa.int64()), ("content", pa.binary())]))
        for batch in batches:
            for *key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != now:
                    if held:
                        yield piece()
                    now, held = key, []
                held.append(text.as_py().encode() + b"\n")
        if held:
            yield piece()

    dealt = rows.select(path.alias("path"), part.cast("long").alias("part"), order.alias("o"), line.alias("line")).repartition("path", "part").sortWithinPartitions("path", "part", "o")
    return dealt.select("path", "part", "line").mapInArrow(join, "path string, part long, content binary")


PIECE_BYTES = 2 << 20
WHOLE = ScanConfig(max_file_mb=None, max_rows=None)


def _split_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Documents as records of a training file or an evaluation file for each remainder by eight of their ids.

    A file is as long as its documents, so it comes in pieces of about PIECE_BYTES, by hash of
    the id, which any recomputation cuts alike.  Returned with the files' paths.
    """
    docs = _read(spark, sf_dir, "documents").where("text IS NOT NULL")
    side = F.when(F.col("doc_id") % 2 == 0, "train").otherwise("eval")
    pieces = max(1, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 8 / PIECE_BYTES))
    label = F.coalesce(json_string(F.col("source")), F.lit("null"))
    line = F.concat(F.lit('{"prompt": '), json_string(F.col("text")), F.lit(', "label": '), label, F.when(F.col("doc_id") % 5 != 0, F.lit("}")).otherwise(F.concat(F.lit(', "id": '), F.col("doc_id").cast("string"), F.lit("}"))))
    path = F.concat(side, F.lit("_"), (F.col("doc_id") % 8).cast("string"), F.lit(".jsonl"))
    files = _joined_pieces(docs, path, F.pmod(F.xxhash64("doc_id"), F.lit(pieces)), F.col("doc_id"), line)
    return files, [r["path"] for r in docs.select(path.alias("path")).distinct().collect()]  # a path for each remainder


def _whole_index(spark: SparkSession, sf_dir: str, fields: frozenset[str]) -> Index:
    """The index of all rows of the split files; an error where any was lost."""
    files, paths = _split_files(spark, sf_dir)
    index = Index.of_files(spark, files, WHOLE, fields=fields, hashed=False, paths=paths, shown=measure.shown_fields(WHOLE))
    if lost := sorted({d["code"] for d in index.diagnostics}):
        raise RuntimeError(f"The documents were not read in full: {', '.join(lost)}.")
    return index


TRIMMED = r"regexp_replace(text, '^[\s\x1c-\x1f\x0b\x85\p{Z}]+|[\s\x1c-\x1f\x0b\x85\p{Z}]+$', '', 'g')"
SPLIT_ROWS = f"""WITH d AS (SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 'train_' ELSE 'eval_' END) || (doc_id % 8) || '.jsonl' AS path, text,
 sha256(to_json({TRIMMED})::VARCHAR || to_json(source)::VARCHAR || CASE WHEN doc_id % 5 <> 0 THEN '' ELSE doc_id::VARCHAR END) AS h FROM documents WHERE text IS NOT NULL)"""


@_query(SPLIT_ROWS + """, m AS (SELECT path, count(*)::BIGINT AS n, count(DISTINCT h)::BIGINT AS u, count(*) FILTER (doc_id % 5 = 0)::BIGINT AS i, min(length(text))::BIGINT AS lo, max(length(text))::BIGINT AS hi, quantile_disc(length(text), 0.5)::BIGINT AS p50, quantile_disc(length(text), 0.95)::BIGINT AS p95 FROM d GROUP BY path)
SELECT path AS artifact_path, 'dataset.row_count' AS measurement_id, n::DOUBLE AS value, n AS population FROM m
UNION ALL SELECT path, 'dataset.rejected_record_rate', 0.0, n FROM m UNION ALL SELECT path, 'dataset.exact_duplicate_rate', round((n - u) / n, 9), n FROM m UNION ALL SELECT path, 'dataset.sample_id_coverage', round(i / n, 9), n FROM m
UNION ALL SELECT path, 'dataset.input_character_lengths.' || k, v::DOUBLE, n FROM (SELECT path, n, unnest(['min', 'max', 'p50', 'p95']) AS k, unnest([lo, hi, p50, p95]) AS v FROM m)""")
def profile_measurements(spark, sf_dir):
    """The measurements of a whole profile, a row per number."""
    index = _whole_index(spark, sf_dir, measure.asked_fields(WHOLE))
    out = []
    for m in measure.measurements(index):
        named = {f"{m['measurement_id']}.{k}": v for k, v in (m["value"] or {}).items()} if m["measurement_id"] == "dataset.input_character_lengths" else {m["measurement_id"]: m["value"]}
        out += [(m["artifact_path"], k, round(float(v), 9), m["population_count"]) for k, v in named.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(out, "artifact_path string, measurement_id string, value double, population long")


@_query(SPLIT_ROWS + """, x AS (
 SELECT 'contamination.duplicate_train_sample' AS rule_id, 'medium' AS severity, count(*)::BIGINT AS findings FROM (SELECT path, h FROM d WHERE doc_id % 2 = 0 GROUP BY path, h HAVING count(*) > 1)
 UNION ALL SELECT 'contamination.duplicate_eval_sample', 'high', count(*)::BIGINT FROM (SELECT path, h FROM d WHERE doc_id % 2 = 1 GROUP BY path, h HAVING count(*) > 1)
 UNION ALL SELECT 'dataset.partial_sample_id_coverage', 'medium', count(*)::BIGINT FROM (SELECT path FROM d WHERE doc_id % 2 = 1 GROUP BY path HAVING count(*) FILTER (doc_id % 5 <> 0) BETWEEN 1 AND count(*) - 1)
 UNION ALL SELECT 'contamination.train_eval_overlap', 'critical', count(*)::BIGINT FROM d t JOIN d e ON t.h = e.h AND t.doc_id % 2 = 0 AND e.doc_id % 2 = 1) SELECT * FROM x WHERE findings > 0""")
def scan_findings(spark, sf_dir):
    """Findings of a scan with four rules, counted by rule."""
    chosen = [RULES[i] for i in ("contamination.duplicate_train_sample", "contamination.duplicate_eval_sample", "dataset.partial_sample_id_coverage", "contamination.train_eval_overlap")]
    return counted(_whole_index(spark, sf_dir, counted_fields(chosen)), chosen)


def minhash_sql(table: str, key: str, text: str, name: str, size: int = 64, bands: int = 16) -> str:
    """CTEs name_s (shingles), name_n (their number) and name_b (band keys) of a table's texts."""
    a, b = hash_family(size)
    params = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)))
    return rf"""{name}_t AS (SELECT {key} AS id, trim(regexp_replace(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM {table} WHERE {text} <> ''),
{name}_s AS (SELECT DISTINCT id, CASE WHEN length(t) <= 3 THEN t ELSE substr(t, p, 3) END AS g FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS p FROM {name}_t WHERE t <> '')),
{name}_n AS (SELECT id, count(*)::BIGINT AS n FROM {name}_s GROUP BY id),
{name}_l AS (SELECT id, h FROM (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS k FROM (SELECT id, ('0x' || substr(sha256(g), 1, 8))::BIGINT & 2147483647 AS h FROM {name}_s)) WHERE k <= 50),
{name}_g AS (SELECT id, i, min((a * h + b) % 2147483647) AS m FROM {name}_l, (VALUES {params}) AS p(i, a, b) GROUP BY id, i
  UNION ALL SELECT id, unnest(range({size})), 0 FROM {name}_t WHERE t = ''),
{name}_b AS (SELECT id, i // {size // bands} AS band, string_agg(m::VARCHAR, ',' ORDER BY i) AS key FROM {name}_g GROUP BY ALL)"""


PAIRS = "WITH " + minhash_sql("documents", "doc_id", "text", "d") + """, hot AS (SELECT band, key FROM d_b GROUP BY band, key HAVING count(*) BETWEEN 2 AND 100),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM d_b x JOIN hot USING (band, key) JOIN d_b y USING (band, key) WHERE x.id < y.id),
o AS (SELECT a, b, count(s.g)::BIGINT AS shared FROM c JOIN d_s r ON r.id = a LEFT JOIN d_s s ON s.id = b AND s.g = r.g GROUP BY a, b),
j AS (SELECT a, b, CAST(shared AS DOUBLE) / (m.n + n.n - shared) AS score FROM o JOIN d_n m ON m.id = a JOIN d_n n ON n.id = b),
p AS (SELECT j.*, sha256(trim(x.text, ' ')) <> sha256(trim(y.text, ' ')) AS differ, round_even(score, 4) AS r FROM j JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE score >= 0.85)
"""

NEAR_OVERLAP = PAIRS + """, m AS (SELECT CASE WHEN a % 2 = 1 THEN a ELSE b END AS e, CASE WHEN a % 2 = 0 THEN a ELSE b END AS t, r FROM p WHERE a % 2 <> b % 2 AND score < 1 AND r >= 0.85 AND differ)
SELECT 'eval' AS evaluation_artifact, e AS evaluation_row, min(t) AS training_row, max(r) AS similarity_score, count(*)::BIGINT AS overlap_count FROM m GROUP BY e"""


def near_duplicates_sql(name: str, parity: int) -> str:
    return PAIRS + f""", m AS (SELECT a, b, r FROM p WHERE a % 2 = {parity} AND b % 2 = {parity} AND score < 1 AND r >= 0.85 AND differ)
SELECT '{name},{name}' AS artifact_paths, count(*)::BIGINT AS near_duplicate_pair_count, (SELECT count(*) FROM (SELECT a FROM m UNION SELECT b FROM m))::BIGINT AS affected_row_count, max(r) AS max_similarity_score FROM m HAVING count(*) > 0"""


CROSS_ROLE = PAIRS + """SELECT CASE WHEN a % 2 = 0 THEN a ELSE b END AS training_row, CASE WHEN a % 2 = 1 THEN a ELSE b END AS evaluation_row, round(score, 9) AS jaccard FROM p WHERE a % 2 <> b % 2"""

PROBE = "WITH " + minhash_sql("documents", "doc_id", "text", "d") + ", " + minhash_sql("benchmark", "item_id", "text", "q") + """,
c AS (SELECT DISTINCT q_b.id AS q, d_b.id AS d FROM q_b JOIN d_b USING (band, key) WHERE q_b.id IN (SELECT id FROM q_n)),
o AS (SELECT q, d, count(s.g)::BIGINT AS shared FROM c JOIN q_s r ON r.id = q LEFT JOIN d_s s ON s.id = d AND s.g = r.g GROUP BY q, d)
SELECT q::VARCHAR AS query_id, 'documents:' || d AS id, round(CAST(shared AS DOUBLE) / (m.n + coalesce(n.n, 0) - shared), 9) AS jaccard FROM o JOIN q_n m ON m.id = q LEFT JOIN d_n n ON n.id = d WHERE CAST(shared AS DOUBLE) / (m.n + coalesce(n.n, 0) - shared) >= 0.3"""
