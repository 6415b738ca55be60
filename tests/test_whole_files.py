"""Scans and profiles of files beyond the limits and in pieces, of files with odd contents, and counts without findings."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lakewarden import scan_workloads
from lakewarden.operators import overlap
from lakewarden.plans import measure, rules
from lakewarden.plans.index import Index
from lakewarden.sources.config import ConfigError, ScanConfig

DIR = "/root/testdata/sf0.001"


def against_sql(name, spark, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = scan_workloads.QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({scan_workloads.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def of_pieces(spark, texts, size=3, **how):
    """The index of {path: lines}, in pieces of so many lines."""
    rows = [(p, at // size, bytearray(b"".join(held[at : at + size]))) for p, held in texts.items() for at in range(0, len(held), size)]
    return Index.of_files(spark, spark.createDataFrame(rows, "path string, part long, content binary"), ScanConfig(max_file_mb=None, max_rows=None), **how)


def test_profile_of_files_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(scan_workloads, "PIECE_BYTES", 10_000)
    got, want = against_sql("profile_measurements", spark, DIR)
    assert got == want and len(got) == 64


def test_pieces_are_as_the_whole_file(spark):
    lines = [b'\xef\xbb\xbf{"prompt": "a", "id": 1}\n', b"\n", b"no json\n", b'{"prompt": "b"}\r\n', b"\r\n", b'{"prompt": "c", "id": 2}\n', b"none either\n", b'{"prompt": "a", "id": 1}']
    texts = {"train.jsonl": lines, "eval_nul.jsonl": [b'{"id": 1}\n'] * 4 + [b'{"id": "\0"}\n'] + [b'{"id": 2}\n'] * 3 + [b"\xff\n"]}
    fields = measure.asked_fields(ScanConfig())
    pieces = of_pieces(spark, texts, fields=fields)
    whole = Index.of_files(spark, spark.createDataFrame([(p, bytearray(b"".join(held))) for p, held in texts.items()], "path string, content binary"), ScanConfig(), fields=fields)
    seen = lambda index: sorted((r["path"], r["row_num"], r["row_hash"]) for r in index.rows.collect())
    assert seen(pieces) == seen(whole) and [n for _, n, _ in seen(pieces)] == [1, 4, 6, 8]
    assert pieces.coverage == whole.coverage and pieces.coverage["train.jsonl"]["fingerprint"]
    told = lambda index: sorted(json.dumps(d, sort_keys=True) for d in index.diagnostics)
    assert told(pieces) == told(whole) and len(told(pieces)) == 3
    assert pieces.facts["eval_nul.jsonl"]["encoding"] == whole.facts["eval_nul.jsonl"]["encoding"]
    assert measure.measurements(pieces) == measure.measurements(whole)


def test_pieces_have_no_limits(spark):
    files = spark.createDataFrame([("train.jsonl", 0, bytearray(b"{}\n"))], "path string, part long, content binary")
    with pytest.raises(ConfigError):
        Index.of_files(spark, files, ScanConfig(), fields=frozenset())
    with pytest.raises(ConfigError):
        Index.of_files(spark, files.withColumn("path", F.lit("train.csv")), ScanConfig(max_file_mb=None, max_rows=None), fields=frozenset())


@pytest.fixture(scope="module")
def long_file(spark, tmp_path_factory):
    """All documents in one training file, more than a scan's row limit; the last two are equal."""
    folder = tmp_path_factory.mktemp("long")
    ids = spark.range(250_003).select((F.col("id") * 8).alias("doc_id"))
    ids.select("doc_id", F.least("doc_id", F.lit(2_000_008)).cast("string").alias("text"), F.lit("s").alias("source")).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_profile_has_all_rows(spark, long_file):
    got, want = against_sql("profile_measurements", spark, long_file)
    assert got == want and ("train_0.jsonl", "dataset.row_count", 250_003.0, 250_003) in got


def test_scan_has_all_rows(spark, long_file):
    got, want = against_sql("scan_findings", spark, long_file)
    assert got == want == [("contamination.duplicate_train_sample", "medium", 1)]


def test_lost_rows_are_an_error(spark, monkeypatch):
    cut = spark.createDataFrame([("train_0.jsonl", 0, bytearray(b'{"prompt": "p"}\n{"prompt"'))], "path string, part long, content binary")
    monkeypatch.setattr(scan_workloads, "_split_files", lambda *_: (cut, ["train_0.jsonl"]))
    for name in ("profile_measurements", "scan_findings"):
        with pytest.raises(RuntimeError, match="row_parse_failed"):
            scan_workloads.QUERIES[name](spark, DIR)


def test_a_failing_rule_ends_the_count(spark, monkeypatch):
    def fails(index):
        raise ValueError("no")

    monkeypatch.setitem(rules.COUNTED, "contamination.train_eval_overlap", (fails, ()))
    with pytest.raises(ValueError):
        scan_workloads.QUERIES["scan_findings"](spark, DIR)


def test_counts_are_those_of_the_findings(spark, monkeypatch):
    same = [b'{"prompt": "p"}\n'] * 5
    texts = {"train_1.jsonl": same + [b'{"prompt": "q", "id": 1}\n'], "train_2.jsonl": same[:2], "eval_1.jsonl": same[:4] + [b'{"prompt": "q", "id": 1}\n'], "train_eval.jsonl": same[:3]}
    index = of_pieces(spark, texts, fields=rules.counted_fields([rules.RULES[i] for i in rules.COUNTED]))
    chosen = [rules.RULES[i] for i in rules.COUNTED]
    want: dict = {}
    for f in rules.execute(index, chosen):
        want[f["rule_id"]] = want.get(f["rule_id"], 0) + 1
    assert {r["rule_id"]: r["findings"] for r in rules.counted(index, chosen).collect()} == want and want["contamination.train_eval_overlap"] == 7 * 4 + 7 * 3 + 3 * 4 + 1


def test_overlaps_are_counted_without_pairs(spark):
    """10^5 copies on both sides are 10^10 pairs."""
    n = 100_000
    side = lambda path, role: spark.range(n).select(F.lit(path).alias("path"), F.col("id").alias("row_num"), F.array(F.lit(role)).alias("roles"), F.lit("h").alias("row_hash"))
    assert [r["findings"] for r in overlap.overlap_counts(side("t", "training_dataset").unionByName(side("e", "evaluation_dataset"))).collect()] == [n * n]


def test_odd_texts(spark, tmp_path):
    rows = [(0, "a the b"), (1, ""), (2, None), (3, "x"), (3, "y the\r the z\n"), (4, "﻿q"), (5, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql("scan_text", spark, tmp_path)
    assert got == want and len(got) == len(rows)
