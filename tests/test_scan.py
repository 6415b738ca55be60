"""Every rule finds its case in a broken project, keeps quiet on a clean one, and abstains without artifacts."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml

from lakewarden import cli
from lakewarden.plans.rules import RULES

EVIDENCE = {
    "provenance.required_metadata_missing": {"artifact_path", "contract_fingerprint", "missing_fields", "missing_count"},
    "provenance.manifest_fingerprint_mismatch": {"declared_fingerprint", "observed_fingerprint"},
    "provenance.local_source_unresolved": {"source_ref_hash", "source_status"},
    "dataset.invalid_text_encoding": {"byte_hash", "byte_count", "invalid_utf8_range", "nul_byte_count"},
    "contamination.train_eval_near_duplicate": {"similarity_score", "configured_threshold", "matched_training_records", "evidence_truncated"},
    "rag.chunk_id_collision": {"chunk_id_hash", "record_count", "distinct_content_count", "sample_records"},
    "evaluation.sample_alignment_mismatch": {"dataset_count", "result_count", "mismatch_types"},
    "dataset.schema_contract_violation": {"total_violation_count", "affected_row_count", "violation_counts", "sample_violations"},
}


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


LONG = "The quick brown fox jumps over the lazy dog near the river bank at dawn"


@pytest.fixture(scope="module")
def broken(tmp_path_factory):
    root = tmp_path_factory.mktemp("broken")
    lines(root / "data/train.jsonl", [{"prompt": "a shared question about rivers", "answer": "blue"}, {"prompt": LONG + " today", "answer": "x"}, {"prompt": LONG + " todayy", "answer": "y"}, {"prompt": "twice", "answer": "t"}, {"prompt": "twice ", "answer": "t"}])
    lines(root / "data/eval.jsonl", [
        {"id": 1, "prompt": "a shared question about rivers", "answer": "blue"}, {"id": "1", "prompt": LONG + " todays", "answer": "The capital of the river land is Lyonesse"},
        {"prompt": "  ", "doc_id": "empty-doc"}, {"prompt": "fill {{name}} in", "doc_id": "nowhere"}, {"prompt": "same input", "label": "yes it is so"}, {"prompt": "same input", "label": "no it is not"},
        {"prompt": "again"}, {"prompt": "again"}, {"prompt": LONG + " todayz"}, {"prompt": LONG + " todayq"}, {"prompt": "a key api_key = ABCDEFGHIJKLMNOP and jane@example.org"},
    ])
    lines(root / "data/eval_shared.jsonl", [{"prompt": "a shared question about rivers", "answer": "blue"}])
    lines(root / "rag/corpus.jsonl", [{"id": "empty-doc", "text": " "}, {"chunk_id": "c", "text": "one content"}, {"chunk_id": "c", "text": "another content"}, {"id": "d1", "text": "same chunk  text"}, {"id": "d2", "text": "same chunk text"}])
    (root / "rag/notes.md").write_text("It says: the capital is known.\nThe capital of the river\nland is Lyonesse.\n")
    (root / "prompts").mkdir()
    (root / "prompts/p.md").write_text("Answer from this:\n{{context}}\n")
    (root / "data/eval_bad.jsonl").write_bytes(b'{"prompt": "\xff"}\n')
    lines(root / "data/aligned_test.jsonl", [{"id": "a", "prompt": "p one"}, {"id": "b", "prompt": "p two"}])
    from lakewarden.functions.canon import canonical_json, sha256_text

    fingerprint = sha256_text("\n".join(canonical_json(r) for r in [{"id": "a", "prompt": "p one"}, {"id": "b", "prompt": "p two"}]))
    (root / "results").mkdir()
    (root / "results/one.json").write_text(json.dumps({"dataset_fingerprint": fingerprint, "samples": [{"id": "a"}, {"id": "c"}, {"id": "c"}], "metrics": {"accuracy": {"value": 1.4, "unit": "fraction"}}, "run": {"generation_params": {"temperature": 0.7}}}))
    (root / "results/two.json").write_text(json.dumps({"prompt_fingerprint": "0" * 64, "model": "m"}))
    (root / "lakewarden.yaml").write_text(yaml.safe_dump({"similarity": {"threshold": 0.8}, "artifacts": [
        {"path": "data/train.jsonl", "roles": ["training_dataset"], "schema": {"required": ["prompt", "source"], "fields": {"prompt": {"type": "string"}, "source": {"type": "string"}, "answer": {"type": "integer"}}}, "provenance": {"required": ["license", "version"], "fingerprint": "1" * 64, "source": {"type": "local", "ref": "raw/none.csv"}}}]}))
    return root


@pytest.fixture(scope="module")
def report(broken, spark):
    out = broken.parent / "report.json"
    code = cli.run(["scan", str(broken), "--output", str(out)], spark)
    assert code == 1
    return json.loads(out.read_text())


def test_every_rule_has_a_finding(report):
    assert not [d for d in report["diagnostics"] if d["code"] == "rule.recoverable_error"]
    found = {f["rule_id"] for f in report["findings"]}
    quiet = set(RULES) - found
    # both abstain by design here: one artifact is not fully read, so absence cannot be shown
    assert quiet <= {"rag.unreachable_context_id", "contamination.fingerprint_mismatch"}, quiet
    assert len(RULES) == 29


def test_evidence_keys_and_order(report):
    for f in report["findings"]:
        assert EVIDENCE.get(f["rule_id"], set()) <= set(f["evidence"]), f["rule_id"]
    ranks = [{"critical": 4, "high": 3, "medium": 2, "low": 1}[f["severity"]] for f in report["findings"]]
    assert ranks == sorted(ranks, reverse=True)


def test_values_are_redacted(report):
    text = json.dumps(report["findings"])
    assert "ABCDEFGHIJKLMNOP" not in text and "jane@example.org" not in text and "Lyonesse" not in text


def test_specific_findings(report):
    by = {}
    for f in report["findings"]:
        by.setdefault(f["rule_id"], []).append(f["evidence"])
    assert {(e["evaluation_artifact"], e["training_row"], e["evaluation_row"]) for e in by["contamination.train_eval_overlap"]} == {("data/eval_shared.jsonl", 1, 1)}
    assert by["contamination.duplicate_train_sample"][0]["duplicate_row_locations"] == [4, 5]
    assert by["evaluation.metric_out_of_bounds"][0]["observed_value"] == 1.4
    (a,) = by["evaluation.sample_alignment_mismatch"]
    assert a["mismatch_types"] == ["count_mismatch", "missing_ids", "unexpected_ids", "duplicate_result_ids"]
    v = by["dataset.schema_contract_violation"][0]["violation_counts"]
    assert v == {"required_field_missing": 5, "type_mismatch": 5}
    assert {e["detector_type"] for e in by["contamination.sensitive_value_exposure"]} == {"api_key", "email"}


def test_scan_is_deterministic(broken, spark, report, tmp_path):
    out = tmp_path / "r.json"
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        cli.run(["scan", str(broken), "--output", str(out)], spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    again = json.loads(out.read_text())
    assert again["findings"] == report["findings"] and again["diagnostics"] == report["diagnostics"]


def test_references_and_fingerprints(tmp_path, spark):
    lines(tmp_path / "eval.jsonl", [{"prompt": "q", "doc_id": "gone"}, {"prompt": "r", "doc_ids": ["d", 7]}])
    lines(tmp_path / "rag/corpus.jsonl", [{"id": "d", "text": "some"}, {"id": 7, "text": "more"}])
    (tmp_path / "results").mkdir()
    (tmp_path / "results/a.json").write_text(json.dumps({"dataset_hash": "sha256:" + "0" * 64}))
    out = tmp_path.parent / "ref.json"
    cli.run(["scan", str(tmp_path), "--output", str(out), "--rules", "rag.unreachable_context_id,contamination.fingerprint_mismatch"], spark)
    found = {f["rule_id"]: f["evidence"] for f in json.loads(out.read_text())["findings"]}
    assert found["rag.unreachable_context_id"]["evaluation_row"] == 1 and found["rag.unreachable_context_id"]["missing_reference_count"] == 1
    assert found["contamination.fingerprint_mismatch"]["candidate_artifact_paths"] == ["eval.jsonl"]


def test_clean_and_empty_projects(tmp_path, spark):
    clean, empty = tmp_path / "clean", tmp_path / "empty"
    empty.mkdir()
    lines(clean / "train.jsonl", [{"id": "t1", "prompt": "alpha beta gamma", "answer": "one"}])
    lines(clean / "eval.jsonl", [{"id": "e1", "prompt": "delta epsilon zeta", "answer": "two"}])
    for root in (clean, empty):
        out = tmp_path / f"{root.name}.json"
        assert cli.run(["scan", str(root), "--output", str(out)], spark) == 0
        body = json.loads(out.read_text())
        assert body["findings"] == [] and body["diagnostics"] == []


def test_formats_agree(tmp_path, spark):
    rows = [{"prompt": "p1", "answer": "a1"}, {"prompt": "p2", "answer": "a2"}]
    lines(tmp_path / "train.jsonl", rows)
    (tmp_path / "train.csv").write_text("prompt,answer\np1,a1\np2, a2\nshort\n")
    (tmp_path / "train.json").write_text(json.dumps(rows))
    (tmp_path / "train.yaml").write_text(yaml.safe_dump({"rows": rows}))
    (tmp_path / "train.toml").write_text("".join(f'[[rows]]\nprompt = "{r["prompt"]}"\nanswer = "{r["answer"]}"\n' for r in rows))
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "train.parquet")
    pq.write_table(pa.table({"when": pa.array([1], pa.timestamp("us"))}), tmp_path / "train_times.parquet")
    out = tmp_path.parent / "profile.json"
    assert cli.run(["profile", str(tmp_path), "--output", str(out)], spark) == 0
    body = json.loads(out.read_text())
    value = {(m["artifact_path"], m["measurement_id"]): m["value"] for m in body["measurements"]}
    for name in ("jsonl", "csv", "json", "yaml", "toml", "parquet"):
        assert value[f"train.{name}", "dataset.row_count"] == 2
        assert value[f"train.{name}", "dataset.input_character_lengths"] == {"min": 2, "max": 2, "p50": 2, "p95": 2}
    assert value["train.jsonl", "dataset.artifact_fingerprint"] == value["train.parquet", "dataset.artifact_fingerprint"] == value["train.csv", "dataset.artifact_fingerprint"]
    assert value["train.csv", "dataset.rejected_record_rate"] == pytest.approx(1 / 3)
    assert value["train_times.parquet", "dataset.row_count"] is None
    assert {d["code"] for d in body["diagnostics"]} == {"artifact.row_parse_failed", "artifact.unsupported_parquet_schema"}


def test_exit_codes(tmp_path, spark, capsys):
    assert cli.run(["rules"]) == 0 and "contamination.train_eval_overlap" in capsys.readouterr().out
    assert cli.run(["scan", str(tmp_path / "none")]) == 4
    (tmp_path / "lakewarden.yaml").write_text("nonsense: 1\n")
    assert cli.run(["scan", str(tmp_path)]) == 3
    os.remove(tmp_path / "lakewarden.yaml")
    assert cli.run(["scan", str(tmp_path), "--rules", "no.such_rule"], spark) == 2
    assert cli.run(["scan", str(tmp_path), "--rules", " , "], spark) == 2
    assert cli.run(["scan", str(tmp_path), "--output", str(tmp_path / "no/such/r.json")], spark) == 5
    assert cli.run(["nothing"]) == 2
