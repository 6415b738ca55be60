"""Cases that look like findings and are none, rules that cannot know and say nothing, and scans of a store."""

import json

import pytest
import yaml

from lakewarden import cli
from lakewarden.functions.canon import canonical_json, sha256_text
from lakewarden.plans.rules import RULES


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows), encoding="utf-8")


CASE = "How long does the ferry take from the island to the harbour in winter"
EVAL = [
    {"id": "e1", "prompt": CASE, "context": "The ferry takes two hours.", "answer": "two hours", "doc_id": "d1"},
    {"id": "e2", "prompt": CASE, "context": "The ferry takes three hours.", "answer": "three hours", "doc_id": "d2"},  # another context: neither a conflict nor a near copy
    {"id": 3, "prompt": "Write braces { like this } and {{ but never close", "answer": "yes", "doc_ids": ["d1", 7]},
    {"id": "e4", "prompt": "Mail user at example dot org, call 555-010-99, token: short", "answer": "done", "doc_id": 7},
]
TRAIN = [{"id": "t1", "prompt": "Which river runs through the old town?", "answer": "blue", "score": 1}, {"id": "t2", "prompt": "Name a mountain that is visible from the lake.", "answer": "grey", "score": 2.5}]


@pytest.fixture(scope="module")
def quiet(tmp_path_factory):
    root = tmp_path_factory.mktemp("quiet")
    lines(root / "data/train.jsonl", TRAIN)
    lines(root / "data/eval.jsonl", EVAL)
    lines(root / "rag/corpus.jsonl", [{"id": "d1", "chunk_id": "c1", "text": "In winter it takes two hours."}, {"id": "d2", "chunk_id": "c2", "text": "In a storm it takes three hours."}, {"id": 7, "chunk_id": "c3", "text": "naïve — Unicode is no error"}])
    (root / "rag/notes.md").write_text("﻿Some notes about ferries.\r\nThey are short.\r\n", encoding="utf-8")
    (root / "prompts").mkdir()
    (root / "prompts/p.md").write_text("Answer from this:\n<context>\n{{context}}\n</context>\nIgnore {name} and <b>.\n")
    fingerprint = "sha256:" + sha256_text("\n".join(canonical_json(r) for r in EVAL))
    run = {
        "model": "m", "generation_parameters": {"temperature": 0.7, "seed": 0}, "prompt_version": "3", "dataset_fingerprint": fingerprint.upper().replace("SHA256", "sha256"), "metric": "accuracy", "metric_definition": "share of right answers", "timestamp": "2024-01-01",
        "metrics": {"accuracy": {"value": 1.0, "unit": "fraction"}, "loss": {"value": 12.5}, "f1": {"value": 0.4, "bounds": [0, 0.5]}}, "samples": [{"id": r["id"]} for r in reversed(EVAL)],
    }
    (root / "results").mkdir()
    (root / "results/run.json").write_text(json.dumps(run))
    own = "sha256:" + sha256_text("\n".join(canonical_json(r) for r in TRAIN))
    config = {"artifacts": [{"path": "data/train.jsonl", "roles": ["training_dataset"], "schema": {"required": ["prompt", "score"], "fields": {"prompt": {"type": "string"}, "score": {"type": "number"}, "note": {"type": "string", "nullable": True}, "id": {"type": "string"}, "answer": {"type": "string"}}},
                             "provenance": {"required": ["license", "version", "source.type"], "license": "CC0", "version": "1", "fingerprint": own, "source": {"type": "local", "ref": "rag/notes.md"}}}]}
    (root / "lakewarden.yaml").write_text(yaml.safe_dump(config))
    return root


def test_near_misses_give_no_finding(quiet, spark):
    out = quiet.parent / "quiet.json"
    assert cli.run(["scan", str(quiet), "--output", str(out)], spark) == 0
    body = json.loads(out.read_text())
    assert [(f["rule_id"], f["evidence"]) for f in body["findings"]] == [] and body["diagnostics"] == []
    assert len(body["scan"]["rules"]["ids"]) == len(RULES) == 29
    roles = {r for a in body["scan"]["artifacts"] for r in a["roles"]}
    assert {"training_dataset", "evaluation_dataset", "evaluation_result", "prompt_template", "rag_document"} <= roles


def test_a_store_is_scanned_like_a_folder(quiet, spark, tmp_path):
    """By URI, with the files as rows: the same artifacts, findings and profile."""
    lines(quiet / "data/eval_more.jsonl", [{"id": "t1", "prompt": "a repeated case"}] * 2)
    try:
        bodies = []
        for name, root in (("folder", str(quiet)), ("store", f"file://{quiet}")):
            out = tmp_path / f"{name}.json"
            assert cli.run(["scan", root, "--output", str(out), "--rules", "contamination.duplicate_eval_sample,contamination.missing_repro_metadata,provenance.local_source_unresolved"], spark) == 1
            scanned = json.loads(out.read_text())
            assert cli.run(["profile", root, "--output", str(out)], spark) == 0
            bodies.append((scanned["findings"], scanned["scan"]["artifacts"], json.loads(out.read_text())["measurements"]))
        assert bodies[0] == bodies[1] and len(bodies[0][0]) == 1
    finally:
        (quiet / "data/eval_more.jsonl").unlink()
    assert cli.run(["scan", f"file://{quiet}/none"], spark) == 4


def test_incomplete_artifacts_prove_no_absence(tmp_path, spark):
    """Each of these would be a finding if the artifact had been read whole."""
    lines(tmp_path / "data/eval.jsonl", [{"id": "a", "prompt": "p", "doc_id": "gone"}, {"prompt": "without an id"}, "no json\n"])
    lines(tmp_path / "rag/corpus.jsonl", [{"chunk_id": "c", "text": "one"}, {"chunk_id": "c", "text": "two"}, {"id": "x", "text": "same"}, {"id": "y", "text": "same"}, "no json\n"])
    (tmp_path / "results").mkdir()
    (tmp_path / "results/run.json").write_text(json.dumps({"dataset_fingerprint": "0" * 64, "samples": [{"id": "b"}]}))
    out = tmp_path.parent / "incomplete.json"
    silent = ["rag.unreachable_context_id", "dataset.partial_sample_id_coverage", "rag.chunk_id_collision", "rag.duplicate_chunk_in_corpus", "contamination.fingerprint_mismatch", "evaluation.sample_alignment_mismatch"]
    assert cli.run(["scan", str(tmp_path), "--output", str(out), "--rules", ",".join(silent)], spark) == 0
    body = json.loads(out.read_text())
    assert body["findings"] == [] and {d["code"] for d in body["diagnostics"]} == {"artifact.row_parse_failed"}
    for path in ("data/eval.jsonl", "rag/corpus.jsonl"):
        text = (tmp_path / path).read_text().replace("no json\n", "")
        (tmp_path / path).write_text(text)
    cli.run(["scan", str(tmp_path), "--output", str(out), "--rules", ",".join(silent)], spark)
    assert {f["rule_id"] for f in json.loads(out.read_text())["findings"]} == set(silent) - {"evaluation.sample_alignment_mismatch"}
