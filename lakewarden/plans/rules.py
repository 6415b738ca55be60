"""The 29 integrity rules: each is a plan over the index whose bounded rows become findings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.canon import canonical_json, type_name
from ..functions.text import content_fields, content_state, first_rows, first_scalar, plain_text
from ..operators import content, contracts, identity, overlap, results
from .index import INCOMPLETE, Index

SEVERITY_RANKS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
Found = Iterator[tuple[str, list[dict], dict]]  # (message, locations, evidence)


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    confidence: str
    title: str
    advice: str
    roles: tuple[str, ...]
    run: Callable[[Index], Found]


RULES: dict[str, Rule] = {}


def rule(id: str, severity: str, confidence: str, title: str, advice: str, *roles: str):
    def add(f):
        RULES[id] = Rule(id, severity, confidence, title, advice, roles or aliases.DATASETS, f)
        return f

    return add


def plain(value: Any) -> Any:
    """Rows and structs as plain objects."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def collected(df: DataFrame) -> Iterator[dict]:
    for row in df.toLocalIterator():
        yield plain(row)


def at(role: str, path: str, **where) -> dict:
    return {"role": role, "path": path, **{k: v for k, v in where.items() if v is not None}}


def finding(r: Rule, severity: str, message: str, locations: list[dict], evidence: dict) -> dict:
    core = {"rule_id": r.id, "severity": severity, "confidence": r.confidence, "locations": locations, "evidence": evidence}
    digest = hashlib.sha256(canonical_json(core).encode()).hexdigest()
    return {**core, "title": r.title, "message": message, "impact": r.title, "recommendation": r.advice, "fingerprint": f"sha256:{digest}"}


def _ungated(index: Index, rows: DataFrame) -> DataFrame:
    """Rows of artifacts that were read without loss."""
    lossy = [p for p in index.artifacts if index.codes(p) & set(INCOMPLETE)]
    return rows.where(~F.col("path").isin(lossy)) if lossy else rows


@rule("contamination.train_eval_overlap", "critical", "confirmed", "A training record is also an evaluation record", "Take the record out of one split.", *aliases.DATASETS)
def train_eval_overlap(index: Index) -> Found:
    for e in collected(overlap.exact_overlap(index.rows)):
        yield f"Row {e['training_row']} of '{e['training_artifact']}' is row {e['evaluation_row']} of '{e['evaluation_artifact']}'.", [at("source", e["training_artifact"], row=e["training_row"]), at("target", e["evaluation_artifact"], row=e["evaluation_row"])], e


@rule("contamination.train_eval_near_duplicate", "high", "likely", "An evaluation record is nearly a training record", "Replace the evaluation record.", *aliases.DATASETS)
def train_eval_near_duplicate(index: Index) -> Found:
    if not index.config.similarity.enabled:
        return
    for e in collected(overlap.near_overlap(index.pairs, index.config.similarity.threshold)):
        yield f"Row {e['evaluation_row']} of '{e['evaluation_artifact']}' is close to {e['overlap_count']} training records ({e['similarity_score']:.4f}).", [at("target", e["evaluation_artifact"], row=e["evaluation_row"]), at("source", e["training_artifact"], row=e["training_row"])], e


def _repeats(index: Index, roles: tuple[str, ...]) -> Found:
    for e in collected(overlap.exact_duplicates(index.rows, roles)):
        yield f"A record occurs {e['duplicate_count']} times in '{e['artifact_path']}'.", [at("primary", e["artifact_path"], row=n) for n in e["duplicate_row_locations"]], e


@rule("contamination.duplicate_eval_sample", "high", "confirmed", "An evaluation record is repeated", "Keep one of the records.", *aliases.EVALUATION)
def duplicate_eval_sample(index: Index) -> Found:
    yield from _repeats(index, aliases.EVALUATION)


@rule("contamination.duplicate_train_sample", "medium", "confirmed", "A training record is repeated", "Keep one of the records.", *aliases.TRAINING)
def duplicate_train_sample(index: Index) -> Found:
    yield from _repeats(index, aliases.TRAINING)


def _near(index: Index, roles: tuple[str, ...], discriminate: bool, key: str) -> Found:
    if not index.config.similarity.enabled:
        return
    for e in collected(overlap.near_duplicates(index.pairs, roles, index.config.similarity.threshold, discriminate)):
        for pair in e["sample_pairs"]:
            pair["rows"] = [{"path": r["path"], key: r["row"]} for r in pair["rows"]]
        first = e["sample_pairs"][0]["rows"]
        yield f"{e['near_duplicate_pair_count']} pairs of records are close in {e['artifact_paths']}.", [at("primary", first[0]["path"], row=first[0][key]), at("secondary", first[1]["path"], row=first[1][key])], e


@rule("contamination.duplicate_eval_near_duplicate", "medium", "likely", "Evaluation records are nearly equal", "Keep one of each group.", *aliases.EVALUATION)
def duplicate_eval_near_duplicate(index: Index) -> Found:
    yield from _near(index, aliases.EVALUATION, True, "row")


@rule("contamination.duplicate_train_near_duplicate", "low", "likely", "Training records are nearly equal", "Keep one of each group.", *aliases.TRAINING)
def duplicate_train_near_duplicate(index: Index) -> Found:
    yield from _near(index, aliases.TRAINING, False, "training_row")


@rule("contamination.rag_answer_leakage", "high", "likely", "A retrieval text holds an expected answer", "Take the answer out of the corpus, or mark the case as grounded.", *aliases.EVALUATION, "rag_document")
def rag_answer_leakage(index: Index) -> Found:
    textual = [p for p in index.paths("rag_document") if index.artifacts[p].format != "parquet"]
    whole = index.texts.where(F.col("path").isin(textual)).select(F.col("path").alias("rag_artifact"), F.lit(None).cast("long").alias("rag_row"), plain_text(F.col("text")).alias("rag_text"))
    binary = [p for p in index.paths("rag_document") if index.artifacts[p].format == "parquet"]
    records = identity.retrieval_records(index.rows.where(F.col("path").isin(binary))).where("plain IS NOT NULL").select(F.col("path").alias("rag_artifact"), F.col("row_num").alias("rag_row"), F.col("plain").alias("rag_text"))
    for e in collected(content.answer_leakage(content.answers(index.rows), whole.unionByName(records))):
        where = at("related", e["rag_artifact"], row=e.pop("rag_row"))
        yield f"The answer of row {e['evaluation_row']} of '{e['evaluation_artifact']}' stands in '{e['rag_artifact']}'.", [at("primary", e["evaluation_artifact"], row=e["evaluation_row"], field=e["answer_field"]), where], e


@rule("contamination.missing_repro_metadata", "high", "confirmed", "A result lacks what it takes to reproduce it", "Record the missing metadata.", "evaluation_result")
def missing_repro_metadata(index: Index) -> Found:
    held = [(p, {k: "there" for k in m}) for p, m in index.metadata.items()]
    meta = index.spark.createDataFrame(held, "result_artifact string, fields map<string,string>")
    for e in collected(results.missing_metadata(meta)):
        yield f"'{e['result_artifact']}' lacks {', '.join(e['missing_metadata_fields'])}.", [at("primary", e["result_artifact"])], e


@rule("contamination.fingerprint_mismatch", "high", "confirmed", "A result refers to an artifact that is not there", "Restore the artifact or run again.", "evaluation_result", "prompt_template", *aliases.DATASETS)
def fingerprint_mismatch(index: Index) -> Found:
    kinds = {"prompt": ("prompt_template",), "dataset": aliases.DATASETS}
    open_roles = {r for p, c in index.coverage.items() if c["index_status"] != "indexed" and "configuration" not in c["roles"] for r in c["roles"]}
    wanted = [(p, kind, str(m[f"{kind}_fingerprint"][0])) for p, m in index.metadata.items() for kind, roles in kinds.items() if isinstance(m.get(f"{kind}_fingerprint", (None,))[0], str) and not set(roles) & open_roles]
    known = [(kind, p, index.fingerprint(p)) for kind, roles in kinds.items() for p in index.paths(*roles, but_configuration=True)]
    found = results.unmatched_fingerprints(index.spark.createDataFrame(wanted, "result_artifact string, artifact_type string, referenced_fingerprint string"), index.spark.createDataFrame(known, "artifact_type string, path string, fingerprint string"))
    for e in collected(found):
        yield f"No {e['artifact_type']} artifact has the fingerprint that '{e['result_artifact']}' refers to.", [at("primary", e["result_artifact"])], e


@rule("contamination.untrusted_context_interpolation", "medium", "heuristic", "A prompt takes outside context without a fence", "Put delimiters around the placeholder.", "prompt_template")
def untrusted_context_interpolation(index: Index) -> Found:
    for e in collected(content.unfenced_interpolations(index.lines.where(F.col("path").isin([p for p in index.paths("prompt_template") if index.artifacts[p].format != "parquet"])))):
        yield f"'{e['variable_name']}' stands unfenced in line {e['line_number']} of '{e['prompt_artifact']}'.", [at("primary", e["prompt_artifact"], line=e["line_number"])], e


@rule("contamination.sensitive_value_exposure", "medium", "heuristic", "A text shows keys or personal data", "Remove or replace the values.", *content.SCANNED_ROLES)
def sensitive_value_exposure(index: Index) -> Found:
    for e in collected(content.exposures(index.lines)):
        key = "row" if index.artifacts[e["artifact_path"]].format == "parquet" else "line"
        yield f"{e['exposure_count']} values of kind {e['detector_type']} in '{e['artifact_path']}'.", [at("primary", e["artifact_path"], **{key: n}) for n in e["sample_locations"]], e


@rule("dataset.empty_evaluation_input", "high", "confirmed", "Evaluation records have no input", "Fill or remove them.", *aliases.EVALUATION)
def empty_evaluation_input(index: Index) -> Found:
    for e in collected(identity.empty_inputs(index.rows)):
        yield f"{e['affected_count']} records of '{e['artifact_path']}' have blank inputs.", [at("primary", e["artifact_path"], row=n) for n in e["row_locations"]], e


@rule("dataset.invalid_text_encoding", "medium", "confirmed", "A dataset is no clean UTF-8 text", "Convert it to UTF-8.", *aliases.DATASETS)
def invalid_text_encoding(index: Index) -> Found:
    for path in sorted(index.facts):
        if (facts := index.facts[path].get("encoding")) is not None:
            yield f"'{path}' holds bytes that are no text.", [at("primary", path)], {"artifact_path": path, **facts}


@rule("dataset.label_inconsistency", "high", "confirmed", "Equal inputs have different labels", "Check the labels, or add the context that tells the cases apart.", *aliases.EVALUATION)
def label_inconsistency(index: Index) -> Found:
    for e in collected(identity.label_conflicts(index.rows)):
        e["conflicting_target_count"], e["conflicting_target_hashes"] = e.pop("distinct_target_count"), e.pop("target_hashes")
        places = [{"path": p["path"], "row": p["row_num"]} for p in e["row_locations"]]
        e["row_locations"] = places
        yield f"One input has {e['conflicting_target_count']} different targets.", [at("primary", p["path"], row=p["row"]) for p in places], e


@rule("dataset.partial_sample_id_coverage", "medium", "confirmed", "Only some records have an id", "Give every record an id.", *aliases.EVALUATION)
def partial_sample_id_coverage(index: Index) -> Found:
    for e in collected(identity.partial_sample_ids(_ungated(index, index.rows))):
        yield f"{e['missing_id_count']} of {e['row_count']} records of '{e['artifact_path']}' have no id.", [at("primary", e["artifact_path"], row=n) for n in e["missing_row_locations"]], e


@rule("dataset.sample_id_collision", "high", "confirmed", "Several records share an id", "Give each record an id of its own.", *aliases.EVALUATION)
def sample_id_collision(index: Index) -> Found:
    for e in collected(identity.sample_id_collisions(index.rows)):
        yield f"{e['record_count']} records of '{e['artifact_path']}' share one id.", [at("primary", e["artifact_path"], row=n) for n in e["row_locations"]], e


@rule("dataset.schema_contract_violation", "high", "confirmed", "A dataset breaks its declared schema", "Repair the records or the declaration.", *aliases.DATASETS)
def schema_contract_violation(index: Index) -> Found:
    declared = {d.path: d.schema for d in index.config.artifacts if d.schema is not None and d.path in index.artifacts}
    contract_of = {p: "sha256:" + hashlib.sha256(canonical_json({"required": sorted(c.required), "fields": {n: {"type": t, "nullable": u} for n, (t, u) in c.fields.items()}}).encode()).hexdigest() for p, c in declared.items()}
    rows, early = [], {}
    for path, c in declared.items():
        codes = index.codes(path)
        if "artifact.file_size_limit_exceeded" in codes or "artifact.unsupported_parquet_schema" in codes:
            continue
        kind = "artifact_unparseable" if codes & {"artifact.parse_failed", "artifact.invalid_text_encoding"} else None if index.facts.get(path, {}).get("has_rows") else "record_collection_unavailable"
        if kind:
            early[path] = [{"violation_type": kind}]
            continue
        early[path] = [{"violation_type": "record_unparseable", "row": d.get("row")} for d in index.diagnostics if d.get("path") == path and d["code"] == "artifact.row_parse_failed"]
        rows += [(path, n, t, n in c.required, u, True) for n, (t, u) in c.fields.items()]
    listed = index.spark.createDataFrame(rows, contracts.CONTRACT)
    found = {e["artifact_path"]: e for e in collected(contracts.violation_summary(contracts.contract_violations(index.rows, listed)))} if rows else {}
    for path in sorted(early):
        e = found.get(path, {"artifact_path": path, "total_violation_count": 0, "affected_row_count": 0, "violation_counts": {}, "sample_violations": []})
        for v in early[path]:
            e["violation_counts"][v["violation_type"]] = e["violation_counts"].get(v["violation_type"], 0) + 1
        samples = [{"row": v["row"], "field": v["field"], "violation_type": v["violation"], "expected_type": v["expected"], "observed_type": v["observed"]} for v in e["sample_violations"]]
        samples = sorted(early[path] + samples, key=lambda v: (v.get("row") or 0, v.get("field") or "", v["violation_type"]))
        total = e["total_violation_count"] + len(early[path])
        if total:
            affected = e["affected_row_count"] + len({v["row"] for v in early[path] if "row" in v})
            yield f"'{path}' breaks its schema {total} times.", [at("primary", path, row=v.get("row"), field=v.get("field") or None) for v in samples[:20]], {"artifact_path": path, "contract_fingerprint": contract_of[path], "total_violation_count": total, "affected_row_count": affected, "violation_counts": dict(sorted(e["violation_counts"].items())), "sample_violations": samples[:20], "evidence_truncated": total > 20}


@rule("evaluation.metric_out_of_bounds", "high", "confirmed", "A metric lies outside its bounds", "Check the metric or its declared bounds.", "evaluation_result")
def metric_out_of_bounds(index: Index) -> Found:
    held = index.spark.createDataFrame(index.metrics, "result_artifact string, metric_name string, field_path string, value double, unit string, low double, high double")
    for e in collected(results.metrics_out_of_bounds(results.with_unit_bounds(held))):
        e["accepted_bounds"] = [None if b == float("inf") else b for b in e["accepted_bounds"]]
        yield f"{e['metric_name']} of '{e['result_artifact']}' is {e['observed_value']}.", [at("primary", e["result_artifact"], field=e["field_path"])], e


@rule("evaluation.sample_alignment_mismatch", "high", "confirmed", "A result's samples are not those of its dataset", "Run again on the dataset, or refer to the right one.", "evaluation_result", *aliases.EVALUATION)
def sample_alignment_mismatch(index: Index) -> Found:
    named = index.rows.withColumn("sample_id", first_scalar(aliases.SAMPLE_ID)["value"])
    for path, meta in sorted(index.metadata.items()):
        wanted = meta.get("dataset_fingerprint", (None,))[0]
        if not isinstance(wanted, str) or not index.complete(path):
            continue
        bare = wanted.strip().lower().removeprefix("sha256:")
        fits = [p for p in index.paths(*aliases.EVALUATION, but_configuration=True) if index.complete(p) and (index.fingerprint(p) or "").removeprefix("sha256:") == bare]
        if not fits or not index.row_counts.get(path) or not index.row_counts.get(fits[0]):
            continue
        (e,) = collected(results.alignment(named.where(F.col("path") == fits[0]), named.where(F.col("path") == path)))
        kinds = ["count_mismatch"] * (e["dataset_count"] != e["result_count"]) + [k for k in ("missing_ids", "unexpected_ids", "duplicate_dataset_ids", "duplicate_result_ids") if e[k]]
        if kinds:
            yield f"'{path}' and '{fits[0]}' differ: {', '.join(kinds)}.", [at("primary", path), at("related", fits[0])], {"result_artifact": path, "dataset_artifact": fits[0], "matched_dataset_artifact_paths": fits, "dataset_fingerprint": wanted, **e, "mismatch_types": kinds}


@rule("prompt.unresolved_placeholder", "medium", "heuristic", "An input still has template placeholders", "Render the template before the record is stored.", *aliases.EVALUATION)
def unresolved_placeholder(index: Index) -> Found:
    for e in collected(content.unresolved_placeholders(index.rows)):
        yield f"Row {e['row']} of '{e['artifact_path']}' has {e['detected_count']} placeholders.", [at("primary", e["artifact_path"], row=e["row"], field=e["field"])], e


def _declared(index: Index) -> Iterator[tuple[dict, dict]]:
    for p in index.provenance():
        c = p["contract"]
        core = {"required": list(c.required), "values": c.values, **({"card": c.card} if c.card else {})}
        yield p, {"artifact_path": p["path"], "contract_fingerprint": "sha256:" + hashlib.sha256(canonical_json(core).encode()).hexdigest()}


@rule("provenance.required_metadata_missing", "medium", "confirmed", "Declared provenance lacks required values", "Record them.", *aliases.DATASETS)
def required_metadata_missing(index: Index) -> Found:
    for p, evidence in _declared(index):
        missing = [n for n in p["contract"].required if p["contract"].values.get(n) is None and not (n == "license" and p["card"] is not None and p["card"]["license_status"] != "missing")]
        if missing:
            yield f"The provenance of '{p['path']}' lacks {', '.join(missing)}.", [at("primary", p["path"])], {**evidence, "missing_fields": missing, "missing_count": len(missing), **(p["card"] or {})}


@rule("provenance.manifest_fingerprint_mismatch", "high", "confirmed", "A dataset is not the one that was declared", "Restore the dataset or update its declaration.", *aliases.DATASETS)
def manifest_fingerprint_mismatch(index: Index) -> Found:
    for p, evidence in _declared(index):
        declared, seen = p["contract"].values.get("fingerprint"), index.fingerprint(p["path"])
        if declared and seen and index.complete(p["path"]) and declared != seen:
            yield f"'{p['path']}' does not have its declared fingerprint.", [at("primary", p["path"])], {**evidence, "declared_fingerprint": declared, "observed_fingerprint": seen}


@rule("provenance.local_source_unresolved", "high", "confirmed", "A declared local source is not there", "Restore the source or correct the reference.", *aliases.DATASETS)
def local_source_unresolved(index: Index) -> Found:
    for p, evidence in _declared(index):
        if p["source_status"] in ("missing", "not_file"):
            yield f"The local source of '{p['path']}' is {p['source_status']}.", [at("primary", p["path"])], {**evidence, "source_ref_hash": "sha256:" + hashlib.sha256(p["contract"].values["source.ref"].encode()).hexdigest(), "source_status": p["source_status"]}


@rule("rag.chunk_id_collision", "high", "confirmed", "One chunk id stands for different contents", "Give each content an id of its own.", "rag_document")
def chunk_id_collision(index: Index) -> Found:
    for e in collected(identity.chunk_id_collisions(_ungated(index, index.rows))):
        yield f"One chunk id of '{e['artifact_path']}' has {e['distinct_content_count']} contents.", [at("related" if i else "primary", e["artifact_path"], row=s["row"], field=s["field"]) for i, s in enumerate(e["sample_records"])], e


def _has_evaluation(index: Index) -> bool:
    return bool(index.paths(*aliases.EVALUATION, but_configuration=True))


@rule("rag.duplicate_chunk_in_corpus", "medium", "confirmed", "A chunk occurs several times in the corpus", "Keep one of the chunks.", "rag_document")
def duplicate_chunk_in_corpus(index: Index) -> Found:
    if _has_evaluation(index):
        for e in collected(identity.duplicate_chunks(_ungated(index, index.rows))):
            yield f"One chunk occurs {e['duplicate_count']} times.", [at("primary", p["path"], row=p["row"]) for p in e["row_locations"]], e


@rule("rag.empty_or_corrupted_document", "medium", "confirmed", "A retrieval document is empty or unreadable", "Restore or remove it.", "rag_document")
def empty_or_corrupted_document(index: Index) -> Found:
    if not _has_evaluation(index):
        return
    paths = index.paths("rag_document")
    state = index.rows.where(F.col("path").isin(paths)).withColumn("state", content_state())
    empty = state.where("state = 'empty'")
    counted = empty.groupBy("path").agg(F.count("*").alias("n")).join(first_rows(empty, ["path"], ["row_num", "row_hash"], {"rows": "row_num", "hashes": "row_hash"}), "path")
    empties = {r["path"]: r for r in counted.collect()}  # a row per artifact
    fields = {r["path"]: r["f"] for r in state.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(content_fields())))).alias("f")).collect()}
    for path in paths:
        codes, facts, rows = index.codes(path), index.facts.get(path, {}), index.row_counts.get(path, 0)
        if codes & {"artifact.file_size_limit_exceeded", "artifact.row_limit_reached", "artifact.unsupported_parquet_schema"}:
            continue
        broken = sorted(codes & {"artifact.parse_failed", "artifact.row_parse_failed"})
        binary, held = index.artifacts[path].format == "parquet", empties.get(path)
        if facts.get("blank") and not binary or binary and not rows and facts.get("fingerprint") and not broken:
            state_name = "empty"
        elif broken and not rows:
            state_name = "corrupted"
        elif held is not None:
            state_name = "empty"
        else:
            continue
        samples = list(zip(held["rows"], held["hashes"], strict=True)) if held is not None else []
        n = held["n"] if held is not None else 0
        evidence = {"artifact_path": path, "state": state_name, "empty_record_count": n, "row_count": rows, "observed_text_length": facts.get("text_length", 0), "content_fields": fields.get(path, []), "row_locations": [{"path": path, "row": a} for a, _ in samples], "row_hashes": [b for _, b in samples], "diagnostic_codes": broken, "evidence_truncated": n > 20}
        yield f"'{path}' holds {state_name} content.", [at("primary", path, row=a) for a, _ in samples] or [at("primary", path)], evidence


@rule("rag.empty_referenced_document", "high", "confirmed", "An evaluation record refers to empty documents", "Restore the documents or correct the references.", "rag_document", *aliases.EVALUATION)
def empty_referenced_document(index: Index) -> Found:
    for e in collected(identity.empty_references(index.rows)):
        yield f"Row {e['evaluation_row']} of '{e['evaluation_artifact']}' refers to {e['empty_reference_count']} empty documents.", [at("primary", e["evaluation_artifact"], row=e["evaluation_row"])], e


@rule("rag.unreachable_context_id", "high", "confirmed", "An evaluation record refers to documents that are not there", "Add the documents or correct the references.", "rag_document", *aliases.EVALUATION)
def unreachable_context_id(index: Index) -> Found:
    paths = index.paths("rag_document")
    if not paths or not all(index.complete(p) for p in paths):
        return
    for e in collected(identity.unreachable_references(index.rows)):
        e |= {"rag_artifact_paths": paths, "searched_id_fields": list(aliases.RAG_ID)}
        yield f"{e['missing_reference_count']} references of row {e['evaluation_row']} of '{e['evaluation_artifact']}' lead nowhere.", [at("primary", e["evaluation_artifact"], row=e["evaluation_row"])], e


@rule("reproducibility.nondeterministic_generation_without_seed", "medium", "likely", "Generation samples without a seed", "Record the seed.", "evaluation_result")
def generation_without_seed(index: Index) -> Found:
    held = []
    for path, meta in index.metadata.items():
        parameters, where = meta.get("generation_parameters", (None, None))
        if "configuration" in index.artifacts[path].roles or not isinstance(parameters, dict) or type_name(parameters.get("temperature")) not in ("integer", "number"):
            continue
        seed = parameters.get("seed")
        state = "missing" if "seed" not in parameters else "null" if seed is None else "blank" if isinstance(seed, str) and not seed.strip() else "present"
        held.append((path, where, float(parameters["temperature"]), state))
    for e in collected(results.unseeded_generation(index.spark.createDataFrame(held, "result_artifact string, parameters_field string, temperature double, seed_state string"))):
        e["temperature_field"], e["seed_field"] = f"{e['parameters_field']}.temperature", f"{e['parameters_field']}.seed"
        yield f"'{e['result_artifact']}' samples at temperature {e['observed_temperature']} without a seed.", [at("primary", e["result_artifact"], field=e["temperature_field"])], e


def selected(config, wanted: list[str] | None) -> list[Rule]:
    """The rules to run, by id: the wanted ones, or all, less those that the configuration disables."""
    unknown = sorted(set(wanted or ()) - set(RULES))
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    chosen = [RULES[i] for i in sorted(wanted or RULES) if i not in config.disabled]
    if not chosen:
        raise ValueError("no rule is left to run")
    return chosen


# of the rules whose findings are rows of a relation: how many findings the relation's rows stand for, and the top-level fields it reads
COUNTED: dict[str, tuple[Callable[[Index], DataFrame], tuple[str, ...]]] = {
    "contamination.train_eval_overlap": (lambda index: overlap.overlap_counts(index.rows), ()),
    "contamination.duplicate_eval_sample": (lambda index: overlap.exact_duplicates(index.rows, aliases.EVALUATION).select(F.lit(1).cast("long").alias("findings")), ()),
    "contamination.duplicate_train_sample": (lambda index: overlap.exact_duplicates(index.rows, aliases.TRAINING).select(F.lit(1).cast("long").alias("findings")), ()),
    "dataset.partial_sample_id_coverage": (lambda index: identity.partial_sample_ids(_ungated(index, index.rows)).select(F.lit(1).cast("long").alias("findings")), aliases.SAMPLE_ID),
}


def counted_fields(rules: list[Rule]) -> frozenset[str]:
    """Top-level fields that counting these rules' findings looks at."""
    return frozenset(name for r in rules for name in COUNTED[r.id][1])


def counted(index: Index, rules: list[Rule]) -> DataFrame:
    """(rule_id, severity, findings) of the COUNTED rules that find something.

    The same numbers as those of execute, but on the executors: no finding comes to
    the driver, however many there are, and a rule that fails ends the count.
    """
    sums = [COUNTED[r.id][0](index).agg(F.sum("findings").cast("long").alias("findings")).select(F.lit(r.id).alias("rule_id"), F.lit(index.config.severity.get(r.id, r.severity)).alias("severity"), "findings") for r in rules]
    return reduce(DataFrame.unionByName, sums).where("findings > 0")


def execute(index: Index, rules: list[Rule]) -> list[dict]:
    """All findings; a rule that fails becomes a diagnostic and the others go on."""
    out = []
    for r in rules:
        severity = index.config.severity.get(r.id, r.severity)
        try:
            out += [finding(r, severity, *found) for found in r.run(index)]
        except Exception as e:  # noqa: BLE001  one rule must not end a scan
            index.diagnostics.append({"severity": "error", "code": "rule.recoverable_error", "message": f"Rule '{r.id}' failed: {type(e).__name__}."})
    return out
