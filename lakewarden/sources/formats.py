"""Reading artifacts on the executors: one task reads one file and gives events.

An event is a row, a diagnostic, a document's text, or its facts.  Files are read
whole, which the size limit bounds, or JSON lines in pieces of any number, each in a
task of its own; everything after this is relational.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.canon import ROW_FIELDS, canonical_json, focus_text, record_view, string_leaves

EVENTS = f"event string, path string, row_num long, payload string, sim_text string, leaves array<string>, {ROW_FIELDS}"
ARROW = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()), "map<string,array<string>>": pa.map_(pa.string(), pa.list_(pa.string()))}
SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (part.split(" ") for part in EVENTS.split(", "))])
PIECE_EVENTS = f"{EVENTS}, part long"
PIECE_SCHEMA = SCHEMA.append(pa.field("part", pa.int64()))
DATASETS = set(aliases.DATASETS)
TEXT_ROLES = {"rag_document", "prompt_template", *aliases.EVALUATION, "evaluation_result"}
BATCH_EVENTS = 5000


@dataclass(frozen=True)
class ReadLimits:
    max_rows: int | None  # None: all rows
    focus_roles: tuple[str, ...]
    focus_fields: tuple[str, ...]
    fields: frozenset[str] | None = None  # the top-level fields that are asked for, in a profile; all of them in a scan
    shown: frozenset[str] | None = None  # those of them whose values are asked for as JSON; None: all
    canon: bool = False  # records in canonical form also where fields are given


class _Reader:
    """Collects the events of one file."""

    def __init__(self, path: str, kind: str, roles: set[str], limits: ReadLimits, part: int | None = None):
        self.path, self.kind, self.roles, self.limits, self.part = path, kind, roles, limits, part
        self.events: list[dict] = []
        self.accepted, self.digest = 0, hashlib.sha256()
        self.facts: dict[str, Any] = {"path": path, "fingerprint": None, "has_rows": False, "blank": True, "text_length": 0, "line_ends": None, "n_chars": None, "encoding": None, "root": None}

    def diagnostic(self, code: str, message: str, row: int | None = None) -> None:
        told = {"severity": "warning", "code": code, "message": message, "path": self.path, "row": row}
        self.events.append({"event": "diagnostic", "path": self.path, "row_num": row, "payload": canonical_json(told if self.part is None else told | {"part": self.part})})

    def row(self, number: int, record: Any) -> bool:
        """Whether the row was within the limit."""
        self.facts["has_rows"] = True
        if self.limits.max_rows is not None and self.accepted >= self.limits.max_rows:
            self.diagnostic("artifact.row_limit_reached", f"Only the first {self.limits.max_rows} rows of '{self.path}' were read.")
            return False
        view = record_view(record, self.limits.fields, self.limits.shown)
        if self.part is None:
            self.digest.update(b"\n" * (self.accepted > 0) + view["canon"].encode())
        self.accepted += 1
        event = {"event": "row", "path": self.path, "row_num": number, "part": self.part, **view}
        if self.limits.fields is None:
            event |= {"sim_text": focus_text(record, self.limits.focus_roles, self.limits.focus_fields), "leaves": list(string_leaves(record))}
        elif not self.limits.canon:
            event["canon"] = None
        self.events.append(event)
        return True

    def of_rows(self) -> None:
        """The fingerprint of what was accepted, one canonical row a line."""
        if self.accepted and self.part is None:
            self.facts["fingerprint"] = "sha256:" + self.digest.hexdigest()

    def of_document(self, document: Any) -> None:
        self.facts["fingerprint"] = "sha256:" + hashlib.sha256(canonical_json(document).encode()).hexdigest()
        self.facts["root"] = document if isinstance(document, dict) and "evaluation_result" in self.roles else None
        rows = document if isinstance(document, list) else next((document[k] for k in aliases.ROW_COLLECTION if isinstance(document, dict) and isinstance(document.get(k), list)), None)
        if rows is not None:
            self.facts["has_rows"] = True
            for number, record in enumerate(rows, 1):
                if not self.row(number, record):
                    break

    def finish(self) -> list[dict]:
        self.events.append({"event": "document", "path": self.path, "payload": canonical_json(self.facts)})
        return self.events


def audit(data: bytes) -> dict | None:
    """Why bytes are no clean UTF-8 text, or None."""
    bad = None
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        bad = [e.start, e.end]
    nul = data.count(b"\x00")
    if bad is None and not nul:
        return None
    offsets = [m.start() for _, m in zip(range(aliases.EVIDENCE_LIMIT), re.finditer(b"\x00", data), strict=False)]
    return {"byte_hash": "sha256:" + hashlib.sha256(data).hexdigest(), "byte_count": len(data), "invalid_utf8_range": bad, "nul_byte_count": nul, "sample_nul_offsets": offsets, "nul_offsets_truncated": nul > len(offsets)}


def _jsonl(r: _Reader, text: str) -> None:
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
        except ValueError:
            r.diagnostic("artifact.row_parse_failed", f"Row {number} of '{r.path}' is no JSON.", number)
            continue
        if not r.row(number, record):
            break
    r.of_rows()


def _csv(r: _Reader, text: str) -> None:
    header = None
    for number, record in enumerate(csv.reader(io.StringIO(text)), 1):
        if header is None:
            if record:
                header = [h.strip() for h in record]
            continue
        if len(record) != len(header):
            r.diagnostic("artifact.row_parse_failed", f"Row {number} of '{r.path}' has {len(record)} fields, not {len(header)}.", number)
            continue
        if not r.row(number, dict(zip(header, (v.strip() for v in record), strict=True))):
            break
    if header is not None:
        r.facts["has_rows"] = True
        r.of_rows()


def _parquet(r: _Reader, data: bytes) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    def fits(t: pa.DataType) -> bool:
        if pa.types.is_dictionary(t):
            return fits(t.value_type)
        if pa.types.is_struct(t):
            return len({f.name for f in t}) == t.num_fields and all(fits(f.type) for f in t)
        if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
            return fits(t.value_type)
        return pa.types.is_null(t) or pa.types.is_boolean(t) or pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_string(t) or pa.types.is_large_string(t)

    try:
        file = pq.ParquetFile(io.BytesIO(data))
        schema = file.schema_arrow
    except (pa.ArrowException, OSError):
        r.diagnostic("artifact.parse_failed", f"'{r.path}' is no readable Parquet file.")
        return
    if len(set(schema.names)) < len(schema.names) or not all(fits(f.type) for f in schema):
        r.diagnostic("artifact.unsupported_parquet_schema", f"'{r.path}' has column types that records cannot hold.")
        return
    r.facts["has_rows"], number = True, 0
    try:
        for batch in file.iter_batches(65536):
            for record in batch.to_pylist():
                number += 1
                if not r.row(number, record):
                    r.of_rows()
                    return
    except (pa.ArrowException, OSError):
        r.diagnostic("artifact.parse_failed", f"'{r.path}' breaks off after {number} rows.")
        return
    r.of_rows()
    if not r.accepted:
        r.facts["fingerprint"] = "sha256:" + hashlib.sha256(b"").hexdigest()


def read_file(path: str, kind: str, roles: set[str], data: bytes | None, limits: ReadLimits, part: int | None = None) -> list[dict]:
    """The events of a file, or of its piece number part, with rows counted from the piece's first line."""
    r = _Reader(path, kind, roles, limits, part)
    if part is not None:
        r.facts |= {"part": part, "bytes": len(data or b""), "line_ends": 0, "n_chars": 0}
    if data is None:
        r.diagnostic("artifact.parse_failed", f"'{path}' has no content.")
        return r.finish()
    if kind == "parquet":
        _parquet(r, data)
        return r.finish()
    text = data.decode("utf-8" if part else "utf-8-sig", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    r.facts |= {"blank": not text.strip(), "text_length": len(text.strip()), "line_ends": text.count("\n"), "n_chars": len(text)}
    if text and limits.fields is None and roles & TEXT_ROLES:
        r.events.append({"event": "text", "path": path, "payload": text})
    if roles & DATASETS and (trouble := audit(data)) is not None:
        r.facts["encoding"] = trouble
        r.diagnostic("artifact.invalid_text_encoding", f"'{path}' is no clean UTF-8 text.")
        return r.finish()
    try:
        if kind == "jsonl":
            _jsonl(r, text)
        elif kind == "csv":
            _csv(r, text)
        elif kind == "json":
            r.of_document(json.loads(text))
        elif kind == "yaml":
            document = yaml.safe_load(text)
            if document is not None:
                r.of_document(document)
        elif kind == "toml":
            r.of_document(tomllib.loads(text))
        else:
            r.facts["fingerprint"] = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    except (ValueError, TypeError, csv.Error, yaml.YAMLError, RecursionError):
        # dates and other values without a JSON form end here too
        r.diagnostic("artifact.parse_failed", f"'{path}' cannot be parsed as {kind}.")
    return r.finish()


def _batch(events: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    def column(field: pa.Field) -> pa.Array:
        values = [e.get(field.name) for e in events]
        if pa.types.is_map(field.type):
            values = [list(v.items()) if v is not None else None for v in values]
        return pa.array(values, field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def read_artifacts(files: DataFrame, limits: ReadLimits) -> DataFrame:
    """files(path, kind, roles, content) -> events (EVENTS); files(path, kind, roles, content, part) -> PIECE_EVENTS."""
    pieces = "part" in files.columns
    schema = PIECE_SCHEMA if pieces else SCHEMA

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(4).to_pylist() if pieces else [None] * batch.num_rows
            for path, kind, roles, content, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), parts, strict=True):
                events = read_file(path, kind, set(roles), content.as_py(), limits, part)
                for at in range(0, len(events), BATCH_EVENTS):
                    yield _batch(events[at : at + BATCH_EVENTS], schema)

    return files.mapInArrow(read, PIECE_EVENTS if pieces else EVENTS)


def ordered_hashes(lines: DataFrame, between: bytes = b"") -> DataFrame:
    """lines(path, part, place, text) -> (path, hash): SHA-256 of each path's texts in order, streamed by one task a path."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        out = lambda path, d: pa.RecordBatch.from_pylist([{"path": path, "hash": "sha256:" + d.hexdigest()}], pa.schema([("path", pa.string()), ("hash", pa.string())]))
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if path != now or digest is None:
                    if digest is not None:
                        yield out(now, digest)
                    now, digest = path, hashlib.sha256()
                else:
                    digest.update(between)
                digest.update(text.as_py())
        if digest is not None:
            yield out(now, digest)

    held = lines.select("path", "part", "place", F.col("text").cast("binary").alias("text"))
    return held.repartition("path").sortWithinPartitions("path", "part", "place").select("path", "text").mapInArrow(take, "path string, hash string")
