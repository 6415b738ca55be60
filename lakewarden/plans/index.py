"""The index of a scan: artifacts and their facts on the driver, rows and lines as relations."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.canon import type_name
from ..operators import overlap
from ..sources.card import read_card
from ..sources.config import ConfigError, ScanConfig, resolve_ref
from ..sources.discovery import Artifact, artifact_at, discover, fits_any
from ..sources.formats import EVENTS, PIECE_EVENTS, ReadLimits, ordered_hashes, read_artifacts

INCOMPLETE = ("artifact.parse_failed", "artifact.row_parse_failed", "artifact.row_limit_reached", "artifact.file_size_limit_exceeded")


def _joined_facts(of_pieces: dict[str, list[dict]]) -> tuple[dict[str, dict], dict[tuple[str, int], int]]:
    """The facts of files from those of their pieces, and the lines before each (path, part)."""
    facts, firsts = {}, {}
    for path, pieces in of_pieces.items():
        lines, size, trouble = 0, 0, None
        pieces.sort(key=lambda f: f["part"])
        for f in pieces:
            if (path, f["part"]) in firsts:
                raise ConfigError(f"'{path}' has two pieces of number {f['part']}.")
            firsts[path, f["part"]] = lines
            if (t := f["encoding"]) is not None:
                trouble = trouble or {"byte_hash": None, "invalid_utf8_range": None, "nul_byte_count": 0, "sample_nul_offsets": [], "nul_offsets_truncated": False}
                if trouble["invalid_utf8_range"] is None and t["invalid_utf8_range"] is not None:
                    trouble["invalid_utf8_range"] = [size + at for at in t["invalid_utf8_range"]]
                trouble["nul_byte_count"] += t["nul_byte_count"]
                trouble["sample_nul_offsets"] = (trouble["sample_nul_offsets"] + [size + at for at in t["sample_nul_offsets"]])[: aliases.EVIDENCE_LIMIT]
                trouble["nul_offsets_truncated"] = trouble["nul_byte_count"] > len(trouble["sample_nul_offsets"])
            lines, size = lines + f["line_ends"], size + f["bytes"]
        if trouble is not None:
            trouble["byte_count"] = size
        facts[path] = {"path": path, "fingerprint": None, "has_rows": trouble is None and any(f["has_rows"] for f in pieces), "blank": all(f["blank"] for f in pieces), "text_length": sum(f["text_length"] for f in pieces), "line_ends": lines, "n_chars": sum(f["n_chars"] for f in pieces), "encoding": trouble, "root": None}
    return facts, firsts


def _joined_diagnostics(told: list[dict], firsts: dict[tuple[str, int], int]) -> list[dict]:
    """Diagnostics with rows counted from the file's first line; those of a whole file once."""
    out: dict[tuple, dict] = {}
    for d in told:
        part, row = d.pop("part"), d.get("row")
        if row is not None:
            d |= {"row": row + firsts[d["path"], part], "message": d["message"].replace(f"Row {row} ", f"Row {row + firsts[d['path'], part]} ", 1)}
        out[d["path"], d["code"], d.get("row")] = {k: v for k, v in d.items() if v is not None}
    return list(out.values())


@dataclass
class Index:
    spark: SparkSession
    root: str | None
    config: ScanConfig
    artifacts: dict[str, Artifact]
    rows: DataFrame  # the row relation with roles and sim_text
    texts: DataFrame  # (path, roles, text) of text artifacts, one kind of line end; never on the driver
    listed: frozenset[str]  # all paths that were found
    facts: dict[str, dict] = field(default_factory=dict)
    diagnostics: list[dict] = field(default_factory=list)
    accepted: DataFrame | None = None  # (path, part, place, text) of accepted rows in canonical form, of files in pieces
    hashed: bool = True  # whether files in pieces get fingerprints, which takes a pass of its own

    @classmethod
    def build(cls, spark: SparkSession, root: str, config: ScanConfig, keep=lambda artifact: True, fields: frozenset[str] | None = None) -> Index:
        """The index of the folder root."""
        found = [(path, os.path.getsize(os.path.join(root, path)), "file:" + os.path.abspath(os.path.join(root, path))) for path in discover(root, config)]

        def contents(small: list[tuple[str, str]]) -> DataFrame:
            listed = spark.createDataFrame(small, "path string, uri string")
            files = spark.read.format("binaryFile").load([u.removeprefix("file:") for _, u in small]).select(F.col("path").alias("found"), "content")
            # a row per discovered file: as many as the command's user has below the root
            return files.join(F.broadcast(listed), F.regexp_replace(F.url_decode("found"), "^file:/+", "/") == F.regexp_replace("uri", "^file:", "")).select("path", "content")

        return cls._of(spark, root, config, found, contents, keep, fields)

    @classmethod
    def of_files(cls, spark: SparkSession, files: DataFrame, config: ScanConfig, keep=lambda artifact: True, fields: frozenset[str] | None = None, hashed: bool = True, paths: list[str] | None = None, shown: frozenset[str] | None = None) -> Index:
        """The index of files(path, content) or files(path, length, content): the same scan where files are rows.

        Paths and sizes are listed on the driver, contents are not.  Cards are not read.
        Files of JSON lines beyond what one task can hold come as files(path, part, content),
        in pieces by number that end at line ends.  They are read whole, whatever their size,
        so the limits must be None, and by what asks for fields only, as texts are not joined;
        paths are theirs, where the caller knows them without making the pieces, and shown the
        fields whose values as JSON are asked for.
        """
        if "part" in files.columns:
            if config.max_rows is not None or config.max_file_mb is not None or fields is None:
                raise ConfigError("Files in pieces are read without limits, and for named fields.")
            listed = [r["path"] for r in files.select("path").distinct().collect()] if paths is None else paths
            found = sorted((p, 0, p) for p in listed if fits_any(p, config.include) and not fits_any(p, config.exclude))
            if strange := [p for p, *_ in found if (a := artifact_at(p, config)) is not None and a.format != "jsonl"]:
                raise ConfigError(f"'{strange[0]}' is no file of JSON lines, so it cannot come in pieces.")
            return cls._of(spark, None, config, found, lambda small: files.join(F.broadcast(spark.createDataFrame(small, "path string, uri string")), "path").select("path", "part", "content"), keep, fields, hashed, True, shown)
        size = F.col("length") if "length" in files.columns else F.length("content")
        found = sorted((r["path"], r["n"], r["path"]) for r in files.select("path", size.alias("n")).collect() if fits_any(r["path"], config.include) and not fits_any(r["path"], config.exclude))
        return cls._of(spark, None, config, found, lambda small: files.join(F.broadcast(spark.createDataFrame(small, "path string, uri string")), "path").select("path", "content"), keep, fields)

    @staticmethod
    def stored_files(spark: SparkSession, uri: str) -> DataFrame:
        """(path, length, content) of a folder in any store that Spark reads; files whose names begin with a dot or an underscore are not seen."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
        # Spark shows paths in full and may leave out an empty authority (file:/x for file:///x)
        inner = F.regexp_replace(F.url_decode("path"), "^[a-z0-9]+:/*", "")
        root = re.sub("^[a-z0-9]+:/*", "", uri.rstrip("/")) + "/"
        return files.select(F.substring(inner, len(root) + 1, 1 << 30).alias("path"), "length", "content")

    @classmethod
    def _of(cls, spark: SparkSession, root: str | None, config: ScanConfig, found: list[tuple[str, int, str]], contents: Callable[[list[tuple[str, str]]], DataFrame], keep, fields, hashed: bool = True, pieces: bool = False, shown: frozenset[str] | None = None) -> Index:
        artifacts = {p: a for p, *_ in found if (a := artifact_at(p, config)) is not None and keep(a)}
        diagnostics = [n for a in artifacts.values() for n in a.notes]
        small = []
        for path, size, uri in found:
            if path in artifacts and config.max_file_mb is not None and size > config.max_file_mb << 20:
                diagnostics.append({"severity": "warning", "code": "artifact.file_size_limit_exceeded", "message": f"'{path}' is larger than {config.max_file_mb} MB.", "path": path})
            elif path in artifacts:
                small.append((path, uri))
        s = config.similarity
        limits = ReadLimits(config.max_rows, s.focus_roles, s.focus_fields, fields, shown)
        roles = spark.createDataFrame([(p, a.format, list(a.roles)) for p, a in artifacts.items()], "path string, kind string, roles array<string>")
        accepted = None
        if small:
            met = contents(small).join(F.broadcast(roles), "path").select("path", "kind", "roles", "content", *["part"] * pieces)
            events = read_artifacts(met, limits)
            if pieces:
                accepted = read_artifacts(met, replace(limits, fields=frozenset(), canon=True)).where("event = 'row'").select("path", "part", F.col("row_num").alias("place"), F.col("canon").alias("text"))
        else:
            events = spark.createDataFrame([], PIECE_EVENTS if pieces else EVENTS)
        # those of files without limit are on disk only: as much text as the files have would fill the memory
        events = events.persist(StorageLevel.DISK_ONLY if pieces else StorageLevel.MEMORY_AND_DISK)
        facts, of_pieces, told = {}, {}, []
        for r in events.where("event NOT IN ('row', 'text')").select("event", "payload").collect():  # a document's facts and its rejected rows
            value = json.loads(r["payload"])
            if r["event"] == "document" and pieces:
                of_pieces.setdefault(value["path"], []).append(value)
            elif r["event"] == "document":
                facts[value["path"]] = value
            elif pieces:
                told.append(value)
            else:
                diagnostics.append({k: v for k, v in value.items() if v is not None})
        with_roles = lambda rows: rows.join(F.broadcast(roles.drop("kind")), "path")
        rows = with_roles(events.where("event = 'row'").drop("event", "payload"))
        if pieces:
            facts, firsts = _joined_facts(of_pieces)
            unclean = [p for p, f in facts.items() if f["encoding"] is not None]
            diagnostics += _joined_diagnostics([d for d in told if d["path"] not in unclean or d["row"] is None], firsts)
            if unclean:  # such a file gives no rows, whichever piece is at fault
                rows, accepted = rows.where(~F.col("path").isin(unclean)), accepted.where(~F.col("path").isin(unclean))
                whole = contents([(p, p) for p in unclean]).select("path", "part", F.lit(0).alias("place"), F.col("content").alias("text"))
                for r in ordered_hashes(whole).collect():  # a row per file
                    facts[r["path"]]["encoding"]["byte_hash"] = r["hash"]
            # a row per piece: bytes of the files over the size of a piece
            first = spark.createDataFrame([(*k, n) for k, n in firsts.items()], "path string, part long, first long")
            rows = rows.join(F.broadcast(first), ["path", "part"]).withColumn("row_num", F.col("row_num") + F.col("first")).drop("part", "first")
        texts = with_roles(events.where("event = 'text'").select("path", F.col("payload").alias("text")))
        return cls(spark, root, config, artifacts, rows, texts, frozenset(p for p, *_ in found), facts, diagnostics, accepted, hashed)

    def paths(self, *roles: str, but_configuration: bool = False) -> list[str]:
        return sorted(p for p, a in self.artifacts.items() if set(roles) & set(a.roles) and not (but_configuration and "configuration" in a.roles))

    def codes(self, path: str) -> set[str]:
        return {d["code"] for d in self.diagnostics if d.get("path") == path}

    def fingerprint(self, path: str) -> str | None:
        if self.accepted is not None and self.hashed:
            return self.accepted_hashes.get(path)
        return self.facts.get(path, {}).get("fingerprint")

    @cached_property
    def accepted_hashes(self) -> dict[str, str]:
        """Fingerprints of files in pieces, from another reading of them."""
        return {r["path"]: r["hash"] for r in ordered_hashes(self.accepted, b"\n").collect()}  # a row per file

    @cached_property
    def row_counts(self) -> dict[str, int]:
        return {r["path"]: r["count"] for r in self.rows.groupBy("path").count().collect()}

    @cached_property
    def coverage(self) -> dict[str, dict]:
        out = {}
        for path in sorted(self.artifacts):
            a, codes = self.artifacts[path], self.codes(path)
            rejected = sum(d["code"] == "artifact.row_parse_failed" and d.get("path") == path for d in self.diagnostics)
            cut = "artifact.row_limit_reached" in codes
            reasons = [name for code, name in (("artifact.file_size_limit_exceeded", "file_size_limit"), ("artifact.parse_failed", "parse_failed"), ("artifact.invalid_text_encoding", "invalid_text_encoding"), ("artifact.unsupported_parquet_schema", "unsupported_parquet_schema")) if code in codes]
            has_content = self.fingerprint(path) is not None if self.hashed or self.accepted is None else path in self.row_counts
            if not has_content or "artifact.file_size_limit_exceeded" in codes:
                status, reasons = "skipped", reasons or ["no_indexable_content"]
            elif rejected or cut:
                status, reasons = "partial", ["row_parse_failures"] * bool(rejected) + ["row_limit"] * cut
            else:
                status, reasons = "indexed", ["complete"]
            has_rows = self.facts.get(path, {}).get("has_rows")
            out[path] = {"path": path, "format": a.format, "roles": sorted(a.roles), "role_source": a.role_source, "index_status": status, "index_reasons": reasons, "rows_indexed": self.row_counts.get(path, 0) if has_rows else None, "rows_rejected": rejected, "truncated": cut, "fingerprint": self.fingerprint(path), "diagnostic_codes": sorted(codes)}
        return out

    def complete(self, path: str) -> bool:
        return self.coverage[path]["index_status"] == "indexed"

    @cached_property
    def pairs(self) -> DataFrame:
        """Similar pairs over the rows of all roles, found once."""
        s = self.config.similarity
        items = overlap.similarity_items(self.rows, "sim_text", s.shingle_size, s.num_hashes)
        return overlap.candidate_pairs(items, s.threshold, s.num_hashes, s.bands, s.shingle_size).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of text artifacts, and of the strings in Parquet rows (numbered by row)."""
        physical = self.texts.select("path", "roles", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).cast("long").alias("line_num"), "roles", "line")
        binary = [p for p, a in self.artifacts.items() if a.format == "parquet"]
        leaves = self.rows.where(F.col("path").isin(binary)).select("path", F.col("row_num").alias("line_num"), "roles", F.explode("leaves").alias("leaf"))
        return physical.unionByName(leaves.select("path", "line_num", "roles", F.explode(F.split("leaf", "\r\n|[\r\n\x0b\x0c\x1c-\x1e\u0085  ]")).alias("line")))

    @cached_property
    def metadata(self) -> dict[str, dict[str, tuple]]:
        """Of each result artifact: canonical metadata name -> (value, dotted field); the root first, then its sections."""
        out = {}
        for path in self.paths("evaluation_result"):
            root = self.facts.get(path, {}).get("root") or {}
            found: dict[str, tuple] = {}
            for prefix, source in [("", root), *((s + ".", root.get(s)) for s in aliases.METADATA_SECTIONS)]:
                if isinstance(source, dict):
                    for name, options in aliases.METADATA.items():
                        hit = next((o for o in options if source.get(o) is not None), None)
                        if hit is not None and name not in found:
                            found[name] = (source[hit], prefix + hit)
            out[path] = found
        return out

    @cached_property
    def metrics(self) -> list[tuple]:
        """(result_artifact, metric_name, field_path, value, unit, low, high) of result documents and rows."""
        out = []

        def one(path: str, name, spec, where: str) -> None:
            if not isinstance(name, str) or name.strip().lower() not in aliases.METRICS:
                return
            first = lambda *keys: next((spec[k] for k in keys if k in spec), None)
            value, unit, bounds = (first("value", "metric_value"), first("unit", "metric_unit"), first("bounds", "metric_bounds")) if isinstance(spec, dict) else (spec, None, None)
            if type_name(value) not in ("integer", "number"):
                return
            ok = isinstance(bounds, list) and len(bounds) == 2 and all(type_name(b) in ("integer", "number") for b in bounds)
            out.append((path, name.strip().lower(), where, float(value), unit.strip().lower() if isinstance(unit, str) else None, float(bounds[0]) if ok else None, float(bounds[1]) if ok else None))

        def walk(path: str, source, prefix: str) -> None:
            if not isinstance(source, dict):
                return
            held = source.get("metrics")
            if isinstance(held, dict):
                for name in sorted(held):
                    one(path, name, held[name], f"{prefix}.metrics.{name}".lstrip("."))
            elif isinstance(held, list):
                for i, spec in enumerate(held):
                    if isinstance(spec, dict):
                        one(path, spec.get("metric_name", spec.get("metric", spec.get("name"))), spec, f"{prefix}.metrics[{i}]".lstrip("."))
            name = source.get("metric_name", source.get("metric"))
            if name is not None:
                one(path, name, source, prefix or "root")

        for path in self.paths("evaluation_result"):
            walk(path, self.facts.get(path, {}).get("root"), "")
        held = self.rows.where(F.col("path").isin(self.paths("evaluation_result")) & (F.col("types")["metrics"].isNotNull() | F.col("types")["metric"].isNotNull() | F.col("types")["metric_name"].isNotNull()))
        for r in held.select("path", "row_num", "canon").toLocalIterator():
            walk(r["path"], json.loads(r["canon"]), f"row[{r['row_num']}]")
        return out

    def provenance(self) -> list[dict]:
        """Facts of each provenance contract: status of its local source and of its card."""
        out = []
        for d in self.config.artifacts:
            if d.provenance is None or d.path not in self.artifacts:
                continue
            status, ref = None, d.provenance.values.get("source.ref")
            if d.provenance.values.get("source.type") == "local" and ref:
                status = self._source_status(ref)
            card = read_card(self.root, d.provenance.card, (self.config.max_file_mb or sys.maxsize) << 20) if d.provenance.card and self.root is not None else None
            out.append({"path": d.path, "contract": d.provenance, "source_status": status, "card": card})
        return out

    def _source_status(self, ref: str) -> str:
        if self.root is None:
            return "present" if ref in self.listed else "not_file" if any(p.startswith(ref + "/") for p in self.listed) else "missing"
        try:
            target = resolve_ref(self.root, ref)
            return "present" if target.is_file() else "not_file" if target.exists() else "missing"
        except OSError:
            return "unreadable"
