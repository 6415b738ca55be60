"""Finding artifacts below a root, their formats and their roles."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field
from functools import cache
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ScanConfig

# fixed values: extensions, and the path parts and name parts that tell roles
FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".markdown": "markdown", ".txt": "plain_text", ".text": "plain_text"}
STRUCTURED = ("json", "jsonl", "csv", "yaml", "toml", "parquet")
ROLE_SIGNS = {
    "training_dataset": (STRUCTURED, ("train", "training", "finetune"), ("train", "training", "finetune")),
    "evaluation_dataset": (STRUCTURED, ("eval", "evals", "evaluation", "test", "tests", "val", "valid", "validation"), ("eval", "evaluation", "test", "golden", "expected", "val", "valid", "validation")),
    "benchmark_dataset": (STRUCTURED, ("benchmark", "benchmarks", "leaderboard"), ("benchmark", "bench", "leaderboard")),
    "evaluation_result": (STRUCTURED, ("result", "results", "report", "reports", "run", "runs"), ("result", "results", "scores", "metrics", "baseline", "run")),
    "prompt_template": (("markdown", "plain_text", "json", "yaml", "toml"), ("prompt", "prompts", "template", "templates"), ("prompt", "template", "system", "instruction")),
    "rag_document": (("markdown", "plain_text", *STRUCTURED), ("rag", "retrieval", "corpus", "knowledge", "kb", "docs", "documents"), ("corpus", "knowledge", "retrieval", "context", "source")),
}
CONFIG_NAMES = ("lakewarden.yaml", "lakewarden.yml", "config.yaml", "config.yml", "config.json", "settings.yaml", "settings.yml", "settings.json")


@dataclass
class Artifact:
    path: str
    format: str
    roles: tuple[str, ...]
    role_source: str = "heuristic"
    notes: list[dict] = field(default_factory=list)

    @property
    def id(self) -> str:
        return "sha256:" + hashlib.sha256(self.path.removeprefix("./").encode()).hexdigest()


GLOB_PIECES = re.compile(r"\*\*/|\*\*|\*|\?|.", re.S)


@cache
def glob_pattern(glob: str) -> re.Pattern:
    """A glob over paths from the root; one without a slash fits at any depth, one that ends in a slash all below."""
    glob = glob.replace("\\", "/").removeprefix("./")
    if glob.endswith("/"):
        glob += "**"
    meaning = {"**/": "(?:|.*/)", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(meaning.get(piece) or re.escape(piece) for piece in GLOB_PIECES.findall(glob))
    return re.compile(body if "/" in glob else f"(?:.*/)?{body}")


def fits_any(path: str, globs) -> bool:
    return any(glob_pattern(g).fullmatch(path) for g in globs)


def discover(root: str, config: ScanConfig) -> list[str]:
    """Paths below the root that are included and not excluded, in order."""
    found = []
    for folder, folders, names in os.walk(root):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if below == "." else below + "/"
        folders[:] = sorted(folders)
        found += [prefix + n for n in names if fits_any(prefix + n, config.include) and not fits_any(prefix + n, config.exclude)]
    return sorted(found)


def format_of(path: str) -> str | None:
    return FORMATS.get(PurePosixPath(path).suffix.lower())


def roles_of(path: str, kind: str) -> tuple[str, ...]:
    low = path.lower()
    *folders, name = low.split("/")
    if kind in ("json", "yaml", "toml") and name in CONFIG_NAMES:
        return ("configuration",)
    found = [role for role, (kinds, parts, words) in ROLE_SIGNS.items() if kind in kinds and (any(p in folders for p in parts) or any(w in name for w in words))]
    return tuple(sorted(found)) or ("unknown",)


def artifact_at(path: str, config: ScanConfig) -> Artifact | None:
    """The artifact of a path; configured roles replace those guessed, other extensions need them."""
    declared = config.declared(path)
    kind = format_of(path)
    if kind is None:
        if declared is None:
            return None
        note = {"severity": "warning", "code": "artifact.unsupported_extension", "message": f"The extension of '{path}' is not supported; read as plain text.", "path": path}
        return Artifact(path, "plain_text", tuple(sorted(declared.roles)), "config", [note])
    if declared is not None:
        return Artifact(path, kind, tuple(sorted(declared.roles)), "config")
    roles = roles_of(path, kind)
    notes = []
    if "training_dataset" in roles and ({"evaluation_dataset", "benchmark_dataset"} & set(roles)):
        notes.append({"severity": "warning", "code": "artifact.role_conflict", "message": f"'{path}' looks like training and evaluation data at once.", "path": path})
    return Artifact(path, kind, roles, notes=notes)


def classified(paths: DataFrame, config: ScanConfig) -> DataFrame:
    """paths(path) -> (path, format, roles, included): for listings that are too long for the driver."""

    @F.pandas_udf("format string, roles string, included boolean")
    def classify(found: pd.Series) -> pd.DataFrame:
        kinds = [format_of(p) for p in found]
        roles = [",".join(roles_of(p, k)) if k else None for p, k in zip(found, kinds, strict=True)]
        included = [fits_any(p, config.include) and not fits_any(p, config.exclude) for p in found]
        return pd.DataFrame({"format": pd.Series(kinds, dtype=object), "roles": pd.Series(roles, dtype=object), "included": included})

    return paths.select("path", classify("path").alias("x")).select("path", "x.*")
