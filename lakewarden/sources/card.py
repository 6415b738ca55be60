"""The licence field in the front matter of a dataset card, read within bounds."""

from __future__ import annotations

import hashlib

import yaml

from .config import ConfigError, resolve_ref

MOST_BYTES = 1 << 20
MOST_TOKENS = 4096
MOST_DEPTH = 16


def license_state(header: str) -> str:
    """present, missing, or unavailable where the header is no plain mapping within the bounds."""
    depth = 0
    try:
        for count, event in enumerate(yaml.parse(header, Loader=yaml.SafeLoader)):
            if count > MOST_TOKENS or isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None) or (getattr(event, "tag", None) or "").startswith("!"):
                return "unavailable"
            if isinstance(event, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
                depth += 1
            elif isinstance(event, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                depth -= 1
            if depth > MOST_DEPTH:
                return "unavailable"
        node = yaml.compose(header, Loader=yaml.SafeLoader)
        names = [k.value for k, _ in node.value] if isinstance(node, yaml.MappingNode) else None
        if names is None or len(set(names)) < len(names):
            return "unavailable"
        held = yaml.safe_load(header).get("license")
    except (yaml.YAMLError, ValueError, AttributeError):
        return "unavailable"
    if held is None or held == [] or isinstance(held, str) and not held.strip():
        return "missing"
    if isinstance(held, str) or isinstance(held, list) and all(isinstance(v, str) and v.strip() for v in held):
        return "present"
    return "unavailable"


def read_card(root: str, ref: str, max_bytes: int) -> dict:
    facts = {"card_ref_hash": "sha256:" + hashlib.sha256(ref.encode()).hexdigest(), "license_status": "unavailable", "card_header_fingerprint": None}
    limit = min(max_bytes, MOST_BYTES)
    try:
        path = resolve_ref(root, ref)
        if not path.is_file():
            return facts
        with path.open("rb") as stream:
            data = stream.read(limit + 1)
        lines = data.decode("utf-8-sig").splitlines()
    except (OSError, UnicodeDecodeError, ConfigError):
        return facts
    if not lines or lines[0].rstrip() != "---":
        return facts | {"license_status": "missing"}
    end = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() in ("---", "...")), None)
    if end is None:
        return facts
    header = "\n".join(lines[1:end])
    return facts | {"license_status": license_state(header), "card_header_fingerprint": "sha256:" + hashlib.sha256(header.encode()).hexdigest()}
