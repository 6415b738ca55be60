"""Reports: deterministic JSON envelopes and short terminal summaries."""

from __future__ import annotations

from .. import __version__
from .rules import SEVERITY_RANKS

TOOL = {"name": "lakewarden", "version": __version__}


def finding_order(f: dict) -> tuple:
    first = next((x for x in f["locations"] if x["role"] in ("primary", "source")), f["locations"][0] if f["locations"] else {})
    return (-SEVERITY_RANKS[f["severity"]], f["rule_id"], first.get("path", ""), first.get("line") or first.get("row") or 0, f["fingerprint"])


def diagnostic_order(d: dict) -> tuple:
    return (d.get("path") or "", d.get("row") or 0, d["code"], d["message"])


def scan_report(index, findings: list[dict], rules, mode: str, started: str, ended: str) -> dict:
    by_severity = {s: sum(f["severity"] == s for f in findings) for s in reversed(SEVERITY_RANKS)}
    covered = [{**c, "role_matched_rule_ids": sorted(r.id for r in rules if set(r.roles) & set(c["roles"]))} for c in index.coverage.values()]
    return {
        "schema_version": "1.0", "tool": TOOL,
        "scan": {"root": ".", "started_at": started, "completed_at": ended, "config_path": index.config.path, "rules": {"mode": mode, "ids": sorted(r.id for r in rules)}, "artifacts": covered},
        "summary": {"artifacts_scanned": len(index.artifacts), "findings_total": len(findings), "findings_by_severity": by_severity},
        "findings": sorted(findings, key=finding_order), "diagnostics": sorted(index.diagnostics, key=diagnostic_order),
    }


def profile_report(index, measured: list[dict], started: str, ended: str) -> dict:
    return {
        "schema_version": "1.0", "report_type": "profile", "tool": TOOL,
        "profile": {"root": ".", "started_at": started, "completed_at": ended, "config_path": index.config.path, "artifacts": list(index.coverage.values())},
        "summary": {"artifacts_profiled": len(index.coverage), "measurements_total": len(measured)},
        "measurements": measured, "diagnostics": sorted(index.diagnostics, key=diagnostic_order),
    }


def fails(findings: list[dict], level: str) -> bool:
    return any(SEVERITY_RANKS[f["severity"]] >= SEVERITY_RANKS[level] for f in findings)


def scan_summary(report: dict, output: str) -> str:
    counts = report["summary"]["findings_by_severity"]
    states: dict[str, int] = {}
    for a in report["scan"]["artifacts"]:
        states[a["index_status"]] = states.get(a["index_status"], 0) + 1
    lines = [f"{report['summary']['artifacts_scanned']} artifacts: " + ", ".join(f"{n} {s}" for s, n in sorted(states.items())), f"{report['summary']['findings_total']} findings: " + ", ".join(f"{n} {s}" for s, n in counts.items())]
    lines += [f"  [{f['severity']}] {f['rule_id']}: {f['message']}" for f in report["findings"][:5]]
    lines += [f"  {d['code']}: {d['message']}" for d in report["diagnostics"][:5]]
    return "\n".join([*lines, f"Report: {output}"])


def profile_summary(report: dict, output: str) -> str:
    return f"{report['summary']['artifacts_profiled']} artifacts, {report['summary']['measurements_total']} measurements\nReport: {output}"
