"""Commands: scan, profile, rules.  A path is a local folder, or a URI of a folder in any
store that Spark reads; its report then goes to --output or the working folder.

Exit codes: 0 done, 1 findings at the failing level, 2 usage, 3 configuration,
4 input, 5 output, 6 internal error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import textwrap
from datetime import UTC, datetime

import yaml
from pyspark.sql import functions as F

from .functions import aliases
from .plans import measure, report
from .plans.index import Index
from .plans.rules import RULES, SEVERITY_RANKS, execute, selected
from .sources.config import SEVERITIES, ConfigError, ScanConfig, load_config, parse_config


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lakewarden").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def rules_listing(width: int = 96) -> str:
    out = []
    for r in sorted(RULES.values(), key=lambda r: r.id):
        ci = SEVERITY_RANKS[r.severity] >= SEVERITY_RANKS["high"]
        out.append(f"{r.id}  [{r.severity}, {r.confidence}{', fails by default' if ci else ''}]")
        out.append(textwrap.fill(f"{r.title}. {r.advice}", width, initial_indent="    ", subsequent_indent="    "))
    return "\n".join(out)


def rule_list(raw: str | None) -> list[str] | None:
    if raw is None:
        return None
    names = [n.strip() for n in raw.split(",")]
    if not all(names):
        raise ValueError("a rule name is blank")
    return sorted(set(names))


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _write(path: str, body: dict) -> bool:
    try:
        with open(path, "w", encoding="utf-8") as stream:
            json.dump(body, stream, indent=2, ensure_ascii=False, allow_nan=False)
            stream.write("\n")
        return True
    except OSError as e:
        print(f"The report cannot be written: {e}", file=sys.stderr)
        return False


def _stored_config(stored) -> ScanConfig:
    """lakewarden.yaml or lakewarden.yml at the top of a store's folder, else the defaults."""
    held = {r["path"]: bytes(r["content"]) for r in stored.where(F.col("path").isin("lakewarden.yaml", "lakewarden.yml")).select("path", "content").collect()}
    if not held:
        return ScanConfig()
    path = min(held)
    try:
        return parse_config(yaml.safe_load(held[path].decode("utf-8")), path)
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise ConfigError(f"The configuration cannot be read: {e.__class__.__name__}.") from e


def _index(spark, root: str, stored, config: ScanConfig, **options) -> Index:
    return Index.build(spark, root, config, **options) if stored is None else Index.of_files(spark, stored, config, **options)


def run(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="lakewarden")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "profile"):
        c = commands.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--config")
        c.add_argument("--output")
        c.add_argument("--format", choices=("terminal", "json"), default="terminal")
        if name == "scan":
            c.add_argument("--rules")
            c.add_argument("--fail-on", choices=SEVERITIES)
    commands.add_parser("rules")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    if args.command == "rules":
        print(rules_listing())
        return 0
    stored = None
    if "://" in args.path:
        try:
            spark = spark or session()
            stored = Index.stored_files(spark, args.path)
        except Exception as e:  # noqa: BLE001  whatever the store says
            print(f"'{args.path}' cannot be read: {type(e).__name__}.", file=sys.stderr)
            return 4
    elif not os.path.isdir(args.path):
        print(f"'{args.path}' is no folder.", file=sys.stderr)
        return 4
    try:
        config = load_config(args.path, args.config) if stored is None or args.config else _stored_config(stored)
    except ConfigError as e:
        print(str(e), file=sys.stderr)
        return 3
    output = args.output or os.path.join(args.path if stored is None else ".", f"lakewarden_{'report' if args.command == 'scan' else 'profile'}.json")
    started = _now()
    try:
        if args.command == "scan":
            try:
                wanted = rule_list(args.rules)
                rules = selected(config, wanted)
            except ValueError as e:
                print(str(e), file=sys.stderr)
                return 2
            index = _index(spark or session(), args.path, stored, config)
            found = execute(index, rules)
            body = report.scan_report(index, found, rules, "selected" if wanted else "all", started, _now())
            text = report.scan_summary(body, output)
        else:
            index = _index(spark or session(), args.path, stored, config, keep=lambda a: bool(set(a.roles) & set(aliases.DATASETS)) and "configuration" not in a.roles, fields=measure.asked_fields(config))
            body, found = report.profile_report(index, measure.measurements(index), started, _now()), []
            text = report.profile_summary(body, output)
    except Exception as e:  # noqa: BLE001  the exit code tells callers
        print(f"Internal error: {type(e).__name__}: {e}", file=sys.stderr)
        return 6
    if not _write(output, body):
        return 5
    print(json.dumps(body, indent=2, ensure_ascii=False) if args.format == "json" else text)
    return 1 if args.command == "scan" and report.fails(found, args.fail_on or config.fail_on) else 0


def main() -> None:
    sys.exit(run())


if __name__ == "__main__":
    main()
