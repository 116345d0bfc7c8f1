"""python -m tidegate.cli validate | run | manifest | add-entity | state"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import api
from .plans.config import ConfigError


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidegate").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _variables(pairs: list[str]) -> dict[str, str]:
    return dict(p.split("=", 1) for p in pairs)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tidegate")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "run", "manifest", "add-entity", "state"):
        c = commands.add_parser(name)
        c.add_argument("-c", "--config")
        c.add_argument("--profile")
        c.add_argument("--var", action="append", default=[])
        if name in ("validate", "run"):
            c.add_argument("--entities", type=lambda x: x.split(","))
        if name == "run":
            c.add_argument("--manifest")
            c.add_argument("--run-id")
            c.add_argument("--full-refresh", action="store_true")
            c.add_argument("--dry-run", action="store_true")
        if name == "manifest":
            c.add_argument("-o", "--output")
            c.add_argument("--deterministic", action="store_true")
        if name == "add-entity":
            c.add_argument("--input", required=True)
            c.add_argument("--format", required=True)
            c.add_argument("--name")
            c.add_argument("--dry-run", action="store_true")
        if name == "state":
            c.add_argument("action", choices=["inspect", "reset"])
            c.add_argument("--entity", required=True)
    a = parser.parse_args(args)
    try:
        if a.command == "validate":
            api.validate(a.config, a.profile, _variables(a.var), a.entities)
            print("valid")
            return 0
        if a.command == "run":
            options = {"entities": a.entities, "run_id": a.run_id, "full_refresh": a.full_refresh, "dry_run": a.dry_run}
            show = lambda e: print(json.dumps(e), file=sys.stderr)
            if a.manifest:
                out = api.run_manifest(_session(), json.loads(Path(a.manifest).read_text()), observer=show, **options)
            else:
                out = api.run(_session(), a.config, profile=a.profile, variables=_variables(a.var), observer=show, **options)
            print(json.dumps(out.to_dict(), indent=2, default=str))
            return out.exit_code
        if a.command == "manifest":
            text = json.dumps(api.generate(a.config, a.deterministic), indent=2, sort_keys=True)
            Path(a.output).write_text(text) if a.output else print(text)
            return 0
        if a.command == "add-entity":
            print(json.dumps(api.add_entity(_session(), a.config, a.input, a.format, a.name, a.dry_run), indent=2))
            return 0
        print(json.dumps(api.inspect_state(a.config, a.entity), indent=2) if a.action == "inspect" else api.reset_state(a.config, a.entity))
        return 0
    except (ConfigError, ValueError, OSError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
