"""A manifest: the checked contract as one JSON document that a run can start from."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import os
from pathlib import Path
from typing import Any

from .config import Config, ConfigError, build, load, validate

VERSION = "1"


def _plain(value: Any) -> Any:
    """Without what is null or empty."""
    if isinstance(value, dict):
        return {k: p for k, v in value.items() if (p := _plain(v)) not in (None, {}, [])}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def generate(path: str | os.PathLike, deterministic: bool = False, **options: Any) -> dict[str, Any]:
    """deterministic: the same contract gives the same bytes (no time of making)."""
    config = load(path, **options)
    body = _plain(dataclasses.asdict(config))
    sums = {e["name"]: hashlib.sha256(json.dumps(e, sort_keys=True).encode()).hexdigest() for e in body["entities"]}
    out = {"manifest_version": VERSION, "config": body, "checksums": sums, "source_sha256": hashlib.sha256(Path(path).read_bytes()).hexdigest()}
    return out if deterministic else out | {"generated_at": datetime.datetime.now(datetime.UTC).isoformat()}


def reconstruct(manifest: dict[str, Any]) -> Config:
    """The contract of a manifest; ConfigError if an entity isn't what its checksum says."""
    if manifest.get("manifest_version") != VERSION:
        raise ConfigError(f"unsupported manifest version: {manifest.get('manifest_version')}")
    body = dict(manifest["config"])
    for e in body["entities"]:
        if manifest.get("checksums", {}).get(e["name"]) != hashlib.sha256(json.dumps(e, sort_keys=True).encode()).hexdigest():
            raise ConfigError(f"entity.name={e['name']} does not match its checksum")
    base = body.pop("base", ".")
    out = build(Config, body, "manifest")
    out.base = base
    validate(out)
    return out
