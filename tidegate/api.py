"""The Python interface: validate, run, load_config, config_variables, inspect_state, reset_state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from .plans.config import Config, ConfigError, config_variables, load, load_profile, validate as check
from .plans.infer import add_entity, infer_contract
from .plans.manifest import generate, reconstruct
from .plans.run import Outcome, ledger, run
from .storage import Files

__all__ = ["Config", "ConfigError", "Outcome", "add_entity", "config_variables", "generate", "infer_contract", "inspect_state", "load_config", "reconstruct", "reset_state", "run", "run_manifest", "validate"]

load_config = load


def validate(path: str, profile: str | None = None, variables: dict[str, str] | None = None, entities: list[str] | None = None) -> Config:
    """The contract, if it is valid; else ConfigError."""
    config = load(path, load_profile(profile) if profile else None, variables)
    if entities and (unknown := set(entities) - {e.name for e in config.entities}):
        raise ConfigError(f"unknown entities: {sorted(unknown)}")
    check(config)
    return config


def run_manifest(spark: SparkSession, manifest: dict[str, Any], **options: Any) -> Outcome:
    return run(spark, "manifest", config=reconstruct(manifest), **options)


def inspect_state(path: str, entity: str, **options: Any) -> dict[str, Any]:
    config = load(path, **options)
    return ledger(Files(), config, config.entity(entity)).read()


def reset_state(path: str, entity: str, **options: Any) -> bool:
    config = load(path, **options)
    return ledger(Files(), config, config.entity(entity)).reset()
