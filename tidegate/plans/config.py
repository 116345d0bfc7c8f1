"""The YAML contract: parsing (unknown keys are refused), templates, variables, validation."""

from __future__ import annotations

import dataclasses
import os
import re
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..functions import names
from ..functions.casts import canonical
from ..functions.masks import STRATEGIES as PII
from ..functions.selectors import json_path, xml_steps
from ..operators.policy import SEVERITIES
from ..sinks.partitions import TRANSFORMS


class ConfigError(ValueError):
    pass


# --- shapes ---------------------------------------------------------------------------------------
@dataclass
class SourceOptions:
    header: bool = True
    separator: str | None = None
    encoding: str = "UTF-8"
    null_values: list[str] | None = None
    recursive: bool = False
    glob: str | None = None
    json_mode: str = "array"
    sheet: str | None = None
    header_row: int = 1
    data_row: int | None = None
    row_tag: str | None = None
    namespace: str | None = None
    value_tag: str | None = None


@dataclass
class Source:
    format: str
    path: str
    storage: str | None = None
    options: SourceOptions = field(default_factory=SourceOptions)
    cast_mode: str = "strict"


@dataclass
class HistoryOptions:
    current_flag_column: str = "__dq_is_current"
    valid_from_column: str = "__dq_valid_from"
    valid_to_column: str = "__dq_valid_to"


@dataclass
class MergeOptions:
    ignore_columns: list[str] = field(default_factory=list)
    compare_columns: list[str] = field(default_factory=list)
    scd2: HistoryOptions = field(default_factory=HistoryOptions)


@dataclass
class SinkOptions:
    compression: str | None = None
    row_group_size: int | None = None
    max_size_per_file: int | None = None


@dataclass
class DuckDb:
    table: str = ""
    schema: str | None = None


@dataclass
class IcebergTable:
    catalog: str | None = None
    namespace: str | None = None
    table: str | None = None
    location: str | None = None


@dataclass
class DeltaTable:
    catalog: str | None = None
    schema: str | None = None
    table: str | None = None


@dataclass
class PartitionField:
    column: str
    transform: str = "identity"


@dataclass
class Target:
    format: str
    path: str
    storage: str | None = None
    options: SinkOptions = field(default_factory=SinkOptions)
    merge: MergeOptions = field(default_factory=MergeOptions)
    duckdb: DuckDb = field(default_factory=DuckDb)
    iceberg: IcebergTable | None = None
    delta: DeltaTable | None = None
    partition_by: list[str] = field(default_factory=list)
    partition_spec: list[PartitionField] = field(default_factory=list)


@dataclass
class Archive:
    path: str
    storage: str | None = None


@dataclass
class Sink:
    accepted: Target
    rejected: Target | None = None
    archive: Archive | None = None
    write_mode: str = "overwrite"


@dataclass
class Policy:
    severity: str = "warn"


@dataclass
class Mismatch:
    missing_columns: str = "fill_nulls"
    extra_columns: str = "ignore"


@dataclass
class Normalize:
    enabled: bool = False
    strategy: str = "snake_case"


@dataclass
class Evolution:
    mode: str = "strict"


@dataclass
class ColumnSpec:
    name: str
    type: str
    source: str | None = None
    nullable: bool | None = None
    unique: bool = False
    width: int | None = None
    trim: bool = True


@dataclass
class Schema:
    columns: list[ColumnSpec]
    mismatch: Mismatch = field(default_factory=Mismatch)
    normalize_columns: Normalize = field(default_factory=Normalize)
    schema_evolution: Evolution = field(default_factory=Evolution)
    primary_key: list[str] = field(default_factory=list)
    unique_keys: list[list[str]] = field(default_factory=list)


@dataclass
class PiiColumn:
    name: str
    strategy: str
    mask_pattern: str | None = None
    redact_value: str | None = None


@dataclass
class Pii:
    columns: list[PiiColumn] = field(default_factory=list)


@dataclass
class State:
    path: str | None = None


@dataclass
class Metadata:
    project: str | None = None
    data_product: str | None = None
    domain: str | None = None
    owner: str | None = None
    description: str | None = None
    tags: list[str] = field(default_factory=list)


@dataclass
class Entity:
    name: str
    source: Source
    sink: Sink
    schema: Schema
    policy: Policy = field(default_factory=Policy)
    metadata: Metadata | None = None
    domain: str | None = None
    incremental_mode: str = "none"
    state: State = field(default_factory=State)
    pii: Pii = field(default_factory=Pii)


@dataclass
class Storage:
    name: str
    type: str = "local"
    bucket: str | None = None
    region: str | None = None
    account: str | None = None
    container: str | None = None
    prefix: str | None = None
    endpoint: str | None = None
    path_style_access: bool | None = None


@dataclass
class Storages:
    default: str | None = None
    definitions: list[Storage] = field(default_factory=list)


@dataclass
class Catalog:
    name: str
    type: str
    region: str | None = None
    database: str | None = None
    create_database_if_missing: bool = True
    allow_takeover: bool = False
    uri: str | None = None
    credential: str | None = None
    warehouse: str | None = None
    oauth2_server_uri: str | None = None
    scope: str | None = None
    host: str | None = None
    catalog: str | None = None
    schema: str | None = None
    token: str | None = None
    create_schema_if_missing: bool = False
    warehouse_storage: str | None = None
    warehouse_prefix: str | None = None


@dataclass
class Catalogs:
    default: str | None = None
    definitions: list[Catalog] = field(default_factory=list)


@dataclass
class Env:
    file: str | None = None
    vars: dict[str, str] = field(default_factory=dict)


@dataclass
class Domain:
    name: str
    incoming_dir: str


@dataclass
class Report:
    path: str
    formatter: str = "json"
    storage: str | None = None


@dataclass
class Lineage:
    url: str
    namespace: str
    api_key: str | None = None
    timeout_secs: int = 5
    producer: str | None = None
    max_failures: int = 3
    job_name: str | None = None


@dataclass
class Config:
    version: str
    entities: list[Entity]
    metadata: Metadata | None = None
    storages: Storages = field(default_factory=Storages)
    catalogs: Catalogs = field(default_factory=Catalogs)
    env: Env = field(default_factory=Env)
    domains: list[Domain] = field(default_factory=list)
    report: Report | None = None
    lineage: Lineage | None = None
    base: str = "."

    def entity(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)


# --- parsing --------------------------------------------------------------------------------------
def build(kind: Any, value: Any, at: str) -> Any:
    """value as the annotated kind."""
    origin = typing.get_origin(kind)
    if origin in (types.UnionType, typing.Union):
        return None if value is None else build(next(k for k in typing.get_args(kind) if k is not type(None)), value, at)
    if origin is list:
        if not isinstance(value, list):
            raise ConfigError(f"{at}: a list is expected")
        return [build(typing.get_args(kind)[0], v, f"{at}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        return {str(k): str(v) for k, v in (value or {}).items()}
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ConfigError(f"{at}: a mapping is expected")
        hints = {k: v for k, v in typing.get_type_hints(kind).items() if not (kind is Config and k == "base")}
        if unknown := sorted(set(map(str, value)) - set(hints)):
            raise ConfigError(f"{at}: unknown key {unknown[0]}")
        try:
            return kind(**{k: build(hints[k], v, f"{at}.{k}") for k, v in value.items() if v is not None})
        except TypeError:
            need = [f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and f.name not in value]
            raise ConfigError(f"{at}: missing key {need[0] if need else '?'}") from None
    if kind is str and isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(value)
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise ConfigError(f"{at}: {kind.__name__} is expected")
    return value


def expand(text: str, variables: dict[str, str], depth: int = 0, seen: tuple[str, ...] = ()) -> str:
    """${VAR} from variables, in their values too; ConfigError for unknown and circular ones."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in seen:
            raise ConfigError(f"circular variable: {' -> '.join([*seen, name])}")
        if name not in variables:
            raise ConfigError(f"unresolved variable: {name}")
        if depth >= 32:
            raise ConfigError("variables are nested too deep")
        return expand(variables[name], variables, depth + 1, (*seen, name))

    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, text)


def _walk(value: Any, f) -> Any:
    if isinstance(value, dict):
        return {k: _walk(v, f) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, f) for v in value]
    return f(value) if isinstance(value, str) else value


def load(path: str | os.PathLike, profile: Profile | dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> Config:
    """The contract at path, checked. Variables: the profile's, then the caller's, then the file's own.
    Storages, catalogs and lineage are the profile's where the contract has none."""
    profile = profile if isinstance(profile, Profile) else Profile(profile or {})
    base = Path(path).resolve().parent
    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigError(f"invalid YAML: {e}") from None
    if not isinstance(raw, dict):
        raise ConfigError("config: a mapping is expected")
    raw = {**profile.sections, **raw}
    env = raw.get("env") or {}
    own = {str(k): str(v) for k, v in (env.get("vars") or {}).items()}
    if env.get("file"):
        listed = yaml.safe_load((base / env["file"]).read_text(encoding="utf-8")) or {}
        own = {str(k): str(v) for k, v in listed.items()} | own
    variables = {**profile.variables, **(overrides or {}), **own}
    domains = {d.get("name"): d.get("incoming_dir") for d in raw.get("domains") or [] if isinstance(d, dict)}
    wanted = raw.pop("env", None)

    def in_entity(entity: dict):
        def template(text: str) -> str:
            def one(m: re.Match) -> str:
                name = m[1].strip()
                if name == "domain.incoming_dir" and entity.get("domain") in domains:
                    return domains[entity["domain"]]
                if name in variables:
                    return variables[name]
                raise ConfigError(f"unresolved template variable: {name}")

            return expand(re.sub(r"\{\{(.*?)\}\}", one, text), variables)

        return template

    raw["entities"] = [_walk(e, in_entity(e)) if isinstance(e, dict) else e for e in raw.get("entities") or []]
    rest = _walk({k: v for k, v in raw.items() if k != "entities"}, in_entity({}))
    out = build(Config, {**rest, "entities": raw["entities"], **({"env": wanted} if wanted else {})}, "config")
    out.base = str(base)
    validate(out)
    return out


# --- rules ----------------------------------------------------------------------------------------
SOURCES = ("csv", "tsv", "fixed", "json", "xml", "xlsx", "parquet", "orc", "avro")
SINKS = ("parquet", "delta", "iceberg", "duckdb", "versioned")
MODES = ("overwrite", "append", "merge_scd1", "merge_scd2")
MERGING = ("delta", "duckdb", "versioned")


#: What a storage's definition needs, by type, and the storages that a sink can write to.
STORAGES = {"local": (), "s3": ("bucket", "region"), "gcs": ("bucket",), "adls": ("account", "container")}
CATALOGS = {"glue": ("region", "database"), "rest": ("uri",), "unity": ("host", "catalog", "schema", "token")}
SINK_STORAGES = {"duckdb": ("local",), "iceberg": ("local", "s3", "gcs")}


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ConfigError(f"{what}={value} is unsupported (allowed: {', '.join(allowed)})")


def validate(config: Config) -> None:
    """Raises ConfigError for the first rule that the contract breaks."""
    if not config.entities:
        raise ConfigError("entities list is empty")
    if not re.fullmatch(r"\d+\.\d+", config.version):
        raise ConfigError(f"version={config.version} is unsupported (expected: major.minor)")
    named: set[str] = set()
    for s in config.storages.definitions:
        if s.name in named:
            raise ConfigError(f"storages.definitions name={s.name} is duplicated")
        named.add(s.name)
        _one_of(s.type, tuple(STORAGES), f"storages.definitions name={s.name} type")
        for need in STORAGES[s.type]:
            if not getattr(s, need):
                raise ConfigError(f"storages.definitions name={s.name} requires {need} for type {s.type}")
    if config.storages.default and config.storages.default not in named:
        raise ConfigError(f"storages.default={config.storages.default} is not defined")
    listed = [c.name for c in config.catalogs.definitions]
    for c in config.catalogs.definitions:
        _one_of(c.type, tuple(CATALOGS), f"catalogs.definitions name={c.name} type")
        for need in CATALOGS[c.type]:
            if not getattr(c, need):
                raise ConfigError(f"catalogs.definitions name={c.name} requires {need} for type {c.type}")
        if c.warehouse_storage and c.warehouse_storage not in named:
            raise ConfigError(f"catalogs.definitions name={c.name} warehouse_storage references unknown storage {c.warehouse_storage}")
    if len(set(listed)) < len(listed):
        raise ConfigError("catalogs.definitions has a duplicate name")
    if config.catalogs.default and config.catalogs.default not in listed:
        raise ConfigError(f"catalogs.default={config.catalogs.default} is not defined")
    seen: set[str] = set()
    for e in config.entities:
        if not e.name.strip():
            raise ConfigError("entity.name must not be empty")
        if e.name in seen:
            raise ConfigError(f"entity.name={e.name} is duplicated")
        seen.add(e.name)
        try:
            _entity(config, e)
        except (ConfigError, ValueError) as x:
            raise ConfigError(f"entity.name={e.name} {x}") from None


def _entity(config: Config, e: Entity) -> None:
    src, sink, sch = e.source, e.sink, e.schema
    _one_of(src.format, SOURCES, "source.format")
    _one_of(src.cast_mode, ("strict", "coerce"), "source.cast_mode")
    _one_of(sink.accepted.format, SINKS, "sink.accepted.format")
    _one_of(sink.write_mode, MODES, "sink.write_mode")
    _one_of(e.policy.severity, SEVERITIES, "policy.severity")
    _one_of(e.incremental_mode, ("none", "archive", "file"), "incremental_mode")
    _one_of(sch.mismatch.missing_columns, ("fill_nulls", "reject_file"), "schema.mismatch.missing_columns")
    _one_of(sch.mismatch.extra_columns, ("ignore", "reject_file"), "schema.mismatch.extra_columns")
    _one_of(sch.schema_evolution.mode, ("strict", "add_columns"), "schema.schema_evolution.mode")
    _one_of(sch.normalize_columns.strategy, names.STRATEGIES, "schema.normalize_columns.strategy")
    if src.format == "json":
        _one_of(src.options.json_mode, ("array", "ndjson"), "source.options.json_mode")
    if src.options.separator is not None and len(src.options.separator.encode()) != 1:
        raise ConfigError("source.options.separator must be a single byte")
    if src.format == "xml" and not src.options.row_tag:
        raise ConfigError("source.options.row_tag is required for xml")
    if src.format == "xlsx":
        o = src.options
        if o.sheet is not None and not o.sheet.strip():
            raise ConfigError("source.options.sheet must not be empty")
        if o.header_row < 1:
            raise ConfigError("source.options.header_row must be greater than 0")
        if o.data_row is not None and o.data_row <= o.header_row:
            raise ConfigError("source.options.data_row must be greater than source.options.header_row")
    for what, path in (("source.path", src.path), ("sink.accepted.path", sink.accepted.path), ("sink.rejected.path", sink.rejected and sink.rejected.path)):
        if path is not None and not path.strip():
            raise ConfigError(f"{what} must not be empty")
    if not sch.columns:
        raise ConfigError("schema.columns is empty")
    declared = [c.name for c in sch.columns]
    if len(set(declared)) < len(declared):
        raise ConfigError("schema.columns has a duplicate name")
    for c in sch.columns:
        canonical(c.type)
        if src.format == "fixed" and not (c.width and c.width > 0):
            raise ConfigError(f"schema.columns[{c.name}].width is required for fixed")
        if c.source and src.format == "json":
            json_path(c.source)
        if c.source and src.format == "xml":
            xml_steps(c.source)
    for key in [sch.primary_key, *sch.unique_keys]:
        for c in key:
            if c not in declared:
                raise ConfigError(f"key column {c} is not declared")
    kind = {c.name: canonical(c.type) for c in sch.columns}
    for c in sch.columns:
        if c.name in sch.primary_key and c.nullable:
            raise ConfigError(f"schema.primary_key column {c.name} must not be nullable")
    merging = sink.write_mode.startswith("merge_")
    if merging and sink.accepted.format not in MERGING:
        raise ConfigError(f"sink.write_mode={sink.write_mode} is not supported for sink.accepted.format={sink.accepted.format}")
    if merging and not sch.primary_key:
        raise ConfigError(f"sink.write_mode={sink.write_mode} requires schema.primary_key")
    if sch.schema_evolution.mode == "add_columns" and sink.accepted.format not in ("delta", "versioned"):
        raise ConfigError("schema.schema_evolution.mode=add_columns is not supported for this sink")
    if sch.schema_evolution.mode == "add_columns" and tuple(map(int, config.version.split("."))) < (0, 2):
        raise ConfigError('schema.schema_evolution requires version >= "0.2"')
    for key in [sch.primary_key, *sch.unique_keys]:
        if len(set(key)) < len(key):
            raise ConfigError(f"key {key} has a duplicate column")
    if any(not key for key in sch.unique_keys):
        raise ConfigError("schema.unique_keys has an empty key")
    m = sink.accepted.merge
    if m.scd2 != HistoryOptions() and sink.write_mode != "merge_scd2":
        raise ConfigError("merge.scd2 is only supported with sink.write_mode=merge_scd2")
    for what, listed in (("ignore_columns", m.ignore_columns), ("compare_columns", m.compare_columns)):
        for c in listed:
            if c not in declared:
                raise ConfigError(f"merge.{what} column {c} is not declared")
            if c in sch.primary_key:
                raise ConfigError(f"merge.{what} column {c} is part of the primary key")
        if len(set(listed)) < len(listed):
            raise ConfigError(f"merge.{what} has a duplicate column")
    if (m.ignore_columns or m.compare_columns) and not merging:
        raise ConfigError("merge options need a merge write mode")
    own = [m.scd2.current_flag_column, m.scd2.valid_from_column, m.scd2.valid_to_column]
    if any(not x for x in own) or len(set(own)) < 3 or set(own) & set(declared):
        raise ConfigError("merge.scd2 column names must be unique, not empty, and not declared")
    if sink.accepted.partition_by and sink.accepted.partition_spec:
        raise ConfigError("partition_by and partition_spec exclude each other")
    for p in sink.accepted.partition_spec:
        _one_of(p.transform, TRANSFORMS, "partition_spec.transform")
    for c in [*sink.accepted.partition_by, *[p.column for p in sink.accepted.partition_spec]]:
        if c not in declared:
            raise ConfigError(f"partition column {c} is not declared")
    if sink.accepted.format == "duckdb" and not sink.accepted.duckdb.table:
        raise ConfigError("sink.accepted.duckdb.table is required")
    if e.policy.severity == "reject" and sink.rejected is None:
        raise ConfigError("sink.rejected is required when policy.severity=reject")
    if sink.rejected and sink.rejected.format != "csv":
        raise ConfigError(f"sink.rejected.format={sink.rejected.format} is unsupported (allowed: csv)")
    if e.incremental_mode == "archive" and sink.archive is None:
        raise ConfigError("sink.archive is required when incremental_mode=archive")
    if sink.archive and (sink.archive.storage or config.storages.default) != (src.storage or config.storages.default):
        raise ConfigError("sink.archive.storage must match source.storage")
    known = {s.name: s.type for s in config.storages.definitions}
    kind_of = known.get(sink.accepted.storage or config.storages.default or "", "local")
    if kind_of not in SINK_STORAGES.get(sink.accepted.format, tuple(STORAGES)):
        raise ConfigError(f"sink.accepted.format={sink.accepted.format} is not supported on {kind_of} storage")
    for s in filter(None, (src.storage, sink.accepted.storage, sink.rejected and sink.rejected.storage)):
        if s not in known:
            raise ConfigError(f"storage {s} is not defined")
    if e.domain and e.domain not in {d.name for d in config.domains}:
        raise ConfigError(f"domain {e.domain} is not defined")
    from .catalogs import chosen  # which needs these shapes

    chosen(config, e)
    strategy = sch.normalize_columns.strategy if sch.normalize_columns.enabled else None
    names.NameMap.of([(c.name, c.source) for c in sch.columns], strategy)
    _pii(e, declared, kind)


def _pii(e: Entity, declared: list[str], kind: dict[str, str]) -> None:
    if not e.pii.columns:
        return
    if e.policy.severity == "abort":
        raise ConfigError("pii is not supported with policy.severity=abort")
    if e.sink.archive is not None:
        raise ConfigError("pii is not supported with sink.archive")
    if "reject_file" in (e.schema.mismatch.missing_columns, e.schema.mismatch.extra_columns):
        raise ConfigError("pii is not supported with a mismatch policy of reject_file")
    unique = {c.name for c in e.schema.columns if c.unique} | {c for k in [e.schema.primary_key, *e.schema.unique_keys] for c in k}
    required = {c.name for c in e.schema.columns if c.nullable is False} | set(e.schema.primary_key)
    seen: set[str] = set()
    for p in e.pii.columns:
        _one_of(p.strategy, PII, "pii.strategy")
        if p.strategy == "tokenize":
            raise ConfigError("pii.strategy=tokenize is reserved")
        if p.name not in declared:
            raise ConfigError(f"pii column {p.name} is not declared")
        if p.name in seen:
            raise ConfigError(f"pii column {p.name} is duplicated")
        seen.add(p.name)
        if p.name in unique:
            raise ConfigError(f"pii column {p.name} is part of a unique key")
        if p.strategy in ("hash", "redact", "mask") and kind[p.name] != "string":
            raise ConfigError(f"pii.strategy={p.strategy} needs a string column: {p.name}")
        if p.strategy == "nullify" and p.name in required:
            raise ConfigError(f"pii.strategy=nullify needs a nullable column: {p.name}")
        if p.strategy == "drop" and e.sink.accepted.format in ("delta", "iceberg"):
            raise ConfigError(f"pii.strategy=drop is not supported for {e.sink.accepted.format}")
        if p.strategy == "mask" and not re.search(r"\{(first|last)\d+\}", p.mask_pattern or ""):
            raise ConfigError(f"pii.mask_pattern of {p.name} needs {{firstN}} or {{lastN}}")


@dataclass
class Profile:
    """What a profile brings: variables, and sections for contracts that lack them."""

    variables: dict[str, str] = field(default_factory=dict)
    sections: dict[str, Any] = field(default_factory=dict)


RUNNERS = ("local", "kubernetes_job", "databricks_job")


def load_profile(path: str | os.PathLike) -> Profile:
    """A profile: metadata, variables, execution, and storages, catalogs and lineage that a contract may
    do without. Variables may also stand under spec. ConfigError for what is not valid."""
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(raw, dict):
        raise ConfigError("profile: a mapping is expected")
    found = raw.get("variables", (raw.get("spec") or {}).get("variables", {}))
    if not isinstance(found, dict):
        raise ConfigError("profile variables: a mapping is expected")
    if "metadata" in raw and not str((raw["metadata"] or {}).get("name", "")).strip():
        raise ConfigError("profile.metadata.name must not be empty")
    runner = ((raw.get("execution") or {}).get("runner") or {}).get("type")
    if runner is not None:
        _one_of(runner, RUNNERS, "profile.execution.runner.type")
    for name, value in found.items():
        if re.search(r"\$\{(?![A-Za-z_][A-Za-z0-9_]*\})", str(value)):
            raise ConfigError(f"profile.variables.{name} has a malformed placeholder")
    sections = {k: raw[k] for k in ("storages", "catalogs", "lineage") if raw.get(k)}
    for k in ("storages", "catalogs"):
        if k in sections and not sections[k].get("definitions"):
            raise ConfigError(f"profile.{k}.definitions must not be empty")
    return Profile({str(k): str(v) for k, v in found.items()}, sections)


def config_variables(path: str | os.PathLike) -> list[str]:
    """Names of the ${VAR}s that a contract uses."""
    return sorted(set(re.findall(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", Path(path).read_text(encoding="utf-8"))))
