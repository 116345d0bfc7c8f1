"""Which files an entity reads."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import SparkSession

from ..storage import Files, InputFile
from .config import Config, ConfigError, Entity, Storage

#: File name endings by format.
ENDINGS = {"csv": (".csv",), "tsv": (".tsv",), "fixed": (".txt", ".fixed", ".dat"), "json": (".json", ".jsonl", ".ndjson"), "xml": (".xml",), "xlsx": (".xlsx",), "parquet": (".parquet",), "orc": (".orc",), "avro": (".avro",)}


def located(config: Config, path: str, storage: str | None) -> str:
    """path in its storage: a URI for object stores, else a local path from the contract's folder."""
    if "://" in path:
        return path.removeprefix("local://") if path.startswith("local://") else path
    name = storage or config.storages.default
    found = next((s for s in config.storages.definitions if s.name == name), Storage("local"))
    inner = "/".join(x.strip("/") for x in (found.prefix or "", path) if x)
    match found.type:
        case "s3":
            return f"s3a://{found.bucket}/{inner}"
        case "gcs":
            return f"gs://{found.bucket}/{inner}"
        case "adls":
            return f"abfss://{found.container}@{found.account}.dfs.core.windows.net/{inner}"
        case "local":
            return str(Path(config.base, path).resolve())
    raise ConfigError(f"unsupported storage type: {found.type}")


def configure(spark: SparkSession, config: Config) -> None:
    """Tells Hadoop what the storages' definitions say about their buckets."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for s in config.storages.definitions:
        if s.type == "s3":
            own = {"endpoint.region": s.region, "endpoint": s.endpoint, "path.style.access": None if s.path_style_access is None else str(s.path_style_access).lower()}
            for key, value in own.items():
                if value is not None:
                    conf.set(f"fs.s3a.bucket.{s.bucket}.{key}", value)


def resolve(files: Files, config: Config, e: Entity) -> list[InputFile]:
    """Sorted and each once. A file, a folder (with its glob, or the format's endings), or a glob, on any
    storage; no match is an error."""
    path, options = located(config, e.source.path, e.source.storage), e.source.options
    found = files.find(path, ENDINGS[e.source.format], options.glob, options.recursive)
    if not found:
        raise FileNotFoundError(f"entity.name={e.name} no input files matched {path}")
    return found


def archive_name(file: InputFile, run_id: str) -> str:
    """<stem>__run-<id>__src-<hash>.<ending>, short enough for a file name."""
    ending = Path(file.path).suffix
    tail = f"__run-{run_id}__src-{hashlib.sha256(file.path.encode()).hexdigest()[:12]}{ending}"
    return file.stem.encode()[: 255 - len(tail.encode())].decode(errors="ignore") + tail
