"""A first contract for files that are there: columns and types from a sample."""

from __future__ import annotations

import csv
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts
from ..functions.names import normalize_name
from ..sources import json as json_source
from ..sources.lines import literal
from ..storage import Files

#: Lines that types are read off, and bytes that they are looked for in, at most.
SAMPLE, PREFIX = 1000, 1 << 20
_TEXT_KINDS = ("boolean", "integer", "number", "date", "datetime")
_KINDS = ((T.BooleanType, "boolean"), (T.DateType, "date"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.NumericType, "number"))


def kind_of(t: T.DataType) -> str:
    """Numbers of all widths are `number`; what isn't a scalar is text."""
    return next((name for kind, name in _KINDS if isinstance(t, kind)), "string")


def _sampled(files: Files, path: str) -> list[str]:
    """The first lines, whole ones only."""
    raw = files.prefix(path, PREFIX)
    lines = raw.decode("utf-8", "replace").lstrip("\ufeff").splitlines()
    return (lines if len(raw) < PREFIX else lines[:-1])[: SAMPLE + 1]


def _text_columns(spark: SparkSession, lines: list[str], sep: str) -> list[dict[str, str]]:
    """The first kind that the engine's own cast takes every cell of a column for; else text."""
    header, *rows = csv.reader(lines, delimiter=sep)
    cells = [[c or None for c in (r + [""] * len(header))[: len(header)]] for r in rows]
    df = spark.createDataFrame(cells, ", ".join(f"c{i} string" for i in range(len(header))))
    fits = [F.bool_and(F.col(f"c{i}").isNull() | casts.typed(F.col(f"c{i}"), k).isNotNull()).alias(f"{i}_{k}") for i in range(len(header)) for k in _TEXT_KINDS]
    some = [F.count(f"c{i}").alias(f"n{i}") for i in range(len(header))]
    found = df.agg(*fits, *some).first()
    return [{"name": h, "type": next((k for k in _TEXT_KINDS if found[f"n{i}"] and found[f"{i}_{k}"]), "string")} for i, h in enumerate(header)]


def infer_contract(spark: SparkSession, path: str, format: str, name: str | None = None) -> dict[str, Any]:
    """An entity for the file at path: csv, tsv, json or parquet. Types come from the file's beginning."""
    files, options = Files(spark), {}
    if format in ("csv", "tsv"):
        lines = _sampled(files, path)
        if not lines:
            raise ValueError(f"{path} is empty")
        sep = "\t" if format == "tsv" else csv.Sniffer().sniff("\n".join(lines[:20]), ",;|\t").delimiter
        options = {"separator": sep, "header": True}
        columns = _text_columns(spark, lines, sep)
    elif format == "json":
        array = files.prefix(path, PREFIX).decode("utf-8", "ignore").lstrip("\ufeff \t\r\n")[:1] == "["
        options = {"json_mode": "array" if array else "ndjson"}
        json_source.first_keys(files, path, array)
        share = 1.0 if array else min(1.0, 100 * PREFIX / max(1, files.find(path, ())[0].size))
        schema = spark.read.options(multiLine=array, samplingRatio=share).json(literal([path])).schema
        columns = [{"name": f.name, "type": kind_of(f.dataType)} for f in schema]
    elif format == "parquet":
        columns = [{"name": f.name, "type": kind_of(f.dataType)} for f in spark.read.parquet(*literal([path])).schema]
    else:
        raise ValueError(f"no inference for {format}")
    name = name or normalize_name(Path(path).stem, "snake_case")
    return {"name": name, "source": {"format": format, "path": path, **({"options": options} if options else {})}, "sink": {"accepted": {"format": "parquet", "path": f"out/accepted/{name}"}}, "policy": {"severity": "warn"}, "schema": {"columns": columns}}


def add_entity(spark: SparkSession, config: str, path: str, format: str, name: str | None = None, dry_run: bool = False) -> dict[str, Any]:
    """Adds the entity to the contract; ValueError if it has one of that name."""
    raw = yaml.safe_load(Path(config).read_text()) or {"version": "0.1"}
    entity = infer_contract(spark, path, format, name)
    if any(e["name"] == entity["name"] for e in raw.setdefault("entities", []) or []):
        raise ValueError(f"entity.name={entity['name']} exists")
    raw["entities"].append(entity)
    if not dry_run:
        Path(config).write_text(yaml.safe_dump(raw, sort_keys=False, allow_unicode=True))
    return entity
