"""A run: each entity's files are read as one DataFrame, checked, routed, masked, written, reported."""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import asdict, dataclass, field
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import casts, masks, names
from ..operators import checks, merge, mismatch, policy, report, unique
from ..session import importable
from ..sinks import partitions, tables
from ..sources import avro, columnar, fixed, json as json_source, text, xlsx, xml
from ..sources.lines import AT, SPLIT, with_row_index
from ..storage import STATE_FOLDER, Files, InputFile, joined
from . import catalogs
from .config import Config, Entity, load, load_profile
from .inputs import archive_name, configure, located, resolve
from .lineage import Emitter
from .state import Heartbeat, Ledger

#: Formats whose rows can say that their file can't be read.
WHOLE_FILE = ("fixed", "json", "xml", "avro")
#: Formats whose rows know their number in the file.
NUMBERED = ("xml", "avro", "xlsx", "parquet")
#: Files that a filter names one by one, at most.
LISTED = 1000
LONG_ROW = "row has more cells than the file has columns"
Observer = Callable[[dict[str, Any]], None]
EXIT = {"success": 0, "success_with_warnings": 0, "rejected": 0, "aborted": 2, "failed": 1}
#: What a constraint's duplicates did, by severity.
EFFECTS = {"warn": "warn", "reject": "reject_rows", "abort": "abort_run"}


@dataclass
class FileReport:
    path: str
    status: str = "success"
    rows: int = 0
    accepted: int = 0
    rejected: int = 0
    warnings: int = 0
    mismatch: dict[str, Any] = field(default_factory=dict)
    error: str | None = None
    rules: list[dict[str, Any]] = field(default_factory=list)
    rejected_path: str | None = None
    archived_path: str | None = None


@dataclass
class EntityReport:
    entity: str
    status: str = "success"
    files: list[FileReport] = field(default_factory=list)
    rows: int = 0
    accepted: int = 0
    rejected: int = 0
    warnings: int = 0
    errors: int = 0
    unique: list[dict[str, Any]] = field(default_factory=list)
    merge: dict[str, Any] | None = None
    added_columns: list[str] = field(default_factory=list)
    output: dict[str, Any] = field(default_factory=dict)
    errors_path: str | None = None
    notes: list[str] = field(default_factory=list)
    #: Milliseconds of each phase.
    phases: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def timed(self, phase: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.phases[phase] = self.phases.get(phase, 0) + round(1000 * (time.monotonic() - began))


@dataclass
class Outcome:
    run_id: str
    status: str
    exit_code: int
    entities: list[EntityReport]
    previews: list[dict[str, Any]] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


class EntityRun:
    """One entity, with its names and constraints worked out."""

    def __init__(self, spark: SparkSession, config: Config, e: Entity, full: bool, emit: Observer = lambda _: None):
        self.spark, self.config, self.e, self.full, self.emit = spark, config, e, full, emit
        self.files = Files(spark)
        sch = e.schema
        strategy = sch.normalize_columns.strategy if sch.normalize_columns.enabled else None
        self.strategy = strategy
        self.map = names.NameMap.of([(c.name, c.source) for c in sch.columns], strategy)
        self.columns = {self.map.runtime[c.name]: c for c in sch.columns}
        run = lambda key: [self.map.runtime[c] for c in key]
        self.key = run(sch.primary_key)
        self.required = list(dict.fromkeys([n for n, c in self.columns.items() if c.nullable is False] + self.key))
        self.constraints = unique.constraints([run(k) for k in sch.unique_keys], [n for n, c in self.columns.items() if c.unique], self.key)
        self.strict = e.source.cast_mode == "strict"
        self.delimited_ = e.source.format in ("csv", "tsv")
        self.mode = "overwrite" if full and e.sink.write_mode == "append" else e.sink.write_mode
        self.seeded: tables.Table | None = None
        self.numbered = e.source.format in NUMBERED or e.source.format == "json" and e.source.options.json_mode == "array"

    # --- reading ---
    def headers(self, inputs: Sequence[InputFile]) -> list[list[str] | ValueError]:
        """Each file's columns as they stand, or why it is rejected. Only the files' beginnings or footers
        are read; workbooks, which have their directory at the end, in one job."""
        o, e = self.e.source.options, self.e
        declared = [c.source or c.name for c in e.schema.columns]
        match e.source.format:
            case "csv" | "tsv":
                look = lambda f: text.header_of(self.files, f.path, self.delimited(), declared)
            case "json":
                look = lambda f: json_source.first_keys(self.files, f.path, o.json_mode == "array")
            case "parquet" | "orc":
                look = lambda f: columnar.columns_of(self.files, f.path, e.source.format)
            case "avro":
                look = lambda f: avro.columns_of(self.files, f.path)
            case "xlsx":
                found = xlsx.headers(self.spark, [(i, f.path) for i, f in enumerate(inputs)], o.sheet, o.header_row)
                return [found[i] for i in range(len(inputs))]
            case _:
                return [declared] * len(inputs)
        return self.files.each(look, inputs)

    def delimited(self) -> text.Delimited:
        o = self.e.source.options
        return text.Delimited(o.separator or ("\t" if self.e.source.format == "tsv" else ";"), o.header, tuple(o.null_values if o.null_values is not None else [""]), o.encoding)

    def compared(self) -> list[str]:
        """The declared columns that are compared with a file's."""
        if self.e.source.format in ("json", "xml"):
            return [n for n, c in self.columns.items() if mismatch.takes_part(c.source)]
        return list(self.columns)

    def read(self, files: list[tuple[int, str]], header: list[str]) -> DataFrame:
        """Files, (position, path), of one header: raw_ or cell_ columns by runtime name, and places."""
        o, e, spark = self.e.source.options, self.e, self.spark
        runtime: dict[str, str] = {}
        for h in header:  # the first of two that normalise alike
            runtime.setdefault(names.normalize_name(h, self.strategy), h)
        match e.source.format:
            case "csv" | "tsv":
                place = {n: str(header.index(h)) for n, h in runtime.items() if n in self.columns}
                raw = text.read_delimited(spark, files, [f"{i}" for i in range(len(header))], self.delimited(), list(place.values()))
                return raw.withColumnsRenamed({f"raw_{i}": f"raw_{n}" for n, i in place.items()})
            case "fixed":
                out = fixed.read_fixed(spark, files, [(n, c.width, c.trim) for n, c in self.columns.items()])
                return out.withColumn("__error", F.when(F.col("__bad"), "fixed_width_error: a line does not fit")).drop("__bad")
            case "json":
                selectors = {n: c.source or (runtime.get(n) or c.name) for n, c in self.columns.items()}
                reader = json_source.read_json_array if o.json_mode == "array" else json_source.read_ndjson
                return reader(spark, files, selectors, self.strict)
            case "xml":
                return xml.read_xml(spark, files, o.row_tag, {n: c.source or c.name for n, c in self.columns.items()}, o.namespace, o.value_tag)
            case "avro":
                return avro.read_avro(spark, files, {n: runtime[n] for n in self.columns if n in runtime}, self.strict)
            case "xlsx":
                raw = xlsx.read_xlsx(spark, files, [runtime[n] for n in self.columns if n in runtime], o.sheet, o.header_row, o.data_row or o.header_row + 1)
                return raw.withColumnsRenamed({f"raw_{runtime[n]}": f"raw_{n}" for n in self.columns if n in runtime})
            case kind:
                raw = columnar.read_columnar(spark, files, kind, [runtime[n] for n in self.columns if n in runtime])
                return raw.withColumnsRenamed({f"cell_{runtime[n]}": f"cell_{n}" for n in self.columns if n in runtime})

    def typed(self, df: DataFrame) -> DataFrame:
        """Each declared column and, where a cast may fail, __raw_: whether its cell holds something."""
        cells = []
        for n, c in self.columns.items():
            may_fail = self.strict and casts.canonical(c.type) != "string"
            if f"cell_{n}" in df.columns:
                raw = F.col(f"`cell_{n}`")
                cells.append(casts.from_typed(raw, df.schema[f"cell_{n}"].dataType, c.type).alias(n))
            elif f"raw_{n}" in df.columns:
                raw = F.col(f"`raw_{n}`")
                cells.append(casts.typed(raw, c.type).alias(n))
            else:
                raw = F.lit(None)
                cells.append(raw.cast(casts.spark_type(c.type)).alias(n))
            if may_fail:
                cells.append(raw.isNotNull().alias(f"__raw_{n}"))
        own = ["__error"] * (self.e.source.format in WHOLE_FILE) + ["__long"] * self.delimited_
        return df.select(*cells, checks.FILE_ORD, SPLIT, AT, *own)

    # --- checking ---
    def place(self, inputs: Sequence[InputFile]) -> Column | None:
        """The rows' order as one long: file, split, number; None where the bits of a long are too few. A
        split begins at a multiple of a length that is no less than the unit."""
        conf = self.spark.conf
        unit = max(1, min(_bytes(conf.get("spark.sql.files.maxPartitionBytes")), _bytes(conf.get("spark.sql.files.openCostInBytes"))))
        low = 40 if self.numbered else 33
        mid = 0 if self.numbered else (max((f.size for f in inputs), default=0) // unit).bit_length()
        if len(inputs).bit_length() + mid + low > 62:
            return None
        at = F.col(AT) if self.numbered else F.col(AT).bitwiseAND(F.lit((1 << 33) - 1))
        split = F.floor(F.col(SPLIT) / unit).cast("long")
        return F.shiftleft(F.col(checks.FILE_ORD), mid + low) + F.shiftleft(split, low) + at

    def seed(self) -> DataFrame | None:
        """The keys of the rows that are there already, by runtime name."""
        if self.mode != "append" or not self.constraints:
            return None
        a, back = self.e.sink.accepted, {o: r for r, o in self.map.output.items()}
        wanted = [self.map.output[c] for c in dict.fromkeys(c for key in self.constraints for c in key)]
        table = self.seeded = self.table()
        found = table.keys(wanted) if table else tables.read_parquet(self.spark, located(self.config, a.path, a.storage))
        return None if found is None else found.select(*[F.col(f"`{c}`").alias(back[c]) for c in wanted if c in found.columns])

    def checked(self, df: DataFrame, order: list[str], seed: DataFrame | None) -> DataFrame:
        flags, self.cheap, self.held = [], True, []
        for i, key in enumerate(self.constraints):
            df, cheap, firsts = unique.with_duplicates_counted(df, key, order, f"__dup_{i}", seed)
            self.cheap = self.cheap and cheap
            self.held += [firsts] if firsts is not None else []
            flags.append((f"__dup_{i}", unique.key_name(key)))
        found = [checks.not_null_error(c) for c in self.required]
        if self.strict:
            found += [F.when(F.col(f"`__raw_{n}`") & F.col(f"`{n}`").isNull(), checks.error("cast_error", n, checks.INVALID)) for n, c in self.columns.items() if casts.canonical(c.type) != "string"]
        found += [F.when(F.col(f), checks.error("unique", n, checks.DUPLICATE_KEY if n.startswith("[") else checks.DUPLICATE)) for f, n in flags]
        if self.strict and self.delimited_:
            found.append(F.when(F.col("__long"), checks.error("schema_error", "*", LONG_ROW)))
        return df.withColumn(checks.ERRORS, checks.gathered(found))

    def output(self, df: DataFrame, extra: list = ()) -> DataFrame:
        out = df.select(*[F.col(f"`{n}`").alias(o) for n, o in self.map.output.items()], *extra)
        rules = {self.map.output[self.map.runtime[p.name]]: (p.strategy, p.mask_pattern if p.strategy == "mask" else p.redact_value) for p in self.e.pii.columns}
        return masks.mask(out, rules)

    # --- writing ---
    def table(self):
        a = self.e.sink.accepted
        path = located(self.config, a.path, a.storage)
        match a.format:
            case "versioned":
                return tables.VersionedTable(self.spark, path)
            case "duckdb":
                return tables.DuckDbTable(self.spark, path, a.duckdb.table, a.duckdb.schema)
            case "delta" | "iceberg":
                bound = catalogs.binding(self.config, self.e)
                table = tables.ConnectorTable(self.spark, path, a.format, bound.table if bound and a.format == "iceberg" else None)
                if bound:
                    catalogs.attach(self.spark, bound)
                return table
        return None

    def write(self, df: DataFrame, out: EntityReport) -> None:
        a = self.e.sink.accepted
        path, table = located(self.config, a.path, a.storage), self.table()
        if table is None:
            parts = [*a.partition_by]
            for p in a.partition_spec:
                column = partitions.transform(p.column, p.transform)
                if p.transform != "identity":
                    df = df.select("*", column)
                parts.append(p.column if p.transform == "identity" else f"{p.column}_{p.transform}")
            if self.mode == "overwrite" or out.accepted:
                n = tables.write_parquet(df, path, self.mode, a.options, parts, out.accepted)
                if n != out.accepted:
                    raise RuntimeError(f"{n} rows were written of {out.accepted} accepted ones")
            out.output = asdict(tables.size_metrics(self.spark, path, a.options.max_size_per_file)) | {"path": path}
            return
        if self.mode == "append" and not out.accepted:
            out.output = {"path": path, "format": a.format}
            return
        old = table.read() if self.mode != "overwrite" else None
        key = [self.map.output[k] for k in self.key]
        options, now = a.merge, F.lit(datetime.datetime.now(datetime.UTC).replace(tzinfo=None)).cast("timestamp_ntz")
        shape = merge.HistoryNames(options.scd2.current_flag_column, options.scd2.valid_from_column, options.scd2.valid_to_column)
        named = lambda listed: [self.map.output[self.map.runtime[c]] for c in listed]
        started = time.time()
        if old is not None:
            system = (shape.is_current, shape.valid_from, shape.valid_to) if self.mode == "merge_scd2" else ()
            evolution = self.e.schema.schema_evolution.mode
            old, out.added_columns = merge.evolve(old, df, evolution, key, system)
            if out.added_columns:
                self.emit({"event": "schema_evolution_applied", "entity": self.e.name, "mode": evolution, "added_columns": out.added_columns})
        m = tables.Merge(key, named(options.ignore_columns), merge.compare_columns(df, key, named(options.compare_columns), named(options.ignore_columns)), now, shape)
        match self.mode:
            case "append":
                table.append(df)
            case "merge_scd1" if old is not None:
                out.merge = table.upsert(old, df, m)
            case "merge_scd2" if old is not None:
                out.merge = table.record(old, df, m)
            case "merge_scd2":
                table.overwrite(merge.history(df, now, shape))
                out.merge = {"inserted": out.accepted, "closed": 0, "unchanged": 0, "rows_before": 0, "rows_after": out.accepted}
            case "merge_scd1":
                table.overwrite(df)
                out.merge = {"inserted": out.accepted, "updated": 0, "rows_before": 0, "rows_after": out.accepted}
            case _:
                table.overwrite(df)
        if a.format == "delta" and (bound := catalogs.binding(self.config, self.e)):
            catalogs.register(self.spark, bound.table, a.format, path)
        if out.merge is not None:
            out.merge["elapsed_ms"] = round((time.time() - started) * 1000)
        out.output = {"path": path, "format": a.format}


def _bytes(text: str) -> int:
    """A size setting: bytes, or with a unit."""
    text = text.strip().lower().removesuffix("b")
    return int(text[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[text[-1]] if text[-1:] in set("kmgt") else int(text)


def ledger(files: Files, config: Config, e: Entity) -> Ledger:
    if e.state.path:
        return Ledger(files, str(Path(config.base, e.state.path)) if "://" not in e.state.path else e.state.path, e.name)
    root = located(config, e.source.path, e.source.storage)
    if not files.is_folder(root):
        root = root.rpartition("/")[0]
    return Ledger(files, joined(root, f"{STATE_FOLDER}/state/{e.name}/state.json"), e.name)


def run_entity(spark: SparkSession, config: Config, e: Entity, run_id: str, full: bool, emit: Observer) -> EntityReport:
    run, out = EntityRun(spark, config, e, full, emit), EntityReport(e.name)
    if full and e.sink.write_mode.startswith("merge_"):
        raise ValueError(f"entity.name={e.name} full refresh is not supported for {e.sink.write_mode}")
    with out.timed("inputs"):
        files = resolve(run.files, config, e)
    book = ledger(run.files, config, e)
    if e.incremental_mode == "file":
        claim = book.claim(run_id, files, full)
        files, out.notes, out.warnings = claim.taken, claim.warnings, len(claim.warnings)
        for w in claim.warnings:
            emit({"event": "log", "level": "warn", "code": "incremental_skip", "entity": e.name, "message": w})
        if not files:
            return out
    try:
        with Heartbeat(book, run_id) if e.incremental_mode == "file" else nullcontext():
            _process(run, files, out, emit)
    except Exception:
        if e.incremental_mode == "file":
            book.release(run_id)
        raise
    if e.incremental_mode == "file":
        book.release(run_id) if out.status == "aborted" else book.commit(run_id, full)
    if e.sink.archive and out.status != "aborted":
        to = located(config, e.sink.archive.path, e.sink.archive.storage)
        with out.timed("archive"):
            for f, r in zip(files, out.files, strict=True):
                r.archived_path = joined(to, archive_name(f, run_id))
                run.files.copy(f.path, r.archived_path)
                run.files.delete(f.path)
    return out


def _process(run: EntityRun, files: list[InputFile], out: EntityReport, emit: Observer) -> None:
    e, severity = run.e, run.e.policy.severity
    rejected_at = located(run.config, e.sink.rejected.path, e.sink.rejected.storage) if e.sink.rejected else None
    reports = [FileReport(f.path) for f in files]
    out.files = reports
    with out.timed("headers"):
        groups, stopped = _headers(run, files, reports, out, rejected_at)
    if groups:
        with out.timed("read"):
            rows = None
            for header, at in groups.items():
                own = run.typed(run.read([(i, files[i].path) for i in at], list(header)))
                rows = own if rows is None else rows.unionByName(own)
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            stopped = _check_and_write(run, rows, files, reports, out, rejected_at) or stopped
        finally:
            rows.unpersist()
    elif run.mode == "overwrite":
        empty = run.spark.createDataFrame([], ", ".join(f"`{n}` {casts.spark_type(c.type).simpleString()}" for n, c in run.columns.items()))
        run.write(run.output(empty), out)
    out.rows, out.accepted, out.rejected = (sum(getattr(r, k) for r in reports) for k in ("rows", "accepted", "rejected"))
    out.warnings += sum(r.warnings for r in reports)
    out.errors = sum(v["violations"] for r in reports for v in r.rules) + sum(r.error is not None for r in reports)
    statuses = {r.status for r in reports}
    out.status = "aborted" if stopped or "aborted" in statuses else "rejected" if "rejected" in statuses else "success_with_warnings" if out.warnings else "success"
    for r in reports:
        emit({"event": "file_finished", "entity": e.name, "file": r.path, "status": r.status, "rows": r.rows, "accepted": r.accepted, "rejected": r.rejected})


def _headers(run: EntityRun, files: list[InputFile], reports: list[FileReport], out: EntityReport, rejected_at: str | None) -> tuple[dict[tuple[str, ...], list[int]], bool]:
    """The files that are read, by their columns, and whether one of the others ends the entity."""
    e, severity, groups = run.e, run.e.policy.severity, {}
    for i, (header, r) in enumerate(zip(run.headers(files), reports, strict=True)):
        run.emit({"event": "file_started", "entity": e.name, "file": r.path})
        if isinstance(header, ValueError):
            r.status, r.error = ("aborted" if severity == "abort" else "rejected"), str(header)
        else:
            found = run.compared() if e.source.format in ("fixed", "xml") else [names.normalize_name(h, run.strategy) for h in header]
            plan = mismatch.plan_mismatch(run.compared(), found, e.schema.mismatch.missing_columns, e.schema.mismatch.extra_columns, severity)
            r.mismatch, r.warnings = {"missing": plan.missing[: mismatch.REPORTED], "extra": plan.extra[: mismatch.REPORTED], "action": plan.action}, plan.warnings
            if plan.rejected or plan.aborted:
                r.status, r.error = ("aborted" if plan.aborted else "rejected"), plan.message
            else:
                groups.setdefault(tuple(header), []).append(i)
        if r.status != "success":
            keep_raw(run, out, rejected_at, r)
        if r.status == "aborted":
            for later in reports[i + 1 :]:
                later.status = "skipped"
            return groups, True
    return groups, False


def _check_and_write(run: EntityRun, rows: DataFrame, files: list[InputFile], reports: list[FileReport], out: EntityReport, rejected_at: str | None) -> bool:
    """Whether the entity was stopped."""
    e, severity, stopped, place_of = run.e, run.e.policy.severity, False, run.place(files)
    read = rows
    if e.source.format in WHOLE_FILE:
        with out.timed("read"):
            bad = {r[0]: r[1] for r in rows.where("__error IS NOT NULL").groupBy(checks.FILE_ORD).agg(F.min("__error")).collect()}  # a row a file
        for i, problem in sorted(bad.items()):
            reports[i].status, reports[i].error = ("aborted" if severity == "abort" else "rejected"), problem
            keep_raw(run, out, rejected_at, reports[i])
        if bad and severity == "abort":
            stopped = True
            rows = rows.where(F.col(checks.FILE_ORD) < min(bad))
        elif bad and len(bad) <= LISTED:
            rows = rows.where(~F.col(checks.FILE_ORD).isin(*bad))
        elif bad:
            rows = rows.join(run.spark.createDataFrame([(i,) for i in bad], f"{checks.FILE_ORD} long"), checks.FILE_ORD, "left_anti")
        rows = rows.drop("__error")
    order = [checks.FILE_ORD, SPLIT, AT]
    if run.constraints and place_of is not None:
        rows, order = rows.withColumn("__place", place_of), ["__place"]
    with out.timed("checks"):
        seed = run.seed()
        checked = run.checked(rows, order, seed)
        if severity == "abort":
            checked = policy.only_casts_where_aborted(checked)
        if not run.cheap:
            checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
        forced = F.col(f"__dup_{run.constraints.index(tuple(run.key))}") if run.key and run.mode.startswith("merge_") else None
        routed = policy.route(checked, severity, forced)
        stopped = stopped or routed.stopped is not None
        any_errors = _count(checked, routed, forced, reports, severity)
    try:
        with out.timed("reports"):
            _constraints(run, checked, seed, any_errors, out)
        if any_errors and rejected_at:  # first: an append changes the table that the rows were checked against
            with out.timed("rejected"):
                _write_errors(run, routed, read, reports, out, rejected_at)
        out.accepted = sum(r.accepted for r in reports)
        with out.timed("write"):
            run.write(run.output(routed.accepted), out)
    finally:
        for held in [checked, *run.held]:
            held.unpersist()
        if isinstance(run.seeded, tables.DuckDbTable):
            run.seeded.release()
    return stopped


def _constraints(run: EntityRun, checked: DataFrame, seed: DataFrame | None, any_errors: bool, out: EntityReport) -> None:
    """Each constraint's figures; nothing is computed where no row has errors."""
    for i, key in enumerate(run.constraints):
        flag = f"__dup_{i}"
        stats = unique.unique_stats(checked, key, flag).first().asDict() if any_errors else {"duplicates": 0, "affected_keys": 0}
        there = unique.taken_count(checked, key, flag, seed) if seed is not None and stats["duplicates"] else 0
        samples = [r.asDict() for r in unique.unique_samples(checked, key, flag).collect()] if stats["duplicates"] and not run.e.pii.columns else []
        effect = EFFECTS[run.e.policy.severity] if stats["duplicates"] else "none"
        out.unique.append({"columns": list(key), **stats, "target_duplicates": there, "batch_duplicates": stats["duplicates"] - there, "effect": effect, "samples": samples})


def _write_errors(run: EntityRun, routed: policy.Routed, read: DataFrame, reports: list[FileReport], out: EntityReport, rejected_at: str) -> None:
    """The rejected rows as CSV; where rows with errors stay or their file goes, a report of them."""
    e, severity = run.e, run.e.policy.severity
    formatter = run.config.report.formatter if run.config.report else "json"
    sources = {n: c.source for n, c in run.columns.items() if c.source}

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn(checks.ROW, F.col(AT)) if run.numbered else with_row_index(df, read)

    errors = checks.format_errors(F.col(checks.ERRORS), formatter, sources or None).alias(checks.ERRORS)
    if severity != "abort" and (n := sum(r.rejected for r in reports if r.error is None)):
        rejected = run.output(numbered(routed.rejected), [F.col(checks.ROW).alias(checks.ROW_INDEX), errors])
        found = tables.write_rejected(rejected, rejected_at, "overwrite" if run.mode == "overwrite" else "append")
        if found != n:
            raise RuntimeError(f"{found} rows were written of {n} rejected ones")
    if severity != "reject" and any(r.rules for r in reports):
        out.errors_path = f"{rejected_at.rstrip('/')}_errors"
        stems = run.spark.createDataFrame([(i, f"{i}_{PurePosixPath(r.path).stem}") for i, r in enumerate(reports) if r.rules], f"{checks.FILE_ORD} long, file string")
        own = numbered(routed.error_rows).join(stems, checks.FILE_ORD).select("file", F.col(checks.ROW).alias("row_index"), errors.alias("errors"))
        own.write.mode("overwrite").partitionBy("file").json(out.errors_path)
    for r in reports:
        if r.status == "aborted" and r.error is None:
            keep_raw(run, out, rejected_at, r)


def _count(checked: DataFrame, routed: policy.Routed, forced, reports: list[FileReport], severity: str) -> bool:
    """Fills in the files' figures; whether any row has errors."""
    any_errors = False
    out_of = F.size(checks.ERRORS) > 0 if severity != "warn" else F.lit(False)
    if forced is not None:
        out_of = out_of | F.coalesce(forced, F.lit(False))
    for r in checked.groupBy(checks.FILE_ORD).agg(F.count("*").alias("n"), F.count_if(out_of).alias("bad"), F.count_if(F.size(checks.ERRORS) > 0).alias("with_errors")).collect():  # a row a file
        i = r[checks.FILE_ORD]
        any_errors = any_errors or r["with_errors"] > 0
        if routed.stopped is not None and i > routed.stopped:
            reports[i].status = "skipped"
            continue
        f = reports[i]
        f.rows = r["n"]
        f.rejected = r["n"] if i == routed.stopped else r["bad"]
        f.accepted = f.rows - f.rejected
        if i == routed.stopped:
            f.status = "aborted"
        elif severity == "reject" and f.rejected:
            f.status = "rejected"
    for r in report.rule_summary(checked).collect() if any_errors else []:  # a row a file, rule and column
        f = reports[r[checks.FILE_ORD]]
        if f.status != "skipped":
            f.rules.append({"rule": r["rule"], "column": r["column"], "violations": r["violations"]})
            if severity == "warn":
                f.warnings += r["violations"]
    for f in reports:
        f.rules.sort(key=lambda x: (report.RULES.index(x["rule"]), x["column"]))
    return any_errors


def keep_raw(run: EntityRun, out: EntityReport, rejected_at: str | None, r: FileReport) -> None:
    """A byte copy of a file that is rejected as a whole; none where columns are masked, as no mask can be
    laid over raw bytes."""
    if not rejected_at:
        return
    if run.e.pii.columns:
        note = f"{r.path}: rejected, not copied to sink.rejected, because its personal data can't be masked"
        out.notes.append(note)
        out.warnings += 1
        run.emit({"event": "log", "level": "warn", "code": "pii_file_error_drop", "entity": run.e.name, "file": r.path, "message": note})
        return
    r.rejected_path = joined(rejected_at, PurePosixPath(r.path).name)
    run.files.copy(r.path, r.rejected_path)


def run(spark: SparkSession, path: str, entities: list[str] | None = None, profile: str | None = None, variables: dict[str, str] | None = None, run_id: str | None = None, full_refresh: bool = False, dry_run: bool = False, observer: Observer | None = None, config: Config | None = None) -> Outcome:
    """All entities of the contract at path, in order, or those named."""
    importable(spark)
    config = config or load(path, load_profile(profile) if profile else None, variables)
    configure(spark, config)
    run_id = run_id or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    lineage = Emitter(config.lineage, run_id) if config.lineage else None

    def emit(event: dict[str, Any]) -> None:
        event = {"run_id": run_id, "ts_ms": round(1000 * time.time()), **event}
        if observer:
            observer(event)

    chosen = [e for e in config.entities if not entities or e.name in entities]
    if entities and (unknown := set(entities) - {e.name for e in chosen}):
        raise ValueError(f"unknown entities: {sorted(unknown)}")
    if dry_run:
        previews = [{"entity": e.name, "files": [f.path for f in resolve(Files(spark), config, e)], "write_mode": e.sink.write_mode, "accepted": located(config, e.sink.accepted.path, e.sink.accepted.storage)} for e in chosen]
        return Outcome(run_id, "success", 0, [], previews)
    started = datetime.datetime.now(datetime.UTC)
    emit({"event": "run_started", "config": str(path)})
    done: list[EntityReport] = []
    for e in chosen:
        emit({"event": "entity_started", "entity": e.name})
        if lineage:
            lineage.start(e)
        try:
            done.append(run_entity(spark, config, e, run_id, full_refresh, emit))
        except Exception as x:
            done.append(EntityReport(e.name, "failed", notes=[f"{type(x).__name__}: {_cause(x)}"]))
        if lineage:
            lineage.finish(e, done[-1].status)
        emit({"event": "entity_finished", "entity": e.name, **_totals([done[-1]]), "status": done[-1].status})
        _write_report(spark, config, run_id, done[-1])
        if done[-1].status in ("aborted", "failed"):
            break
    rank = ["success", "success_with_warnings", "rejected", "aborted", "failed"]
    status = max((r.status for r in done), key=rank.index, default="success")
    out = Outcome(run_id, status, EXIT[status], done)
    summary = _write_summary(spark, config, path, out, started)
    emit({"event": "run_finished", "status": status, "exit_code": out.exit_code, **_totals(done), "summary": summary})
    return out


def _cause(x: Exception) -> str:
    """What went wrong, in the words of the innermost cause that has some."""
    java = getattr(x, "java_exception", None)
    while java is not None and java.getCause() is not None:
        java = java.getCause()
    lines = [s.strip() for s in (java.toString() if java is not None else str(x)).splitlines() if s.strip()]
    return " ".join(lines[:5])


def _totals(done: list[EntityReport]) -> dict[str, int]:
    files = [f for r in done for f in r.files]
    return {"files": len(files), "files_skipped": sum(f.status == "skipped" for f in files), **{k: sum(getattr(r, k) for r in done) for k in ("rows", "accepted", "rejected", "warnings", "errors")}}


def _report_folder(config: Config, run_id: str) -> str:
    return joined(located(config, config.report.path, config.report.storage), f"run_{run_id}")


def _write_report(spark: SparkSession, config: Config, run_id: str, r: EntityReport) -> None:
    if config.report:
        Files(spark).write(joined(_report_folder(config, run_id), f"{r.entity}/run.json"), json.dumps(asdict(r), indent=2, default=str))


def _write_summary(spark: SparkSession, config: Config, path: str, out: Outcome, started: datetime.datetime) -> str | None:
    if not config.report:
        return None
    ended = datetime.datetime.now(datetime.UTC)
    data = {"tool": {"name": "tidegate", "version": __version__}, "run": {"run_id": out.run_id, "started_at": started.isoformat(), "finished_at": ended.isoformat(), "duration_ms": round((ended - started).total_seconds() * 1000), "status": out.status, "exit_code": out.exit_code}, "config": {"path": str(path), "version": config.version}, "results": _totals(out.entities), "entities": [{"name": r.entity, "status": r.status, "rows": r.rows, "accepted": r.accepted, "rejected": r.rejected} for r in out.entities]}
    at = joined(_report_folder(config, out.run_id), "run.summary.json")
    Files(spark).write(at, json.dumps(data, indent=2, default=str))
    return at
