r"""Chat formatting: records of unlike layouts become canonical turns, and turns one template.

A layout is known by its schema's fingerprint: the hash of its sorted nested field paths ("messages[].role"),
of those that some layout names; other fields (ids, sources, scores) carry no turn and don't change it.
The fingerprint selects a declarative mapping, which says where the turns are; no code is written for a
layout. That holds for JSON records, by record, and for tables, by schema. Records whose fingerprint is
unknown come out as such and are not guessed at.

The template marks a turn as `### role: text</turn>` and a line break. Inside roles and texts a backslash
is doubled, each # of three or more in a row gets a backslash, `</turn>` becomes `<\/turn>`; in roles
also colons and line breaks are written with backslashes. So marks never occur inside, and a backslash
always gives the next character back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .common import batches, importable

TURN = "conv_id long, turn long, role string, text string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fingerprint", pa.string())])
_MARKED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


# --- layouts --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Mapping:
    """before: top-level (field, role) pairs whose texts, unless empty, come first. each: the path of the
    list of turns, with its role and text fields (a text that is a list of parts is their `part` fields,
    joined by line breaks); or, where each is empty, fixed: (field, role) pairs in order; texts of one
    role that follow each other are joined by a blank line."""

    each: str = ""
    role: str = "role"
    text: str = "content"
    part: str = "text"
    before: tuple[tuple[str, str], ...] = ()
    fixed: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """The field paths that a record of the layout has, those it may have, and its mapping."""

    paths: tuple[str, ...]
    mapping: Mapping
    may: tuple[str, ...] = ()

    def forms(self) -> Iterator[frozenset[str]]:
        for n in range(len(self.may) + 1):
            for extra in combinations(self.may, n):
                yield frozenset((*self.paths, *extra))


def _key(name: str) -> str:
    """A field's name in a path: marks of paths inside it are escaped, so that no name forges a path."""
    return re.sub(r"([\\.\[\]{}])", r"\\\1", name)


def paths(value: object) -> set[str]:
    """The field paths of a JSON value; a list adds []. Values may be nested as deep as they like."""
    out: set[str] = set()
    todo = [(value, "")]
    while todo:
        now, at = todo.pop()
        if isinstance(now, dict) and now:
            todo += [(v, f"{at}.{_key(k)}" if at else _key(k)) for k, v in now.items()]
        elif isinstance(now, list):
            todo += [(v, at + "[]") for v in now] or [(None, at + "[]")]
        elif at:
            out.add(at)
    return out


def schema_paths(schema: StructType) -> set[str]:
    """The same of a table's schema; a map, whose keys aren't known, adds {}."""
    out: set[str] = set()
    todo: list[tuple[DataType, str]] = [(schema, "")]
    while todo:
        now, at = todo.pop()
        if isinstance(now, StructType):
            todo += [(f.dataType, f"{at}.{_key(f.name)}" if at else _key(f.name)) for f in now]
        elif isinstance(now, ArrayType):
            todo.append((now.elementType, at + "[]"))
        else:
            out.add(at + "{}" * isinstance(now, MapType))
    return out


def fingerprint(fields: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


#: Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
_PARTS = ("messages[].content[].type", "messages[].content[].text")
LAYOUTS: list[Layout] = [
    Layout(("messages[].role", "messages[].content"), Mapping("messages", before=(("system", "system"),)), ("system", *_PARTS)),
    Layout(("messages[].role", *_PARTS), Mapping("messages", before=(("system", "system"),)), ("system",)),
    Layout(("conversations[].from", "conversations[].value"), Mapping("conversations", "from", "value", before=(("system", "system"),)), ("system",)),
    Layout(("turns[].speaker", "turns[].text"), Mapping("turns", "speaker", "text")),
    Layout(("instruction", "output"), Mapping(before=(("system", "system"),), fixed=(("instruction", "user"), ("input", "user"), ("output", "assistant"))), ("system", "input")),
    Layout(("prompt", "response"), Mapping(before=(("system", "system"),), fixed=(("prompt", "user"), ("response", "assistant"))), ("system",)),
    Layout(("prompt", "completion"), Mapping(before=(("system", "system"),), fixed=(("prompt", "user"), ("completion", "assistant"))), ("system",)),
    Layout(("question", "answer"), Mapping(before=(("system", "system"),), fixed=(("question", "user"), ("answer", "assistant"))), ("system",)),
]
MAPPINGS = {fingerprint(form): layout.mapping for layout in LAYOUTS for form in layout.forms()}
#: What the layouts name; a record's other paths don't enter its fingerprint.
KNOWN = frozenset(p for layout in LAYOUTS for p in (*layout.paths, *layout.may))
#: Layouts of tables with a row a turn: their columns, as (conversation, turn, role, text).
TABLE_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "position", "speaker", "content"))
TABLES = {fingerprint(fields): fields for fields in TABLE_LAYOUTS}
KNOWN_COLUMNS = frozenset(c for fields in TABLE_LAYOUTS for c in fields)


def _word(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: object) -> tuple[str, list[tuple[str, str]] | None]:
    """The fingerprint of a JSON record and its (role, text) turns; None if no mapping has it."""
    mark = fingerprint(paths(record) & KNOWN)
    mapping = MAPPINGS.get(mark)
    if mapping is None or not isinstance(record, dict):
        return mark, None
    out = [(role, text) for name, role in mapping.before if (text := _word(record.get(name)))]
    if mapping.each:
        turns = record.get(mapping.each)
        if not isinstance(turns, list) or not all(isinstance(t, dict) for t in turns):
            return mark, None
        for t in turns:
            text = t.get(mapping.text)
            if isinstance(text, list) and all(isinstance(x, dict) for x in text):
                text = "\n".join(_word(x[mapping.part]) for x in text if mapping.part in x)
            role = _word(t.get(mapping.role))
            out.append((ALIASES.get(role.lower(), role), _word(text)))
        return mark, out
    first = len(out)
    for name, role in mapping.fixed:
        text = _word(record.get(name))
        if len(out) > first and out[-1][0] == role:
            out[-1] = role, "\n\n".join(x for x in (out[-1][1], text) if x)
        else:
            out.append((role, text))
    return mark, out


def _records(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for conv, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            try:
                mark, found = turns_of(json.loads(raw or "null"))
            except (ValueError, RecursionError):  # malformed, or nested deeper than the parser goes
                mark, found = "not json", None
            rows += [(conv, i, role, text, mark) for i, (role, text) in enumerate(found)] if found else [(conv, None, None, None, mark)]
        cols = list(zip(*rows, strict=True)) or [[] for _ in _TURNS]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _TURNS, strict=True)], schema=_TURNS)


def turns_from_records(records: DataFrame) -> DataFrame:
    """records (conv_id, record: JSON text) -> conv_id, turn, role, text, fingerprint.

    Null, malformed, unknown and turnless records give one row with null turn, role and text."""
    importable(records.sparkSession)
    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(_records, TURN + ", fingerprint string")


def turns_from_table(table: DataFrame) -> DataFrame:
    """A table -> conv_id, turn, role, text. The fingerprint of its schema's nested paths selects the
    mapping: of a row a turn, or of a row a conversation in one of the records' layouts, with conv_id.
    Columns that no layout names don't matter, whatever they are called. ValueError if none has it."""
    found = schema_paths(table.schema)
    fields = TABLES.get(fingerprint(found & KNOWN_COLUMNS))
    if fields is not None:
        conv, turn, role, text = fields
        return table.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    if "conv_id" in found and fingerprint(found & KNOWN) in MAPPINGS:
        tops = [f"`{c}`" for c in table.columns if any(p == _key(c) or p.startswith((_key(c) + ".", _key(c) + "[")) for p in found & KNOWN)]
        record = F.to_json(F.struct(*tops), {"ignoreNullFields": "false"})
        return turns_from_records(table.select("conv_id", record.alias("record"))).drop("fingerprint")
    raise ValueError(f"no layout for columns {sorted(table.columns)}")


# --- the template ---------------------------------------------------------------------------------
_HASHES = re.compile("#{3,}")
_MARK = re.compile(r"### ((?:[^\\:\n]|\\.)*): (.*?)</turn>\n", re.DOTALL)
_PAIR = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>")
    return _HASHES.sub(lambda m: "\\#" * len(m[0]), text)


def unescape(text: str) -> str:
    return _PAIR.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\n")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text begins and ends in it."""
    head, body = f"### {escape_role(role)}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; ValueError where it isn't one marked turn after another."""
    out, at = [], 0
    while at < len(formatted):
        m = _MARK.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), _PAIR.sub(lambda p: p[1], m[2])))
        at = m.end()
    return out


def _format(learn: frozenset[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [format_turn(role or "", text or "") for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
            masked = [role in learn for role in part.column("role").to_pylist()]
            yield batches({n: part.column(n) for n in ("conv_id", "turn", "role", "text")} | {"formatted": [r[0] for r in rows], "loss_start": [r[1] if m else None for r, m in zip(rows, masked, strict=True)], "loss_end": [r[2] if m else None for r, m in zip(rows, masked, strict=True)]}, _MARKED)

    return run


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, text) with formatted, and the loss mask: loss_start and loss_end, code
    points into formatted, null where nothing is learned. A conversation's text is its turns' formatted
    texts in order, so nothing of a conversation is gathered here. Null roles and texts read as empty.
    """
    importable(turns.sparkSession)
    turns = turns.select("conv_id", "turn", "role", "text")
    return turns.mapInArrow(_format(frozenset(learn)), TURN + ", formatted string, loss_start long, loss_end long")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and turn. Digests are fed turn by turn, so a conversation is never held."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now: list | None = None
    for part in parts:
        done = []
        cols = (part.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
        for conv, formatted, start, end in zip(*cols, strict=True):
            if now is None or now[0] != conv:
                if now:
                    done.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                learned = _PAIR.sub(lambda p: p[1], formatted[start:end])
                now[3] += len(learned)
                now[4].update(learned.encode("utf-8", "surrogatepass"))
            now[5] += len(formatted)
        yield _digests(done, schema)
    if now:
        yield _digests([now], schema)


def _digests(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*([r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows), strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from formatted turns alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Turns go by turn, nulls first, then by their formatted text; repeated rows are turns of their own.
    Rows without conv_id are one conversation. An empty table gives no rows.
    """
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return rows.mapInArrow(_read_back, DIGESTS)
