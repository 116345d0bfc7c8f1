"""Selectors: `a.b[0].c` into JSON, `a.b/@x` into XML."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def json_path(selector: str) -> str:
    """The path for Spark's variant functions; ValueError for a malformed selector."""
    if not re.fullmatch(r"[^.\[\]]+(\[\d+\])*(\.[^.\[\]]+(\[\d+\])*)*", selector):
        raise ValueError(f"malformed selector: {selector!r}")
    return "$" + "".join(f"[{m[2]}]" if m[2] else "['" + m[1].replace("'", "\\'") + "']" for m in _STEP.finditer(selector))


def select_json(value: Column, selector: str) -> tuple[Column, Column]:
    """From a variant: the text at the selector, and whether an object or array is there. A missing key
    or index, a wrong container and JSON null are null; containers are their compact JSON."""
    path = json_path(selector)
    found = F.try_variant_get(value, path, "variant")
    container = F.coalesce(F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    text = F.when(container, F.to_json(found)).otherwise(F.try_variant_get(value, path, "string"))
    return text, container


def xml_steps(selector: str) -> tuple[list[str], str | None]:
    """Element names and the attribute, if the last step is one."""
    steps = re.split(r"[./]", selector)
    attribute = steps.pop()[1:] if steps[-1].startswith("@") else None
    if any(not s or s.startswith("@") for s in steps) or attribute == "":
        raise ValueError(f"malformed selector: {selector!r}")
    return steps, attribute
