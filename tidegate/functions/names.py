"""Column names: the contract's, the runtime's (for matching and checks) and the output's."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

STRATEGIES = ("snake_case", "lower", "camel_case", "none")


class NameCollision(ValueError):
    """Two columns that normalise alike."""


def words(name: str) -> list[str]:
    """ASCII words: cut at other characters, at a capital after a small letter or digit, and before
    the last capital of a run that a small letter follows."""
    out: list[str] = []
    for run in re.split(r"[^A-Za-z0-9]+", name):
        cut = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", run)
        out += cut.split()
    return out


def normalize_name(name: str, strategy: str | None) -> str:
    found = words(name)
    match strategy:
        case None | "none":
            return name
        case "snake_case":
            return "_".join(w.lower() for w in found)
        case "lower":
            return "".join(w.lower() for w in found)
        case "camel_case":
            return "".join(w.lower() if i == 0 else w[:1].upper() + w[1:].lower() for i, w in enumerate(found))
    raise ValueError(f"unsupported normalization strategy: {strategy}")


def normalize_all(names: Iterable[str], strategy: str | None) -> list[str]:
    """Runtime names in order; NameCollision if two are equal."""
    seen: dict[str, str] = {}
    for name in names:
        new = normalize_name(name, strategy)
        if new in seen:
            raise NameCollision(f"columns {seen[new]!r} and {name!r} both normalize to {new!r}")
        seen[new] = name
    return list(seen)


@dataclass(frozen=True)
class NameMap:
    """schema name -> runtime name, runtime name -> output name."""

    runtime: dict[str, str]
    output: dict[str, str]

    @classmethod
    def of(cls, columns: Iterable[tuple[str, str | None]], strategy: str | None) -> NameMap:
        """columns: (name, source selector or None)."""
        runtime, output = {}, {}
        for name, source in columns:
            new = normalize_name(source or name, strategy) if not (source and re.search(r"[.\[/@]", source)) else source
            if new in output:
                raise NameCollision(f"columns of the contract collide on {new!r}")
            runtime[name] = new
            output[new] = name if source else normalize_name(name, strategy)
        if len(set(output.values())) < len(output):
            raise NameCollision("output columns collide")
        return cls(runtime, output)
