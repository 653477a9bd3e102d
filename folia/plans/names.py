"""Names and values of the query language: node-name normalisation, node paths, wildcards."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings before which an all-lower-case node name gets its hyphen. The first that fits counts.
NAME_ENDINGS = (
    "proposition", "registration", "definition", "reference", "statement", "structure", "attribute", "relation", "function", "arguments", "argument", "selector", "adjective",
    "variable", "variables", "pattern", "formula", "cluster", "functor", "numeral", "term", "type", "mode", "item", "block",
)
# Attributes by their names in queries, and the keys they have in documents.
ATTRIBUTE_KEYS = {
    "absoluteconstrmmlid": ("absoluteconstrMMLId", "absoluteconstrmmlid"),
    "absolutenr": ("absolutenr",),
    "absoluteorigconstrmmlid": ("absoluteorigconstrMMLId", "absoluteorigconstrmmlid"),
    "absoluteorigpatternmmlid": ("absoluteorigpatternMMLId", "absoluteorigpatternmmlid"),
    "absolutepatternmmlid": ("absolutepatternMMLId", "absolutepatternmmlid"),
    "arity": ("arity",),
    "constr": ("constr",),
    "formatdes": ("formatdes",),
    "formatnr": ("formatnr",),
    "kind": ("kind",),
    "mmlid": ("MMLId", "mmlid"),
    "occurs": ("occurs",),
    "origconstrnr": ("origconstrnr",),
    "origpatternnr": ("origpatternnr",),
    "patternnr": ("patternnr",),
    "position": ("position",),
    "spelling": ("spelling",),
    "xmlid": ("xmlid",),
}


class QueryError(ValueError):
    """A query that cannot be parsed or evaluated."""


@dataclass(frozen=True)
class Path:
    """Segments, and between them steps: a number of levels, or None for any number."""

    segments: tuple[str, ...]
    steps: tuple[int | None, ...]


_STEP = re.compile(r"/(?:/|(\d+)/)?")


def parse_path(text: str) -> Path | None:
    """A/B, A//B, A/3/B and chains of these; None for anything else."""
    segments, steps, at = [], [], 0
    while m := _STEP.search(text, at):
        segments.append(text[at : m.start()].strip())
        steps.append(int(m[1]) if m[1] else None if m[0] == "//" else 1)
        at = m.end()
    segments.append(text[at:].strip())
    if not steps or "" in segments or 0 in steps:
        return None
    return Path(tuple(segments), tuple(steps))


def _normal_segment(name: str) -> str:
    name = name.strip()
    if "*" in name or "_" in name:
        return name.lower()
    if "-" not in name:
        name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1-\2", name)
        name = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name)
    if "-" not in name and name == name.lower():
        for ending in NAME_ENDINGS:
            if len(name) > len(ending) + 1 and name.endswith(ending):
                name = f"{name[: -len(ending)]}-{ending}"
                break
    return name.lower()


def normal_name(name: str) -> str:
    """InfixTerm, infixterm and Infix-Term become infix-term; each segment of a path on its own."""
    path = parse_path(name.strip())
    if path is None:
        return _normal_segment(name)
    out = _normal_segment(path.segments[0])
    for step, segment in zip(path.steps, path.segments[1:], strict=True):
        out += {None: "//", 1: "/"}.get(step, f"/{step}/") + _normal_segment(segment)
    return out


def _units(text: str) -> list[tuple[str, bool]]:
    """Characters, each with whether a backslash stood before it; a last lone backslash is a character."""
    return [(m[1], True) if m[1] else (m[0], False) for m in re.finditer(r"\\(.)|.", text, re.S)]


def is_pattern(value: str) -> bool:
    """Whether * or _ stands in it without a backslash."""
    return any(c in "*_" and not escaped for c, escaped in _units(value))


def like_pattern(value: str) -> str:
    """The LIKE pattern, with \\ as its escape, that a wildcard value means."""
    out = []
    for c, escaped in _units(value):
        if not escaped and c in "*_":
            out.append("%" if c == "*" else "_")
        else:
            out.append("\\" + c if c in "%_\\" else c)
    return "".join(out)


def literal(value: str) -> str:
    """A value without wildcards: \\*, \\_, \\\\ and \\% stand for the character, other backslashes for themselves."""
    return "".join(c if not escaped or c in "*_\\%" else "\\" + c for c, escaped in _units(value))


def matches(column: Column, value: str) -> Column:
    """Whether a lower-cased column equals the value, or fits it if it is a pattern; case does not count."""
    wanted = value.strip().lower()
    lowered = F.lower(F.coalesce(column, F.lit("")))
    if is_pattern(wanted):
        return lowered.like(like_pattern(wanted))
    return lowered == literal(wanted)
