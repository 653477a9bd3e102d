"""What a query says, as a tree."""

from __future__ import annotations

from dataclasses import asdict, dataclass, is_dataclass


class Query:
    pass


class Operation:
    pass


@dataclass(frozen=True)
class NodePredicate:
    """A node name or path with an optional attribute test; `adjective` marks the negated-adjective form."""

    name: str
    attribute: str | None = None
    value: str | None = None
    negated: bool = False
    adjective: bool = False


@dataclass(frozen=True)
class ListQuery(Query):
    """type: theorems, definitions, statements, registrations, symbols, occurrences or all; source None is any article."""

    type: str
    source: str | None = None
    spelling: str | None = None


@dataclass(frozen=True)
class ArticleQuery(Query):
    article: str


@dataclass(frozen=True)
class ScopedQuery(Query):
    """scope: item or proposition."""

    query: Query
    scope: str
    predicates: tuple[NodePredicate, ...]


@dataclass(frozen=True)
class NotQuery(Query):
    query: Query


@dataclass(frozen=True)
class SetQuery(Query):
    """operator: and, or, butnot."""

    operator: str
    left: Query
    right: Query


@dataclass(frozen=True)
class PipeQuery(Query):
    query: Query
    operation: Operation


@dataclass(frozen=True)
class Navigate(Operation):
    """relation: ref, occur, definition, notation, redef, origin, copy, termtype ref, deftype ref, main mode, main functor."""

    relation: str


@dataclass(frozen=True)
class Filter(Operation):
    criteria: str


@dataclass(frozen=True)
class Grep(Operation):
    pattern: str


@dataclass(frozen=True)
class SelectNodes(Operation):
    target: NodePredicate
    predicates: tuple[NodePredicate, ...] = ()


@dataclass(frozen=True)
class Reverse(Operation):
    word: str = "reverse"


@dataclass(frozen=True)
class NumericFilter(Operation):
    """comparator: eq, ge, le, gt, lt."""

    comparator: str
    number: int


@dataclass(frozen=True)
class RelationCount(Operation):
    comparator: str
    relation: str
    number: int


@dataclass(frozen=True)
class NodeCount(Operation):
    comparator: str
    scope: str
    name: str
    number: int


def to_dict(node) -> dict:
    """The tree as plain values, each node with its type, for JSON."""
    if is_dataclass(node):
        return {"node": type(node).__name__, **{k: to_dict(getattr(node, k)) for k in asdict(node)}}
    return [to_dict(x) for x in node] if isinstance(node, tuple) else node
