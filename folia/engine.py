"""The entry point: queries over a library."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from folia.plans import ast
from folia.plans.compiler import Compiler
from folia.plans.library import Library
from folia.plans.names import ATTRIBUTE_KEYS, QueryError
from folia.plans.paging import Page, PageRequest, list_page, result_page
from folia.plans.parser import KEYWORDS, parse
from folia.plans.projection import item_fragment, project
from folia.plans.rows import ROW

# Queries that a fresh session runs to load code and tables.
WARM_UP = ("list of theorem", "list of all")


@dataclass
class Result:
    """What execute() returns; to_dict() is the response of a service."""

    query: str
    ast: dict
    description: str
    page: Page
    request: PageRequest
    items: list[dict] = field(default_factory=list)
    timing: dict[str, int] = field(default_factory=dict)

    def to_dict(self) -> dict:
        r = self.request
        return {
            "query": self.query, "ast": self.ast, "description": self.description, "count": self.page.count, "page": self.page.page, "size": self.page.size, "sortBy": r.sort_by,
            "sortDirection": "desc" if r.falling else "asc", "filter": r.needle, "returnedCount": len(self.items), "items": self.items, "timing": self.timing,
        }


class Engine:
    def __init__(self, spark: SparkSession, library: Library, *, occur_items: bool = False):
        self.spark, self.library, self.compiler = spark, library, Compiler(library, occur_items=occur_items)

    def query(self, text: str, *, ordered: bool = False) -> DataFrame:
        """All rows of a query, as one lazy plan; sorted only if asked for."""
        rows = self.compiler.rows(parse(text))
        return rows.sorted() if ordered else rows.df.select(*ROW)

    def page(self, text: str, request: PageRequest | None = None) -> Page:
        tree, request = parse(text), request or PageRequest()
        rows = self.compiler.rows(tree)
        return list_page(tree, rows, request) if isinstance(tree, ast.ListQuery) else result_page(rows, request, lambda df: project(self.library, df))

    def execute(self, text: str, page: int | None = None, size: int | None = None, sort_by: str | None = None, direction: str | None = None, filter: str | None = None) -> Result:
        """One page, projected, as plain dictionaries, with the time of each step in milliseconds.

        Unless a filter or sort key needs them all, only the rows of the page are projected.
        """
        request, clock = PageRequest(page, size, sort_by, direction, filter), [time.perf_counter()]
        tree = parse(text)
        clock.append(time.perf_counter())
        found = self.page(text, request)
        clock.append(time.perf_counter())
        frame = found.frame if found.projected else project(self.library, found.frame)
        rows = frame.orderBy("position").collect()
        items = [{k: v for k, v in r.asDict().items() if k != "position" and k[0] != "_" and (v is not None or k not in ("spelling", "occurrences"))} for r in rows]
        clock.append(time.perf_counter())
        steps = dict(zip(("parseMs", "executeMs", "projectionMs"), (round(1000 * (b - a)) for a, b in zip(clock, clock[1:], strict=False)), strict=True))
        return Result(text, ast.to_dict(tree), describe(tree), found, request, items, steps | {"totalMs": round(1000 * (clock[-1] - clock[0]))})

    def fragment(self, item_id: str) -> dict | None:
        return item_fragment(self.library, item_id)

    def warm_up(self, queries: tuple[str, ...] = WARM_UP) -> list[dict]:
        """Run queries for their side effects; a failure is reported, not raised."""
        out = []
        for q in queries:
            try:
                r = self.execute(q, size=1)
                out.append({"query": q, "success": True, "count": r.page.count, **r.timing})
            except (QueryError, ValueError) as e:
                out.append({"query": q, "success": False, "error": str(e)})
        return out

    def syntax(self) -> dict:
        """The words of the language, and the tags and attributes that the library has."""
        tags = [r[0] for r in self.library.nodes.select("tag").distinct().orderBy("tag").collect()]  # as many as the markup has names
        return {"keywords": sorted(KEYWORDS), "attributes": sorted(ATTRIBUTE_KEYS), "nodes": tags, "operators": ["and", "or", "butnot", "not", "|"]}


def describe(tree: ast.Query) -> str:
    match tree:
        case ast.ListQuery():
            return f"List of {tree.type}" + (f" in {tree.source}" if tree.source else "")
        case ast.ArticleQuery():
            return f"Items of {tree.article}"
        case ast.ScopedQuery():
            return f"{describe(tree.query)} whose {tree.scope} has {len(tree.predicates)} properties"
        case ast.NotQuery():
            return f"Not ({describe(tree.query)})"
        case ast.SetQuery():
            return f"({describe(tree.left)}) {tree.operator} ({describe(tree.right)})"
        case ast.PipeQuery():
            return f"{describe(tree.query)} | {type(tree.operation).__name__}"
    return type(tree).__name__


def balance(text: str) -> list[str]:
    """What a user should still close: unmatched brackets and quotes."""
    open_, quote, escaped, out = [], "", False, []
    pairs = {")": "(", "]": "["}
    for c in text:
        if quote:
            quote = quote if escaped or c != quote else ""
            escaped = c == "\\" and not escaped
        elif c in "'\"":
            quote, escaped = c, False
        elif c in "([":
            open_.append(c)
        elif c in pairs and (not open_ or open_.pop() != pairs[c]):
            out.append(f"unmatched {c}")
    return out + [f"unclosed {k} x{n}" for k, n in Counter(open_).items()] + ([f"unclosed {quote}"] if quote else [])


def suggest(prefix: str, vocabulary: list[str], most: int = 8) -> list[str]:
    """Words that a prefix can become; if there are none, those within two edits of it."""
    p = prefix.lower()
    starting = sorted(w for w in vocabulary if w.lower().startswith(p))
    return (starting or sorted((w for w in vocabulary if edit_distance(w.lower(), p, 2) <= 2), key=lambda w: (edit_distance(w.lower(), p, 2), w)))[:most]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is above."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)
