"""Pages of results: filter, sort, clamp, cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.plans import ast
from folia.plans.names import like_pattern
from folia.plans.rows import Rows

DEFAULT_SIZE, MOST_SIZE = 10, 500
_ITEM_SORTS = {
    "item_id": "item_id", "lib_id": "lib_id", "article_name": "article_name", "kind": "kind", "subkind": "subkind", "node_type": "node_type",
    "raw": "text_content", "raw_text": "text_content", "text_content": "text_content", "text_position": "text_content",
}
_SYMBOL_SORTS = _ITEM_SORTS | {"spelling": "spelling", "text_position": "text_position"}
_ITEM_FILTER = ("article_name", "lib_id", "kind", "subkind", "node_type", "text_content", "item_id")
_OCCURRENCE_SORTS = {"spelling": "spelling", "occurrences": "occurrences", "count": "occurrences"}


@dataclass(frozen=True)
class PageRequest:
    page: int | None = None
    size: int | None = None
    sort_by: str | None = None
    direction: str | None = None
    filter: str | None = None

    @property
    def rows(self) -> int:
        return min(MOST_SIZE, max(1, DEFAULT_SIZE if self.size is None else self.size))

    @property
    def falling(self) -> bool:
        return (self.direction or "").strip().lower() == "desc"

    @property
    def needle(self) -> str | None:
        return (self.filter or "").strip() or None


@dataclass(frozen=True)
class Page:
    """frame: the page in order, with its 1-based place in `position`; count: rows in all pages; projected: whether its rows are."""

    frame: DataFrame
    count: int
    page: int
    size: int
    projected: bool = False


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _cut(df: DataFrame, order: list[Column], request: PageRequest, projected: bool = False) -> Page:
    """Sort and cut: Spark keeps the first (page + 1) * size rows of each task only. The page itself is numbered."""
    count = df.count()
    page = min(max(0, request.page or 0), max(0, (count - 1) // request.rows))
    cut = df.orderBy(*order).offset(page * request.rows).limit(request.rows)
    numbered = cut.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + page * request.rows).cast("int"))
    return Page(numbered, count, page, request.rows, projected)


def list_page(query: ast.ListQuery, rows: Rows, request: PageRequest) -> Page:
    """A page of a bare list: wildcards in the filter, sorting by listed columns only, nulls last either way."""
    df = rows.df
    if request.needle:
        pattern = f"%{like_pattern(request.needle.lower())}%"
        fields = ("spelling", "occurrences") if query.type == "occurrences" else (("spelling",) if query.type == "symbols" else ()) + _ITEM_FILTER
        found = F.lit(False)
        for c in fields:
            found = found | _lower(c).like(pattern)
        df = df.filter(found)
    sorts = {"occurrences": _OCCURRENCE_SORTS, "symbols": _SYMBOL_SORTS}.get(query.type, _ITEM_SORTS)
    default = {"occurrences": ("occurrences", "spelling"), "symbols": ("spelling", "article_name", "lib_id", "item_id")}.get(query.type, ("article_name", "lib_id", "item_id"))
    column = sorts.get((request.sort_by or "").strip().lower())
    if column:
        order = [F.col(column).desc_nulls_last() if request.falling else F.col(column).asc_nulls_last()]
    elif query.type == "occurrences":
        order = [F.col("occurrences").desc_nulls_last(), F.col("spelling").asc_nulls_last()]
    else:
        order = [F.col(c).asc_nulls_last() for c in default]
    return _cut(df, [*order, *rows.sort_columns()], request)


def result_page(rows: Rows, request: PageRequest, projection: Callable[[DataFrame], DataFrame]) -> Page:
    """A page of any other result: plain text in any field; numbers sort as numbers and before text, case does not count.

    Filter and sort key look at projected rows; without either, only the page needs projecting.
    Nulls come last in rising and first in falling order; equal rows keep their order.
    """
    by, order = (request.sort_by or "").strip(), rows.sort_columns()
    if not request.needle and not by:
        return _cut(rows.df, order, request)
    df = projection(rows.df)
    shown = [c for c in df.columns if not c.startswith("_")]
    if request.needle:
        found = F.lit(False)
        for c in shown:
            found = found | _lower(c).contains(request.needle.lower())
        df = df.filter(found)
    if by in shown:
        number = F.expr(f"try_cast(trim(cast(`{by}` as string)) as double)")
        keys = [F.col(by).isNull(), number.isNull(), number, _lower(by)]
        order = [k.desc() if request.falling else k.asc() for k in keys] + order
    return _cut(df, order, request, True)
