"""From a query tree to one lazy plan."""

from __future__ import annotations

from functools import singledispatchmethod

from pyspark.sql import functions as F

from folia.operators import setops
from folia.operators.filters import by_criteria, by_number, by_regex
from folia.operators.navigate import by_node_count, by_relation_count, follow, item_ids
from folia.operators.predicates import items_with, matching_nodes
from folia.operators.select_nodes import select_nodes
from folia.plans import ast
from folia.plans.library import Library
from folia.plans.names import matches
from folia.plans.rows import Rows, rows_of

_VIEWS = {"theorems": "view_theorems", "definitions": "view_definitions", "statements": "view_statements", "registrations": "view_registrations"}


def item_node_type():
    """The node type of an item by its kind."""
    kind, sub = F.col("kind"), F.col("subkind")
    is_statement = kind == "statement"
    return (
        F.when(is_statement & (sub == "th"), "theorems")
        .when(is_statement & sub.isin("def", "dfs"), "definitions")
        .when(is_statement & (sub == "sch"), "schemes")
        .when(kind == "registration", "registrations")
        .otherwise(kind)
    )


class Compiler:
    """Every method returns Rows and runs nothing."""

    def __init__(self, library: Library, *, occur_items: bool = False):
        self.lib, self.occur_items = library, occur_items

    @singledispatchmethod
    def rows(self, query) -> Rows:
        raise TypeError(type(query))

    @rows.register
    def _(self, q: ast.ListQuery) -> Rows:
        if q.type in ("symbols", "occurrences"):
            return self.symbols(q)
        if q.type == "all":
            df = self.lib.view_items.withColumn("node_type", item_node_type())
        else:
            df = getattr(self.lib, _VIEWS[q.type])
        if q.source:
            df = df.filter(F.col("article_name") == q.source.upper())
        return rows_of(df, unique=True)

    def symbols(self, q: ast.ListQuery) -> Rows:
        df = self.lib.view_item_nodes.filter((F.right("tag_lc", F.lit(8)) == "-pattern") & (F.col("spelling") != ""))
        if q.source:
            df = df.filter(F.col("article_name") == q.source.upper())
        if q.type == "occurrences":
            # counts rise from the least: the order column holds them negated
            df = df.groupBy("spelling").agg(F.count(F.lit(1)).alias("occurrences")).withColumn("_rarity", -F.col("occurrences"))
            return rows_of(df, ("_rarity", "spelling"))
        if q.spelling and q.spelling.strip():
            df = df.filter(matches(F.col("attrs")["spelling"], q.spelling))
        attrs = F.col("attrs")
        df = df.select(
            "item_id", F.col("id").alias("node_id"), "node_path", F.col("tag").alias("node_tag"), attrs["xmlid"].alias("node_xmlid"), "lib_id", "article_name", "kind", "subkind",
            F.lit("symbols").alias("node_type"), F.coalesce(attrs["position"], F.col("pos").cast("string")).alias("text_position"), "spelling", "text_content", "pos",
        )
        return rows_of(df, ("article_name", "lib_id", "item_id", "pos", "node_id"))

    @rows.register
    def _(self, q: ast.ArticleQuery) -> Rows:
        df = self.lib.view_items.filter(F.col("article_name") == q.article).withColumn("node_type", item_node_type())
        return rows_of(df, unique=True)

    @rows.register
    def _(self, q: ast.ScopedQuery) -> Rows:
        base = self.rows(q.query)
        # a list of one article, or what steps have left, is worth looking up first; a list of everything of a type is not
        narrow = not isinstance(q.query, ast.ListQuery) or q.query.source
        ids = items_with(self.lib, q.scope, q.predicates, item_ids(base) if narrow else None)
        return Rows(base.df.join(ids, "item_id", "left_semi"), base.order, base.unique)

    @rows.register
    def _(self, q: ast.NotQuery) -> Rows:
        return setops.difference(self.rows(ast.ListQuery("all")), self.rows(q.query))

    @rows.register
    def _(self, q: ast.SetQuery) -> Rows:
        apply = {"and": setops.intersect, "or": setops.union, "butnot": setops.difference}[q.operator]
        return apply(self.rows(q.left), self.rows(q.right))

    @rows.register
    def _(self, q: ast.PipeQuery) -> Rows:
        return self.step(q.operation, self.rows(q.query))

    @singledispatchmethod
    def step(self, operation, rows: Rows) -> Rows:
        raise TypeError(type(operation))

    @step.register
    def _(self, op: ast.Navigate, rows: Rows) -> Rows:
        return follow(self.lib, rows, op.relation, occur_items=self.occur_items)

    @step.register
    def _(self, op: ast.Filter, rows: Rows) -> Rows:
        return by_criteria(rows, op.criteria)

    @step.register
    def _(self, op: ast.Grep, rows: Rows) -> Rows:
        return by_regex(rows, op.pattern)

    @step.register
    def _(self, op: ast.SelectNodes, rows: Rows) -> Rows:
        return select_nodes(self.lib, rows, op.target, op.predicates)

    @step.register
    def _(self, op: ast.Reverse, rows: Rows) -> Rows:
        return rows.reversed()

    @step.register
    def _(self, op: ast.NumericFilter, rows: Rows) -> Rows:
        return by_number(self.lib, rows, op.comparator, op.number)

    @step.register
    def _(self, op: ast.RelationCount, rows: Rows) -> Rows:
        return by_relation_count(self.lib, rows, op.relation, op.comparator, op.number)

    @step.register
    def _(self, op: ast.NodeCount, rows: Rows) -> Rows:
        return by_node_count(self.lib, rows, op.scope, matching_nodes(self.lib, ast.NodePredicate(op.name), item_ids(rows)), op.comparator, op.number)
