"""Steps from items along references to other items, and filters on how many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.plans.library import Library
from folia.plans.names import QueryError
from folia.plans.rows import Rows, rows_of

_ROLES = {"ref": "ref", "termtype ref": "termtype_ref", "deftype ref": "deftype_ref"}
_COMPARE = {
    "eq": lambda a, b: a == b,
    "ge": lambda a, b: a >= b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
}


def compare(comparator: str, a: Column, b) -> Column:
    return _COMPARE[comparator](a, b)


def item_ids(rows: Rows) -> DataFrame:
    return rows.df.filter("item_id is not null").select("item_id").distinct()


def _constructors(lib: Library, ids: DataFrame) -> Rows:
    """Constructor rows of the ids in column `to`."""
    df = lib.view_constructors.join(ids.select("to").distinct(), F.col("item_id") == F.col("to"), "left_semi")
    df = df.withColumns({"kind": F.lit("constructor"), "subkind": F.col("constructor_kind"), "node_type": F.lit("constructors")})
    return rows_of(df, unique=True)


def _edges(lib: Library, relation: str) -> DataFrame:
    """(item_id, to) pairs of a relation."""
    refs = lib.item_constructor_ref
    if relation in _ROLES:
        return refs.filter(F.lower("role") == _ROLES[relation]).select("item_id", F.col("constructor_item_id").alias("to"))
    if relation == "occur":
        return refs.select(F.col("constructor_item_id").alias("item_id"), F.col("item_id").alias("to"))
    column = {
        "definition": ("constructor_definition", "constructor_item_id", "definition_item_id"),
        "notation": ("notation_constructor", "constructor_item_id", "notation_id"),
        "origin": ("constructor_redefinition", "copy_item_id", "origin_item_id"),
        "copy": ("constructor_redefinition", "origin_item_id", "copy_item_id"),
        "main mode": ("registration", "item_id", "main_mode_constructor_id"),
        "main functor": ("registration", "item_id", "main_func_constructor_id"),
    }.get(relation)
    if column is None:
        raise QueryError(f"unknown relation {relation!r}")
    table, of, to = column
    return getattr(lib, table).select(F.col(of).alias("item_id"), F.col(to).alias("to")).filter("to is not null")


def follow(lib: Library, rows: Rows, relation: str, *, occur_items: bool = False) -> Rows:
    """The distinct items that a relation leads to from the items of rows.

    `occur` leads to constructors that refer to a constructor; with occur_items, to all items
    that do. `redef` is origin and copy together.
    """
    ids = item_ids(rows)

    def reached(name: str) -> DataFrame:
        return _edges(lib, name).join(ids, "item_id", "left_semi")

    if relation == "redef":
        return _constructors(lib, reached("origin").union(reached("copy")))
    to = reached(relation)
    if relation == "definition":
        df = lib.view_definitions.join(to.select("to").distinct(), F.col("item_id") == F.col("to"), "left_semi")
        return rows_of(df.withColumn("node_type", F.lit("definitions")), unique=True)
    if relation == "notation":
        df = lib.view_notations.join(to.select("to").distinct(), F.col("item_id") == F.col("to"), "left_semi")
        return rows_of(df.withColumns({"kind": F.lit("notation"), "subkind": F.col("notation_kind"), "node_type": F.lit("notations")}), unique=True)
    if relation == "occur" and occur_items:
        df = lib.view_items.join(to.select("to").distinct(), F.col("item_id") == F.col("to"), "left_semi")
        return rows_of(df.withColumn("node_type", F.col("kind")), unique=True)
    return _constructors(lib, to)


def _by_count(rows: Rows, counts: DataFrame, comparator: str, number: int) -> Rows:
    """Rows whose item has a count (0 if it is not in counts) that compares so; rows without item go."""
    keep = compare(comparator, F.coalesce("_n", F.lit(0)), number)
    df = rows.df.filter("item_id is not null").join(counts.select(F.col("item_id"), F.col("n").alias("_n")), "item_id", "left").filter(keep).drop("_n")
    return Rows(df, rows.order, rows.unique)


def by_relation_count(lib: Library, rows: Rows, relation: str, comparator: str, number: int) -> Rows:
    """Keep rows by how many distinct items their item reaches by the relation."""
    counts = _edges(lib, relation).join(item_ids(rows), "item_id", "left_semi").groupBy("item_id").agg(F.countDistinct("to").alias("n"))
    return _by_count(rows, counts, comparator, number)


def by_node_count(lib: Library, rows: Rows, scope: str, matching: DataFrame, comparator: str, number: int) -> Rows:
    """Keep rows by how many matching nodes (of their items) their item has; in proposition scope, by the most in one proposition."""
    if scope == "proposition":
        counts = matching.filter("prop_path is not null").groupBy("item_id", "prop_path").agg(F.count(F.lit(1)).alias("c")).groupBy("item_id").agg(F.max("c").alias("n"))
    else:
        counts = matching.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return _by_count(rows, counts, comparator, number)
