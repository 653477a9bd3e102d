"""Predicates over node trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.plans.ast import NodePredicate
from folia.plans.library import Library
from folia.plans.names import ATTRIBUTE_KEYS, Path, matches, parse_path


def tag_matches(name: str) -> Column:
    return F.lit(True) if name.strip() == "*" else matches(F.col("tag_lc"), name)


def attribute_matches(name: str, value: str | None) -> Column:
    """Whether a node has the attribute, and with the value if one is given.

    Names of documented attributes stand for their keys. Other plain names match keys whatever
    their case; `_` is no wildcard in them. Names with other characters are matched against
    every key, wildcards allowed.
    """
    attrs = F.col("attrs")
    known = ATTRIBUTE_KEYS.get(name)
    if known:
        found = F.coalesce(*[attrs[k] for k in known]) if len(known) > 1 else attrs[known[0]]
        return found.isNotNull() if value is None else found.isNotNull() & matches(found, value)
    plain = all(c.isascii() and (c.isalnum() or c in "_-") for c in name)

    def fits(entry: Column) -> Column:
        key = F.lower(entry["key"]) == name if plain else matches(entry["key"], name)
        return key if value is None else key & matches(entry["value"], value)

    return F.coalesce(F.exists(F.map_entries("attrs"), fits), F.lit(False))


def simple_condition(predicate: NodePredicate) -> Column | None:
    """The condition on a node itself; None for a path, which needs other nodes."""
    if predicate.adjective:
        attrs = F.col("attrs")
        there = attrs["nonocc"].isNotNull() | attrs["spelling"].isNotNull()
        return (F.col("tag_lc") == "attribute") & there & (F.lower(F.coalesce(attrs["nonocc"], F.lit(""))) == "true") & matches(attrs["spelling"], predicate.value)
    if parse_path(predicate.name):
        return None
    condition = tag_matches(predicate.name)
    return condition if predicate.attribute is None else condition & attribute_matches(predicate.attribute, predicate.value)


def next_in_path_order(path: Column, *ties: str) -> Column:
    """The first path, null ones left out, among the nodes after each node of an item.

    All that lies below a node comes first after it, since a path is followed by those that go
    on from it. Paths are read backwards: then the frame grows by a row at a time, and an item
    takes as many steps as it has nodes. ties: what orders rows of one path.
    """
    backwards = Window.partitionBy("item_id").orderBy(F.desc("node_path"), *ties).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(path, ignorenulls=True).over(backwards)


def lies_below(path: Column) -> Column:
    """Whether a path leads to a node below this one."""
    return F.coalesce(F.startswith(path, F.concat("node_path", F.lit("/"))), F.lit(False))


def ancestors_at(nodes: DataFrame, levels: int) -> DataFrame:
    """(item_id, node_path) of the ancestors so many levels above nodes: one for each node, no matter how deep trees are."""
    path = F.expr(f"substring_index(node_path, '/', depth + {2 - levels})")
    return nodes.filter(F.col("depth") >= levels).select("item_id", path.alias("node_path")).distinct()


def above(candidates: DataFrame, below: DataFrame) -> DataFrame:
    """The candidates that have one of `below` at any depth under them: one pass over each item in path order."""
    rows = candidates.withColumn("_below", F.lit(False)).unionByName(below.select("item_id", "node_path", F.lit(True).alias("_below")), allowMissingColumns=True)
    # a node that is both must not stand in its own way
    return rows.withColumn("_next", next_in_path_order(F.when(F.col("_below"), F.col("node_path")), "_below")).filter(~F.col("_below") & lies_below(F.col("_next"))).drop("_below", "_next")


def matching_nodes(lib: Library, predicate: NodePredicate, ids: DataFrame | None = None) -> DataFrame:
    """The rows of lib.nodes (of the items in ids, if given) that match: for a path, those of its first segment.

    Built from the last segment back; each step is a semi join on the parent's id for a direct
    child, on the path cut short for a number of levels, and one pass in path order for any.
    """
    nodes = lib.nodes if ids is None else lib.nodes.join(ids, "item_id", "left_semi")
    condition = simple_condition(predicate)
    if condition is not None:
        return nodes.filter(condition)
    path: Path = parse_path(predicate.name)
    below = nodes.filter(simple_condition(NodePredicate(path.segments[-1], predicate.attribute, predicate.value)))
    for segment, step in zip(reversed(path.segments[:-1]), reversed(path.steps), strict=True):
        candidates = nodes.filter(tag_matches(segment))
        if step == 1:
            below = candidates.join(below.select(F.col("parent_node_id").alias("_above")), F.col("id") == F.col("_above"), "left_semi")
        elif step is None:
            below = above(candidates, below)
        else:
            below = candidates.join(ancestors_at(below, step), ["item_id", "node_path"], "left_semi").select(*candidates.columns)
    return below


def flagged_nodes(lib: Library, predicates: list[NodePredicate], ids: DataFrame | None = None, carry: tuple[Column | str, ...] = ()) -> DataFrame:
    """(id, item_id, prop_path, carry..., m0, m1, ...): which predicate each node matches, negation left aside."""
    df, plain = lib.nodes if ids is None else lib.nodes.join(ids, "item_id", "left_semi"), {}
    for k, p in enumerate(predicates):
        condition = simple_condition(p)
        if condition is not None:
            plain[f"m{k}"] = condition
    df = df.select("id", "item_id", "prop_path", *carry, *[c.alias(n) for n, c in plain.items()])
    for k, p in enumerate(predicates):
        if f"m{k}" not in plain:
            hits = matching_nodes(lib, p, ids).select("id", F.lit(True).alias(f"m{k}"))
            df = df.join(hits, "id", "left").withColumn(f"m{k}", F.coalesce(f"m{k}", F.lit(False)))
    return df


def items_with(lib: Library, scope: str, predicates: tuple[NodePredicate, ...], ids: DataFrame | None = None) -> DataFrame:
    """Distinct item_id of the items (of those in ids, if given) that the predicates hold for.

    Item scope: each positive predicate has a match in the item, no negative one has. Without
    a positive one the item must have a node. Proposition scope: the same inside one innermost
    proposition, where some match of the first positive predicate (any node, if there is none)
    leaves for every other positive one a match that is another node.

    One aggregation answers it: counts of matches, and the sets of other predicates that
    matches of the first one match themselves, of which there are few.
    """
    positive = [p for p in predicates if not p.negated]
    negative = [p for p in predicates if p.negated]
    df = flagged_nodes(lib, [*positive, *negative], ids)
    n = len(positive)
    if not positive or scope == "item":
        # nodes that match nothing decide only whether there is any node at all
        some = [F.col(f"m{k}") for k in range(n + len(negative))]
        group = ["item_id"] if scope == "item" else ["item_id", "prop_path"]
        if scope != "item":
            df = df.filter("prop_path is not null")
        if positive:
            df = df.filter(any_of(some))
        have = df.groupBy(*group).agg(*[F.bool_or(c).alias(f"m{k}") for k, c in enumerate(some)])
        keep = F.lit(True)
        for k in range(len(some)):
            keep = keep & (F.col(f"m{k}") if k < n else ~F.col(f"m{k}"))
        return have.filter(keep).select("item_id").distinct()
    df = df.filter("prop_path is not null").filter(any_of([F.col(f"m{k}") for k in range(n + len(negative))]))
    mask = sum((F.when(F.col(f"m{k}"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(1, n)), F.lit(0))
    counts = [F.count_if(F.col(f"m{k}")).alias(f"c{k}") for k in range(1, n + len(negative))]
    groups = df.groupBy("item_id", "prop_path").agg(F.collect_set(F.when(F.col("m0"), mask)).alias("masks"), *counts)
    keep = F.size("masks") > 0
    for k in range(n, n + len(negative)):
        keep = keep & (F.col(f"c{k}") == 0)
    if n > 1:

        def leaves_others(m: Column) -> Column:
            out = F.lit(True)
            for k in range(1, n):
                out = out & (F.col(f"c{k}") - F.when(m.bitwiseAND(F.lit(1 << k)) > 0, 1).otherwise(0) >= 1)
            return out

        keep = keep & F.exists("masks", leaves_others)
    return groups.filter(keep).select("item_id").distinct()


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


