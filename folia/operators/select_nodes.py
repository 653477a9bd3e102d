"""Selection of nodes inside items."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.operators.navigate import item_ids
from folia.operators.predicates import any_of, flagged_nodes, lies_below, next_in_path_order
from folia.plans.ast import NodePredicate
from folia.plans.library import Library
from folia.plans.rows import Rows, rows_of


def select_nodes(lib: Library, rows: Rows, target: NodePredicate, predicates: tuple[NodePredicate, ...]) -> Rows:
    """Nodes of the rows' items that match the target, and below which every predicate has a match (or none, if negated).

    Of nested matches the innermost stays. Targets and matches of all predicates of an item go
    through one pass in path order: what lies below a node follows it at once, so the next
    match of each kind tells. Ordered by article, text position and path.
    """
    flags = [f"m{k}" for k in range(len(predicates) + 1)]
    df = flagged_nodes(lib, [target, *predicates], item_ids(rows), ("node_path", F.struct("tag_lc", "attrs", "pos", "spelling", "raw").alias("node")))
    df = df.filter(any_of([F.col(m) for m in flags])).withColumn("node", F.when(F.col("m0"), F.col("node")))
    keep = F.col("m0")
    df = df.withColumns({f"below{k}": lies_below(next_in_path_order(F.when(F.col(f"m{k}"), F.col("node_path")))) for k in range(1, len(flags))})
    for k, p in enumerate(predicates, 1):
        keep = keep & (~F.col(f"below{k}") if p.negated else F.col(f"below{k}"))
    found = df.filter(keep).select("id", "item_id", "node_path", "node.*")
    found = found.withColumn("_nested", lies_below(next_in_path_order(F.col("node_path")))).filter(~F.col("_nested")).drop("_nested")
    items = lib.view_items.select("item_id", "article_name", "lib_id", "kind", F.col("subkind").alias("item_subkind"))
    attrs = F.col("attrs")
    df = found.join(items, "item_id").select(
        "item_id", F.col("id").alias("node_id"), "node_path", F.col("tag_lc").alias("node_tag"), attrs["xmlid"].alias("node_xmlid"), "lib_id", "article_name", "kind",
        F.coalesce(attrs["kind"], "item_subkind").alias("subkind"), F.coalesce(attrs["kind"], "tag_lc").alias("node_type"),
        F.coalesce(attrs["position"], F.col("pos").cast("string")).alias("text_position"), "spelling", F.col("raw").alias("raw_text"),
    )
    return rows_of(df, ("article_name", "text_position", "node_path", "node_id")).deduplicated()
