"""Rows as users see them: with the markup and the place of their node or of their item's root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.fragments import fragment
from folia.plans.library import Library

TABLE = ("item_id", "node_id", "node_path", "lib_id", "article_name", "node_type", "text_position", "spelling", "occurrences", "raw")


def _some(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def project(lib: Library, df: DataFrame) -> DataFrame:
    """Columns of TABLE, and position and order columns if there. Best done for a page: it looks up markup.

    raw of a node row: the element with its xmlid, cut from the item's markup, or else its own
    raw text; of an item row: the root's raw text, or its tag and attributes; then the row's text.
    text_position of a node row is its own; of an item row, that of the root.
    """
    attrs = F.col("attrs")
    roots = lib.view_item_root_nodes.select(
        F.col("item_id").alias("_item"), F.col("raw").alias("_root_raw"), F.to_json(F.struct("tag", "attrs")).alias("_details"), F.coalesce(attrs["position"], F.col("pos").cast("string")).alias("_root_position")
    )
    items = lib.mml_item.select(F.col("id").alias("_id"), "raw_xml")
    df = df.join(roots, F.col("item_id") == F.col("_item"), "left").join(items, F.col("item_id") == F.col("_id"), "left")
    of_node = F.coalesce("node_id", "node_xmlid").isNotNull()
    cut = F.when(of_node, fragment(F.when(of_node, F.col("raw_xml")), F.when(of_node, F.col("node_xmlid"))))
    raw = _some(cut, F.when(of_node, F.col("raw_text")), F.col("_root_raw"), F.col("_details"), F.col("raw_text"), F.col("text_content"))
    position = F.coalesce(F.when(of_node, _some(F.col("text_position"))), _some(F.col("_root_position")), F.col("text_position"))
    df = df.withColumns({"raw": F.when(F.col("item_id").isNotNull() | of_node, raw), "text_position": position})
    return df.select(*TABLE, *[c for c in df.columns if c == "position" or c.startswith("_o")])


def item_fragment(lib: Library, item_id: str) -> dict | None:
    """The markup of an item: the element of the root's xmlid in the article, or else the item's own markup."""
    roots = lib.view_item_root_nodes.select(F.col("item_id").alias("_item"), F.col("attrs")["xmlid"].alias("_xmlid"))
    xmlid = F.coalesce("_xmlid", F.nullif(F.regexp_extract(F.coalesce("raw_xml", F.lit("")), r'xmlid="([^"]*)"', 1), F.lit("")))
    articles = lib.article.select(F.col("id").alias("_article"), F.col("name").alias("article_name"), "xml_content")
    rows = lib.mml_item.filter(F.col("id") == item_id).join(roots, F.col("id") == F.col("_item"), "left").join(articles, F.col("article_id") == F.col("_article"), "left")
    found = rows.select("id", "lib_id", "article_name", xmlid.alias("xmlid"), F.coalesce(fragment(F.col("xml_content"), xmlid), "raw_xml").alias("fragment")).first()
    return found.asDict() if found else None
