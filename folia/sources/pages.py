"""Web pages as a document library: the tags of a page are its node tree."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folia.plans.library import Library
from folia.sources.esx import RAW_MOST, key

# Tags that have no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NODES = "item_id string, id string, parent_node_id string, node_path string, pos int, depth int, tag string, attrs map<string,string>, raw string, node_type string"


#: The tag of the root that every page has: what its markup has on top lies below it.
ROOT = "page"


class _Tree(HTMLParser):
    """Elements in document order, below one root; an end tag closes all that is open inside it, one without a start is skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = [[ROOT, f"/{ROOT}[1]", 0]]  # tag, path, children
        self.rows: list[tuple] = [(f"/{ROOT}[1]", None, 1, 0, ROOT, {}, "")]

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1]
        parent[2] += 1
        path = f"{parent[1]}/{tag}[{parent[2]}]"
        self.rows.append((path, parent[1], parent[2], len(self.open), tag, {k: v or "" for k, v in attrs}, (self.get_starttag_text() or "")[:RAW_MOST]))
        if tag not in VOID:
            self.open.append([tag, path, 0])

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return


def page_nodes(html: str | None) -> list[tuple]:
    """(path, parent's path, position, depth, tag, attributes, raw) of all elements; a page without any, or null, has its root alone."""
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def page_library(pages: DataFrame) -> Library:
    """pages (page_id, url, html): an article for each host, an item for each page, a node for each tag."""
    host = F.upper(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/:?#]+)", 1), "[^A-Za-z0-9]", "_"))
    pages = pages.select(F.concat(F.lit("w:"), F.col("page_id").cast("string")).alias("id"), F.col("page_id").cast("string").alias("number"), "url", "html", host.alias("name"))

    schema = to_arrow_schema(StructType.fromDDL(NODES))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [
                    {"item_id": id_, "id": key(id_, path), "parent_node_id": key(id_, parent) if parent else None, "node_path": path, "pos": pos, "depth": depth, "tag": tag,
                     "attrs": list(attrs.items()), "raw": raw, "node_type": "no_nodes" if depth else "theorems"}
                    for path, parent, pos, depth, tag, attrs, raw in page_nodes(html)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    none = lambda t: F.lit(None).cast(t)
    return Library(pages.sparkSession, {
        "article": pages.select("name").distinct().select(F.concat(F.lit("h:"), "name").alias("id"), "name", none("string").alias("xml_content")),
        "mml_item": pages.select("id", F.concat(F.lit("h:"), "name").alias("article_id"), F.lit("statement").alias("kind"), F.lit("th").alias("subkind"), F.concat(F.lit("P"), "number").alias("lib_id"), F.col("url").alias("text_content"), none("string").alias("raw_xml")),
        "statement": pages.select(F.col("id").alias("item_id"), F.lit("th").alias("statement_kind"), F.col("url").alias("statement_text")),
        "item_node": pages.select("id", "html").mapInArrow(nodes, NODES).withColumn("symbol_id", none("string")),
    })
