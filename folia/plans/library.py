"""The tables of a document library, and the named relations over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.functions.ancestors import ancestors

SCHEMAS = {
    "article": "id string, name string, title string, file_path string, xml_content string",
    "mml_item": "id string, article_id string, kind string, subkind string, number int, lib_id string, title string, text_content string, raw_xml string, component_rank int",
    "statement": "item_id string, statement_kind string, statement_text string",
    "registration": "item_id string, registration_kind string, main_mode_constructor_id string, main_func_constructor_id string",
    "notation": "item_id string, notation_kind string, direct boolean, opposite boolean, default_not boolean, first_not boolean, expandable boolean, definition_item_id string",
    "constructor": "item_id string, constructor_kind string, short_name string",
    "symbol": "id string, text string, normalized string, kind string, article_id string, description string",
    "format": "id string, name string, representation string, article_id string, description string",
    "fm_keyword": "id string, text string, kind string",
    "fm_tex_macro": "id string, name string, body string",
    "item_node": "id string, item_id string, parent_node_id string, node_path string, node_type string, symbol_id string, format_id string, constructor_item_id string, pos int, depth int, raw string, tag string, attrs map<string,string>",
    "item_constructor_ref": "id string, item_id string, constructor_item_id string, role string, is_positive boolean, occurrences int",
    "notation_symbol": "notation_id string, symbol_id string, pos int",
    "notation_format": "notation_id string, format_id string, pos int",
    "notation_constructor": "notation_id string, constructor_item_id string, role string",
    "format_symbol": "format_id string, symbol_id string, pos int",
    "constructor_definition": "constructor_item_id string, definition_item_id string",
    "constructor_definiens": "constructor_item_id string, definiens_item_id string",
    "constructor_redefinition": "copy_item_id string, origin_item_id string",
    "registration_relation": "id string, registration_item_id string, constructor_item_id string, role string, is_positive boolean",
    "constructor_property": "constructor_item_id string, property_name string, property_value boolean",
}
#: Path of the innermost proposition that holds a node, in lower case.
PROPOSITION = r"^(.*/proposition\[[0-9]+\])"


class Library:
    """Named tables; a table that is not given is empty. Relations are built when first asked for."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.tables = dict(tables)
        self.built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name in SCHEMAS:
            if name not in self.tables:
                self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
            return self.tables[name]
        if name not in self.built:
            if name not in RELATIONS:
                raise AttributeError(name)
            self.built[name] = RELATIONS[name](self)
        return self.built[name]

    def persist(self, *names: str) -> Library:
        """Keep tables that many queries read, and what is derived from the node tree."""
        for n in names:
            kept = getattr(self, n).persist()
            (self.tables if n in SCHEMAS else self.built)[n] = kept
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Library:
        """The library that ingest wrote to path."""
        from folia.sources.store import table_paths

        return cls(spark, {n: spark.read.schema(SCHEMAS[n]).parquet(p) for n, p in table_paths(spark, path, SCHEMAS).items()})


def _nodes(lib: Library) -> DataFrame:
    """item_node with what predicates need: lower-case tag, innermost proposition, spelling."""
    path = F.regexp_extract(F.lower("node_path"), PROPOSITION, 1)
    return lib.item_node.withColumns({"tag_lc": F.lower(F.coalesce("tag", F.lit(""))), "prop_path": F.nullif(path, F.lit("")), "spelling": F.trim(F.coalesce(F.col("attrs")["spelling"], F.lit("")))})


def _closure(lib: Library) -> DataFrame:
    """(item_id, anc_id, des_id, dist) of all strict ancestors, found by the prefixes of paths, without recursion."""
    return ancestors(lib.item_node.select("item_id", "id", "node_path"))


def _view_items(lib: Library) -> DataFrame:
    a = lib.article.select(F.col("id").alias("a_id"), F.col("name").alias("article_name"))
    return lib.mml_item.join(a, F.col("article_id") == F.col("a_id")).drop("a_id").withColumnRenamed("id", "item_id")


def _subtype(table: str):
    return lambda lib: lib.view_items.join(getattr(lib, table), "item_id")


def _item_nodes(lib: Library) -> DataFrame:
    return lib.nodes.join(lib.view_items.select("item_id", "article_name", "lib_id", "kind", "subkind", "text_content"), "item_id")


def _roots(lib: Library) -> DataFrame:
    """One root node of each item, that of the largest id should there be several."""
    latest = Window.partitionBy("item_id").orderBy(F.desc("id"))
    return lib.item_node.filter("depth = 0").withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n")


def _root_types(lib: Library) -> DataFrame:
    return lib.view_item_root_nodes.select("item_id", F.col("node_type").alias("root_type"))


def _statements(lib: Library) -> DataFrame:
    rows = lib.view_items.join(lib.statement, "item_id").join(_root_types(lib), "item_id", "left")
    return rows.withColumn("node_type", F.coalesce("root_type", F.lit("no_nodes"))).drop("root_type")


def _registrations(lib: Library) -> DataFrame:
    rows = lib.view_items.join(lib.registration, "item_id").join(_root_types(lib), "item_id", "left")
    plain = F.col("root_type").isNull() | (F.col("root_type") == "no_nodes")
    return rows.withColumn("node_type", F.when(plain, F.lit("registrations")).otherwise(F.col("root_type"))).drop("root_type")


def _typed(kinds: tuple[str, ...], node_type: str):
    return lambda lib: lib.view_statements.filter(F.col("statement_kind").isin(*kinds) & (F.col("node_type") == node_type))


def _named(lib: Library, prefix: str) -> DataFrame:
    return lib.view_items.select(F.col("item_id").alias(f"{prefix}_id"), F.col("lib_id").alias(f"{prefix}_lib_id"), F.col("article_name").alias(f"{prefix}_article"))


def _symbol_constructors(lib: Library) -> DataFrame:
    s = lib.symbol.select(F.col("id").alias("symbol_id"), F.col("text").alias("symbol_text"))
    links = lib.notation_symbol.join(s, "symbol_id").join(lib.notation_constructor.select("notation_id", "constructor_item_id"), "notation_id")
    return links.join(lib.constructor.select(F.col("item_id").alias("constructor_item_id"), "constructor_kind"), "constructor_item_id").join(_named(lib, "constructor").withColumnRenamed("constructor_id", "constructor_item_id"), "constructor_item_id")


def _ref_items(lib: Library) -> DataFrame:
    c = lib.constructor.select(F.col("item_id").alias("constructor_item_id"), "constructor_kind")
    return lib.item_constructor_ref.join(c, "constructor_item_id").join(lib.view_items.select("item_id", "article_name", "lib_id", "kind", "subkind"), "item_id")


def _properties(lib: Library) -> DataFrame:
    c = lib.view_constructors.select(F.col("item_id").alias("constructor_item_id"), "lib_id", "article_name", "constructor_kind")
    return lib.constructor_property.join(c, "constructor_item_id")


def _ref_counts(lib: Library) -> DataFrame:
    refs = lib.item_constructor_ref.groupBy("item_id", "role")
    return refs.agg(F.countDistinct("constructor_item_id").alias("distinct_constructors"), F.sum("occurrences").alias("total_occurrences"))


def _symbol_usage(lib: Library) -> DataFrame:
    """Items and their symbols, through notations or through nodes, each pair once."""
    s = lib.symbol.select(F.col("id").alias("symbol_id"), F.col("text").alias("symbol_text"))
    by_notation = lib.notation_symbol.select(F.col("notation_id").alias("item_id"), "symbol_id")
    by_node = lib.item_node.filter("symbol_id is not null").select("item_id", "symbol_id")
    return by_notation.union(by_node).join(s, "symbol_id").join(lib.view_items.select("item_id", "article_name", "lib_id"), "item_id").distinct()


def _article_summary(lib: Library) -> DataFrame:
    is_kind = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s")
    counts = lib.mml_item.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("items"), *[is_kind(k) for k in ("constructor", "notation", "statement", "registration")])
    rows = lib.article.select("id", F.col("name").alias("article_name")).join(counts, "id", "left")
    return rows.select("article_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("items", "constructors", "notations", "statements", "registrations")])


def _synonyms(lib: Library) -> DataFrame:
    """Pairs of notations of one constructor."""
    n = lib.notation_constructor
    a = n.select("constructor_item_id", F.col("notation_id").alias("notation_id_1"))
    b = n.select("constructor_item_id", F.col("notation_id").alias("notation_id_2"))
    return a.join(b, "constructor_item_id").filter("notation_id_1 <> notation_id_2")


def _edge_ends(table: str, ends: tuple[tuple[str, str], ...]):
    def build(lib: Library) -> DataFrame:
        rows = getattr(lib, table)
        for column, name in ends:
            rows = rows.join(_named(lib, name), F.col(column) == F.col(f"{name}_id")).drop(f"{name}_id")
        return rows

    return build


def _role_summary(lib: Library) -> DataFrame:
    refs = lib.item_constructor_ref.groupBy("item_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.countDistinct("constructor_item_id").alias("constructors"))
    rows = lib.view_items.select("item_id", "lib_id", "article_name").join(refs, "item_id", "left")
    return rows.withColumns({"roles": F.coalesce("roles", F.array().cast("array<string>")), "constructors": F.coalesce("constructors", F.lit(0))})


def _symbol_nodes(lib: Library) -> DataFrame:
    a = lib.article.select(F.col("id").alias("article_id"), F.col("name").alias("article_name"))
    return lib.symbol.join(a, "article_id", "left").withColumn("node_type", F.lit("symbols"))


def _query_nodes(lib: Library) -> DataFrame:
    """Symbols and the four kinds of items that queries list, in one shape."""
    item = lambda v: getattr(lib, v).select("node_type", "item_id", "lib_id", "article_name", "text_content")
    symbols = lib.view_symbol_nodes.select("node_type", F.col("id").alias("item_id"), F.lit(None).cast("string").alias("lib_id"), "article_name", F.col("text").alias("text_content"))
    out = symbols
    for v in ("view_theorems", "view_definitions", "view_schemes", "view_registration_nodes"):
        out = out.unionByName(item(v))
    return out


def _article_node_summary(lib: Library) -> DataFrame:
    """Items of each article by root type, and its symbols; both counted before they meet, so that nothing fans out."""
    types = ("theorems", "definitions", "schemes", "registrations")
    roots = lib.view_items.select("item_id", "article_name").join(_root_types(lib), "item_id")
    counts = roots.groupBy("article_name").agg(*[F.count_if(F.col("root_type") == t).alias(t) for t in types])
    symbols = lib.view_symbol_nodes.filter("article_name is not null").groupBy("article_name").agg(F.count(F.lit(1)).alias("symbols"))
    rows = lib.article.select(F.col("name").alias("article_name")).join(counts, "article_name", "left").join(symbols, "article_name", "left")
    return rows.select("article_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*types, "symbols")])


def items_sharing_refs(lib: Library, item_id: str, least: int) -> DataFrame:
    """Items that refer to at least so many of the constructors that the given item refers to."""
    wanted = lib.item_constructor_ref.filter(F.col("item_id") == item_id).select("constructor_item_id").distinct()
    shared = lib.item_constructor_ref.join(wanted, "constructor_item_id", "left_semi").groupBy("item_id").agg(F.countDistinct("constructor_item_id").alias("shared"))
    return shared.filter((F.col("shared") >= least) & (F.col("item_id") != item_id))


RELATIONS = {
    "nodes": _nodes,
    "closure": _closure,
    "view_items": _view_items,
    "view_constructors": _subtype("constructor"),
    "view_notations": _subtype("notation"),
    "view_statements": _statements,
    "view_registrations": _registrations,
    "view_symbol_denotes_constructors": _symbol_constructors,
    "view_constructor_ref_items": _ref_items,
    "view_constructor_properties": _properties,
    "view_item_nodes": _item_nodes,
    "view_item_constructor_ref_counts": _ref_counts,
    "view_item_symbol_usage": _symbol_usage,
    "view_article_summary": _article_summary,
    "view_notation_synonyms": _synonyms,
    "view_constructor_definitions": _edge_ends("constructor_definition", (("constructor_item_id", "constructor"), ("definition_item_id", "definition"))),
    "view_definiens_to_constructors": _edge_ends("constructor_definiens", (("constructor_item_id", "constructor"), ("definiens_item_id", "definiens"))),
    "view_registration_clusters": _edge_ends("registration_relation", (("registration_item_id", "registration"), ("constructor_item_id", "constructor"))),
    "view_items_role_summary": _role_summary,
    "view_item_root_nodes": _roots,
    "view_theorems": _typed(("th",), "theorems"),
    "view_definitions": _typed(("def", "dfs"), "definitions"),
    "view_schemes": _typed(("sch",), "schemes"),
    "view_registration_nodes": lambda lib: lib.view_registrations.filter("node_type = 'registrations'"),
    "view_symbol_nodes": _symbol_nodes,
    "view_query_nodes": _query_nodes,
    "view_article_node_summary": _article_node_summary,
}
