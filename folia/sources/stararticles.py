"""Articles written from star-schema tables, so that shredding and ingest can be held against SQL over the same tables.

Suppliers become theorems, every fourth a cluster with a registration as well; parts become
definitions, each with a notation and the constructor that it introduces. One article a nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.plans.library import Library
from folia.sources.ingest import library_tables, parse_files

INPUTS = ("nation", "supplier", "part")
ITEMS = """
SELECT n_name AS article, 1 AS turn, s_suppkey AS k, concat(
         '<Item kind="Theorem-Item" xmlid="s', s_suppkey, '"><Theorem-Item MMLId="', n_name, ':', s_suppkey, '"><Proposition><Label spelling="S', s_suppkey, '"/>of ', s_name,
         '<Infix-Term spelling="+" absoluteconstrMMLId="K:', s_suppkey % 50 + 1, '"><Numeral-Term number="', s_suppkey, '"/></Infix-Term></Proposition></Theorem-Item></Item>') AS xml
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 2, s_suppkey, concat(
         '<Item kind="Cluster" xmlid="r', s_suppkey, '"><Cluster><Conditional-Registration xmlid="c', s_suppkey, '"><Attribute nonocc="true" absoluteconstrMMLId="K:', s_suppkey % 50 + 1,
         '"/><Attribute absoluteconstrMMLId="K:', s_suppkey % 50 + 1, '"/><Attribute absoluteconstrMMLId="none:1"/></Conditional-Registration></Cluster></Item>')
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 0
UNION ALL SELECT n_name, 3, p_partkey, concat(
         '<Item kind="Definition-Item" xmlid="d', p_partkey, '"><Definition-Item MMLId="', n_name, ':def ', p_partkey, '">', p_name, '<Attribute-Definition><Attribute-Pattern absolutepatternMMLId="', n_name, ':attr ', p_partkey,
         '" absoluteconstrMMLId="K:', p_partkey, if(p_partkey % 5 = 0, concat('" absoluteorigconstrMMLId="K:', p_partkey - 4), ''), '" formatnr="', p_size, '" spelling="', split_part(p_name, ' ', 1),
         '" xmlid="a', p_partkey, '"/></Attribute-Definition></Definition-Item></Item>')
FROM {part} JOIN {nation} ON p_partkey % 25 = n_nationkey"""

# The same articles as tables, for another engine: what of them each query shows.
_SUPPLIERS, _PARTS = "supplier JOIN nation ON s_nationkey = n_nationkey", "part JOIN nation ON p_partkey % 25 = n_nationkey"
_TH, _CLUSTER, _REG = "n_name || ':' || s_suppkey", "n_name || ':th r' || s_suppkey", "n_name || ':condreg:c' || s_suppkey"
_DEF, _PATTERN, _CONSTR = "'statement:' || n_name || ':def ' || p_partkey || ':d' || p_partkey", "'pattern:' || n_name || ':attr ' || p_partkey || ':a' || p_partkey", "'K:' || p_partkey"
_USED = "'K:' || (s_suppkey % 50 + 1)"


def _nodes(lib_id: str, source: str, nodes: tuple[tuple[str, int, str], ...]) -> str:
    """SELECTs of nodes given by path, node type, and the SQL of the spelling."""
    return " UNION ALL ".join(
        f"SELECT {lib_id} AS lib_id, '{path}' AS node_path, {path.rpartition('[')[2][:-1]} AS pos, {path.count('/') - 1} AS depth, '{path.rpartition('/')[2].rpartition('[')[0]}' AS tag, '{kind}' AS node_type, {spelling} AS spelling FROM {source}"
        for path, kind, spelling in nodes
    )


_TOP, _MID = "/Item[1]/Theorem-Item[1]/Proposition[1]", "/Item[1]/Cluster[1]/Conditional-Registration[1]"
EXPECTED = {
    "ingest_items": (
        ("article_name", "kind", "subkind", "number", "lib_id", "title", "text_content"),
        f"""SELECT n_name AS article_name, 'statement' AS kind, 'th' AS subkind, cast(s_suppkey as int) AS number, {_TH} AS lib_id, 'S' || s_suppkey AS title, 'of ' || s_name AS text_content FROM {_SUPPLIERS}
        UNION ALL SELECT n_name, 'statement', 'th', cast(1000000 + s_suppkey as int), {_CLUSTER}, NULL, NULL FROM {_SUPPLIERS} WHERE s_suppkey % 4 = 0
        UNION ALL SELECT n_name, 'registration', 'condreg', cast(s_suppkey as int), {_REG}, 'Conditional-Registration', NULL FROM {_SUPPLIERS} WHERE s_suppkey % 4 = 0
        UNION ALL SELECT n_name, 'statement', 'def', cast(p_partkey as int), {_DEF}, NULL, p_name FROM {_PARTS}
        UNION ALL SELECT n_name, 'notation', 'attrnot', cast(p_partkey as int), {_PATTERN}, split_part(p_name, ' ', 1), NULL FROM {_PARTS}
        UNION ALL SELECT n_name, 'constructor', 'attr', cast(p_partkey as int), {_CONSTR}, split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) FROM {_PARTS}""",
    ),
    "ingest_nodes": (
        ("lib_id", "node_path", "pos", "depth", "tag", "node_type", "spelling"),
        _nodes(_TH, _SUPPLIERS, (("/Item[1]", "theorems", "NULL"), ("/Item[1]/Theorem-Item[1]", "no_nodes", "NULL"), (_TOP, "no_nodes", "NULL"), (f"{_TOP}/Label[1]", "no_nodes", "'S' || s_suppkey"),
            (f"{_TOP}/Infix-Term[2]", "no_nodes", "'+'"), (f"{_TOP}/Infix-Term[2]/Numeral-Term[1]", "no_nodes", "NULL")))
        + " UNION ALL " + _nodes(_CLUSTER, f"{_SUPPLIERS} WHERE s_suppkey % 4 = 0", (("/Item[1]", "registrations", "NULL"), ("/Item[1]/Cluster[1]", "no_nodes", "NULL"), (_MID, "no_nodes", "NULL"),
            *[(f"{_MID}/Attribute[{k}]", "no_nodes", "NULL") for k in (1, 2, 3)]))
        + " UNION ALL " + _nodes(_REG, f"{_SUPPLIERS} WHERE s_suppkey % 4 = 0", (("/Conditional-Registration[1]", "registrations", "NULL"), *[(f"/Conditional-Registration[1]/Attribute[{k}]", "no_nodes", "NULL") for k in (1, 2, 3)]))
        + " UNION ALL " + _nodes(_DEF, _PARTS, (("/Item[1]", "definitions", "NULL"), ("/Item[1]/Definition-Item[1]", "no_nodes", "NULL"), ("/Item[1]/Definition-Item[1]/Attribute-Definition[1]", "no_nodes", "NULL"),
            ("/Item[1]/Definition-Item[1]/Attribute-Definition[1]/Attribute-Pattern[1]", "symbols", "split_part(p_name, ' ', 1)"))),
    ),
    "ingest_notations": (
        ("lib_id", "symbol", "symbol_kind", "constructor", "definition"),
        f"SELECT {_PATTERN} AS lib_id, split_part(p_name, ' ', 1) AS symbol, cast(1 as int) AS symbol_kind, {_CONSTR} AS constructor, {_DEF} AS definition FROM {_PARTS}",
    ),
    "ingest_constructors": (
        ("lib_id", "constructor_kind", "short_name", "definition", "origin"),
        f"""SELECT {_CONSTR} AS lib_id, 'attr' AS constructor_kind, split_part(p_name, ' ', 1) AS short_name, {_DEF} AS definition, CASE WHEN p_partkey % 5 = 0 AND p_partkey - 4 IN (SELECT p_partkey FROM part) THEN 'K:' || (p_partkey - 4) END AS origin FROM {_PARTS}""",
    ),
    "ingest_references": (
        ("lib_id", "constructor", "role", "is_positive", "occurrences"),
        f"""SELECT {_TH} AS lib_id, {_USED} AS constructor, 'ref' AS role, true AS is_positive, 1 AS occurrences FROM {_SUPPLIERS} WHERE s_suppkey % 50 + 1 IN (SELECT p_partkey FROM part)
        UNION ALL SELECT {_CLUSTER}, {_USED}, 'ref', true, 2 FROM {_SUPPLIERS} WHERE s_suppkey % 4 = 0 AND s_suppkey % 50 + 1 IN (SELECT p_partkey FROM part)
        UNION ALL SELECT {_REG}, {_USED}, 'ref', true, 2 FROM {_SUPPLIERS} WHERE s_suppkey % 4 = 0 AND s_suppkey % 50 + 1 IN (SELECT p_partkey FROM part)""",
    ),
    "ingest_registrations": (
        ("lib_id", "registration_kind", "constructor", "role", "is_positive"),
        f"SELECT {_REG} AS lib_id, 'condreg' AS registration_kind, {_USED} AS constructor, 'ref' AS role, true AS is_positive FROM {_SUPPLIERS} WHERE s_suppkey % 4 = 0 AND s_suppkey % 50 + 1 IN (SELECT p_partkey FROM part)",
    ),
    "ingest_symbols": (
        ("article_name", "text", "normalized"),
        f"SELECT DISTINCT n_name AS article_name, split_part(p_name, ' ', 1) AS text, lower(split_part(p_name, ' ', 1)) AS normalized FROM {_PARTS}",
    ),
    "ingest_formats": (
        ("article_name", "name", "nodes"),
        f"SELECT n_name AS article_name, cast(p_size as string) AS name, count(*) AS nodes FROM {_PARTS} GROUP BY ALL",
    ),
}


def star_articles(spark: SparkSession, directory: str) -> DataFrame:
    """(path, content, sha256) of an article for each nation."""
    items = spark.sql(ITEMS, **{t: spark.read.parquet(f"{directory}/{t}.parquet") for t in INPUTS})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "k", "xml"))), lambda x: x["xml"]), "\n")
    content = F.concat(F.lit('<Text-Proper articleid="'), "article", F.lit('">\n'), text, F.lit("\n</Text-Proper>")).cast("binary")
    return items.groupBy("article").agg(content.alias("content")).select(F.concat(F.lit("star/"), F.lower("article"), F.lit(".esx")).alias("path"), "content", F.sha2("content", 256).alias("sha256"))


def ingested_star(spark: SparkSession, directory: str) -> Library:
    """The library that ingest makes of the articles; parsed rows are persisted."""
    return Library(spark, library_tables(parse_files(star_articles(spark, directory)).persist()))


def shown(library: Library, name: str) -> DataFrame:
    """What a query of EXPECTED shows of an ingested library: ids by the library ids that stand for them."""
    lib_id = library.mml_item.select(F.col("id").alias("of"), F.col("lib_id").alias("of_lib"))

    def named(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(lib_id.select(F.col("of").alias(column), F.col("of_lib").alias(out)), column, "left")

    articles = library.article.select(F.col("id").alias("article_id"), F.col("name").alias("article_name"))
    if name == "ingest_items":
        df = library.view_items
    elif name == "ingest_nodes":
        df = named(library.item_node, "item_id", "lib_id").withColumn("spelling", F.col("attrs")["spelling"])
    elif name == "ingest_notations":
        df = library.notation.join(library.notation_symbol.join(library.symbol.select(F.col("id").alias("symbol_id"), F.col("text").alias("symbol")), "symbol_id"), F.col("item_id") == F.col("notation_id"))
        df = df.drop("notation_id").join(library.notation_constructor.select(F.col("notation_id").alias("item_id"), "constructor_item_id"), "item_id")
        df = named(named(named(df, "item_id", "lib_id"), "constructor_item_id", "constructor"), "definition_item_id", "definition").withColumn("symbol_kind", F.col("pos"))
    elif name == "ingest_constructors":
        df = library.constructor.join(library.constructor_definition.withColumnRenamed("constructor_item_id", "item_id"), "item_id").join(library.constructor_redefinition.withColumnRenamed("copy_item_id", "item_id"), "item_id", "left")
        df = named(named(named(df, "item_id", "lib_id"), "definition_item_id", "definition"), "origin_item_id", "origin")
    elif name == "ingest_references":
        df = named(named(library.item_constructor_ref, "item_id", "lib_id"), "constructor_item_id", "constructor")
    elif name == "ingest_registrations":
        df = library.registration_relation.withColumnRenamed("registration_item_id", "item_id").join(library.registration, "item_id")
        df = named(named(df, "item_id", "lib_id"), "constructor_item_id", "constructor")
    elif name == "ingest_symbols":
        df = library.symbol.join(articles, "article_id")
    else:
        nodes = library.item_node.filter("format_id is not null").groupBy("format_id").agg(F.count(F.lit(1)).alias("nodes"))
        df = library.format.join(articles, "article_id").join(nodes, F.col("id") == F.col("format_id"))
    return df.select(*EXPECTED[name][0])
