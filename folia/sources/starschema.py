"""A document library derived from star-schema tables, by SQL that Spark and other engines read alike.

Orders become statements with a tree of propositions (one a line), terms and numerals;
suppliers become registrations; parts become constructors, notations and symbols; lines become
references. Tables named in braces are the inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.plans.library import Library

INPUTS = ("nation", "customer", "supplier", "part", "orders", "lineitem")
ATTRIBUTES = ("kind", "xmlid", "position", "spelling", "nonocc", "occurs", "number")

SQL = {
    "article": "SELECT 'a:' || cast(n_nationkey as string) AS id, n_name AS name FROM {nation}",
    "order_items": """
        SELECT 'o:' || cast(o_orderkey as string) AS id, 'a:' || cast(c_nationkey as string) AS article_id, o_orderkey AS k, o_orderpriority AS text, c_mktsegment AS segment,
               CASE o_orderstatus WHEN 'F' THEN 'th' WHEN 'O' THEN 'def' ELSE 'sch' END AS sub
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "supplier_items": """
        SELECT 's:' || cast(s_suppkey as string) AS id, 'a:' || cast(s_nationkey as string) AS article_id, s_suppkey AS k, s_name AS text,
               CASE s_suppkey % 3 WHEN 0 THEN 'exreg' WHEN 1 THEN 'condreg' ELSE 'funcreg' END AS sub
        FROM {supplier}""",
    "part_items": """
        SELECT 'p:' || cast(p_partkey as string) AS id, 'n:' || cast(p_partkey as string) AS notation_id, 'a:' || cast(p_partkey % 25 as string) AS article_id, p_partkey AS k, p_name AS text,
               CASE p_size % 7 WHEN 0 THEN 'aggr' WHEN 1 THEN 'attr' WHEN 2 THEN 'func' WHEN 3 THEN 'mode' WHEN 4 THEN 'pred' WHEN 5 THEN 'sel' ELSE 'struct' END AS sub
        FROM {part}""",
    "lines": """
        SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS number, cast(l_quantity as int) AS quantity, l_returnflag AS flag, l_linestatus AS status,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line
        FROM {lineitem}""",
    "mml_item": """
        SELECT id, article_id, 'statement' AS kind, sub AS subkind, 'L' || cast(k as string) || ':' || sub AS lib_id, text AS text_content FROM {order_items}
        UNION ALL SELECT id, article_id, 'registration', sub, 'R' || cast(k as string) || ':' || sub, text FROM {supplier_items}
        UNION ALL SELECT id, article_id, 'constructor', sub, 'C' || cast(k as string) || ':' || sub, text FROM {part_items}
        UNION ALL SELECT notation_id, article_id, 'notation', sub || 'not', 'N' || cast(k as string) || ':' || sub, text FROM {part_items}""",
    "statement": "SELECT id AS item_id, sub AS statement_kind, text AS statement_text FROM {order_items}",
    "constructor": "SELECT id AS item_id, sub AS constructor_kind, text AS short_name FROM {part_items}",
    "notation": "SELECT notation_id AS item_id, sub || 'not' AS notation_kind FROM {part_items}",
    "registration": """
        SELECT i.id AS item_id, i.sub AS registration_kind, 'p:' || cast(m.least as string) AS main_mode_constructor_id, 'p:' || cast(m.most as string) AS main_func_constructor_id
        FROM {supplier_items} i LEFT JOIN (SELECT l_suppkey, min(l_partkey) AS least, max(l_partkey) AS most FROM {lineitem} GROUP BY l_suppkey) m ON m.l_suppkey = i.k""",
    "symbol": """
        SELECT 'y:' || word AS id, word AS text, lower(word) AS normalized, 'O' AS kind, 'a:' || cast(min(k) % 25 as string) AS article_id
        FROM (SELECT split_part(p_name, ' ', 1) AS word, p_partkey AS k FROM {part} UNION ALL SELECT split_part(p_name, ' ', 2), p_partkey FROM {part}) w GROUP BY word""",
    "notation_symbol": """
        SELECT 'n:' || cast(p_partkey as string) AS notation_id, 'y:' || split_part(p_name, ' ', 1) AS symbol_id, 1 AS pos FROM {part}
        UNION ALL SELECT 'n:' || cast(p_partkey as string), 'y:' || split_part(p_name, ' ', 2), 2 FROM {part}""",
    "notation_constructor": """
        SELECT notation_id, id AS constructor_item_id, 'main' AS role FROM {part_items}
        UNION ALL SELECT a.notation_id, b.id, 'also' FROM {part_items} a JOIN {part_items} b ON b.k = a.k + 25 WHERE a.k % 5 = 0""",
    "item_constructor_ref": """
        SELECT 'e:' || cast(k as string) || ':' || cast(p as string) || ':' || flag AS id, 'o:' || cast(k as string) AS item_id, 'p:' || cast(p as string) AS constructor_item_id,
               CASE flag WHEN 'N' THEN 'ref' WHEN 'A' THEN 'termtype_ref' ELSE 'deftype_ref' END AS role, cast(count(*) as int) AS occurrences
        FROM {lines} GROUP BY k, p, flag
        UNION ALL SELECT 'e:p' || cast(a.k as string), a.id, b.id, 'ref', 1 FROM {part_items} a JOIN {part_items} b ON b.k = a.k - 7""",
    "constructor_definition": """
        SELECT DISTINCT 'p:' || cast(l.p as string) AS constructor_item_id, i.id AS definition_item_id FROM {lines} l JOIN {order_items} i ON i.k = l.k WHERE i.sub = 'def' AND l.line = 1""",
    "constructor_redefinition": """
        SELECT a.id AS copy_item_id, 'p:' || cast(b.least as string) AS origin_item_id
        FROM {part_items} a JOIN (SELECT text, min(k) AS least FROM {part_items} GROUP BY text) b ON b.text = a.text WHERE a.k > b.least""",
    "constructor_definiens": "SELECT constructor_item_id, definition_item_id AS definiens_item_id FROM {constructor_definition}",
    "registration_relation": """
        SELECT 'g:' || item_id AS id, item_id AS registration_item_id, main_mode_constructor_id AS constructor_item_id, 'antecedent' AS role
        FROM {registration} WHERE main_mode_constructor_id IS NOT NULL""",
    "constructor_property": "SELECT id AS constructor_item_id, 'commutativity' AS property_name, k % 2 = 0 AS property_value FROM {part_items} WHERE sub = 'func'",
    "flat_node": """
        SELECT id || ':0' AS id, id AS item_id, cast(NULL as string) AS parent_node_id, '/Item[1]' AS node_path, 1 AS pos, 0 AS depth, 'Item' AS tag,
               CASE sub WHEN 'th' THEN 'theorems' WHEN 'def' THEN 'definitions' ELSE 'schemes' END AS node_type,
               CASE sub WHEN 'th' THEN 'Theorem-Item' WHEN 'def' THEN 'Definition-Item' ELSE 'Scheme-Block-Item' END AS a_kind, 'x' || cast(k as string) AS a_xmlid,
               cast(k % 7 as string) || ':1' AS a_position, cast(NULL as string) AS a_spelling, cast(NULL as string) AS a_nonocc, cast(NULL as string) AS a_occurs, cast(NULL as string) AS a_number
        FROM {order_items}
        UNION ALL SELECT id || ':0', id, NULL, '/Registration[1]', 1, 0, 'Registration', 'registrations', 'Cluster', 'r' || cast(k as string), NULL, NULL, NULL, NULL, NULL FROM {supplier_items}
        UNION ALL SELECT 'o:' || cast(k as string) || ':' || cast(line as string), 'o:' || cast(k as string), 'o:' || cast(k as string) || ':0', '/Item[1]/Proposition[' || cast(line as string) || ']',
               cast(line as int), 1, 'Proposition', 'no_nodes', NULL, 'x' || cast(k as string) || '.' || cast(line as string), NULL, NULL, NULL, NULL, NULL FROM {lines}
        UNION ALL SELECT 'o:' || cast(k as string) || ':' || cast(line as string) || ':1', 'o:' || cast(k as string), 'o:' || cast(k as string) || ':' || cast(line as string),
               '/Item[1]/Proposition[' || cast(line as string) || ']/Infix-Term[1]', 1, 2, 'Infix-Term', 'no_nodes', NULL, NULL, NULL, flag, NULL, NULL, NULL FROM {lines}
        UNION ALL SELECT 'o:' || cast(k as string) || ':' || cast(line as string) || ':1:1', 'o:' || cast(k as string), 'o:' || cast(k as string) || ':' || cast(line as string) || ':1',
               '/Item[1]/Proposition[' || cast(line as string) || ']/Infix-Term[1]/Numeral-Term[1]', 1, 3, 'Numeral-Term', 'no_nodes', NULL, NULL, NULL, NULL, NULL, NULL, cast(quantity as string) FROM {lines}
        UNION ALL SELECT 'o:' || cast(k as string) || ':' || cast(line as string) || ':1:2', 'o:' || cast(k as string), 'o:' || cast(k as string) || ':' || cast(line as string) || ':1',
               '/Item[1]/Proposition[' || cast(line as string) || ']/Infix-Term[1]/Infix-Term[2]', 2, 3, 'Infix-Term', 'no_nodes', NULL, NULL, NULL, status, NULL, NULL, NULL FROM {lines} WHERE number % 2 = 0
        UNION ALL SELECT 'o:' || cast(k as string) || ':' || cast(line as string) || ':1:2:1', 'o:' || cast(k as string), 'o:' || cast(k as string) || ':' || cast(line as string) || ':1:2',
               '/Item[1]/Proposition[' || cast(line as string) || ']/Infix-Term[1]/Infix-Term[2]/Numeral-Term[1]', 1, 4, 'Numeral-Term', 'no_nodes', NULL, NULL, NULL, NULL, NULL, NULL, '00' || cast(number as string)
               FROM {lines} WHERE number % 2 = 0
        UNION ALL SELECT 'o:' || cast(k as string) || ':' || cast(line as string) || ':2', 'o:' || cast(k as string), 'o:' || cast(k as string) || ':' || cast(line as string),
               '/Item[1]/Proposition[' || cast(line as string) || ']/Attribute[2]', 2, 2, 'Attribute', 'no_nodes', NULL, NULL, NULL, status, CASE s % 2 WHEN 0 THEN 'true' ELSE 'false' END, NULL, NULL FROM {lines}
        UNION ALL SELECT i.id || ':r', i.id, i.id || ':0', '/Item[1]/Redefine[' || cast(coalesce(n.n, 0) + 1 as string) || ']', cast(coalesce(n.n, 0) + 1 as int), 1, 'Redefine', 'no_nodes', NULL, NULL, NULL, NULL, NULL,
               CASE i.k % 2 WHEN 0 THEN 'true' ELSE 'false' END, NULL FROM {order_items} i LEFT JOIN (SELECT k, count(*) AS n FROM {lines} GROUP BY k) n ON n.k = i.k WHERE i.sub = 'def'
        UNION ALL SELECT i.id || ':p', i.id, i.id || ':0', '/Item[1]/Attribute-Pattern[' || cast(coalesce(n.n, 0) + 2 as string) || ']', cast(coalesce(n.n, 0) + 2 as int), 1, 'Attribute-Pattern', 'symbols', NULL,
               NULL, NULL, CASE i.sub WHEN 'sch' THEN '(' || cast(coalesce(n.n, 0) as string) || ' + ' || cast(i.k % 5 as string) || ') * 2' ELSE i.segment END, NULL, NULL, NULL
               FROM {order_items} i LEFT JOIN (SELECT k, count(*) AS n FROM {lines} GROUP BY k) n ON n.k = i.k""",
}


def star_library(spark: SparkSession, directory: str, *, keep: bool = False) -> Library:
    """The library over the Parquet tables of a directory, lazily. keep: numbered lines, which most node rows come from, are persisted."""
    frames: dict[str, DataFrame] = {t: spark.read.parquet(f"{directory}/{t}.parquet") for t in INPUTS}
    for name, text in SQL.items():
        used = {n: frames[n] for n in frames if "{" + n + "}" in text}
        if name == "lines":  # one shuffle for all that numbers lines, whatever columns it takes of them
            used["lineitem"] = used["lineitem"].repartition("l_orderkey")
        frames[name] = spark.sql(text, **used)
        if keep and name == "lines":
            frames[name] = frames[name].persist()
    flat = frames.pop("flat_node")
    pairs = [x for a in ATTRIBUTES for x in (F.lit(a), F.col(f"a_{a}"))]
    attrs = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    label = F.concat(F.lit("<"), "tag", F.coalesce(F.concat(F.lit(' spelling="'), "a_spelling", F.lit('"')), F.lit("")), F.lit(">"))
    frames["item_node"] = flat.select("id", "item_id", "parent_node_id", "node_path", "node_type", F.lit(None).cast("string").alias("symbol_id"), "pos", "depth", label.alias("raw"), "tag", attrs.alias("attrs"))
    frames["mml_item"] = frames["mml_item"].withColumn("raw_xml", F.lit(None).cast("string"))
    frames["article"] = frames["article"].withColumn("xml_content", F.lit(None).cast("string"))
    return Library(spark, {n: df for n, df in frames.items() if n not in (*INPUTS, "order_items", "supplier_items", "part_items", "lines")})


def star_tables() -> dict[str, str]:
    """The same tables as SQL for another engine, in the order in which they build on each other."""
    return {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in SQL.items()}
