"""Registered queries over the star-schema library, each with SQL that another engine runs on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.engine import Engine
from folia.plans.library import Library, items_sharing_refs
from folia.plans.paging import PageRequest
from folia.plans.projection import project
from folia.sources.ingest import attribute_count, backfilled, tag_diagnostics
from folia.sources.pages import page_library
from folia.sources.stararticles import EXPECTED, ingested_star, shown
from folia.sources.starschema import star_library, star_tables

ITEM = ("item_id", "lib_id", "article_name", "kind", "subkind", "node_type", "text_content")
NODE = ("item_id", "node_id", "node_path", "article_name", "node_type", "text_position", "spelling", "raw_text")
SYMBOL = ("item_id", "node_id", "node_path", "lib_id", "article_name", "node_type", "text_position", "spelling", "text_content")
COUNT = ("spelling", "occurrences")

_engines: dict[tuple, Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine for each session and directory; the node tree and what it derives are kept, as a stored library would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        library = star_library(spark, sf_dir, keep=True)
        stored = library.item_node.columns
        library.built["closure"] = library.closure  # of three columns of the nodes, which need not be kept for it
        library.persist("mml_item", "item_constructor_ref", "nodes", "view_items")
        library.tables["item_node"] = library.nodes.select(*stored)  # kept once
        _engines[key] = Engine(spark, library)
    return _engines[key]


#: Derived tables by name, after those of the star-schema library. A statement has only the ones that it uses.
_DERIVED = {
    "item_node": """SELECT *, '<' || tag || coalesce(' spelling="' || a_spelling || '"', '') || '>' AS raw FROM flat_node""",
    "nd": """SELECT *, lower(tag) AS t, CASE WHEN starts_with(node_path, '/Item[1]/Proposition[') THEN split_part(node_path, '/', 3) END AS prop FROM item_node""",  # propositions are not nested
    "vi": """SELECT i.id AS item_id, i.lib_id, a.name AS article_name, i.kind, i.subkind, i.text_content, i.article_id FROM mml_item i JOIN article a ON a.id = i.article_id""",
    "roots": """SELECT item_id, node_type AS root_type FROM flat_node WHERE depth = 0""",
    "va": """SELECT item_id, lib_id, article_name, kind, subkind, text_content, CASE WHEN kind = 'statement' AND subkind = 'th' THEN 'theorems' WHEN kind = 'statement' AND subkind IN ('def', 'dfs') THEN 'definitions'
       WHEN kind = 'statement' AND subkind = 'sch' THEN 'schemes' WHEN kind = 'registration' THEN 'registrations' ELSE kind END AS node_type FROM vi""",
    "vs": """SELECT vi.*, s.statement_kind, coalesce(r.root_type, 'no_nodes') AS node_type FROM vi JOIN statement s USING (item_id) LEFT JOIN roots r USING (item_id)""",
    "vt": """SELECT * FROM vs WHERE statement_kind = 'th' AND node_type = 'theorems'""",
    "vd": """SELECT * FROM vs WHERE statement_kind IN ('def', 'dfs') AND node_type = 'definitions'""",
    "vr": """SELECT vi.*, g.main_mode_constructor_id, g.main_func_constructor_id, CASE WHEN r.root_type IS NULL OR r.root_type = 'no_nodes' THEN 'registrations' ELSE r.root_type END AS node_type
       FROM vi JOIN registration g USING (item_id) LEFT JOIN roots r USING (item_id)""",
    "vc": """SELECT vi.item_id, lib_id, article_name, 'constructor' AS kind, constructor_kind AS subkind, 'constructors' AS node_type, text_content FROM vi JOIN constructor USING (item_id)""",
    "vn": """SELECT vi.item_id, lib_id, article_name, 'notation' AS kind, notation_kind AS subkind, 'notations' AS node_type, text_content FROM vi JOIN notation USING (item_id)""",
    "sy": """SELECT nd.item_id, nd.id AS node_id, node_path, lib_id, article_name, 'symbols' AS node_type, coalesce(a_position, cast(pos as string)) AS text_position, trim(a_spelling) AS spelling, text_content
       FROM nd JOIN vi USING (item_id) WHERE t LIKE '%-pattern' AND trim(coalesce(a_spelling, '')) <> ''""",
    "nr": """SELECT nd.item_id, nd.id AS node_id, node_path, article_name, coalesce(a_kind, t) AS node_type, coalesce(a_position, cast(pos as string)) AS text_position, trim(coalesce(a_spelling, '')) AS spelling, raw AS raw_text,
       t, a_spelling, a_nonocc, a_kind, kind AS item_kind, subkind AS item_sub, lib_id FROM nd JOIN vi USING (item_id)""",
    "up": "SELECT item_id, id, parent_node_id AS parent FROM flat_node WHERE parent_node_id IS NOT NULL",
    "up2": "SELECT a.item_id, a.id, b.parent FROM up a JOIN up b ON b.id = a.parent",
    "up3": "SELECT a.item_id, a.id, b.parent FROM up2 a JOIN up b ON b.id = a.parent",
    "up4": "SELECT a.item_id, a.id, b.parent FROM up3 a JOIN up b ON b.id = a.parent",
    "cl": " UNION ALL ".join(f"SELECT item_id, parent AS anc, id AS des, {k} AS dist FROM up{k if k > 1 else ''}" for k in range(1, 5)),  # no tree is deeper
}

# name: query, columns, SQL over the derived tables
_QUERIES: dict[str, tuple[str, tuple[str, ...], str]] = {}


def _add(name: str, query: str, columns: tuple[str, ...], sql: str) -> None:
    _QUERIES[name] = (query, columns, sql)


def _items(name: str, query: str, view: str, where: str = "true") -> None:
    _add(name, query, ITEM, f"SELECT {', '.join(ITEM)} FROM {view} WHERE {where}")


def _nodes(name: str, query: str, where: str, base: str = "vs", nested: bool = True) -> None:
    """nested: the target can lie inside itself, so that the innermost must be picked."""
    hit = f"hit AS (SELECT * FROM nr WHERE item_id IN (SELECT item_id FROM {base}) AND {where})"
    inner = " WHERE NOT EXISTS (SELECT 1 FROM hit h JOIN cl ON cl.des = h.node_id WHERE cl.anc = hit.node_id)" if nested else ""
    _add(name, query, NODE, f", {hit} SELECT {', '.join(NODE)} FROM hit{inner}")


def _in_item(where: str) -> str:
    return f"item_id IN (SELECT item_id FROM nd WHERE {where})"


def _below(where: str, dist: str = "true") -> str:
    return f"node_id IN (SELECT cl.anc FROM cl JOIN nd ON nd.id = cl.des WHERE {where} AND {dist})"


def _anchor(where: str, below: str, dist: str) -> str:
    return f"item_id IN (SELECT a.item_id FROM nd a JOIN cl ON cl.anc = a.id JOIN nd d ON d.id = cl.des WHERE a.t = '{where}' AND d.t = '{below}' AND {dist})"


# sources
_items("list_theorem", "list of theorem", "vt")
_items("list_definition", "list of definitions", "vd")
_items("list_statement", "list of statement", "vs")
_items("list_registration", "list of registrations", "vr")
_items("list_all", "list of all", "va")
_items("list_in_article", "list of theorem in NATION_3", "vt", "article_name = 'NATION_3'")
_items("article_items", "article NATION_7", "va", "article_name = 'NATION_7'")
_add("list_symbol", "list of symbols", SYMBOL, f"SELECT {', '.join(SYMBOL)} FROM sy")
_add("list_symbol_spelling", "list of symbols in NATION_4 where spelling = 'machinery'", SYMBOL, f"SELECT {', '.join(SYMBOL)} FROM sy WHERE article_name = 'NATION_4' AND lower(spelling) = 'machinery'")
_add("list_symbol_wildcard", "list of symbols where spelling 'B_ILD*'", SYMBOL, f"SELECT {', '.join(SYMBOL)} FROM sy WHERE lower(spelling) LIKE 'b_ild%'")
_add("symbol_occurrences", "occurrences of symbols", COUNT, "SELECT spelling, count(*) AS occurrences FROM sy GROUP BY spelling")
_add("symbol_occurrences_in_article", "occurrences of symbol in NATION_1", COUNT, "SELECT spelling, count(*) AS occurrences FROM sy WHERE article_name = 'NATION_1' GROUP BY spelling")

# navigation
_REFS = "item_id IN (SELECT constructor_item_id FROM item_constructor_ref WHERE role = '{}' AND item_id IN (SELECT item_id FROM vt WHERE article_name = 'NATION_3'))"
for _relation, _role in (("ref", "ref"), ("termtype ref", "termtype_ref"), ("deftype ref", "deftype_ref")):
    _items(f"nav_{_relation.replace(' ', '_')}", f"list of theorem in NATION_3 | {_relation}", "vc", _REFS.format(_role))
_N3 = "(SELECT constructor_item_id FROM item_constructor_ref WHERE role = 'ref' AND item_id IN (SELECT item_id FROM vt WHERE article_name = 'NATION_3'))"
_items("nav_occur", "list of theorem in NATION_3 | ref | occur", "vc", f"item_id IN (SELECT item_id FROM item_constructor_ref WHERE constructor_item_id IN {_N3})")
_items("nav_definition", "list of theorem in NATION_3 | ref | definition", "vd", f"item_id IN (SELECT definition_item_id FROM constructor_definition WHERE constructor_item_id IN {_N3})")
_items("nav_notation", "list of theorem in NATION_3 | ref | notation", "vn", f"item_id IN (SELECT notation_id FROM notation_constructor WHERE constructor_item_id IN {_N3})")
_items("nav_origin", "list of theorem in NATION_3 | ref | origin", "vc", f"item_id IN (SELECT origin_item_id FROM constructor_redefinition WHERE copy_item_id IN {_N3})")
_items("nav_copy", "list of theorem in NATION_3 | ref | copied", "vc", f"item_id IN (SELECT copy_item_id FROM constructor_redefinition WHERE origin_item_id IN {_N3})")
_items("nav_redef", "list of theorem in NATION_3 | ref | redefinition", "vc",
       f"item_id IN (SELECT copy_item_id FROM constructor_redefinition WHERE origin_item_id IN {_N3} UNION ALL SELECT origin_item_id FROM constructor_redefinition WHERE copy_item_id IN {_N3})")
_items("nav_main_mode", "list of registration | main mode", "vc", "item_id IN (SELECT main_mode_constructor_id FROM vr)")
_items("nav_main_functor", "list of registration | main functor", "vc", "item_id IN (SELECT main_func_constructor_id FROM vr)")

# scoped predicates
_N = "t = 'infix-term' AND lower(a_spelling) = 'n'"
_O = "t = 'infix-term' AND lower(a_spelling) = 'o'"
_items("where_item_has", "list of statement where item has InfixTerm spelling 'N' and item has infixterm[spelling='O']", "vs", f"{_in_item(_N)} AND {_in_item(_O)}")
_items("where_item_has_not", "list of statement where item has InfixTerm and item has not Infix-Term[spelling='N']", "vs", _in_item("t = 'infix-term'") + f" AND NOT {_in_item(_N)}")
_items("where_prop_has", "list of theorem where proposition has InfixTerm spelling 'N' and proposition has InfixTerm spelling 'O'", "vt",
       f"item_id IN (SELECT a.item_id FROM (SELECT * FROM nd WHERE {_N}) a JOIN (SELECT * FROM nd WHERE {_O}) b ON a.item_id = b.item_id AND a.prop = b.prop WHERE a.id <> b.id)")
_items("where_prop_two_distinct", "list of statement where proposition has InfixTerm and proposition has InfixTerm", "vs",
       "item_id IN (SELECT item_id FROM nd WHERE t = 'infix-term' AND prop IS NOT NULL GROUP BY item_id, prop HAVING count(*) > 1)")
_items("where_prop_not_has", "list of statement where proposition has NumeralTerm['number'='5'] and proposition not has InfixTerm[spelling='N']", "vs",
       f"""item_id IN (SELECT item_id FROM nd WHERE prop IS NOT NULL GROUP BY item_id, prop
       HAVING count(*) FILTER (WHERE t = 'numeral-term' AND a_number = '5') > 0 AND count(*) FILTER (WHERE t = 'infix-term' AND lower(a_spelling) = 'n') = 0)""")  # fmt: skip
_items("where_all_negative", "list of statement where proposition has not InfixTerm spelling 'N'", "vs",
       f"item_id IN (SELECT item_id FROM nd WHERE prop IS NOT NULL GROUP BY item_id, prop HAVING count(*) FILTER (WHERE t = 'infix-term' AND lower(a_spelling) = 'n') = 0)")
_items("where_item_all_negative", "list of all where item has not InfixTerm", "va", "item_id IN (SELECT item_id FROM nd) AND NOT " + _in_item("t = 'infix-term'"))
_items("where_attr_value", "list of theorem where item has NumeralTerm['number'='50']", "vt", _in_item("t = 'numeral-term' AND a_number = '50'"))
_items("where_attr_wildcard", "list of theorem where item has *[xmlid='X1*.4']", "vt", _in_item("lower(a_xmlid) LIKE 'x1%.4'"))
_items("where_attr_any_key", "list of statement where item has *[\"*occ*\"='false']", "vs", _in_item("a_nonocc = 'false' OR a_occurs = 'false'"))
_items("where_tag_wildcard", "list of statement where item has \"*-pattern\" and item has not \"re_efine\"", "vs", _in_item("t LIKE '%-pattern'") + " AND NOT " + _in_item("t LIKE 're_efine'"))
_items("where_path_child", "list of statement where item has Proposition/InfixTerm spelling 'N'", "vs",
       "item_id IN (SELECT a.item_id FROM nd a JOIN nd d ON d.parent_node_id = a.id WHERE a.t = 'proposition' AND d.t = 'infix-term' AND lower(d.a_spelling) = 'n')")
_items("where_path_desc", "list of statement where item has Proposition//InfixTerm[spelling='O']", "vs",
       "item_id IN (SELECT a.item_id FROM nd a JOIN cl ON cl.anc = a.id JOIN nd d ON d.id = cl.des WHERE a.t = 'proposition' AND d.t = 'infix-term' AND lower(d.a_spelling) = 'o')")
_items("where_path_exact_depth", "list of statement where item has Item/4/NumeralTerm", "vs", _anchor("item", "numeral-term", "dist = 4"))
_items("where_path_chain", "list of theorem where proposition has Infix-Term/InfixTerm/NumeralTerm['number'='002'] and proposition has Attribute[nonocc='true']", "vt",
       """item_id IN (SELECT a.item_id FROM nd a JOIN nd b ON b.parent_node_id = a.id JOIN nd c ON c.parent_node_id = b.id JOIN nd x ON x.item_id = a.item_id AND x.prop = a.prop
       WHERE a.t = 'infix-term' AND b.t = 'infix-term' AND c.t = 'numeral-term' AND c.a_number = '002' AND x.t = 'attribute' AND x.a_nonocc = 'true' AND x.id <> a.id)""")  # fmt: skip
_items("negated_adjective", "list of statement where proposition has negated adjective spelling 'F'", "vs", _in_item("t = 'attribute' AND a_nonocc = 'true' AND lower(a_spelling) = 'f' AND prop IS NOT NULL"))

# nodes
_NUMERAL = "nd.t = 'numeral-term'"
_nodes("nodes_basic", "list of statement in NATION_2 | nodes Proposition", "t = 'proposition' AND article_name = 'NATION_2'", nested=False)
_nodes("nodes_attr", "list of statement | nodes Attribute[nonocc='true'] | filter('spelling=F')", "t = 'attribute' AND a_nonocc = 'true' AND lower(spelling) = 'f'", nested=False)
_nodes("nodes_where_has", "list of theorem | nodes Proposition where has InfixTerm/InfixTerm spelling 'O'",
       "t = 'proposition' AND " + _below("nd.t = 'infix-term' AND EXISTS (SELECT 1 FROM nd c WHERE c.parent_node_id = nd.id AND c.t = 'infix-term' AND lower(c.a_spelling) = 'o')"), "vt", nested=False)
_nodes("nodes_not_has", "list of definition | nodes Proposition where not has InfixTerm[spelling='N'] and has NumeralTerm", f"t = 'proposition' AND NOT {_below(_N)} AND {_below(_NUMERAL)}", "vd", nested=False)
_nodes("nodes_redefine_true", "list of definition | nodes Item where redefine true", "t = 'item' AND " + _below("nd.t = 'redefine' AND nd.a_occurs = 'true'"), "vd")
_nodes("nodes_redefine_false", "list of definition | nodes Item where redefine false", "t = 'item' AND " + _below("nd.t = 'redefine' AND nd.a_occurs = 'false'"), "vd")
_nodes("nodes_redefine_both", "list of statement | nodes Item where redefine both", "t = 'item' AND " + _below("nd.t = 'redefine'"))
_nodes("nodes_redefined", "list of statement | nodes Item where not redefined", "t = 'item' AND NOT " + _below("nd.t = 'redefine' AND nd.a_occurs = 'true'"))
_nodes("nodes_spelling", "list of theorem | nodes Proposition where spelling 'R'", "t = 'proposition' AND " + _below("lower(nd.a_spelling) = 'r'"), "vt", nested=False)
_nodes("nodes_not_spelling", "list of theorem | nodes Proposition where has InfixTerm not spelling 'R'", "t = 'proposition' AND NOT " + _below("nd.t = 'infix-term' AND lower(nd.a_spelling) = 'r'"), "vt", nested=False)
_nodes("nodes_most_specific", "list of statement in NATION_5 | nodes InfixTerm", "t = 'infix-term' AND article_name = 'NATION_5'")
_nodes("nodes_path", "list of theorem in NATION_6 | nodes Proposition/2/InfixTerm", "article_name = 'NATION_6' AND t = 'proposition' AND " + _below("nd.t = 'infix-term'", "dist = 2"), "vt", nested=False)

# row filters
_items("filter_kv", "list of all | filter('kind=Registration')", "va", "lower(kind) = 'registration'")
_items("filter_kv_wildcard", "list of statement | filter('text=*-U_GENT')", "vs", "lower(text_content) LIKE '%-u_gent'")
_items("filter_unknown_key", "list of registration | filter('colour=red')", "vr", "false")
_items("filter_needle", "list of all | filter('nation_3')", "va", "contains(lower(article_name || ' ' || lib_id || ' ' || kind || ' ' || subkind || ' ' || node_type || '    ' || text_content), 'nation_3')")
_items("grep", "list of statement | grep('^[1-3]-.*(high|low)?$')", "vs", "regexp_matches(text_content, '(?i)^[1-3]-.*(high|low)?$') OR regexp_matches(lib_id, '(?i)^[1-3]-.*(high|low)?$')")
_items("grep_lib", "list of all | grep('^c1[0-9]*:(attr|mode)$')", "va", "regexp_matches(lib_id, '(?i)^c1[0-9]*:(attr|mode)$')")
_NUM = "t IN ('numeral-term', 'natural-term', 'numeralterm', 'naturalterm')"
_items("numeq", "list of statement | numeq(4)", "vs", _in_item(f"{_NUM} AND a_number = '4'"))
for _op, _sign in (("ge", ">="), ("le", "<="), ("gt", ">"), ("lt", "<")):
    _items(f"num{_op}", f"list of theorem | num{_op}(5)", "vt", _in_item(f"{_NUM} AND cast(a_number as bigint) {_sign} 5"))
_items("number_infix", "list of definition | number >= 49", "vd", _in_item(f"{_NUM} AND cast(a_number as bigint) >= 49"))
_add("symbol_numeric_expression", "occurrences of symbols | numgt(9)", COUNT,
     r"SELECT spelling, count(*) AS occurrences FROM sy WHERE cast(nullif(regexp_extract(spelling, '^.(\d+) . (\d+)', 1), '') as int) + cast(nullif(regexp_extract(spelling, '^.(\d+) . (\d+)', 2), '') as int) > 4 GROUP BY spelling")  # twice the sum is over 9

# counts
_COUNTS = {
    "ref": "SELECT item_id, constructor_item_id AS x FROM item_constructor_ref WHERE role = 'ref'",
    "termtype ref": "SELECT item_id, constructor_item_id AS x FROM item_constructor_ref WHERE role = 'termtype_ref'",
    "deftype ref": "SELECT item_id, constructor_item_id AS x FROM item_constructor_ref WHERE role = 'deftype_ref'",
    "occur": "SELECT constructor_item_id AS item_id, item_id AS x FROM item_constructor_ref",
    "definition": "SELECT constructor_item_id AS item_id, definition_item_id AS x FROM constructor_definition",
    "notation": "SELECT constructor_item_id AS item_id, notation_id AS x FROM notation_constructor",
}
for _name, _list, _view, _op, _sign, _relation, _k in (
    ("whereeq_ref", "statement", "vs", "eq", "=", "ref", 2), ("wherege_occur", "all | filter('kind=constructor')", "va", "ge", ">=", "occur", 30), ("wherele_definition", "all | filter('kind=constructor')", "va", "le", "<=", "definition", 1),
    ("wheregt_notation", "all | filter('kind=constructor')", "va", "gt", ">", "notation", 1), ("wherelt_termtype_ref", "theorem", "vt", "lt", "<", "termtype ref", 1), ("wherege_deftype_ref", "statement", "vs", "ge", ">=", "deftype ref", 3),
):
    _counted = f"coalesce((SELECT count(DISTINCT x) FROM ({_COUNTS[_relation]}) e WHERE e.item_id = {_view}.item_id), 0) {_sign} {_k}"
    _items(_name, f"list of {_list} | where{_op}({_relation}, {_k})", _view, _counted + (" AND kind = 'constructor'" if "constructor" in _list else ""))
_items("card_node_item", "list of statement | wherege(infixterm, 6)", "vs", "item_id IN (SELECT item_id FROM nd WHERE t = 'infix-term' GROUP BY item_id HAVING count(*) >= 6)")
_items("card_node_zero", "list of statement | whereeq(item:Infix-Term, 0)", "vs", "NOT " + _in_item("t = 'infix-term'"))
_items("card_node_prop", "list of statement | whereeq(proposition:InfixTerm, 1)", "vs",
       "item_id IN (SELECT item_id FROM (SELECT item_id, prop, count(*) AS n FROM nd WHERE t = 'infix-term' AND prop IS NOT NULL GROUP BY item_id, prop) c GROUP BY item_id HAVING max(n) = 1)")

# set operators
_items("set_and", "list of theorem and list of statement where item has InfixTerm spelling 'N'", "vt", _in_item(_N))
_items("set_butnot", "list of theorem butnot list of theorem in NATION_3", "vt", "article_name <> 'NATION_3'")
_items("set_not", "not list of statement", "va", "kind <> 'statement'")
_add("set_or", "list of theorem in NATION_1 or list of registration or list of all in NATION_1", ITEM,
     f"SELECT {', '.join(ITEM)} FROM vt WHERE article_name = 'NATION_1' UNION ALL SELECT {', '.join(ITEM)} FROM vr UNION ALL SELECT {', '.join(ITEM)} FROM va WHERE article_name = 'NATION_1' AND node_type NOT IN ('theorems', 'registrations')")
_items("set_nested", "(list of theorem or list of definition) and not (list of all in NATION_2 butnot list of definition)", "vs", "node_type IN ('theorems', 'definitions') AND (article_name <> 'NATION_2' OR node_type = 'definitions')")
_items("set_pipeline", "list of statement | wherege(proposition:numeralterm,2) and list of statement where item has InfixTerm | numgt(49)", "vs",
       "item_id IN (SELECT item_id FROM (SELECT item_id, prop, count(*) AS n FROM nd WHERE t = 'numeral-term' AND prop IS NOT NULL GROUP BY item_id, prop) c GROUP BY item_id HAVING max(n) >= 2) AND "
       + _in_item("t = 'infix-term'") + " AND " + _in_item(f"{_NUM} AND cast(a_number as bigint) > 49"))
# relations: name, columns, SQL over the derived tables
_VIEWS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "article_summary": ("view_article_summary", ("article_name", "items", "constructors", "notations", "statements", "registrations"),
        """SELECT a.name AS article_name, count(i.id) AS items, count(i.id) FILTER (WHERE kind = 'constructor') AS constructors, count(i.id) FILTER (WHERE kind = 'notation') AS notations,
        count(i.id) FILTER (WHERE kind = 'statement') AS statements, count(i.id) FILTER (WHERE kind = 'registration') AS registrations FROM article a LEFT JOIN mml_item i ON i.article_id = a.id GROUP BY a.name"""),
    "article_node_summary": ("view_article_node_summary", ("article_name", "theorems", "definitions", "schemes", "registrations", "symbols"),
        """SELECT a.name AS article_name, count(DISTINCT vi.item_id) FILTER (WHERE root_type = 'theorems') AS theorems, count(DISTINCT vi.item_id) FILTER (WHERE root_type = 'definitions') AS definitions,
        count(DISTINCT vi.item_id) FILTER (WHERE root_type = 'schemes') AS schemes, count(DISTINCT vi.item_id) FILTER (WHERE root_type = 'registrations') AS registrations,
        (SELECT count(*) FROM symbol y WHERE y.article_id = a.id) AS symbols FROM article a LEFT JOIN vi ON vi.article_id = a.id LEFT JOIN roots USING (item_id) GROUP BY a.id, a.name"""),
    "ref_counts": ("view_item_constructor_ref_counts", ("item_id", "role", "distinct_constructors", "total_occurrences"),
        "SELECT item_id, role, count(DISTINCT constructor_item_id) AS distinct_constructors, cast(sum(occurrences) as bigint) AS total_occurrences FROM item_constructor_ref GROUP BY item_id, role"),
    "role_summary": ("view_items_role_summary", ("item_id", "lib_id", "article_name", "roles", "constructors"),
        """SELECT vi.item_id, lib_id, article_name, coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') AS roles, count(DISTINCT constructor_item_id) AS constructors
        FROM vi LEFT JOIN item_constructor_ref r USING (item_id) GROUP BY ALL"""),
    "symbol_usage": ("view_item_symbol_usage", ("item_id", "symbol_id", "symbol_text", "article_name", "lib_id"),
        "SELECT DISTINCT vi.item_id, s.id AS symbol_id, s.text AS symbol_text, article_name, lib_id FROM notation_symbol n JOIN symbol s ON s.id = n.symbol_id JOIN vi ON vi.item_id = n.notation_id"),
    "notation_synonyms": ("view_notation_synonyms", ("constructor_item_id", "notation_id_1", "notation_id_2"),
        "SELECT a.constructor_item_id, a.notation_id AS notation_id_1, b.notation_id AS notation_id_2 FROM notation_constructor a JOIN notation_constructor b ON a.constructor_item_id = b.constructor_item_id AND a.notation_id <> b.notation_id"),
    "query_nodes": ("view_query_nodes", ("node_type", "item_id", "lib_id", "article_name", "text_content"),
        """SELECT 'symbols' AS node_type, y.id AS item_id, NULL AS lib_id, a.name AS article_name, y.text AS text_content FROM symbol y LEFT JOIN article a ON a.id = y.article_id
        UNION ALL SELECT node_type, item_id, lib_id, article_name, text_content FROM vt UNION ALL SELECT node_type, item_id, lib_id, article_name, text_content FROM vd
        UNION ALL SELECT node_type, item_id, lib_id, article_name, text_content FROM vs WHERE statement_kind = 'sch' AND node_type = 'schemes'
        UNION ALL SELECT node_type, item_id, lib_id, article_name, text_content FROM vr WHERE node_type = 'registrations'"""),
    "symbol_denotes_constructors": ("view_symbol_denotes_constructors", ("symbol_id", "symbol_text", "notation_id", "constructor_item_id", "constructor_kind", "constructor_lib_id"),
        """SELECT s.id AS symbol_id, s.text AS symbol_text, n.notation_id, c.item_id AS constructor_item_id, c.constructor_kind, vi.lib_id AS constructor_lib_id FROM symbol s JOIN notation_symbol n ON n.symbol_id = s.id
        JOIN notation_constructor x ON x.notation_id = n.notation_id JOIN constructor c ON c.item_id = x.constructor_item_id JOIN vi ON vi.item_id = c.item_id"""),
    "constructor_ref_items": ("view_constructor_ref_items", ("constructor_item_id", "constructor_kind", "item_id", "role", "article_name", "lib_id", "kind", "subkind"),
        """SELECT r.constructor_item_id, c.constructor_kind, r.item_id, r.role, article_name, lib_id, kind, subkind FROM item_constructor_ref r JOIN constructor c ON c.item_id = r.constructor_item_id JOIN vi ON vi.item_id = r.item_id"""),
    "constructor_properties": ("view_constructor_properties", ("constructor_item_id", "property_name", "property_value", "lib_id", "article_name", "constructor_kind"),
        """SELECT p.constructor_item_id, property_name, property_value, lib_id, article_name, constructor_kind FROM constructor_property p JOIN constructor c ON c.item_id = p.constructor_item_id JOIN vi ON vi.item_id = c.item_id"""),
    "constructor_definitions": ("view_constructor_definitions", ("constructor_item_id", "constructor_lib_id", "definition_item_id", "definition_lib_id"),
        """SELECT d.constructor_item_id, a.lib_id AS constructor_lib_id, d.definition_item_id, b.lib_id AS definition_lib_id FROM constructor_definition d JOIN vi a ON a.item_id = d.constructor_item_id
        JOIN vi b ON b.item_id = d.definition_item_id"""),
    "definiens_to_constructors": ("view_definiens_to_constructors", ("constructor_item_id", "constructor_lib_id", "definiens_item_id", "definiens_lib_id"),
        """SELECT d.constructor_item_id, a.lib_id AS constructor_lib_id, d.definiens_item_id, b.lib_id AS definiens_lib_id FROM constructor_definiens d JOIN vi a ON a.item_id = d.constructor_item_id
        JOIN vi b ON b.item_id = d.definiens_item_id"""),
    "registration_clusters": ("view_registration_clusters", ("registration_item_id", "registration_lib_id", "constructor_item_id", "constructor_lib_id", "role"),
        """SELECT d.registration_item_id, a.lib_id AS registration_lib_id, d.constructor_item_id, b.lib_id AS constructor_lib_id, d.role FROM registration_relation d JOIN vi a ON a.item_id = d.registration_item_id
        JOIN vi b ON b.item_id = d.constructor_item_id"""),
    "item_nodes": ("view_item_nodes", ("id", "item_id", "node_path", "pos", "depth", "tag", "article_name", "lib_id"), "SELECT nd.id, item_id, node_path, pos, depth, tag, article_name, lib_id FROM nd JOIN vi USING (item_id)"),
    "node_closure": ("closure", ("item_id", "anc_id", "des_id", "dist"), "SELECT item_id, anc AS anc_id, des AS des_id, dist FROM cl"),
}

_PAGE = ("position", "item_id", "lib_id", "article_name")
# name: query, request, columns, SQL over the derived tables
_PAGES: dict[str, tuple[str, PageRequest, tuple[str, ...], str]] = {
    "page_default": ("list of theorem", PageRequest(page=2, size=25), _PAGE,
        "SELECT cast(row_number() OVER (ORDER BY article_name, lib_id, item_id) as int) AS position, item_id, lib_id, article_name FROM vt QUALIFY position BETWEEN 51 AND 75"),
    "page_sorted": ("list of statement", PageRequest(size=40, sort_by="text_content", direction="desc"), _PAGE,
        "SELECT cast(row_number() OVER (ORDER BY text_content DESC, article_name, lib_id, item_id) as int) AS position, item_id, lib_id, article_name FROM vs QUALIFY position <= 40"),
    "page_filtered": ("list of statement", PageRequest(size=500, filter="l1_*:th"), _PAGE,
        "SELECT cast(row_number() OVER (ORDER BY article_name, lib_id, item_id) as int) AS position, item_id, lib_id, article_name FROM vs WHERE lower(lib_id) LIKE '%l1_%:th%' QUALIFY position <= 500"),
    "page_pipeline": ("list of theorem | filter('article=NATION_1')", PageRequest(size=30, sort_by="lib_id", filter="l1"), _PAGE,
        "SELECT cast(row_number() OVER (ORDER BY lower(lib_id), item_id) as int) AS position, item_id, lib_id, article_name FROM vt WHERE article_name = 'NATION_1' AND contains(lower(lib_id), 'l1') QUALIFY position <= 30"),
    "page_reverse": ("list of theorem | reverse", PageRequest(size=20), _PAGE,
        "SELECT cast(row_number() OVER (ORDER BY article_name DESC, lib_id DESC, item_id DESC) as int) AS position, item_id, lib_id, article_name FROM vt QUALIFY position <= 20"),
    "page_occurrences": ("occurrences of symbols", PageRequest(size=3), ("position", "spelling", "occurrences"),
        "SELECT cast(row_number() OVER (ORDER BY count(*) DESC, spelling) as int) AS position, spelling, count(*) AS occurrences FROM sy GROUP BY spelling QUALIFY position <= 3"),
    "page_symbols": ("list of symbols", PageRequest(size=50, sort_by="spelling", direction="desc"), ("position", "item_id", "spelling"),
        "SELECT cast(row_number() OVER (ORDER BY spelling DESC, article_name, lib_id, item_id) as int) AS position, item_id, spelling FROM sy QUALIFY position <= 50"),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query, columns, _ = _QUERIES[name]
    return lambda spark, sf_dir: engine(spark, sf_dir).query(query).select(*columns)


def _view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    view, columns, _ = _VIEWS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(engine(spark, sf_dir).library, view).select(*columns)
        return df.withColumn("roles", F.array_join("roles", ",")) if "roles" in columns else df

    return run


def _page(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query, request, columns, _ = _PAGES[name]
    return lambda spark, sf_dir: engine(spark, sf_dir).page(query, request).frame.select(*columns)


def pages_where_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages whose articles have a bold line in a paragraph, by the same language; trees of HTML are beyond SQL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return Engine(spark, page_library(pages)).query("list of statement where item has \"Article/P/B\" and item has not A[href='/the']").select(*ITEM)


def _ingested(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _libraries:
            _libraries[key] = ingested_star(spark, sf_dir)
        return shown(_libraries[key], name)

    return run


def node_types_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node types as migration gives them to nodes that have none."""
    return backfilled(engine(spark, sf_dir).library).item_node.select("id", "node_type")


def items_sharing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a reference to one of the constructors that part 8 refers to."""
    return items_sharing_refs(engine(spark, sf_dir).library, "p:8", 1).select("item_id", "shared")


def attributes_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_count(engine(spark, sf_dir).library).select("item_id", "attributes")


def tags_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_diagnostics(engine(spark, sf_dir).library).select("tag", "n")


def projected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return project(e.library, e.query("list of definition")).select(*_TABLE)


def projected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return project(e.library, e.query("list of statement in NATION_2 | nodes Attribute[nonocc='true']")).select(*_TABLE)


_TABLE = ("item_id", "node_id", "lib_id", "article_name", "node_type", "text_position", "spelling", "raw")
# Of what is not asked in the query language: the function, and SQL over the derived tables.
_OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "node_types_backfilled": (node_types_backfilled, """SELECT n.id, CASE WHEN depth > 0 THEN 'no_nodes' WHEN i.kind = 'registration' THEN 'registrations' WHEN statement_kind IN ('def', 'dfs') THEN 'definitions'
        WHEN statement_kind = 'sch' THEN 'schemes' WHEN statement_kind = 'th' THEN 'theorems' ELSE 'no_nodes' END AS node_type FROM flat_node n JOIN mml_item i ON i.id = n.item_id LEFT JOIN statement s ON s.item_id = n.item_id"""),
    "items_sharing_references": (items_sharing_references, """SELECT item_id, count(DISTINCT constructor_item_id) AS shared FROM item_constructor_ref
        WHERE constructor_item_id IN (SELECT constructor_item_id FROM item_constructor_ref WHERE item_id = 'p:8') AND item_id <> 'p:8' GROUP BY item_id"""),
    "attributes_by_item": (attributes_by_item, """SELECT item_id, cast(sum((a_kind IS NOT NULL)::int + (a_xmlid IS NOT NULL)::int + (a_position IS NOT NULL)::int + (a_spelling IS NOT NULL)::int
        + (a_nonocc IS NOT NULL)::int + (a_occurs IS NOT NULL)::int + (a_number IS NOT NULL)::int) as bigint) AS attributes FROM flat_node GROUP BY item_id"""),
    "tags_by_frequency": (tags_by_frequency, "SELECT tag, count(*) AS n FROM flat_node GROUP BY tag ORDER BY n DESC, tag LIMIT 25"),
    "projected_items": (projected_items, """SELECT vd.item_id, cast(NULL as string) AS node_id, lib_id, article_name, vd.node_type, a_position AS text_position, cast(NULL as string) AS spelling, '<Item>' AS raw
        FROM vd JOIN flat_node n ON n.item_id = vd.item_id AND depth = 0"""),
    "projected_nodes": (projected_nodes, """SELECT item_id, node_id, lib_id, article_name, node_type, text_position, spelling, raw_text AS raw FROM nr WHERE t = 'attribute' AND a_nonocc = 'true' AND article_name = 'NATION_2'"""),
}
_libraries: dict[tuple, Library] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: _run(n) for n in _QUERIES} | {f"view_{n}": _view(n) for n in _VIEWS} | {n: _page(n) for n in _PAGES} | {n: f for n, (f, _) in _OTHERS.items()}
    return found | {n: _ingested(n) for n in EXPECTED} | {"pages_where_path": pages_where_path}


#: Tables that many parts of a statement read, and that are small: made once.
_ONCE = ("lines", "up")


def statement(sql: str) -> str:
    """A statement with the tables that it uses, and no others, in front."""
    tables = star_tables() | _DERIVED
    uses = {n: [m for m in tables if m != n and re.search(rf"\b{m}\b", t)] for n, t in tables.items()}
    wanted, left = set(), [n for n in tables if re.search(rf"\b{n}\b", sql)]
    while left:
        if (n := left.pop()) not in wanted:
            wanted.add(n)
            left += uses[n]
    parts = [f"{n} AS {'MATERIALIZED ' if n in _ONCE else ''}({t})" for n, t in tables.items() if n in wanted]
    return f"WITH {', '.join(parts)}{sql}" if sql.startswith(",") else f"WITH {', '.join(parts)} {sql}"


def oracle_sql() -> dict[str, str]:
    found = {n: sql for n, (_, _, sql) in _QUERIES.items()} | {f"view_{n}": sql for n, (_, _, sql) in _VIEWS.items()} | {n: sql for n, (*_, sql) in _PAGES.items()}
    found |= {n: sql for n, (_, sql) in _OTHERS.items()}
    return {n: statement(sql) for n, sql in found.items() if sql} | {n: sql for n, (_, sql) in EXPECTED.items()}
