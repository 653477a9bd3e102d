"""The engine over a shredded article, with answers worked out by hand."""

import shutil
from pathlib import Path

import pytest

from folia.engine import Engine
from folia.functions.expressions import holds
from folia.plans.library import Library
from folia.plans.names import QueryError
from folia.sources import esx
from folia.sources import ingest as ingest_module
from folia.sources.ingest import STATISTICS, attribute_count, backfilled_types, ingest, latest_run, resolve_references, run_log, tag_diagnostics

FIXTURE = Path(__file__).parent / "fixtures" / "demo_1.esx"


def test_shredding():
    items = list(esx.shred(FIXTURE.read_bytes(), "dir/demo_1.esx"))
    rows = [(i.kind, i.subkind, i.number, i.lib_id, i.title, i.nodes[0]["node_type"] if i.nodes else None, len(i.nodes)) for i in items]
    assert rows == [
        ("statement", "th", 1, "DEMO_1:1", "T1", "theorems", 9),
        ("statement", "th", 1000020, "DEMO_1:th x20", None, "theorems", 7),
        ("statement", "def", 5, "statement:DEMO_1:5:x40", None, "definitions", 9),
        ("notation", "attrnot", 46, "pattern:DEMO_1:7:x46", "Noetherian", None, 0),
        ("registration", "condreg", 51, "DEMO_1:condreg:x51", "Conditional-Registration", "registrations", 1),
    ]
    assert "/Item[1]/Theorem-Item[1]/Proposition[1]/Relation-Formula[2]/Numeral-Term[2]" in [n["node_path"] for n in items[0].nodes]
    assert items[0].nodes[0]["raw"] == '<Item kind="Theorem-Item" xmlid="x1">...</Item>'
    assert items[3].symbols == ["Noetherian"]
    assert esx.tag_counts(b"<a><b/><b/></a>") == {"a": 1, "b": 2}


@pytest.fixture(scope="module")
def target(spark, tmp_path_factory):
    source, target = tmp_path_factory.mktemp("articles"), str(tmp_path_factory.mktemp("library"))
    shutil.copy(FIXTURE, source / "demo_1.esx")
    (source / "broken.esx").write_text("<a><b></a>")
    (source / "empty.esx").write_text("")
    return str(source), target, ingest(spark, str(source), target)


@pytest.fixture(scope="module")
def engine(spark, target):
    return Engine(spark, Library.load(spark, target[1]))


def ids(engine, query):
    """xmlids of the rows, in order."""
    out = []
    for r in engine.query(query, ordered=True).collect():
        out.append(r.node_xmlid or r.lib_id.rpartition(":")[2].rpartition(" ")[2].replace("DEMO_1:", ""))
    return [{"1": "x1"}.get(x, x) for x in out]


def test_ingest_counts(target):
    summary = target[2]
    assert (summary.files, summary.failed, summary.counts["mml_item"], summary.counts["item_node"]) == (2, 1, 5, 26)
    assert summary.counts["symbol"] >= 1 and summary.counts["notation"] == summary.counts["registration"] == 1


# ids in order of article, lib_id, item; node rows in order of article, text position, path
ANSWERS = [
    ("list of theorem", {"x1", "x20"}), ("list of definition", {"x40"}), ("list of registration", {"x51"}), ("list of all", {"x1", "x20", "x40", "x46", "x51"}), ("list of symbols", {"x46"}),
    ("list of theorem where proposition has InfixTerm", {"x1", "x20"}), ("list of theorem where proposition has InfixTerm and proposition has InfixTerm", {"x20"}),
    ("list of theorem where item has InfixTerm and item has InfixTerm", {"x1", "x20"}), ("list of theorem where proposition has not InfixTerm", {"x20"}), ("list of statement where item has not InfixTerm", {"x40"}),
    ("list of statement where proposition has negated adjective spelling 'empty'", {"x20"}), (r"list of statement where item has InfixTerm spelling '\*'", {"x20"}), ("list of statement where item has InfixTerm spelling '*'", {"x1", "x20"}),
    ("list of statement | wherege(numeralterm,3)", {"x1"}), ("list of statement | whereeq(numeralterm,0)", {"x20", "x40"}), ("list of statement | wherege(proposition:infixterm,2)", {"x20"}),
    ("list of statement | numgt(300)", {"x1"}), ("list of statement | numeq(300)", {"x1"}), ("list of statement | numgt(302)", set()),
    ("list of theorem | nodes Proposition where has RelationFormula/NumeralTerm", {"x3"}), ("list of theorem | nodes Proposition where has RelationFormula/2/NumeralTerm", {"x3"}),
    ("list of theorem | nodes Proposition where has RelationFormula/3/NumeralTerm", set()), ("list of theorem | nodes Proposition where has RelationFormula//NumeralTerm", {"x3"}),
    ("list of definition | nodes Item", {"x42", "x50"}), ("list of definition | nodes Item where redefine true and has *[spelling='Noetherian']", {"x42"}), ("list of definition | nodes Item where not has Redefine[occurs='true']", {"x50"}),
    ("list of definition | nodes Item where has PatternShapedExpression/AttributePattern", {"x42"}), ("not list of theorem", {"x40", "x46", "x51"}), ("list of theorem | grep('^demo_1:1$')", {"x1"}),
    ("list of all | filter('kind=notation')", {"x46"}), ("list of all | filter('NOETHERIAN')", set()), ("list of theorem and list of all", {"x1", "x20"}), ("list of theorem butnot list of theorem", set()),
    ("list of all | filter('foo=')", {"x1", "x20", "x40", "x46", "x51"}), ("list of all where item has *[xmlid='X9']", {"x1"}), ("list of all | main mode", set()), ("list of all | wherege(ref,0)", {"x1", "x20", "x40", "x46", "x51"}),
]


@pytest.mark.parametrize(("query", "found"), ANSWERS, ids=[q for q, _ in ANSWERS])
def test_answers(engine, query, found):
    rows = ids(engine, query)
    assert sorted(rows) == sorted(found)


def test_occurrences_and_order(engine):
    assert [(r.spelling, r.occurrences) for r in engine.query("occurrences of symbols").collect()] == [("Noetherian", 1)]
    forward = ids(engine, "list of all")
    assert ids(engine, "list of all | reverse") == forward[::-1]
    assert ids(engine, "list of registration or list of all")[0] == "x51"
    assert ids(engine, "(list of registration or list of all) | reverse")[-1] == "x51"
    assert len(ids(engine, "list of registration or list of all")) == 5


def test_pages(engine):
    r = engine.execute("list of all", page=7, size=2, sort_by="lib_id", direction="desc")
    assert (r.page.count, r.page.page, len(r.items)) == (5, 2, 1) and r.items[0]["lib_id"] == "DEMO_1:1"
    assert r.to_dict()["timing"]["totalMs"] >= 0 and r.to_dict()["sortDirection"] == "desc"
    assert [i["lib_id"] for i in engine.execute("list of theorem", filter="*th_x2*").items] == ["DEMO_1:th x20"]
    piped = engine.execute("list of definition | nodes Attribute-Pattern", sort_by="node_path")
    assert piped.items[0]["raw"].startswith("<Attribute-Pattern ") and "Noetherian" in piped.items[0]["raw"]
    assert engine.execute("list of all | filter('kind=statement')", filter="regular").page.count == 1
    root = engine.execute("list of theorem", size=1).items[0]
    assert root["raw"].startswith("<Item kind=") and root["text_position"] == "1"
    assert engine.execute("list of all", size=10**6).page.size == 500


def test_fragment_and_service(engine):
    item = next(r.item_id for r in engine.query("list of definition").collect())
    assert engine.fragment(item)["fragment"].startswith("<Item") and engine.fragment("none") is None
    assert [w["success"] for w in engine.warm_up(("list of theorem", "list of"))] == [True, False]
    assert "Item" in engine.syntax()["nodes"]
    with pytest.raises(QueryError):
        engine.query("list of all | grep('(')")


def test_unchanged_files_are_not_parsed_again(spark, target):
    source, path, _ = target
    again = ingest(spark, source, path)
    assert (again.generation, again.files, again.unchanged, again.counts["item_node"]) == (2, 2, 2, 26)
    assert latest_run(spark, path)["generation"] == 2


def article(k, more=""):
    return f"""<Text-Proper articleid="ART_{k}"><Item kind="Definition-Item" xmlid="d{k}"><Definition-Item MMLId="ART_{k}:def 1"><Attribute-Definition>
      <Attribute-Pattern absolutepatternMMLId="ART_{k}:1" absoluteconstrMMLId="ART_{k}:attr 1" absoluteorigconstrMMLId="ART_{k - 1}:attr 1" spelling="w{k}" formatnr="2" xmlid="a{k}"/></Attribute-Definition></Definition-Item></Item>
      <Item kind="Theorem-Item" xmlid="t{k}"><Theorem-Item MMLId="ART_{k}:1"><Proposition><Attribute absoluteconstrMMLId="ART_{k - 1}:attr 1" nonocc="true"/><Attribute absoluteconstrMMLId="ART_{k}:attr 1"/>{more}</Proposition></Theorem-Item></Item></Text-Proper>"""


def test_edges_of_ingested_articles(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "lib")
    source.mkdir()
    (source / "a2.esx").write_text(article(2))
    first = ingest(spark, str(source), target)
    assert list(first.counts) == list(STATISTICS)
    assert (first.counts["constructor"], first.counts["constructor_definition"], first.counts["item_constructor_ref"], first.counts["item_node.constructor_item_id"]) == (1, 1, 1, 2)
    # what an article refers to may come later
    (source / "a1.esx").write_text(article(1))
    second = ingest(spark, str(source), target)
    assert (second.unchanged, second.counts["item_constructor_ref"]) == (1, 3)
    engine = Engine(spark, Library.load(spark, target))
    found = lambda q: sorted(r.lib_id for r in engine.query(q).collect())
    assert found("list of theorem in ART_2 | ref") == ["ART_1:attr 1", "ART_2:attr 1"] and found("list of theorem in ART_2 | ref | origin") == ["ART_1:attr 1"]
    assert found("list of theorem in ART_2 | ref | definition") == ["statement:ART_1:def 1:d1", "statement:ART_2:def 1:d2"]
    assert found("list of theorem | wherege(ref, 2)") == ["ART_2:1"] and len(found("list of theorem in ART_1 | ref | notation")) == 1
    signs = {(r.item_id, r.constructor_item_id): r.is_positive for r in engine.library.item_constructor_ref.collect()}
    assert sorted(signs.values()) == [False, True, True]


def test_ingest_begins_anew_after_a_failure(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", str(tmp_path / "lib")
    source.mkdir()
    (source / "a1.esx").write_text(article(1))
    ingest(spark, str(source), target)
    (source / "a2.esx").write_text(article(2))

    def fails(parsed):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest_module, "library_tables", fails)
        for _ in range(2):
            with pytest.raises(RuntimeError, match="lost"):
                ingest(spark, str(source), target)
    assert latest_run(spark, target)["generation"] == 1 and Library.load(spark, target).mml_item.count() == 4
    done = ingest(spark, str(source), target)
    assert (done.generation, done.files, done.unchanged) == (2, 2, 1) and Library.load(spark, target).mml_item.count() == 8
    assert [r.generation for r in run_log(spark, target).orderBy("generation").collect()] == [1, 2]


def test_versions_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest_module, "PARTS", 1)
    source, target = tmp_path / "in", str(tmp_path / "lib")
    source.mkdir()
    (source / "a1.esx").write_text(article(1))
    texts = (article(2), article(2, "<Numeral-Term number='7'/>"), article(2))
    for generation, text in enumerate(texts, 1):
        (source / "a2.esx").write_text(text)
        done = ingest(spark, str(source), target)
        assert (done.generation, done.unchanged) == (generation, 0 if generation == 1 else 1)
        folder = next(p for p in Path(target).glob(f"g{generation}-*") if (Path(target) / "_generations" / p.name[1:]).exists())
        versions = {Path(r.path).name: r.version for r in spark.read.parquet(str(folder / "versions")).collect()}
        assert versions == {"a1.esx": 1, "a2.esx": generation}
        numbers = [r.n for r in Library.load(spark, target).item_node.selectExpr("attrs['number'] n").filter("n is not null").collect()]
        assert numbers == {2: ["7"]}.get(generation, []) and done.counts["mml_item"] == 8
    (source / "a2.esx").unlink()
    assert ingest(spark, str(source), target).counts["mml_item"] == 4


def test_streaming_ingest(spark, tmp_path):
    from folia.streaming.watch import watch

    source = tmp_path / "in"
    source.mkdir()
    shutil.copy(FIXTURE, source / "demo_1.esx")
    for theorems in (2, 3):
        watch(spark, str(source), str(tmp_path / "lib"), str(tmp_path / "cp"), once=True).awaitTermination(120)
        assert Engine(spark, Library.load(spark, str(tmp_path / "lib"))).query("list of theorem").count() == theorems
        (source / "a1.esx").write_text(article(1))  # the next batch has this file alone


def test_edges_and_types(spark, engine):
    lib = engine.library
    item = lib.mml_item.filter("kind = 'notation'").first()
    pending = spark.createDataFrame([("i1", item.lib_id, "ref", True), ("i1", item.lib_id, "ref", True), ("i1", "none", "ref", True)], "item_id string, constructor_lib_id string, role string, is_positive boolean")
    made = Library(spark, dict(lib.tables) | {"constructor": spark.createDataFrame([(item.id, "attr", None)], "item_id string, constructor_kind string, short_name string"), "mml_item": lib.mml_item, "article": lib.article})
    edges = resolve_references(pending, made).collect()
    assert [(e.item_id, e.constructor_item_id, e.occurrences) for e in edges] == [("i1", item.id, 2)]
    types = {r.node_type for r in backfilled_types(lib).collect()}
    assert types == {"symbols", "registrations", "definitions", "theorems", "no_nodes"}
    assert attribute_count(lib).count() == 4 and tag_diagnostics(lib, 3).count() == 3


def test_repeated_edges_of_both_signs(spark, engine):
    """Positive if one is, in whatever order they come."""
    lib = engine.library
    item = lib.mml_item.filter("kind = 'notation'").first()
    signs = {"negative": (False, False), "positive": (True, True), "last": (False, True), "first": (True, False), "unknown": (None, True)}
    rows = [(i, item.lib_id, "ref", s) for i, both in signs.items() for s in both]
    made = Library(spark, dict(lib.tables) | {"constructor": spark.createDataFrame([(item.id, "attr", None)], "item_id string, constructor_kind string, short_name string")})
    for turn in (rows, rows[::-1]):
        pending = spark.createDataFrame(turn, "item_id string, constructor_lib_id string, role string, is_positive boolean").coalesce(1)
        found = {e.item_id: (e.is_positive, e.occurrences) for e in resolve_references(pending, made).collect()}
        assert found == {i: (i != "negative", 2) for i in signs}


@pytest.mark.parametrize(
    ("text", "op", "n", "found"),
    [
        ("2 + 3 * 4", "eq", 14, True), ("2 + 3 * 4", "eq", 20, False), ("(2 + 3) * 4", "eq", 20, True), ("2 |^ 10", "gt", 1000, True), ("2|^100000000000", "gt", 10**18, True), ("0 |^ 5", "eq", 0, True),
        ("x 7 y", "ge", 7, True), ("1 +", "eq", 1, False), ("+ 5", "eq", 5, True), ("", "eq", 0, False), (None, "ge", 0, False), ("9" * 50, "gt", 10**18, True),
        ('<a spelling="+"><b number="2"/><b number="3"/></a>', "eq", 5, True), ('<a spelling="|^"><b number="2"/><b number="3"/></a>', "eq", 8, True), ("<a b='1'>", "eq", 1, False), ("5 < 6 > 4", "eq", 6, False),
    ],
)
def test_expressions(text, op, n, found):
    assert holds(text, op, n) is found
