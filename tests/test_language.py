import pytest
from hypothesis import given
from hypothesis import strategies as st

from folia.engine import balance, edit_distance, suggest
from folia.plans import ast
from folia.plans.ast import NodePredicate as P
from folia.plans.names import Path, QueryError, is_pattern, like_pattern, literal, normal_name, parse_path
from folia.plans.parser import parse


@pytest.mark.parametrize(
    ("written", "normal"),
    [
        ("InfixTerm", "infix-term"), ("infixterm", "infix-term"), ("Infix-Term", "infix-term"), ("numeralterm", "numeral-term"), ("redefine", "redefine"), ("InfixFunctorPattern", "infix-functor-pattern"),
        ("InfixFunctor-Pattern", "infixfunctor-pattern"), ("A_b", "a_b"), ("*Pattern", "*pattern"), ("RelationFormula//NumeralTerm", "relation-formula//numeral-term"), ("LociDeclaration/4/Variable", "loci-declaration/4/variable"),
    ],
)
def test_names(written, normal):
    assert normal_name(written) == normal
    assert normal_name(normal) == normal


def test_paths():
    assert parse_path("a/b//c/3/d") == Path(("a", "b", "c", "d"), (1, None, 3))
    assert parse_path("a") is parse_path("a//") is parse_path("/a") is parse_path("a/0/b") is None
    assert parse_path("a/3") == Path(("a", "3"), (1,))


@given(st.text(alphabet="ab*_\\%", max_size=8))
def test_wildcards(value):
    if not is_pattern(value):
        assert "*" not in value.replace("\\\\", "").replace("\\*", "")
    assert like_pattern(literal("a")) == "a"
    assert like_pattern(value).count("%") >= 0


def test_wildcard_forms():
    assert like_pattern("a*_\\*\\_%\\") == "a%_*\\_\\%\\\\"
    assert literal("\\*\\_\\\\\\%\\x\\") == "*_\\%\\x\\"
    assert is_pattern("a*") and is_pattern("\\\\*") and not is_pattern("\\*\\_")


def scoped(text):
    q = parse(text)
    return q.scope, q.predicates


def test_predicates():
    assert scoped("list of theorem where item has InfixTerm spelling '+'") == scoped("list of theorem where item has InfixTerm[spelling='+']") == ("item", (P("infix-term", "spelling", "+"),))
    assert scoped("list of theorem where proposition has not X")[1] == scoped("list of theorem where proposition not has X")[1] == (P("x", negated=True),)
    assert scoped("list of theorem where item has X not spelling v")[1] == (P("x", "spelling", "v", True),)
    assert scoped("list of theorem where item has not X not spelling v")[1] == (P("x", "spelling", "v"),)
    assert scoped('list of theorem where item has "Definition"')[1] == (P("definition"),)
    assert scoped("list of theorem where proposition has negated adjective spelling = 'empty'")[1] == (P("attribute", "spelling", "empty", adjective=True),)
    assert scoped("list of theorem where item has A and item has B")[1] == (P("a"), P("b"))
    assert scoped("list of theorem where item has X[\"number\"='5']")[1] == (P("x", "number", "5"),)
    assert scoped(r"list of theorem where item has X spelling '\*\'\\'")[1][0].value == "\\*'\\"


def nodes(text):
    return parse(text).operation


def test_nodes():
    assert nodes("list of all | nodes A/B[spelling='x']").target == P("a/b", "spelling", "x")
    assert nodes("list of all | nodes A where redefined").predicates == nodes("list of all | nodes A where redefine").predicates == (P("redefine", "occurs", "true"),)
    assert nodes("list of all | nodes A where redefine false and not redefine both").predicates == (P("redefine", "occurs", "false"), P("redefine", negated=True))
    assert nodes("list of all | nodes A where spelling x and not has B and not not has C" if False else "list of all | nodes A where spelling x and not has B").predicates == (P("*", "spelling", "x"), P("b", negated=True))


def test_structure():
    a, b, c = ast.ListQuery("theorems"), ast.ListQuery("definitions"), ast.ListQuery("all", "ABCMIZ_0")
    assert parse("list of theorems or list of definitions and list of all in ABCMIZ_0") == ast.SetQuery("or", a, ast.SetQuery("and", b, c))
    assert parse("not list of theorem | reverse") == ast.NotQuery(ast.PipeQuery(a, ast.Reverse()))
    assert parse("list of theorem butnot list of definition or list of all in ABCMIZ_0") == ast.SetQuery("or", ast.SetQuery("butnot", a, b), c)
    assert parse("list of definition | nodes X where has Y and list of theorem") == ast.SetQuery("and", ast.PipeQuery(b, ast.SelectNodes(P("x"), (P("y"),))), a)
    assert parse("list of definition | nodes X where has Y and not list of theorem").right == ast.NotQuery(a)
    assert parse("LIST OF Symbols WHERE spelling = 'a*'") == ast.ListQuery("symbols", spelling="a*")
    assert parse("occurrences of symbol in *") == ast.ListQuery("occurrences")
    assert parse("article FILTER_0") == ast.ArticleQuery("FILTER_0")


def test_operations():
    op = lambda text: parse(f"list of all | {text}").operation
    assert op("termtype ref") == ast.Navigate("termtype ref") and op("redefinition") == ast.Navigate("redef") and op("original") == ast.Navigate("origin") and op("copied") == ast.Navigate("copy")
    assert op("number >= 5") == op("numge(5)") == ast.NumericFilter("ge", 5)
    assert op("wherelt(occurs, 3)") == ast.RelationCount("lt", "occur", 3)
    assert op("whereeq(proposition:NumeralTerm,0)") == ast.NodeCount("eq", "proposition", "numeral-term", 0)
    assert op("main functor") == ast.Navigate("main functor") and op("invert") == ast.Reverse("invert")


@pytest.mark.parametrize(
    "text",
    [
        "", "  ", "list", "list of theorem in abcmiz_0", "list of constructor", "list of theorem where spelling x", "list of theorem where item has A and proposition has B", "list of theorem |", "list of theorem )",
        "list of all | nodes Definition", "list of all | whereeq(ref, 99999999999)", "list of all | nodes A where frobbed", "list of all where item not has not X", "list of all | filter(x)", "list of all # x",
    ],
)
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_tree_as_values():
    d = ast.to_dict(parse("list of theorem | nodes A where has B"))
    assert d["node"] == "PipeQuery" and d["operation"]["predicates"][0]["name"] == "b"


def test_assistance():
    assert balance("list (a [b") == ["unclosed ( x1", "unclosed [ x1"] and balance("'a(") == ["unclosed '"] and balance("(a)") == []
    assert suggest("the", ["theorem", "term"]) == ["theorem"] and suggest("teorem", ["theorem", "list"]) == ["theorem"]
    assert edit_distance("abc", "abd", 2) == 1 and edit_distance("a", "abcd", 2) == 3
