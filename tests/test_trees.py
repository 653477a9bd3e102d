"""Random trees and predicates against a plain evaluator."""

import random
import re

import pytest

from folia.engine import Engine
from folia.plans.library import Library
from folia.sources.pages import VOID, page_library, page_nodes

TAGS, SPELLINGS = ("A", "B", "Proposition", "C-Term"), ("x", "y")


class Node:
    def __init__(self, rng, depth, tag):
        self.tag, self.spelling = tag, rng.choice(SPELLINGS)
        self.children = [Node(rng, depth + 1, rng.choice(TAGS)) for _ in range(rng.randint(0, 3 if depth < 4 else 0))]


def flatten(item, root):
    out, open_ = [], [(root, None, f"/{root.tag}[1]", None)]
    while open_:
        n, parent, path, prop = open_.pop()
        prop = path if n.tag == "Proposition" else prop
        row = {"n": n, "id": f"{item}{path}", "parent": parent, "path": path, "prop": prop, "item": item, "depth": path.count("/") - 1}
        out.append(row)
        open_ += [(c, row["id"], f"{path}/{c.tag}[{k}]", prop) for k, c in enumerate(n.children, 1)]
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    items = {f"i{k}": flatten(f"i{k}", Node(rng, 0, "Item")) for k in range(40)}
    nodes = [(r["id"], i, r["parent"], r["path"], "theorems" if r["depth"] == 0 else "no_nodes", None, 1, r["depth"], f"<{r['n'].tag}>", r["n"].tag, {"spelling": r["n"].spelling}) for i, rows in items.items() for r in rows]
    schema = "id string, item_id string, parent_node_id string, node_path string, node_type string, symbol_id string, pos int, depth int, raw string, tag string, attrs map<string,string>"
    lib = Library(spark, {
        "article": spark.createDataFrame([("a", "ART")], "id string, name string"),
        "mml_item": spark.createDataFrame([(i, "a", "statement", "th", i, i, None) for i in items], "id string, article_id string, kind string, subkind string, lib_id string, text_content string, raw_xml string"),
        "statement": spark.createDataFrame([(i, "th") for i in items], "item_id string, statement_kind string"),
        "item_node": spark.createDataFrame(nodes, schema),
    }).persist("nodes", "closure", "view_items")
    return Engine(spark, lib), items


def hits(rows, test):
    tag, spelling = test
    return [r for r in rows if (tag == "*" or r["n"].tag == tag) and (spelling is None or r["n"].spelling == spelling)]


def below(r, rows, test):
    return [x for x in hits(rows, test) if x["path"].startswith(r["path"] + "/")]


def holds(rows, scope, tests):
    positive, negative = [t for t, neg in tests if not neg], [t for t, neg in tests if neg]
    groups = [rows] if scope == "item" else [[r for r in rows if r["prop"] == p] for p in {r["prop"] for r in rows if r["prop"]}]
    for g in groups:
        if any(hits(g, t) for t in negative):
            continue
        anchors = hits(g, positive[0]) if positive else g
        for a in anchors:
            if all(any(scope == "item" or x is not a for x in hits(g, t)) for t in positive[1:]):
                return True
    return False


def text(test):
    tag, spelling = test
    return tag + (f"[spelling='{spelling}']" if spelling else "")


@pytest.mark.parametrize("seed", range(12))
def test_scopes(world, seed):
    engine, items = world
    rng = random.Random(seed)
    scope = rng.choice(("item", "proposition"))
    tests = [((rng.choice((*TAGS, "*")), rng.choice((None, *SPELLINGS))), rng.random() < 0.3) for _ in range(rng.randint(1, 3))]
    query = "list of statement where " + " and ".join(f"{scope} has {'not ' * neg}{text(t)}" for t, neg in tests)
    found = {r.item_id for r in engine.query(query).collect()}
    assert found == {i for i, rows in items.items() if holds(rows, scope, tests)}, query


@pytest.mark.parametrize("seed", range(12))
def test_node_selection(world, seed):
    engine, items = world
    rng = random.Random(100 + seed)
    target = (rng.choice(TAGS), None)
    tests = [((rng.choice(TAGS), rng.choice((None, *SPELLINGS))), rng.random() < 0.4) for _ in range(rng.randint(0, 2))]
    query = f"list of statement | nodes {text(target)}" + (" where " + " and ".join(f"has {'not ' * neg}{text(t)}" for t, neg in tests) if tests else "")
    wanted = set()
    for rows in items.values():
        good = [r for r in hits(rows, target) if all(bool(below(r, rows, t)) != neg for t, neg in tests)]
        wanted |= {r["id"] for r in good if not any(x["path"].startswith(r["path"] + "/") for x in good)}
    assert {r.node_id for r in engine.query(query).collect()} == wanted, query


@pytest.mark.parametrize("step", ["/", "//", "/2/", "/3/"])
def test_paths(world, step):
    engine, items = world
    levels = {"/": {1}, "//": set(range(1, 9)), "/2/": {2}, "/3/": {3}}[step]
    wanted = {i for i, rows in items.items() for r in hits(rows, ("A", None)) for x in below(r, rows, ("B", "x")) if x["depth"] - r["depth"] in levels}
    assert {r.item_id for r in engine.query(f"list of statement where item has A{step}B[spelling='x']").collect()} == wanted


@pytest.mark.parametrize("step", ["/", "//", "/2/"])
def test_paths_of_one_tag(world, step):
    """The first and the last of a path can be one kind of node: A below A."""
    engine, items = world
    levels = {"/": {1}, "//": set(range(1, 9)), "/2/": {2}}[step]
    wanted = {i for i, rows in items.items() for r in hits(rows, ("A", None)) for x in below(r, rows, ("A", "x")) if x["depth"] - r["depth"] in levels}
    assert {r.item_id for r in engine.query(f"list of statement where item has A{step}A[spelling='x']").collect()} == wanted and wanted
    nodes = {r["id"] for rows in items.values() for r in hits(rows, ("B", None)) if any(any(y["depth"] - x["depth"] in levels for y in below(x, rows, ("A", "x"))) for x in below(r, rows, ("A", None)))}
    inner = {r["id"] for rows in items.values() for r in rows if r["id"] in nodes and not any(x["id"] in nodes and x["path"].startswith(r["path"] + "/") for x in rows)}
    assert {r.node_id for r in engine.query(f"list of statement | nodes B where has A{step}A[spelling='x']").collect()} == inner


def test_set_laws(world):
    engine, _ = world
    a, b = "list of statement where item has B", "list of statement where item has CTerm[spelling='y']"
    get = lambda q: sorted(r.item_id for r in engine.query(q).collect())
    assert get(f"({a}) butnot ({b})") == get(f"({a}) and not ({b})")
    assert get(f"({a}) and ({a})") == get(a)
    assert get(f"({a}) or ({b})") == sorted(set(get(a)) | set(get(b)))
    nodes = "list of statement | nodes A"
    assert engine.query(f"({nodes}) and (list of all)").count() == 0
    assert engine.query(f"({nodes}) or ({nodes})").count() == engine.query(nodes).count()


def plain_tree(html):
    """(path, depth) of all elements, by cutting the text at tags and keeping a stack of lists."""
    root = ["page", []]
    stack = [root]
    for end, tag in re.findall(r"<(/?)([a-z0-9]+)[^>]*>", html):
        if not end:
            node = [tag, []]
            stack[-1][1].append(node)
            if tag not in VOID:
                stack.append(node)
        elif tag in [n[0] for n in stack[1:]]:
            while stack.pop()[0] != tag:
                pass
    out = []

    def walk(node, path, depth):
        out.append((path, depth))
        for k, child in enumerate(node[1], 1):
            walk(child, f"{path}/{child[0]}[{k}]", depth + 1)

    walk(root, "/page[1]", 0)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_page_trees_keep_all_elements(seed):
    rng = random.Random(seed)
    tags = ("div", "p", "b", "br", "img", "li", "section")
    html = "".join(rng.choice(("<{}>", "<{} class='x'>", "</{}>", "</{}>", "text ")).format(rng.choice(tags)) for _ in range(60))
    assert [(r[0], r[3]) for r in page_nodes(html)] == plain_tree(html)


def test_pages_as_trees(spark):
    assert [r[0] for r in page_nodes("<html><p>a<br>b<p>c</html>")] == ["/page[1]", "/page[1]/html[1]", "/page[1]/html[1]/p[1]", "/page[1]/html[1]/p[1]/br[1]", "/page[1]/html[1]/p[1]/p[2]"]
    # nothing is lost after the first element on top, nor after one that has no content
    assert [r[0] for r in page_nodes("<br><div>a</div><p>b</p>")] == ["/page[1]", "/page[1]/br[1]", "/page[1]/div[2]", "/page[1]/p[3]"]
    assert [r[0] for r in page_nodes(None)] == ["/page[1]"]
    pages = spark.createDataFrame([(1, "http://a.b/x", "<div><p class='k'>t</p></div>"), (2, None, None), (3, "http://a.b/y", "<img><hr><div><p class='k'></p></div>")], "page_id long, url string, html string")
    engine = Engine(spark, page_library(pages))
    assert sorted(r.lib_id for r in engine.query("list of theorem where item has Div/P[class='k']").collect()) == ["P1", "P3"]


def test_closure_in_one_shuffle(spark):
    """All pairs of a node and its ancestors in its item, without a join of paths with their prefixes."""
    rng = random.Random(3)
    rows = [(r["item"], r["id"], r["path"]) for k in range(60) for r in flatten(f"i{k}", Node(rng, 0, "Item"))]
    rows += [("i0", "again", "/Item[1]"), ("gap", "g", "/A[1]/B[1]/C[1]"), ("gap", "h", "/A[1]"), ("null", "n", None), (None, "m", "/A[1]/B[1]"), (None, "o", "/A[1]")]
    closure = Library(spark, {"item_node": spark.createDataFrame(rows, "item_id string, id string, node_path string").repartition(5)}).closure
    plan = closure._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    of = {}
    for i, n, p in rows:
        if i and p:
            of.setdefault(i, []).append((n, p))
    wanted = sorted((i, a, d, pd.count("/") - pa.count("/")) for i, nodes in of.items() for a, pa in nodes for d, pd in nodes if pd.startswith(pa + "/"))
    assert len(wanted) > 1000 and sorted(map(tuple, closure.collect())) == wanted
    assert not Library(spark, {}).closure.count()
