"""Shredding of XML articles into items, notations, registrations and node trees."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

# Kinds of items that define something, and tags of notation patterns.
DEFINITION_KINDS = {
    "definition-item", "attribute-definition", "functor-definition", "predicate-definition", "structure-definition", "mode-definition", "selector-definition", "aggregate-definition",
}
PATTERN_TAGS = {
    "Attribute-Pattern", "Mode-Pattern", "Predicate-Pattern", "Structure-Pattern", "SelectorFunctor-Pattern", "InfixFunctor-Pattern", "CircumfixFunctor-Pattern", "ForgetfulFunctor-Pattern",
    "AggregateFunctor-Pattern", "Strict-Pattern",
}
# Registrations, notations and statements by their tags.
REGISTRATION_KINDS = {"existential-registration": "exreg", "functorial-registration": "funcreg", "conditional-registration": "condreg"}
_NOTATION_KINDS = (("attribute", "attrnot"), ("strict", "attrnot"), ("mode", "modenot"), ("predicate", "prednot"), ("selector", "selnot"), ("structure", "structnot"), ("aggregate", "aggrnot"))
_SUBKINDS = (("definition", "def"), ("scheme", "sch"), ("theorem", "th"), ("registration", "condreg"), ("statement", "th"))
#: Most characters of a node's raw text, and of the character data in it.
RAW_MOST, TEXT_MOST = 512, 256
#: Added to numbers taken from xmlids, and to positions in the file, so that they cannot meet others.
FROM_XMLID, FROM_PLACE = 1_000_000, 2_000_000


@dataclass
class Item:
    """One item with its nodes, as the shredder hands it on; ids come from natural keys."""

    article: str
    kind: str
    subkind: str
    number: int
    lib_id: str | None
    title: str | None
    text_content: str | None
    raw_xml: str | None
    statement_kind: str | None = None
    parent_lib_id: str | None = None
    constructor: str | None = None
    origin: str | None = None
    symbols: list[str] = field(default_factory=list)
    formats: list[str] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)

    def row(self) -> dict:
        return asdict(self)


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attributes(e: ET.Element) -> dict[str, str]:
    return {k.rpartition("}")[2]: v for k, v in e.attrib.items()}


def elements(e: ET.Element) -> list[ET.Element]:
    return [c for c in e if isinstance(c.tag, str)]


def _whole(text: str | None) -> int:
    return int(text) if text and re.fullmatch(r"[+-]?\d{1,10}", text) and abs(int(text)) < 1 << 31 else 0


def _digits(text: str | None) -> int:
    return _whole(re.sub(r"\D+", "", text or ""))


def string_value(e: ET.Element) -> str | None:
    return " ".join("".join(e.itertext()).split()) or None


def own_library_id(e: ET.Element) -> str | None:
    for x in (e, *elements(e)[:1]):
        if (found := x.get("MMLId")) and found.strip():
            return found
    return None


def item_number(e: ET.Element, place: int) -> int:
    """A number that is stable: the item's own, else its library id's, label's or xmlid's, else its place in the file."""
    own = own_library_id(e)
    stated = _whole(e.get("nr", e.get("number")))
    if stated > 0:
        return stated
    if own:
        if (n := _digits(own.rpartition(":")[2] or own)) > 0:
            return n
        label = next((x for x in e.iter() if x is not e and local(x) == "Label" and x.get("labelnr") is not None), None)
        if label is not None and (n := _whole(label.get("labelnr"))) > 0:
            return n
    if re.search(r"\d", e.get("xmlid") or "") and ((n := _digits(e.get("xmlid"))) or set(re.sub(r"\D", "", e.get("xmlid"))) == {"0"}):
        return n if own else FROM_XMLID + n
    return FROM_PLACE + place if place > 0 else 0


def is_definition(e: ET.Element) -> bool:
    return (e.get("kind") or "").lower() in DEFINITION_KINDS


def library_id(e: ET.Element, article: str, subkind: str) -> str | None:
    own = own_library_id(e)
    if own:
        if not is_definition(e):
            return own
        ids = [x.get("xmlid") for x in (e, *elements(e)[:1])]
        return f"statement:{own}:{next((i for i in ids if i and i.strip()), 'def')}"
    mark = e.get("xmlid", e.get("idnr"))
    return f"{article}:{subkind} {mark}" if mark and mark.strip() else None


def subkind_of(e: ET.Element) -> str:
    first = next((local(c).lower() for c in elements(e)), "")
    return next((kind for part, kind in _SUBKINDS if part in first), "th")


def root_type(kind: str | None, statement_kind: str) -> str:
    k = (kind or "").lower()
    if k == "cluster" or "registration" in k:
        return "registrations"
    if "scheme" in k:
        return "schemes"
    if "definition" in k:
        return "definitions"
    if k in ("theorem-item", "regular-statement") or "theorem" in k:
        return "theorems"
    return {"th": "theorems", "def": "definitions", "dfs": "definitions", "sch": "schemes"}.get(statement_kind, "no_nodes")


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def abbreviated(e: ET.Element) -> str:
    """Start tag and, of a leaf, its text; children show as dots; cut at RAW_MOST characters."""
    tag, text = local(e), " ".join((e.text or "").split())
    head = f"<{tag}" + "".join(f' {k}="{_escaped(v).replace(chr(34), "&quot;")}"' for k, v in attributes(e).items())
    body = f">...</{tag}>" if elements(e) else f">{_escaped(text[:TEXT_MOST])}</{tag}>" if text else "/>"
    return (head + body)[:RAW_MOST]


def symbol_of(e: ET.Element) -> str | None:
    tag, a = local(e).lower(), attributes(e)
    if tag.endswith("-pattern"):
        return (a.get("spelling") or "").strip() or None
    if "symbol" in tag:
        return next((v.strip() for v in (a.get("spelling"), a.get("name"), e.text) if v and v.strip()), None)
    return None


def tree(root: ET.Element, node_type: str) -> list[dict]:
    """A row for every element, parents first. Paths count all element siblings, whatever their names."""
    out, open_ = [], [(root, None, f"/{local(root)}[1]", 0, 1)]
    while open_:
        e, parent, path, depth, pos = open_.pop()
        a, symbol = attributes(e), symbol_of(e)
        kind = "symbols" if symbol else node_type if depth == 0 else "no_nodes"
        out.append({
            "node_path": path, "parent_path": parent, "pos": pos, "depth": depth, "tag": local(e), "attrs": a, "raw": abbreviated(e), "node_type": kind, "symbol": symbol,
            "format": a.get("formatnr") or a.get("formatdes"),
        })
        open_ += reversed([(c, path, f"{path}/{local(c)}[{k}]", depth + 1, k) for k, c in enumerate(elements(e), 1)])
    return out


def markup(e: ET.Element) -> str:
    tail, e.tail = e.tail, None
    text = ET.tostring(e, encoding="unicode")
    e.tail = tail
    return text


def _distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def notations(e: ET.Element, article: str, parent: str | None) -> Iterator[Item]:
    """Patterns with a library id, inside an item that defines something, and the constructors that they name as theirs."""
    for p in e.iter():
        name = p.get("absolutepatternMMLId") or p.get("MMLId")
        if local(p) in PATTERN_TAGS and name and name.strip():
            tag, own = local(p).lower(), p.get("spelling")
            kind = next((k for part, k in _NOTATION_KINDS if part in tag), "funcnot")
            below = [x for x in p.iter() if x is not p]
            symbols = _distinct([own, *[x.get("spelling") for x in below if "symbol" in local(x).lower()]])
            number = _digits(p.get("xmlid")) or _digits(name.rpartition(":")[2])
            constructor, origin = [(p.get(k) or "").strip() or None for k in ("absoluteconstrMMLId", "absoluteorigconstrMMLId")]
            yield Item(article, "notation", kind, number, f"pattern:{name}:{(p.get('xmlid') or '').strip() or local(p)}", own or None, string_value(p), markup(p),
                       parent_lib_id=parent, constructor=constructor, origin=origin, symbols=symbols, formats=_distinct(x.get("formatnr") for x in below))
            if constructor:
                yield Item(article, "constructor", kind.removesuffix("not"), _digits(constructor.rpartition(":")[2]), constructor, own or None, own or None, markup(p), parent_lib_id=parent, origin=origin)


def registrations(e: ET.Element, article: str) -> Iterator[Item]:
    for r in e.iter():
        kind = REGISTRATION_KINDS.get(local(r).lower())
        if kind:
            xmlid = (r.get("xmlid") or "").strip()
            yield Item(article, "registration", kind, _digits(xmlid), f"{article}:{kind}:{xmlid or 'reg'}", local(r), string_value(r), markup(r), nodes=tree(r, "registrations"))


def shred_item(e: ET.Element, article: str, place: int) -> Iterator[Item]:
    """The item itself, and the notations and registrations inside it."""
    subkind = subkind_of(e)
    statement = subkind if subkind in ("th", "def", "dfs", "sch") else "th"
    label = next((x for p in e.iter() if local(p) == "Proposition" for x in elements(p) if local(x) == "Label"), None)
    title = (label.get("spelling") or "").strip() or None if label is not None else None
    item = Item(article, "statement", subkind, item_number(e, place), library_id(e, article, subkind), title, string_value(e), markup(e), statement, nodes=tree(e, root_type(e.get("kind"), statement)))
    yield item
    kind = (e.get("kind") or "").lower()
    if is_definition(e):
        yield from notations(e, article, item.lib_id)
    if kind == "cluster" or "registration" in kind or kind == "definition-item":
        yield from registrations(e, article)


def article_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rpartition("/")[2]).upper()


def shred(content: bytes, path: str) -> Iterator[Item]:
    """Items of a file, in order. Nested Items stay inside the outermost; elements are let go once read.

    Raises ET.ParseError if the file is no XML.
    """
    article, depth, place = article_of(path), 0, 0
    for event, e in ET.iterparse(io.BytesIO(content), events=("start", "end")):
        name = local(e).lower()
        if event == "start":
            if name == "text-proper" and (e.get("articleid") or "").strip():
                article = e.get("articleid").strip()
            depth += name == "item"
        elif name == "item":
            depth -= 1
            if depth == 0:
                place += 1
                yield from shred_item(e, article, place)
                e.clear()


def key(*parts) -> str:
    """A repeatable id from what names a thing."""
    return hashlib.sha256("\x1f".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:32]


def tag_counts(content: bytes, most: int = 50_000) -> dict[str, int]:
    """Start tags of a file, for one in which no item was found."""
    out: dict[str, int] = {}
    try:
        for n, (_, e) in enumerate(ET.iterparse(io.BytesIO(content), events=("start",))):
            if n >= most:
                break
            out[local(e)] = out.get(local(e), 0) + 1
    except ET.ParseError:
        pass
    return out
