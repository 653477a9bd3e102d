"""Whether a text holds an arithmetic expression with a value in some range.

Texts are read in infix form (numbers, + * |^ and parentheses) from every place where an
expression can start, or, if they look like XML, in prefix form from number and spelling
attributes. Values are capped just above the number compared with.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INFIX = re.compile(r"\d+|\|\^|[+*()=<>]")
_TAG = re.compile(r"<\s*[A-Za-z_][^\s/>]*([^>]*)>")
_ATTRIBUTE = re.compile(r"""\b(number|spelling)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_LEVELS = (("+",), ("*",), ("|^",))


def _apply(op: str, a: int, b: int, cap: int) -> int:
    if op == "+":
        return min(a + b, cap)
    if op == "*":
        return min(a * b, cap)
    # no power that is not capped has more factors than the cap has bits
    return min(a ** min(b, max(1, cap.bit_length() + 1)), cap) if a > 1 else (1 if b == 0 or a == 1 else 0)


class _Infix:
    def __init__(self, tokens: list[str], cap: int):
        self.tokens, self.cap = tokens, cap

    def value(self, at: int, level: int = 0) -> tuple[int, int] | None:
        """Value and end of the longest expression from `at`; None if an operand is missing. All operators group to the left."""
        if level == len(_LEVELS):
            return self.operand(at)
        found = self.value(at, level + 1)
        while found and found[1] < len(self.tokens) and self.tokens[found[1]] in _LEVELS[level]:
            right = self.value(found[1] + 1, level + 1)
            found = right and (_apply(_LEVELS[level][0], found[0], right[0], self.cap), right[1])
        return found

    def operand(self, at: int) -> tuple[int, int] | None:
        if at >= len(self.tokens):
            return None
        if self.tokens[at].isdigit():
            return min(int(self.tokens[at]), self.cap), at + 1
        inner = self.value(at + 1) if self.tokens[at] == "(" else None
        return (inner[0], inner[1] + 1) if inner and inner[1] < len(self.tokens) and self.tokens[inner[1]] == ")" else None


def _prefix(tokens: list[str], at: int, cap: int) -> tuple[int, int] | None:
    if at >= len(tokens):
        return None
    if tokens[at].isdigit():
        return min(int(tokens[at]), cap), at + 1
    if tokens[at] not in ("+", "*", "|^"):
        return None
    left = _prefix(tokens, at + 1, cap)
    right = left and _prefix(tokens, left[1], cap)
    return right and (_apply(tokens[at], left[0], right[0], cap), right[1])


def _xml_tokens(text: str) -> list[str]:
    out = []
    for tag in _TAG.finditer(text):
        found = {"number": [], "spelling": []}
        for m in _ATTRIBUTE.finditer(tag[1]):
            found[m[1]].append(html.unescape(m[2] if m[2] is not None else m[3]).strip())
        out += [n for n in found["number"] if n.isdigit()] + [s for s in found["spelling"] if s in ("+", "*", "|^", "=", "<", ">")]
    return out


def holds(text: str | None, comparator: str, number: int) -> bool:
    """Whether some expression in the text compares so with the number."""
    if not text or not text.strip():
        return False
    cap = number + 1
    test = {"eq": int.__eq__, "ge": int.__ge__, "le": int.__le__, "gt": int.__gt__, "lt": int.__lt__}[comparator]
    if 0 <= text.find("<") < text.find(">"):
        tokens = _xml_tokens(text)
        values = (_prefix(tokens, k, cap) for k in range(len(tokens)))
    else:
        tokens = _INFIX.findall(text)
        infix = _Infix(tokens, cap)
        values = (infix.value(k) for k, t in enumerate(tokens) if t == "(" or t.isdigit())
    return any(v is not None and test(v[0], number) for v in values)


def expression_matches(text: Column, comparator: str, number: int) -> Column:
    """holds() as an Arrow-batched function."""

    @F.pandas_udf("boolean")
    def match(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: holds(t, comparator, number))

    return match(text)
