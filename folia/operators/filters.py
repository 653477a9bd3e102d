"""Row filters: keyed and free text, regular expressions, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.expressions import expression_matches
from folia.operators.navigate import compare, item_ids
from folia.plans.library import Library
from folia.plans.names import QueryError, is_pattern, matches
from folia.plans.rows import Rows, raw_text

_KEYS = {
    "article": "article_name", "article_name": "article_name", "lib": "lib_id", "lib_id": "lib_id", "kind": "kind", "subkind": "subkind", "node": "node_type", "node_type": "node_type",
    "text": None, "raw_text": None, "text_content": None, "position": "text_position", "text_position": "text_position", "spelling": "spelling", "occurrences": "occurrences", "count": "occurrences",
}
_NEEDLE = ("article_name", "lib_id", "kind", "subkind", "node_type", "text_position", "spelling", "occurrences")
# Tags of number literals, in lower case.
_NUMERALS = ("numeral-term", "natural-term", "numeralterm", "naturalterm")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def by_criteria(rows: Rows, criteria: str) -> Rows:
    """key=value compares one field, wildcards allowed; anything else is looked for in all of them.

    A key that is not known compares as an empty field does.
    """
    criteria = criteria.strip()
    if not criteria:
        return rows
    at = criteria.find("=")
    if at > 0:
        key = criteria[:at].strip().lower()
        field = raw_text() if key in _KEYS and _KEYS[key] is None else _text(_KEYS[key]) if key in _KEYS else F.lit("")
        wanted = criteria[at + 1 :].strip()
        # only patterns see the field without the space around it
        return rows.filter(matches(F.trim(field) if is_pattern(wanted.lower()) else field, wanted))
    everything = F.concat_ws(" ", *[_text(c) for c in _NEEDLE], raw_text())
    return rows.filter(F.lower(everything).contains(criteria.lower()))


def by_regex(rows: Rows, pattern: str) -> Rows:
    """A regular expression found in text, library id or article name; ASCII case does not count."""
    if not pattern.strip():
        return rows
    try:
        rows.df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise QueryError(f"invalid regular expression: {pattern}") from e
    found = F.lit(False)
    for c in (raw_text(), _text("lib_id"), _text("article_name")):
        found = found | F.regexp_like(c, F.lit(f"(?i){pattern}"))
    return rows.filter(found)


def digits_compare(digits: Column, comparator: str, number: int) -> Column:
    """Compare a text of digits of any length with a number."""
    plain = F.regexp_replace(digits, "^0+", "")
    wanted = str(number).lstrip("0")
    length, size = F.length(plain), len(wanted)
    order = F.when(length != size, F.when(length > size, 1).otherwise(-1)).otherwise(F.when(plain > wanted, 1).when(plain < wanted, -1).otherwise(0))
    return digits.rlike("^[0-9]+$") & compare(comparator, order, 0)


def by_number(lib: Library, rows: Rows, comparator: str, number: int) -> Rows:
    """Keep rows whose item has a number literal that compares so; rows without item go by the expressions in their text.

    Equality is of the text, so that 007 is not 7; other comparisons are numeric.
    """
    digits = F.col("attrs")["number"]
    condition = digits == str(number) if comparator == "eq" else digits_compare(digits, comparator, number)
    literals = lib.nodes.filter(F.col("tag_lc").isin(*_NUMERALS) & condition)
    ids = literals.join(item_ids(rows), "item_id", "left_semi").select("item_id").distinct()
    of_items = rows.df.join(ids, "item_id", "left_semi")
    by_text = rows.df.filter("item_id is null").filter(expression_matches(raw_text(), comparator, number))
    return Rows(of_items.unionByName(by_text), rows.order, rows.unique)
