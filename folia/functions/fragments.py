"""Markup of one element, by its xmlid."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fragment_of(xml: str | None, xmlid: str | None) -> str | None:
    """The element with that xmlid, as markup; None if there is none or the text is no XML."""
    if not xml or not xmlid:
        return None
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    for e in root.iter():
        if e.get("xmlid") == xmlid:
            e.tail = None
            return ET.tostring(e, encoding="unicode")
    return None


def fragment(xml: Column, xmlid: Column) -> Column:
    """fragment_of() as an Arrow-batched function."""

    @F.pandas_udf("string")
    def cut(xmls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([fragment_of(x, i) for x, i in zip(xmls, ids, strict=True)])

    return cut(xml, xmlid)
