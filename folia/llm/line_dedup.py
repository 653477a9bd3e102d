"""Removal of lines that many pages of a site share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import materialize, whole_row

#: Bytes of (host, line hash) entries up to which they are broadcast; beyond, pages are joined by salted host.
BROADCAST_BYTES = 32 << 20
SALTS = 64
_PATTERNS = {
    "hidden": r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->",
    "block": r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>",
    "tag": r"<[^>]*>",
    "host": r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)",
    "space": r"[\x20\x09-\x0D]+",
    "inside": r"[\x20\x09\x0B-\x0D]+",
}
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERNS["host"], 1))


def html_lines(html: Column) -> Column:
    """The lines of text of a page: cut at block tags and line ends, white space collapsed, blank lines left out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _PATTERNS["hidden"], "")
    text = F.regexp_replace(F.regexp_replace(text, _PATTERNS["block"], "\n"), _PATTERNS["tag"], "")
    for name, char in _ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    # white space inside lines, once for the whole text; then what is left of it at their ends
    lines = F.transform(F.split(F.regexp_replace(text, _PATTERNS["inside"], " "), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def _same(line: Column) -> Column:
    """What of a line is compared: not the white space around it."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _key(line: Column) -> Column:
    """128 bits of hash, as text: arrays of it are searched by hashing."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), line)))


def drop_site_lines(df: DataFrame, host: Column, lines: Column, *, ratio: float, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop lines that more than `ratio` of a host's other pages contain.

    A line that n of a host's pages have goes if (n - 1) / (pages - 1) is over the ratio: of the pages
    beside any one that has it, the share that has it as well. On a large host that is n / pages;
    on a small one a line of one page is never boilerplate, and there is no floor of pages.

    A line counts once a page, by 128 bits of hash of its trimmed text; blank lines are never
    dropped. Counts are pre-aggregated before the shuffle, so that a line of a third of all
    pages is one row from each task. Of a host's lines at most (lines per page) / ratio can
    exceed the ratio; these short lists are broadcast if their measured size allows, and
    otherwise joined by host and salt, each list once per salt.

    Returns (row, kept_lines, n_lines, n_dropped): row is a struct of all columns of df. Null
    host: all such rows are one host. Null or empty lines: no line, nothing dropped. Repeated
    rows count as pages of their own. Empty table: no rows.
    """
    rows = df.select(whole_row(df).alias("row"), host.alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    keys = F.transform(F.filter(F.transform("lines", _same), lambda x: x != ""), _key)
    seen = rows.select("host", F.explode(F.array_distinct(keys)).alias("line"))
    totals = df.select(host.alias("of_host")).groupBy("of_host").agg(F.count(F.lit(1)).alias("pages"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("of_host"))).filter(F.col("n") - 1 > (F.col("pages") - 1) * ratio)
    lists = materialize(often.groupBy("host").agg(F.collect_list("line").alias("drop")).select(F.col("host").alias("drop_host"), "drop"), "site-lines")
    size = lists.agg(F.sum(64 * F.size("drop") + 64 + F.coalesce(F.octet_length("drop_host"), F.lit(0)))).first()[0]
    same_host = F.col("host").eqNullSafe(F.col("drop_host"))
    if (size or 0) <= broadcast_bytes:
        joined = rows.join(F.broadcast(lists), same_host, "left")
    else:
        lists = lists.withColumn("drop_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("lines"), F.lit(SALTS)).cast("int"))
        joined = salted.join(lists, same_host & (F.col("salt") == F.col("drop_salt")), "left")
    # what a page has of its host's list is found by hashing, and is short: only that is searched for each line
    joined = joined.withColumn("gone", F.when(F.col("drop").isNotNull(), F.array_intersect(F.transform("lines", lambda x: _key(_same(x))), "drop")))
    some = F.coalesce(F.size("gone"), F.lit(0)) > 0
    kept = F.when(some, F.filter("lines", lambda x: ~F.array_contains("gone", _key(_same(x))))).otherwise(F.col("lines"))
    joined = joined.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept_lines"))
    return joined.select("row", "kept_lines", "n_lines", (F.col("n_lines") - F.size("kept_lines")).alias("n_dropped"))


def dedup_page_lines(pages: DataFrame, *, ratio: float = 0.05) -> DataFrame:
    """page_id, host, text without site lines, n_lines, n_dropped of every page (page_id, url, html).

    Pages are taken apart once; counting and dropping both read the lines from the shared folder.
    Null url, or one that names no host: the host is empty, and all such pages are one host. Null or
    empty html: empty text, 0 lines. Repeated rows, and repeated or null ids, are pages of their own.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    parsed = materialize(pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")), "lines")
    cleaned = drop_site_lines(parsed, F.col("host"), F.col("lines"), ratio=ratio)
    return cleaned.select("row.page_id", "row.host", F.array_join("kept_lines", "\n").alias("text"), "n_lines", "n_dropped")


def dedup_document_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.05) -> DataFrame:
    """The rows of docs with their text less the lines that over `ratio` of a source's other documents share.

    Null text stays null, and empty text empty. A null source is a source of its own. Repeated
    rows are documents of their own. Empty table: no rows. Columns are passed on whatever their names.
    """
    cleaned = drop_site_lines(docs, F.col(host_col), F.split(text_col, "\n"), ratio=ratio)
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.array_join("kept_lines", "\n"))
    return cleaned.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
