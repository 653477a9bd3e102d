"""SQL for DuckDB that gives the rows of the operators' queries, where SQL can."""

from __future__ import annotations

from folia.llm.line_dedup import _ENTITIES, _PATTERNS

# CRC-32 of a list of bytes, by a table of 256 entries that a query makes by the rule.
_CRC = """
RECURSIVE bits AS (SELECT i::bigint AS i, i::bigint AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""
_BYTES = "list_transform(regexp_extract_all({}, '..'), lambda h: ('0x' || h)::bigint)"


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::bigint], {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

OP1 = f"""WITH {_CRC},
d AS (SELECT doc_id, source, md5('42:' || coalesce(cast(doc_id as varchar), '')) AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 0.5::double) / count(*) OVER (PARTITION BY source) AS part FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY part, key, doc_id) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, cast(len(h) // 2 + 16 as bigint) AS size, {_crc(_BYTES.format("h"))} AS text_crc32, 'rows' AS law, cast(place * 40 // n as int) AS shard,
       cast(place - ((place * 40 // n) * n + 39) // 40 as bigint) AS slot, cast(NULL as int) AS grown_shard FROM p, crc_table"""


def _replaced() -> str:
    text = f"regexp_replace(coalesce(html, ''), '{_PATTERNS['hidden']}', '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{_PATTERNS['block']}', chr(10), 'g'), '{_PATTERNS['tag']}', '', 'g')"
    for name, char in _ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return text


OP3 = f"""WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{_PATTERNS["host"]}', 1)) AS host,
  list_filter(list_transform(string_split({_replaced()}, chr(10)), lambda x: trim(regexp_replace(x, '{_PATTERNS["space"]}', ' ', 'g'))), lambda x: x <> '') AS lines FROM pages),
hosts AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, pages, unnest(list_distinct(lines)) AS line FROM p JOIN hosts USING (host)) GROUP BY host, line HAVING count(*) - 1 > 0.05 * (any_value(pages) - 1)),
gone AS (SELECT host, list(line) AS gone FROM often GROUP BY host),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN gone USING (host))
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, cast(len(lines) as bigint) AS n_lines, cast(len(lines) - len(kept) as bigint) AS n_dropped FROM k"""

OP5 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


def _little(n: str) -> str:
    """A number as 4 bytes, least first, in hex."""
    return " || ".join(f"lpad(to_hex(({n} >> {8 * k}) & 255), 2, '0')" for k in range(4))


OP6 = f"""WITH {_CRC},
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, greatest(64, (octet_length(encode(coalesce(text, ''))) + 63) // 64 * 64)::bigint AS n FROM documents),
p AS (SELECT doc_id, cast(len(h) // 2 as bigint) AS n_bytes, n, h || repeat('00', cast(n - len(h) // 2 as bigint)) AS payload FROM d),
m AS (SELECT *, '52494646' || {_little("(n + 36)")} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {_little("n")} || payload AS media, {_BYTES.format("payload")} AS s FROM p)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, {_crc(_BYTES.format("right(payload, 128)"))} AS tail_crc32, cast(len(media) // 2 as bigint) AS media_bytes,
       sha256(unhex(media)) AS media_sha256,
       'samples=' || n || ';mean=' || cast(floor(list_sum(list_transform(s, lambda x: x - 128)) * 1000.0::double / n) as bigint)
       || ';rms=' || cast(floor(sqrt(cast(list_sum(list_transform(s, lambda x: (x - 128) * (x - 128))) as hugeint) * 1000000 // n)) as bigint)
       || ';crossings=' || len(list_filter(list_zip(s[2:], s[:-2]), lambda x: (x[1] >= 128) <> (x[2] >= 128))) AS feature
FROM m, crc_table"""

OP10 = f"""WITH d AS (SELECT doc_id, source, cast({_WORDS} as bigint) AS size, md5('42:' || coalesce(cast(doc_id as varchar), '')) AS key FROM documents),
s AS (SELECT source, cast(sum(size) as bigint) AS total, cast(sum(size) as bigint) * 2.0::double AS cap FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::double AS weight FROM s),
l AS (SELECT *, ((sum(total) OVER () * 1.5::double) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, total, least(cap, max(level) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN total > 0 THEN cast(floor(floor(target) / total) as bigint) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, size, total, target, epochs, cast(floor(target) as bigint) - epochs * total AS rest,
      cast(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) as bigint) AS run FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, total AS source_size, target, cast(epochs * size + greatest(0, least(size, rest - run + size)) as bigint) AS taken FROM r"""

ORACLE_SQL = {"op1_sharding": OP1, "op3_line_dedup": OP3, "op5_exact_dedup": OP5, "op6_media": OP6, "op10_mixing": OP10}
