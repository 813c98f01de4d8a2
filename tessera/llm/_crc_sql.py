"""CRC-32 in DuckDB's SQL, which has no function for it."""

from __future__ import annotations

#: A list ``cs`` of 256 values, one for each byte, as common table expressions.
CRC_SQL = """
crc_table AS (
  WITH RECURSIVE t(i, k, c) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8)
  SELECT i, c FROM t WHERE k = 8),
crc_list AS (SELECT list(c ORDER BY i) AS cs FROM crc_table)"""


def crc_sql(value: str) -> str:
    """CRC-32 of a string expression of ASCII characters, given ``cs`` of ``crc_list``."""
    return f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 AS bigint), list_transform(string_split({value}, ''), lambda ch: cast(ascii(ch) AS bigint))), lambda c, b: xor(c >> 8, cs[1 + (xor(c, b) & 255)])))"
