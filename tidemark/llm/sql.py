"""Pieces of DuckDB SQL that several oracles need."""

from __future__ import annotations

#: A table of CRC-32 by its rule; put it among the CTEs.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_row)"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, in a query that also reads crc_table."""
    found = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {found}), lambda c, b: xor(c >> 8, crc_row[(xor(c, b) & 255) + 1])), 4294967295)"
