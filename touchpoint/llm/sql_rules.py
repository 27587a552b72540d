"""Fragments of DuckDB SQL that several statements of results share."""

from __future__ import annotations

#: A one-row relation with the 256 entries of the CRC-32 table, made from its rule.
CRC_TABLE = """(
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS crc_table
  FROM range(0, 256) t(n)
)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of ``text``; ``crc_table`` must be in scope."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"
