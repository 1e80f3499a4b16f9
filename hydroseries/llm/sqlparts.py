"""SQL (DuckDB) shared by the oracles of this subpackage: crc32, which DuckDB lacks."""

from __future__ import annotations

# crc_table(t): the 256 remainders of the reflected polynomial 0xEDB88320, by the shift rule
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_concat([n::UBIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t)"""


def utf8_bytes(text: str) -> str:
    """The UTF-8 bytes of a text of code points below 256, as a list."""
    return f"""flatten(list_transform(string_split({text}, ''), lambda c: CASE
      WHEN c = '' THEN []::UBIGINT[] WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT]
      ELSE [(192 + (unicode(c) >> 6))::UBIGINT, (128 + (unicode(c) & 63))::UBIGINT] END))"""


def crc32(text: str, table: str = "t") -> str:
    return f"""xor(list_reduce(list_concat([4294967295::UBIGINT], {utf8_bytes(text)}),
      lambda c, b: xor(c >> 8, {table}[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"""
