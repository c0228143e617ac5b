"""Parts of SQL that several twins need."""

from __future__ import annotations

#: A table `bytes` of one row: the checksums of single bytes.
BYTES = """bytes AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS table_of FROM range(256) AS r(i))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text; the table `bytes` must be joined."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, table_of[(xor(c, b) & 255) + 1])))"
