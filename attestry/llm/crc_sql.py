"""CRC-32 in DuckDB SQL, for the SQL of queries whose definition uses it."""

#: One row with the list of the 256 remainders of the reflected polynomial.
CRC_TABLE_SQL = """crc_table AS (SELECT list(v ORDER BY k) AS remainders FROM (
  SELECT k, list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(k)))"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; ``crc_table`` must be in the FROM clause."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)"
