"""Reading big-endian fields out of BINARY columns.

A header is turned into hex text once (``hex_of``) and fields are cut from that text, so decoding
stays in JVM expressions. Offsets are 0-based bytes, as the RFCs print them. Functions on hex text
take the *name* of its column and are written as SQL text: a frame has a hundred fields, and one
parsed expression each keeps building the plan fast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(data: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` bytes of a BINARY from 0-based ``start``; shorter at the end of the data."""
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    return F.substring(data, start + 1, F.greatest(length, F.lit(0)))


def rest(data: Column, start: Column | int) -> Column:
    return cut(data, start, F.octet_length(data))


def hex_of(data: Column, length: int) -> Column:
    return F.hex(cut(data, 0, length))


def _uint_sql(hex_name: str, start: int, length: int) -> str:
    kind = "bigint" if length >= 4 else "int"
    return f"cast(conv(substring({hex_name}, {2 * start + 1}, {2 * length}), 16, 10) as {kind})"


def uint(hex_name: str, start: int, length: int) -> Column:
    """Unsigned integer of ``length`` bytes; BIGINT from 4 bytes on, else INT."""
    return F.expr(_uint_sql(hex_name, start, length))


def uint_bits(hex_name: str, start: int, length: int, low: int, width: int) -> Column:
    """``width`` bits from bit ``low`` (0 is the last bit) of an unsigned integer."""
    return F.expr(f"shiftright({_uint_sql(hex_name, start, length)}, {low}) & {(1 << width) - 1}")


def mac(hex_name: str, start: int) -> Column:
    octets = ", ".join(f"substring({hex_name}, {2 * (start + i) + 1}, 2)" for i in range(6))
    return F.expr(f"lower(concat_ws(':', {octets}))")


def ipv4_text(hex_name: str, start: int) -> Column:
    return F.expr(f"concat_ws('.', {', '.join(_uint_sql(hex_name, start + i, 1) for i in range(4))})")


def hextets(hex_name: str, start: int) -> Column:
    """The eight groups of an IPv6 address, lower case and without leading zeros."""
    groups = ", ".join(f"substring({hex_name}, {2 * start + 4 * i + 1}, 4)" for i in range(8))
    return F.expr(f"transform(array({groups}), g -> lower(regexp_replace(g, '^0+(?=.)', '')))")
