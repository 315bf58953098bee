"""Text forms of DNS byte lists and of socket names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte codes shown as themselves in a DNS name (minus, underscore, blank).
_NAME_PUNCTUATION = (45, 95, 32)
# Inclusive byte ranges of digits, upper-case and lower-case letters.
_NAME_RANGES = ((48, 57), (65, 90), (97, 122))

# Fixed pattern: one side of a socket name, "address:port", split at the last colon.
_ENDPOINT = r"^([a-zA-Z0-9\-.*:\[\]]+):([a-zA-Z0-9\-.*:\[\]]+)$"


def _readable(byte: Column) -> Column:
    shown = byte.isin(*_NAME_PUNCTUATION)
    for low, high in _NAME_RANGES:
        shown = shown | byte.between(low, high)
    return shown


def dns_label_text(data: Column, last: Column) -> Column:
    """Bytes of a DNS name as text.

    Readable bytes stay; other bytes are label lengths and give '.', but '' in the first place and
    in place number ``last`` (1-based).
    """

    def one(byte: Column, index: Column) -> Column:
        edge = (index == 0) | F.coalesce(index + 1 == last, F.lit(False))
        return F.when(_readable(byte), F.char(byte.cast("bigint"))).when(edge, "").otherwise(".")

    return F.array_join(F.transform(data, one), "")


def dns_question_text(qname: Column) -> Column:
    return dns_label_text(qname, F.size(qname))


def dns_record_text(rdata: Column, rtype: Column, rclass: Column, qname: Column, last: Column | None = None) -> Column:
    """Record data as text: numbers joined by '.' for IN A/AAAA, else the name rule.

    By default the last place is that of the *question* (so the final byte of a record may give a
    '.'); pass ``last=size(rdata)`` for the record's own end.
    """
    address = F.array_join(rdata.cast("array<string>"), ".")
    if last is None:
        last = F.when(qname.isNotNull(), F.size(qname))
    is_address = F.coalesce((rclass == "IN") & rtype.isin("A", "AAAA"), F.lit(False))
    return F.when(is_address, address).otherwise(dns_label_text(rdata, last))


def socket_side(name: Column, side: int) -> tuple[Column, Column]:
    """(address, port) text of side 1 (source) or 2 (destination) of ``src:port->dst:port``; '' on a miss."""
    part = F.split_part(name, F.lit("->"), F.lit(side))
    return F.regexp_extract(part, _ENDPOINT, 1), F.regexp_extract(part, _ENDPOINT, 2)


def without_brackets(address: Column) -> Column:
    return F.translate(address, "[]", "")


def source_host(address: Column) -> Column:
    """A source holding ':' or '-' keeps only what stands before the first dot, without brackets."""
    first = without_brackets(F.split_part(address, F.lit("."), F.lit(1)))
    return F.when(address.rlike(r"[:\-]"), first).otherwise(address)


def port_number(text: Column) -> Column:
    """Port 0..65535 as INT, NULL for anything else."""
    number = text.try_cast("int")
    return F.when(number.between(0, 65535), number)
