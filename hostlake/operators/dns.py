"""DNS messages (RFC 1035 header and sections) out of a BINARY payload.

A section is a fold over the announced number of entries: the state is the byte position and the
entries read so far. The fixed bytes of an entry are read once, as one or two numbers whose bits are its fields; a
message is one expression, as each further stage would copy the wide row. Headers that announce more than the payload could hold are refused before
anything is read, so other protocols cost a 12-byte look only.

Records are read with a two-byte name tag (a compression pointer), as the record layout here has
no other form: a record whose name is written out is not recognised as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.operators.stages import bind

# Record type mnemonics by number (IANA registry).
TYPE_NAMES = {
    1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG", 9: "MR", 10: "NULL",
    11: "WKS", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB",
    19: "X25", 20: "ISDN", 21: "RT", 22: "NSAP", 23: "NSAP_PTR", 24: "SIG", 25: "KEY", 26: "PX",
    27: "GPOS", 28: "AAAA", 29: "LOC", 30: "NXT", 31: "EID", 32: "NIMLOC", 33: "SRV", 34: "ATMA",
    35: "NAPTR", 36: "KX", 37: "CERT", 38: "A6", 39: "DNAME", 40: "SINK", 41: "OPT", 42: "APL",
    43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID",
    50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 55: "HIP", 56: "NINFO", 57: "RKEY",
    58: "TALINK", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB",
    65: "HTTPS", 99: "SPF", 100: "UINFO", 101: "UID", 102: "GID", 103: "UNSPEC", 104: "NID",
    105: "L32", 106: "L64", 107: "LP", 108: "EUI48", 109: "EUI64", 249: "TKEY", 250: "TSIG",
    251: "IXFR", 252: "AXFR", 253: "MAILB", 254: "MAILA", 255: "ANY", 256: "URI", 257: "CAA",
    258: "AVC", 259: "DOA", 260: "AMTRELAY", 32768: "TA", 32769: "DLV",
}
# Class mnemonics by number.
CLASS_NAMES = {1: "IN", 2: "CS", 3: "CH", 4: "HS"}

# Bytes of the header, of the shortest question and of the shortest record.
HEADER, MIN_QUESTION, MIN_RECORD = 12, 5, 12

_QUESTIONS = "array<struct<qname:array<smallint>,qtype:string,qclass:string>>"
_RECORDS = (
    "array<struct<origin:int,name_tag:int,rtype:string,rclass:string,ttl:bigint,rdlength:int,rdata:array<smallint>>>"
)


def _mnemonic(number: str, names: dict[int, str], other: str) -> str:
    # Unknown numbers are written as RFC 3597 does: TYPE65280, CLASS9.
    table = ", ".join(f"{code}, '{name}'" for code, name in names.items())
    return f"coalesce(try_element_at(map({table}), cast({number} as int)), concat('{other}', {number}))"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _number(data: str, start: str, length: int) -> str:
    """Big-endian integer of ``length`` (at most 7) bytes of ``data`` at 0-based ``start``; NULL where there are none."""
    return f"cast(conv(hex(substring({data}, {start} + 1, {length})), 16, 10) as bigint)"


def _bits(number: str, low: int, width: int) -> str:
    return f"(shiftright({number}, {low}) & {(1 << width) - 1})"


def _bytes(data: str, start: str, length: str) -> str:
    """ARRAY<SMALLINT> of ``length`` bytes of ``data`` at 0-based ``start``."""
    text = f"decode(substring({data}, {start} + 1, {length}), 'ISO-8859-1')"
    values = f"transform(split({text}, ''), c -> cast(ascii(c) as smallint))"
    return f"if({length} > 0, {values}, cast(array() as array<smallint>))"


# Fields of the header: which of its three 4-byte words holds them, their lowest bit and their width.
_HEADER_FIELDS = {
    "id": ("a", 16, 16),
    "is_response": ("a", 15, 1),
    "opcode": ("a", 11, 4),
    "is_authoriative": ("a", 10, 1),
    "is_truncated": ("a", 9, 1),
    "is_recursion_desirable": ("a", 8, 1),
    "is_recursion_available": ("a", 7, 1),
    "zero_reserved": ("a", 6, 1),
    "is_answer_authenticated": ("a", 5, 1),
    "is_non_authenticated_data": ("a", 4, 1),
    "rcode": ("a", 0, 4),
    "query_count": ("b", 16, 16),
    "response_count": ("b", 0, 16),
    "authority_rr_count": ("c", 16, 16),
    "additional_rr_count": ("c", 0, 16),
}


def _field(name: str) -> str:
    word, low, width = _HEADER_FIELDS[name]
    return f"cast({_bits(f'w.{word}', low, width)} as int)"


def _header() -> str:
    fields = ", ".join(f"'{name}', {_field(name)}" for name in _HEADER_FIELDS)
    return f"named_struct({fields})"


def _fold(count: str, start: str, item_type: str, entry: str, fits: str, item: str, size: str) -> str:
    """Read ``count`` entries of a message from byte ``start``: STRUCT(pos after them, items).

    ``entry`` is SQL over the state ``s`` (``s.pos`` is where an entry starts); ``fits``, ``item`` and ``size`` know it
    as ``e``. An entry that does not fit ends the section.
    """
    rounds = f"if({count} > 0, sequence(1, cast({count} as int)), cast(array() as array<int>))"
    initial = f"named_struct('pos', cast({start} as int), 'items', cast(array() as {item_type}))"
    after = f"named_struct('pos', cast(s.pos + {size} as int), 'items', concat(s.items, array({item})))"
    return f"aggregate({rounds}, {initial}, (s, i) -> {_let(entry, 'e', f'if({fits}, {after}, s)')})"


def _questions(data: str) -> str:
    # Where the name's closing byte is (1-based, 0 if nowhere), and the four bytes behind it.
    closing = f"position('\\u0000', decode({data}, 'ISO-8859-1'), s.pos + 1)"
    entry = _let(closing, "z", f"named_struct('zero', z, 'tail', {_number(data, 'z', 4)})")
    item = (
        f"named_struct('qname', {_bytes(data, 's.pos', '(e.zero - s.pos)')},"
        f" 'qtype', {_mnemonic(_bits('e.tail', 16, 16), TYPE_NAMES, 'TYPE')},"
        f" 'qclass', {_mnemonic(_bits('e.tail', 0, 16), CLASS_NAMES, 'CLASS')})"
    )
    fits = f"e.zero > 0 and e.zero + 4 <= octet_length({data})"
    return _fold(_field("query_count"), str(HEADER), _QUESTIONS, entry, fits, item, "(e.zero + 4 - s.pos)")


def _records(data: str, count: str, start: str, origin: int) -> str:
    # Name tag, type and class in one number; time to live and length in another.
    entry = f"named_struct('a', {_number(data, 's.pos', 6)}, 'b', {_number(data, 's.pos + 6', 6)})"
    rdlength = _bits("e.b", 0, 16)
    item = (
        f"named_struct('origin', {origin}, 'name_tag', cast({_bits('e.a', 32, 16)} as int),"
        f" 'rtype', {_mnemonic(_bits('e.a', 16, 16), TYPE_NAMES, 'TYPE')},"
        f" 'rclass', {_mnemonic(_bits('e.a', 0, 16), CLASS_NAMES, 'CLASS')},"
        f" 'ttl', {_bits('e.b', 16, 32)}, 'rdlength', cast({rdlength} as int),"
        f" 'rdata', {_bytes(data, 's.pos + 12', f'cast({rdlength} as int)')})"
    )
    room = f"(octet_length({data}) - s.pos)"
    fits = f"if({room} >= {MIN_RECORD}, {room} >= {rdlength} + {MIN_RECORD}, false)"
    # No more records than fit can be read, whatever the header announces.
    possible = f"least({count}, cast(floor((octet_length({data}) - {start}) / {MIN_RECORD}) as int))"
    return _fold(possible, start, _RECORDS, entry, fits, item, f"({rdlength} + {MIN_RECORD})")


def _message(data: str) -> str:
    """STRUCT(header, questions, records) of a message whose header words are ``w``, from the inside out."""
    whole = f"named_struct('header', {_header()}, 'questions', q.items, 'records', concat(an.items, ar.items, ns.items))"
    rest = _let(_records(data, _field("additional_rr_count"), "ns.pos", 1), "ar", whole)
    more = _let(_records(data, _field("authority_rr_count"), "an.pos", 2), "ns", rest)
    answered = _let(_records(data, _field("response_count"), "q.pos", 0), "an", f"if(size(an.items) = {_field('response_count')}, {more}, null)")
    return _let(_questions(data), "q", f"if(size(q.items) = {_field('query_count')}, {answered}, null)")


def with_dns(df: DataFrame, payload: str) -> DataFrame:
    """Add ``dns`` = STRUCT(header, questions, records), NULL where the payload is no DNS message.

    A message counts as DNS when it announces a question or an answer and all announced questions
    and answers are there. Authority and additional records that do not fit are left out. Records
    come in the order answers (origin 0), additional (1), authority (2).
    """
    questions, answers = _field("query_count"), _field("response_count")
    plausible = f"({questions} > 0 or {answers} > 0) and {questions} * {MIN_QUESTION} + {answers} * {MIN_RECORD} + {HEADER} <= octet_length({payload})"
    words = f"named_struct('a', {_number(payload, '0', 4)}, 'b', {_number(payload, '4', 4)}, 'c', {_number(payload, '8', 4)})"
    read = _let(words, "w", f"if({plausible}, {_message(payload)}, null)")
    return bind(df, {"dns": F.expr(f"if(octet_length({payload}) >= {HEADER}, {read}, null)")}).select(*[c for c in df.columns if c != "dns"], "dns")
