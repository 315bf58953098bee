"""Internet addresses as canonical text.

An address column holds ``host[/prefix]``: dotted IPv4 or lower-case compressed IPv6, with the
prefix left out where it is the full length. Canonical text compares by equality, joins, groups
and exports to any format. Text that is no address becomes NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}(/(3[0-2]|[12]?[0-9]))?$"
_V4_TAIL = r"^(.*:)([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
_HEXTET = r"^[0-9a-f]{1,4}$"
_PREFIX6 = r"^(12[0-8]|1[01][0-9]|[1-9]?[0-9])$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression that uses it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _host_part(text: Column) -> Column:
    return F.split_part(text, F.lit("/"), F.lit(1))


def _prefix_part(text: Column) -> Column:
    return F.split_part(text, F.lit("/"), F.lit(2))


def _groups(part: Column) -> Column:
    # An empty half has no groups; an empty group inside a half is kept and makes the text invalid.
    return F.when(part != "", F.split(part, ":")).otherwise(F.array().cast("array<string>"))


def _embedded_v4_as_hextets(host: Column) -> Column:
    def octet(i: int) -> Column:
        return F.regexp_extract(host, _V4_TAIL, i).cast("int")

    def pair(i: int) -> Column:
        return F.lower(F.hex((octet(i) * 256 + octet(i + 1)).cast("bigint")))

    joined = F.concat(F.regexp_extract(host, _V4_TAIL, 1), pair(2), F.lit(":"), pair(4))
    return F.when(host.rlike(_V4_TAIL), joined).otherwise(host)


def _hextets(host: Column) -> Column:
    """The eight groups of an IPv6 host without leading zeros, or NULL if it is malformed."""

    def from_halves(halves: Column) -> Column:
        head = _groups(halves[0])
        tail = F.when(F.size(halves) == 2, _groups(F.try_element_at(halves, F.lit(2)))).otherwise(
            F.array().cast("array<string>")
        )
        missing = F.lit(8) - F.size(head) - F.size(tail)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        gap_ok = F.when(F.size(halves) == 2, missing >= 1).otherwise(missing == 0)
        groups = F.concat(head, zeros, tail)
        sound = (
            (F.size(halves) <= 2)
            & gap_ok
            & (F.size(groups) == 8)
            & F.forall(groups, lambda g: g.rlike(_HEXTET))
        )
        return F.when(sound, F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    return let(F.split(_embedded_v4_as_hextets(F.lower(host)), "::"), from_halves)


def compress_hextets(groups: Column) -> Column:
    """IPv6 text of eight groups: the longest (leftmost) run of two or more zeros becomes ``::``."""

    def shorten(full: Column) -> Column:
        result = full
        for run in range(2, 9):
            pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)"
            result = F.when(full.rlike(pattern), F.regexp_replace(full, pattern, "$1::")).otherwise(result)
        return result

    return let(F.array_join(groups, ":"), shorten)


def _canonical_v4(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(^|\.)0+(?=[0-9])", "$1"), "/32$", "")


def _canonical_v6(text: Column) -> Column:
    prefix = _prefix_part(text)
    suffix = F.when((prefix == "") | (prefix == "128"), F.lit("")).otherwise(F.concat(F.lit("/"), prefix))
    prefix_ok = (~F.contains(text, F.lit("/"))) | prefix.rlike(_PREFIX6)
    return F.when(prefix_ok, F.concat(compress_hextets(_hextets(_host_part(text))), suffix))


def inet(text: Column) -> Column:
    """Canonical address, or NULL where the text is no address."""
    return F.when(text.rlike(_V4), _canonical_v4(text)).when(F.contains(text, F.lit(":")), _canonical_v6(text))


def inet_host(address: Column) -> Column:
    """The address without its prefix length."""
    return F.when(address.isNotNull(), _host_part(address))


def inet_family(address: Column) -> Column:
    return F.when(F.contains(address, F.lit(":")), 6).when(address.isNotNull(), 4)


def inet_prefix(address: Column) -> Column:
    full = F.when(F.contains(address, F.lit(":")), 128).when(address.isNotNull(), 32)
    return F.coalesce(_prefix_part(address).try_cast("int"), full)


def _v4_number(host: Column) -> Column:
    octets = [F.split_part(host, F.lit("."), F.lit(i)).cast("bigint") for i in range(1, 5)]
    return octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]


def _v4_from_number(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _hextet_number(group: Column) -> Column:
    return F.conv(group, 16, 10).cast("int")


def inet_network_host(address: Column) -> Column:
    """The network of an address without its prefix length: host bits cleared."""

    def shifted(number: Column, drop: Column) -> Column:
        return F.call_function("shiftleft", F.call_function("shiftright", number, drop), drop)

    def v4(parts: Column) -> Column:
        return _v4_from_number(shifted(_v4_number(parts["host"]), F.lit(32) - parts["prefix"]))

    def v6(parts: Column) -> Column:
        def masked(group: Column, i: Column) -> Column:
            low = F.least(F.lit(16), F.greatest(F.lit(0), (i + 1) * 16 - parts["prefix"]))
            return F.lower(F.hex(shifted(_hextet_number(group), low).cast("bigint")))

        return compress_hextets(F.transform(_hextets(parts["host"]), masked))

    parts = F.struct(inet_host(address).alias("host"), inet_prefix(address).alias("prefix"))
    return F.when(address.isNotNull(), let(parts, lambda p: F.when(F.contains(p["host"], F.lit(":")), v6(p)).otherwise(v4(p))))


def inet_network(address: Column) -> Column:
    """The network of an address, with the prefix length unless it is the full one."""
    prefix = inet_prefix(address)
    full = F.when(inet_family(address) == 6, 128).otherwise(32)
    suffix = F.when(prefix == full, F.lit("")).otherwise(F.concat(F.lit("/"), prefix.cast("string")))
    return F.concat(inet_network_host(address), suffix)


def inet_key(address: Column) -> Column:
    """Fixed-width sortable text: family, then 32 hex digits of the host."""
    host = inet_host(address)
    v4 = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(_v4_number(host))), 32, "0"))
    v6 = F.concat(F.lit("6"), F.array_join(F.transform(_hextets(host), lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(inet_family(address) == 6, v6).when(inet_family(address) == 4, v4)


def netmask_length(netmask: Column) -> Column:
    """Number of set bits of a netmask written as an address, IPv4 or IPv6."""

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + F.bit_count(n))

    v4 = total(F.transform(F.split(netmask, r"\."), lambda o: o.try_cast("int")))
    v6 = total(F.transform(_hextets(netmask), _hextet_number))
    return F.when(F.contains(netmask, F.lit(":")), v6).when(netmask.rlike(_V4), v4)
