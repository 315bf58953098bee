"""Layered decoding of captured frames, in JVM expressions only.

Input: ``frames(packet_id, interface, created_at, frame BINARY)``. Every step adds nullable struct
columns and keeps every row: a layer that is unknown or too short is NULL, and so are the layers
above it. The result is one wide row per packet; packet and protocol tables are projections of it
(``protocol_fanout``), so no join is needed to bring the layers of a packet together.

Offsets follow RFC 826 (ARP), 791 (IPv4), 8200 (IPv6), 9293 (TCP), 768 (UDP), 792/4443 (ICMP).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.functions.ids import row_id
from hostlake.functions.inet import compress_hextets
from hostlake.functions.wire import cut, hex_of, hextets, ipv4_text, mac, rest, uint, uint_bits
from hostlake.operators.dns import with_dns
from hostlake.operators.http import http_message
from hostlake.operators.stages import bind
from hostlake.schemas import PROTOCOL_COLUMNS

# Ether types and IP protocol numbers that are decoded further.
ETHER_IPV4, ETHER_ARP, ETHER_IPV6 = 0x0800, 0x0806, 0x86DD
IP_ICMP, IP_TCP, IP_UDP, IP_ICMPV6 = 1, 6, 17, 58
# Shortest header of each layer, in bytes.
MIN_ETHERNET, MIN_ARP, MIN_IPV4, MIN_IPV6, MIN_TCP, MIN_UDP, MIN_ICMP, MIN_TLS = 14, 28, 20, 40, 20, 8, 4, 5
# TLS record content types (change cipher spec .. heartbeat) and versions (SSL 2 .. TLS 1.3).
TLS_CONTENT_TYPES = (20, 21, 22, 23, 24)
TLS_VERSIONS = (2, 768, 769, 770, 771, 772)

LAYERS = ("ethernet", "arp", "ipv4", "ipv6", "tcp", "udp", "icmp", "dns", "http", "tls")


def _layer(condition: Column, **fields: Column) -> Column:
    return F.when(condition, F.struct(*[value.alias(name) for name, value in fields.items()]))


def packet_base(frames: DataFrame) -> DataFrame:
    """Id, interface, length in bytes and time of every frame."""
    return frames.select(
        F.col("packet_id").alias("_id"),
        "interface",
        F.octet_length("frame").cast("bigint").alias("length"),
        "created_at",
    )


def with_ethernet(frames: DataFrame) -> DataFrame:
    h = "_eth"
    size = F.octet_length("frame")
    ethernet = _layer(
        size >= MIN_ETHERNET,
        source=mac(h, 6),
        destination=mac(h, 0),
        ether_type=uint(h, 12, 2),
        payload_length=(size - MIN_ETHERNET).cast("bigint"),
    )
    staged = bind(frames, {"_eth": hex_of(F.col("frame"), MIN_ETHERNET)})
    return bind(staged, {"ethernet": ethernet}).drop("_eth")


def with_network(frames: DataFrame) -> DataFrame:
    """arp, ipv4, ipv6 and the IP payload (``_proto``, ``_payload``) out of the Ethernet payload."""
    h, ether = "_net", F.col("ethernet.ether_type")
    size = F.col("ethernet.payload_length")
    staged = bind(frames, {"_net": F.hex(cut(F.col("frame"), MIN_ETHERNET, MIN_IPV6))})

    arp = _layer(
        (ether == ETHER_ARP) & (size >= MIN_ARP),
        hardware_type=uint(h, 0, 2),
        protocol_type=uint(h, 2, 2),
        hw_addr_len=uint(h, 4, 1),
        proto_addr_len=uint(h, 5, 1),
        operation=uint(h, 6, 2),
        sender_hw_addr=mac(h, 8),
        sender_proto_addr=ipv4_text(h, 14),
        target_hw_addr=mac(h, 18),
        target_proto_addr=ipv4_text(h, 24),
    )
    ipv4 = _layer(
        (ether == ETHER_IPV4) & (size >= MIN_IPV4),
        version=uint_bits(h, 0, 1, 4, 4),
        header_length=uint_bits(h, 0, 1, 0, 4),
        dscp=uint_bits(h, 1, 1, 2, 6),
        ecn=uint_bits(h, 1, 1, 0, 2),
        total_length=uint(h, 2, 2),
        identification=uint(h, 4, 2),
        flags=uint_bits(h, 6, 2, 13, 3),
        fragment_offset=uint_bits(h, 6, 2, 0, 13),
        ttl=uint(h, 8, 1),
        next_level_protocol=uint(h, 9, 1),
        checksum=uint(h, 10, 2),
        source=ipv4_text(h, 12),
        destination=ipv4_text(h, 16),
    )
    ipv6 = _layer(
        (ether == ETHER_IPV6) & (size >= MIN_IPV6),
        version=uint_bits(h, 0, 2, 12, 4),
        traffic_class=uint_bits(h, 0, 2, 4, 8),
        flow_label=uint_bits(h, 0, 4, 0, 20).cast("int"),
        payload_length=uint(h, 4, 2),
        next_header=uint(h, 6, 1),
        hop_limit=uint(h, 7, 1),
        source=compress_hextets(hextets(h, 8)),
        destination=compress_hextets(hextets(h, 24)),
    )
    decoded = bind(staged, {"arp": arp, "ipv4": ipv4, "ipv6": ipv6})

    # The IP payload ends where the header says, so Ethernet padding stays out of it.
    header = F.col("ipv4.header_length") * 4
    v4_payload = cut(
        F.col("frame"), F.lit(MIN_ETHERNET) + F.greatest(header, F.lit(MIN_IPV4)), F.col("ipv4.total_length") - header
    )
    v6_payload = cut(F.col("frame"), MIN_ETHERNET + MIN_IPV6, F.col("ipv6.payload_length"))
    return bind(
        decoded,
        {
            "_proto": F.coalesce(F.col("ipv4.next_level_protocol"), F.col("ipv6.next_header")),
            "_payload": F.when(F.col("ipv4").isNotNull(), v4_payload).when(F.col("ipv6").isNotNull(), v6_payload),
        },
    ).drop("_net")


def with_transport(packets: DataFrame) -> DataFrame:
    """tcp, udp, icmp and the application payload (``_message``) out of the IP payload."""
    h, proto, size = "_tp", F.col("_proto"), F.octet_length("_payload")
    staged = bind(packets, {"_tp": hex_of(F.col("_payload"), MIN_TCP)})

    tcp_head = F.greatest(uint(h, 12, 1).bitwiseAND(0xF0) / 4, F.lit(MIN_TCP)).cast("int")
    tcp = _layer(
        (proto == IP_TCP) & (size >= MIN_TCP),
        source=uint(h, 0, 2),
        destination=uint(h, 2, 2),
        sequence=uint(h, 4, 4),
        acknowledgement=uint(h, 8, 4),
        data_offset=uint_bits(h, 12, 1, 4, 4),
        reserved=uint_bits(h, 12, 1, 0, 4),
        flags=uint(h, 13, 1),
        _window=uint(h, 14, 2),
        checksum=uint(h, 16, 2),
        urgent_ptr=uint(h, 18, 2),
        options=F.lower(F.hex(cut(F.col("_payload"), MIN_TCP, tcp_head - MIN_TCP))),
    )
    udp = _layer(
        (proto == IP_UDP) & (size >= MIN_UDP),
        source=uint(h, 0, 2),
        destination=uint(h, 2, 2),
        length=uint(h, 4, 2),
        checksum=uint(h, 6, 2),
    )
    version = F.when(F.col("ipv4").isNotNull() & (proto == IP_ICMP), 4).when(
        F.col("ipv6").isNotNull() & (proto == IP_ICMPV6), 6
    )
    icmp = _layer(
        version.isNotNull() & (size >= MIN_ICMP),
        version=version,
        type=uint(h, 0, 1),
        code=uint(h, 1, 1),
        checksum=uint(h, 2, 2),
        payload_length=(size - MIN_ICMP).cast("bigint"),
    )
    decoded = bind(staged, {"tcp": tcp, "udp": udp, "icmp": icmp})
    offset = F.greatest(F.col("tcp.data_offset") * 4, F.lit(MIN_TCP))
    message = F.when(F.col("tcp").isNotNull(), rest(F.col("_payload"), offset)).when(
        F.col("udp").isNotNull(), rest(F.col("_payload"), MIN_UDP)
    )
    return bind(decoded, {"_message": message}).drop("_tp", "_payload", "_proto")


def tls_record(hex_name: str) -> Column:
    """Record header (content type, version, length) out of the hex text of the first five bytes.

    NULL unless the header is whole and its type and version are known.
    """
    h = hex_name
    known = (
        (F.length(h) >= 2 * MIN_TLS)
        & uint(h, 0, 1).isin(*TLS_CONTENT_TYPES)
        & uint(h, 1, 2).isin(*TLS_VERSIONS)
    )
    return _layer(known, content_type=uint(h, 0, 1), version=uint(h, 1, 2), length=uint(h, 3, 2))


def with_application(packets: DataFrame, tcp_length_prefix: bool = False) -> DataFrame:
    """dns, http, tls: on TCP the first of the three that fits, on UDP dns only.

    ``tcp_length_prefix`` skips the two length bytes that DNS carries over TCP; by default the
    payload is taken as it is.
    """
    message, over_tcp = F.col("_message"), F.col("tcp").isNotNull()
    if tcp_length_prefix:
        unprefixed = F.when(over_tcp, rest(message, 2)).otherwise(message)
        decoded = with_dns(bind(packets, {"_dns_message": unprefixed}), "_dns_message").drop("_dns_message")
    else:
        decoded = with_dns(packets, "_message")
    decoded = bind(
        decoded,
        {
            "http": F.when(over_tcp & F.col("dns").isNull(), http_message(message)),
            "_record": hex_of(message, MIN_TLS),
        },
    )
    free = over_tcp & F.col("dns").isNull() & F.col("http").isNull()
    return bind(decoded, {"tls": F.when(free, tls_record("_record"))}).drop("_message", "_record")


def decode_packets(frames: DataFrame, tcp_length_prefix: bool = False, depth: str = "application") -> DataFrame:
    """Wide rows: packet columns plus one nullable struct per layer.

    ``depth`` ("data_link", "network", "transport", "application") stops after that layer, for jobs
    that need no more; the result then holds the layers up to it.
    """
    layers = {
        "data_link": (["ethernet"], with_ethernet),
        "network": (["arp", "ipv4", "ipv6"], with_network),
        "transport": (["tcp", "udp", "icmp"], with_transport),
        "application": (["dns", "http", "tls"], lambda df: with_application(df, tcp_length_prefix)),
    }
    if depth not in layers:
        raise ValueError(f"unknown depth {depth!r}")
    wide, decoded = frames, []
    for layer, (columns, step) in layers.items():
        wide = step(wide)
        decoded += columns
        if layer == depth:
            break
    return wide.select(
        F.col("packet_id").alias("_id"),
        "interface",
        F.octet_length("frame").cast("bigint").alias("length"),
        "created_at",
        *decoded,
    )


def layer_labels(wide: DataFrame) -> dict[str, Column]:
    """Names of the four layers of a wide row; the order in each layer is the order of precedence."""

    def first_of(*layers: tuple[str, str]) -> Column:
        return F.coalesce(*[F.when(F.col(column).isNotNull(), F.lit(label)) for column, label in layers])

    return {
        "data_link": first_of(("ethernet", "ethernet")),
        "network": first_of(("ipv4", "ipv4"), ("ipv6", "ipv6"), ("arp", "arp")),
        "transport": first_of(("tcp", "tcp"), ("udp", "udp"), ("icmp", "icmp")),
        "application": first_of(("dns", "dns"), ("tls", "tls"), ("http", "http")),
    }


def protocol_rows(wide: DataFrame, protocol: str, *carried: str) -> DataFrame:
    """Rows of one protocol table, keyed by ``packet_id``, without surrogate id and insert time; with the ``carried``
    columns of the wide rows."""
    packet = [F.col("_id").alias("packet_id"), *carried]
    if protocol == "dns_header":
        return wide.where(F.col("dns").isNotNull()).select(*packet, "dns.header.*")
    many = {"dns_query": "dns.questions", "dns_response": "dns.records"}
    if protocol in many:
        each = wide.where(F.col("dns").isNotNull()).select(*packet, F.posexplode(many[protocol]).alias("_pos", "_one"))
        return each.select("packet_id", *carried, "_pos", "_one.*")
    if protocol not in PROTOCOL_COLUMNS:
        raise ValueError(f"unknown protocol {protocol!r}")
    return wide.where(F.col(protocol).isNotNull()).select(*packet, f"{protocol}.*")


def protocol_id(protocol: str, packet_id: str = "packet_id", position: str | None = None) -> Column:
    """Surrogate id of a protocol row."""
    return row_id(F.lit(protocol), F.col(packet_id), *([] if position is None else [F.col(position)]))


def protocol_fanout(wide: DataFrame, inserted_at: Column) -> dict[str, DataFrame]:
    """The packet table and the 12 protocol tables, by bronze table name.

    Store ``wide`` once and pass the stored table in: every projection then reads only its own
    columns instead of decoding the frames again. ``inserted_at`` may be a column of ``wide``.
    """
    stamped = wide.withColumn("inserted_at", inserted_at)
    lag = F.col("inserted_at") - F.col("created_at")
    tables = {
        "bronze_network_packet": stamped.select(
            "_id", "interface", "length", "created_at", "inserted_at", lag.alias("brz_ingestion_duration")
        )
    }
    for protocol in PROTOCOL_COLUMNS:
        rows = protocol_rows(stamped, protocol, "inserted_at")
        position = "_pos" if "_pos" in rows.columns else None
        tables[f"bronze_network_{protocol}"] = rows.withColumn("_id", protocol_id(protocol, position=position)).drop("_pos")
    return tables
