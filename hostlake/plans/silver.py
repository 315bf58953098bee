"""Silver: enrichment of bronze tables.

Each function takes bronze DataFrames and ``as_of`` and returns the rows of one silver table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.functions.clock import AsOf, as_of_column
from hostlake.functions.inet import inet
from hostlake.functions.names import (
    dns_question_text,
    dns_record_text,
    socket_side,
    source_host,
    without_brackets,
)
from hostlake.operators.packets import layer_labels, protocol_id

# Bits of the layer mask of a packet, in order of precedence inside each layer.
_LAYER_BITS = {
    "data_link": {"ethernet": 0},
    "network": {"ipv4": 1, "ipv6": 2, "arp": 3},
    "transport": {"tcp": 4, "udp": 5, "icmp": 6},
    "application": {"dns": 7, "tls": 8, "http": 9},
}
_TABLE_OF_LABEL = {"dns": "dns_header"}
# Packet columns that enriched protocol rows carry.
_FROM_PACKET = ["packet_length", "interface", "created_at", "brz_ingestion_duration"]


def _refreshed(as_of: AsOf, bronze_inserted: str = "inserted_at") -> list[Column]:
    now = as_of_column(as_of)
    return [now.alias("inserted_at"), (now - F.col(bronze_inserted)).alias("svr_ingestion_duration")]


def silver_process_list(bronze: DataFrame, as_of: AsOf) -> DataFrame:
    kept = [c for c in bronze.columns if c != "inserted_at"]
    age = (F.col("created_at") - F.col("lstart")).alias("duration")
    return bronze.select(*kept, age, *_refreshed(as_of))


def silver_open_files(bronze: DataFrame, as_of: AsOf) -> DataFrame:
    kept = [c for c in bronze.columns if c != "inserted_at"]
    source, source_port = socket_side(F.col("name"), 1)
    destination, destination_port = socket_side(F.col("name"), 2)
    return bronze.select(
        *kept,
        source_host(source).alias("ip_source_address"),
        source_port.alias("ip_source_port"),
        without_brackets(destination).alias("ip_destination_address"),
        destination_port.alias("ip_destination_port"),
        *_refreshed(as_of),
    )


def silver_network_packet(packets: DataFrame, protocols: dict[str, DataFrame], as_of: AsOf) -> DataFrame:
    """Layer labels of packets out of the ten protocol tables.

    The protocol tables are reduced to one bit mask per packet in a single aggregate over their
    union (only ``packet_id`` is read), which is then joined once.
    """
    presence = []
    for labels in _LAYER_BITS.values():
        for label, bit in labels.items():
            rows = protocols[_TABLE_OF_LABEL.get(label, label)]
            presence.append(rows.select(F.col("packet_id").alias("_id"), F.lit(1 << bit).alias("_mask")))
    masks = reduce(DataFrame.unionAll, presence).groupBy("_id").agg(F.bit_or("_mask").alias("_mask"))

    def label_of(layer: str) -> Column:
        return F.coalesce(
            *[
                F.when(F.col("_mask").bitwiseAND(1 << bit) != 0, F.lit(label))
                for label, bit in _LAYER_BITS[layer].items()
            ]
        ).alias(layer)

    return packets.join(masks, "_id", "left").select(
        "_id", "interface", "length", "created_at", "brz_ingestion_duration",
        *[label_of(layer) for layer in _LAYER_BITS],
        *_refreshed(as_of),
    )


def silver_network_interface(interfaces: DataFrame, as_of: AsOf) -> DataFrame:
    """Typed addresses; an interface without netmask has no typed address."""
    return interfaces.select(
        "_id",
        "interface",
        inet(F.concat("address", "netmask")).alias("address"),
        inet(F.col("broadcast_address")).alias("broadcast_address"),
        inet(F.col("destination_address")).alias("destination_address"),
        *_refreshed(as_of),
    )


def _with_packet(rows: DataFrame, packets: DataFrame, as_of: AsOf, on: str = "_id") -> DataFrame:
    """``rows`` (keyed by packet id in column ``on``) with the columns of their packet."""
    packet = packets.select(
        F.col("_id").alias(on),
        F.col("length").alias("packet_length"),
        F.col("interface"),
        F.col("created_at"),
        F.col("brz_ingestion_duration"),
        F.col("inserted_at").alias("_packet_inserted"),
    )
    joined = rows.join(packet, on, "left")
    return joined.select(*rows.columns, *_FROM_PACKET, *_refreshed(as_of, "_packet_inserted"))


def _keyed_by_packet(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("packet_id").alias("_id"), *columns)


def _ethernet_rows(ethernet: DataFrame) -> DataFrame:
    return _keyed_by_packet(ethernet, "source", "destination", "ether_type", "payload_length")


def _ip_rows(ipv4: DataFrame, ipv6: DataFrame) -> DataFrame:
    v4 = ipv4.select(
        F.col("packet_id").alias("_id"),
        "version",
        F.col("total_length").alias("length"),
        F.col("ttl").alias("hop_limit"),
        F.col("next_level_protocol").alias("next_protocol"),
        "source",
        "destination",
    )
    v6 = ipv6.select(
        F.col("packet_id").alias("_id"),
        "version",
        F.col("payload_length").alias("length"),
        "hop_limit",
        F.col("next_header").alias("next_protocol"),
        "source",
        "destination",
    )
    both = v4.unionByName(v6)
    return both.withColumns({side: inet(F.col(side)) for side in ("source", "destination")})


def _transport_rows(tcp: DataFrame, udp: DataFrame) -> DataFrame:
    def side(rows: DataFrame, protocol: str) -> DataFrame:
        return rows.select(
            F.col("packet_id").alias("_id"), F.lit(protocol).alias("protocol"), "source", "destination"
        )

    return side(tcp, "TCP").unionByName(side(udp, "UDP"))


_ARP_COLUMNS = (
    "hardware_type", "protocol_type", "hw_addr_len", "proto_addr_len", "operation",
    "sender_hw_addr", "sender_proto_addr", "target_hw_addr", "target_proto_addr",
)


def silver_network_ethernet(ethernet: DataFrame, packets: DataFrame, as_of: AsOf) -> DataFrame:
    return _with_packet(_ethernet_rows(ethernet), packets, as_of)


def silver_network_ip(ipv4: DataFrame, ipv6: DataFrame, packets: DataFrame, as_of: AsOf) -> DataFrame:
    return _with_packet(_ip_rows(ipv4, ipv6), packets, as_of)


def silver_network_transport(tcp: DataFrame, udp: DataFrame, packets: DataFrame, as_of: AsOf) -> DataFrame:
    return _with_packet(_transport_rows(tcp, udp), packets, as_of)


def silver_network_arp(arp: DataFrame, packets: DataFrame, as_of: AsOf) -> DataFrame:
    return _with_packet(_keyed_by_packet(arp, *_ARP_COLUMNS), packets, as_of)


def silver_network_dns(
    headers: DataFrame, queries: DataFrame, responses: DataFrame, packets: DataFrame, as_of: AsOf,
    own_record_end: bool = False,
) -> DataFrame:
    """Header with every question and every record of its message.

    All pairs of one message are the rows asked for; a message is one datagram, which bounds them.
    ``own_record_end`` lets the text of record data end at the record's own length.
    """
    questions = queries.select("packet_id", F.col("_id").alias("_query_id"), "qname", "qtype", "qclass")
    records = responses.select(
        "packet_id", F.col("_id").alias("_record_id"),
        "origin", "name_tag", "rtype", "rclass", "ttl", "rdlength", "rdata",
    )
    head = headers.drop("inserted_at").withColumnRenamed("_id", "_header_id")
    flat = head.join(questions, "packet_id", "left").join(records, "packet_id", "left")
    parsed = flat.withColumns(
        {
            "_id": F.concat_ws(
                "-", *[F.col(c).cast("string") for c in ("_header_id", "_query_id", "_record_id")]
            ),
            "question_parsed": dns_question_text(F.col("qname")),
            "response_parsed": dns_record_text(
                F.col("rdata"), F.col("rtype"), F.col("rclass"), F.col("qname"),
                F.size("rdata") if own_record_end else None,
            ),
        }
    ).drop("_header_id", "_query_id", "_record_id")
    enriched = _with_packet(parsed, packets, as_of, on="packet_id")
    return enriched.drop("packet_length", "interface")


def refresh_silver(bronze: dict[str, DataFrame], as_of: AsOf) -> dict[str, DataFrame]:
    """All nine silver tables out of the bronze tables, keyed by table name."""
    net = {name.removeprefix("bronze_network_"): df for name, df in bronze.items() if "_network_" in name}
    packets = net["packet"]
    return {
        "silver_process_list": silver_process_list(bronze["bronze_process_list"], as_of),
        "silver_open_files": silver_open_files(bronze["bronze_open_files"], as_of),
        "silver_network_packet": silver_network_packet(packets, net, as_of),
        "silver_network_interface": silver_network_interface(net["interface"], as_of),
        "silver_network_ethernet": silver_network_ethernet(net["ethernet"], packets, as_of),
        "silver_network_dns": silver_network_dns(
            net["dns_header"], net["dns_query"], net["dns_response"], packets, as_of
        ),
        "silver_network_ip": silver_network_ip(net["ipv4"], net["ipv6"], packets, as_of),
        "silver_network_transport": silver_network_transport(net["tcp"], net["udp"], packets, as_of),
        "silver_network_arp": silver_network_arp(net["arp"], packets, as_of),
    }


def silver_from_decoded(wide: DataFrame, inserted_at: Column, as_of: AsOf) -> dict[str, DataFrame]:
    """Packet, Ethernet, IP, transport, ARP and DNS tables straight from decoded rows, without any join.

    ``wide`` is the output of ``decode_packets`` (stored once); ``inserted_at`` is when it was
    stored. Gives the same rows as the bronze tables do.
    """
    now = as_of_column(as_of)
    stamped = wide.withColumns({"_inserted": inserted_at, "_lag": inserted_at - F.col("created_at")})
    times = [
        F.col("created_at"),
        F.col("_lag").alias("brz_ingestion_duration"),
        now.alias("inserted_at"),
        (now - F.col("_inserted")).alias("svr_ingestion_duration"),
    ]
    of_packet = [F.col("length").alias("packet_length"), F.col("interface"), *times]

    def layer(protocols: list[str], shape) -> DataFrame:
        present = reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in protocols])
        return stamped.where(present).select("_id", *shape, *of_packet)

    def of(protocol: str, *columns: str) -> list[Column]:
        return [F.col(f"{protocol}.{c}").alias(c) for c in columns]

    def either(first: str, second: str, name: str) -> Column:
        return F.coalesce(F.col(first), F.col(second)).alias(name)

    return {
        "silver_network_packet": stamped.select(
            "_id", "interface", "length", *times,
            *[label.alias(name) for name, label in layer_labels(stamped).items()],
        ),
        "silver_network_ethernet": layer(
            ["ethernet"], of("ethernet", "source", "destination", "ether_type", "payload_length")
        ),
        "silver_network_ip": layer(
            ["ipv4", "ipv6"],
            [
                either("ipv4.version", "ipv6.version", "version"),
                either("ipv4.total_length", "ipv6.payload_length", "length"),
                either("ipv4.ttl", "ipv6.hop_limit", "hop_limit"),
                either("ipv4.next_level_protocol", "ipv6.next_header", "next_protocol"),
                # Decoded addresses are canonical already.
                either("ipv4.source", "ipv6.source", "source"),
                either("ipv4.destination", "ipv6.destination", "destination"),
            ],
        ),
        "silver_network_transport": layer(
            ["tcp", "udp"],
            [
                F.when(F.col("tcp").isNotNull(), "TCP").otherwise("UDP").alias("protocol"),
                either("tcp.source", "udp.source", "source"),
                either("tcp.destination", "udp.destination", "destination"),
            ],
        ),
        "silver_network_arp": layer(["arp"], of("arp", *_ARP_COLUMNS)),
        "silver_network_dns": _dns_from_decoded(stamped, times),
    }


def dns_messages(wide: DataFrame, *carried: Column | str) -> DataFrame:
    """One row for each DNS message: header columns, and its questions and records as arrays."""
    return wide.where(F.col("dns").isNotNull()).select(
        F.col("_id").alias("packet_id"), "dns.header.*", F.col("dns.questions").alias("questions"), F.col("dns.records").alias("records"), *carried
    )


def _dns_from_decoded(stamped: DataFrame, times: list[Column]) -> DataFrame:
    """All pairs of a message's questions and records, exploded where they stand."""
    asked = dns_messages(stamped, *times).select("*", F.posexplode_outer("questions").alias("_q", "_question"))
    flat = asked.select("*", F.posexplode_outer("records").alias("_r", "_record")).drop("questions", "records").select("*", "_question.*", "_record.*")
    ids = [
        protocol_id("dns_header"),
        F.when(F.col("_q").isNotNull(), protocol_id("dns_query", position="_q")),
        F.when(F.col("_r").isNotNull(), protocol_id("dns_response", position="_r")),
    ]
    return flat.withColumns(
        {
            "_id": F.concat_ws("-", *ids),
            "question_parsed": dns_question_text(F.col("qname")),
            "response_parsed": dns_record_text(F.col("rdata"), F.col("rtype"), F.col("rclass"), F.col("qname"), None),
        }
    ).drop("_q", "_question", "_r", "_record")
