"""The 42 tables: layer, key and columns.

Column names are part of the interface: queries written against the tables use them. Types are
Spark's: unsigned integers take the next wider signed type, addresses are canonical text (see
``functions.inet``), lags are day-time intervals and timestamps carry no zone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LAG = "INTERVAL DAY TO SECOND"
_INSERTED = "inserted_at TIMESTAMP_NTZ"
_BRONZE_TIMES = f"created_at TIMESTAMP_NTZ, {_INSERTED}, brz_ingestion_duration {_LAG}"
_SILVER_TIMES = (
    f"created_at TIMESTAMP_NTZ, brz_ingestion_duration {_LAG}, {_INSERTED}, svr_ingestion_duration {_LAG}"
)
_OF_PACKET = f"packet_length BIGINT, interface STRING, {_SILVER_TIMES}"

_PROCESS = "pid BIGINT, ppid BIGINT, uid INT, lstart TIMESTAMP_NTZ, pcpu FLOAT, pmem FLOAT, status STRING, command STRING"
_OPEN_FILE = (
    "command STRING, pid BIGINT, uid INT, fd STRING, type STRING, device STRING, size BIGINT, node STRING, name STRING"
)
_ETHERNET = "source STRING, destination STRING, ether_type INT, payload_length BIGINT"
_ARP = (
    "hardware_type INT, protocol_type INT, hw_addr_len INT, proto_addr_len INT, operation INT, sender_hw_addr STRING, "
    "sender_proto_addr STRING, target_hw_addr STRING, target_proto_addr STRING"
)
_DNS_HEADER = (
    "id INT, is_response INT, opcode INT, is_authoriative INT, is_truncated INT, is_recursion_desirable INT, "
    "is_recursion_available INT, zero_reserved INT, is_answer_authenticated INT, is_non_authenticated_data INT, "
    "rcode INT, query_count INT, response_count INT, authority_rr_count INT, additional_rr_count INT"
)
_DNS_QUERY = "qname ARRAY<SMALLINT>, qtype STRING, qclass STRING"
_DNS_RECORD = (
    "origin INT, name_tag INT, rtype STRING, rclass STRING, ttl BIGINT, rdlength INT, rdata ARRAY<SMALLINT>"
)

# Columns of each decoded protocol layer, without packet_id and inserted_at.
PROTOCOL_COLUMNS = {
    "ethernet": _ETHERNET,
    "ipv4": (
        "version INT, header_length INT, dscp INT, ecn INT, total_length INT, identification INT, flags INT, "
        "fragment_offset INT, ttl INT, next_level_protocol INT, checksum INT, source STRING, destination STRING"
    ),
    "ipv6": (
        "version INT, traffic_class INT, flow_label INT, payload_length INT, next_header INT, hop_limit INT, "
        "source STRING, destination STRING"
    ),
    "arp": _ARP,
    "tcp": (
        "source INT, destination INT, sequence BIGINT, acknowledgement BIGINT, data_offset INT, reserved INT, "
        "flags INT, _window INT, checksum INT, urgent_ptr INT, options STRING"
    ),
    "udp": "source INT, destination INT, length INT, checksum INT",
    "icmp": "version INT, type INT, code INT, checksum INT, payload_length BIGINT",
    "tls": "content_type INT, version INT, length INT",
    "dns_header": _DNS_HEADER,
    "dns_query": _DNS_QUERY,
    "dns_response": _DNS_RECORD,
    "http": (
        "type STRING, method STRING, uri STRING, version STRING, status_code INT, status_text STRING, "
        "headers MAP<STRING, STRING>, body STRING"
    ),
}


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    ddl: str

    @cached_property
    def schema(self) -> StructType:
        """Spark reads the DDL, so a session must be there."""
        return StructType.fromDDL(self.ddl)

    @property
    def layer(self) -> str:
        return self.name.split("_", 1)[0]

    @property
    def expires(self) -> bool:
        """Lookup and technical tables are exempt from retention."""
        return not self.name.startswith("gold_file_") and "_tech_" not in self.name


def _bronze() -> list[tuple[str, str, str]]:
    tables = [
        ("bronze_process_list", "_id", f"_id STRING, {_PROCESS}, {_BRONZE_TIMES}"),
        ("bronze_open_files", "_id", f"_id STRING, {_OPEN_FILE}, {_BRONZE_TIMES}"),
        ("bronze_network_packet", "_id", f"_id STRING, interface STRING, length BIGINT, {_BRONZE_TIMES}"),
        (
            "bronze_network_interface",
            "interface, address",
            "_id STRING, interface STRING, address STRING, netmask STRING, broadcast_address STRING, "
            f"destination_address STRING, {_INSERTED}",
        ),
    ]
    for protocol, columns in PROTOCOL_COLUMNS.items():
        tables.append(
            (f"bronze_network_{protocol}", "_id", f"_id STRING, packet_id STRING, {columns}, {_INSERTED}")
        )
    return tables


def _silver() -> list[tuple[str, str, str]]:
    return [
        ("silver_process_list", "_id", f"_id STRING, {_PROCESS}, {_SILVER_TIMES}, duration {_LAG}"),
        (
            "silver_open_files",
            "_id",
            f"_id STRING, {_OPEN_FILE}, {_SILVER_TIMES}, ip_source_address STRING, ip_source_port STRING, "
            "ip_destination_address STRING, ip_destination_port STRING",
        ),
        (
            "silver_network_packet",
            "_id",
            f"_id STRING, interface STRING, length BIGINT, {_SILVER_TIMES}, data_link STRING, network STRING, "
            "transport STRING, application STRING",
        ),
        (
            "silver_network_interface",
            "_id",
            "_id STRING, interface STRING, address STRING, broadcast_address STRING, destination_address STRING, "
            f"{_INSERTED}, svr_ingestion_duration {_LAG}",
        ),
        ("silver_network_ethernet", "_id", f"_id STRING, {_ETHERNET}, {_OF_PACKET}"),
        (
            "silver_network_dns",
            "_id",
            f"_id STRING, packet_id STRING, {_DNS_HEADER}, {_DNS_QUERY}, {_DNS_RECORD}, {_SILVER_TIMES}, "
            "question_parsed STRING, response_parsed STRING",
        ),
        (
            "silver_network_ip",
            "_id",
            "_id STRING, version INT, length INT, hop_limit INT, next_protocol INT, source STRING, "
            f"destination STRING, {_OF_PACKET}",
        ),
        ("silver_network_transport", "_id", f"_id STRING, protocol STRING, source INT, destination INT, {_OF_PACKET}"),
        ("silver_network_arp", "_id", f"_id STRING, {_ARP}, {_OF_PACKET}"),
    ]


def _gold() -> list[tuple[str, str, str]]:
    seen = f"started_at TIMESTAMP_NTZ, {_INSERTED}"
    socket_key = "pid, source_address, source_port, destination_address, destination_port"
    return [
        ("gold_file_service", "name, port, protocol", f"name STRING, port INT, protocol STRING, {_INSERTED}"),
        ("gold_file_host", "name, address", f"name STRING, address STRING, {_INSERTED}"),
        ("gold_file_user", "name, uid", f"name STRING, uid INT, {_INSERTED}"),
        (
            "gold_dim_process",
            "pid, started_at",
            f"pid BIGINT, ppid BIGINT, uid INT, command STRING, full_command STRING, {seen}",
        ),
        (
            "gold_dim_file_reg",
            "pid, fd, node",
            f"pid BIGINT, uid INT, fd STRING, node STRING, command STRING, name STRING, {seen}",
        ),
        (
            "gold_dim_network_interface",
            "interface, address",
            "_id BIGINT, interface STRING, address STRING, broadcast_address STRING, destination_address STRING, "
            f"network STRING, {seen}",
        ),
        (
            "gold_dim_network_socket",
            socket_key,
            "_id BIGINT, pid BIGINT, uid INT, command STRING, source_address STRING, source_port INT, "
            f"destination_address STRING, destination_port INT, {seen}",
        ),
        ("gold_dim_network_open_port", "pid, port", f"pid BIGINT, uid INT, command STRING, port INT, {seen}"),
        ("gold_dim_network_foreign_ip", "address", f"_id BIGINT, address STRING, domain_name STRING, {seen}"),
        ("gold_dim_network_host", "address", f"_id BIGINT, address STRING, host STRING, {_INSERTED}"),
        (
            "gold_fact_process",
            "pid, started_at, created_at",
            f"pid BIGINT, started_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, pcpu FLOAT, pmem FLOAT, {_INSERTED}",
        ),
        (
            "gold_fact_file_reg",
            "pid, fd, node, created_at",
            f"pid BIGINT, fd STRING, node STRING, created_at TIMESTAMP_NTZ, size BIGINT, {_INSERTED}",
        ),
        (
            "gold_fact_network_packet",
            "_id",
            "_id STRING, interface STRING, length BIGINT, created_at TIMESTAMP_NTZ, data_link STRING, "
            f"network STRING, transport STRING, application STRING, {_INSERTED}",
        ),
        (
            "gold_fact_network_ip",
            "_id",
            "_id STRING, ip_version SMALLINT, transport_protocol STRING, source_address STRING, source_port INT, "
            f"destination_address STRING, destination_port INT, created_at TIMESTAMP_NTZ, {_INSERTED}",
        ),
        (
            "gold_fact_process_network",
            "pid, packet_id, send",
            f"_id BIGINT, pid BIGINT, packet_id STRING, send BOOLEAN, {_INSERTED}",
        ),
        ("gold_tech_table_count", "_id", f"_id INT, name STRING, max_count BIGINT, last_count BIGINT, {_INSERTED}"),
        (
            "gold_tech_chrono",
            "name",
            "name STRING, brz_max_ingest DOUBLE, brz_min_ingest DOUBLE, svr_max_ingest DOUBLE, svr_min_ingest DOUBLE, "
            f"max_ingest DOUBLE, min_ingest DOUBLE, {_INSERTED}",
        ),
    ]


TABLES: dict[str, Table] = {
    name: Table(name, tuple(k.strip() for k in key.split(",")), ddl)
    for name, key, ddl in _bronze() + _silver() + _gold()
}


def tables_of(layer: str) -> list[Table]:
    return [t for t in TABLES.values() if t.layer == layer]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].schema)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in their declared order and type; columns ``df`` lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].schema.fields
        ]
    )
