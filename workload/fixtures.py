"""Telemetry tables as SQL over the test tables, in text that Spark and DuckDB both run.

``{name}`` stands for another fixture or for a test table. Every fixture covers its whole source
table; which protocols a packet carries follows from the priority, status and customer of its order.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from hostlake.schemas import PROTOCOL_COLUMNS

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "1998-01-01 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def _hex(value: str, digits: int) -> str:
    return f"lpad(lower(hex(CAST({value} AS BIGINT))), {digits}, '0')"


# One row per order: which layers its packet has and the values of their fields.
_WIRE = f"""
SELECT packet_id, peer, interface, created_at, net,
 CASE WHEN net IN ('ipv4', 'ipv6') THEN tp END AS tp,
 CASE WHEN net NOT IN ('ipv4', 'ipv6') THEN NULL
      WHEN tp = 'tcp' AND peer % 4 = 0 THEN 'tls' WHEN tp = 'tcp' AND peer % 4 = 1 THEN 'get'
      WHEN tp = 'tcp' AND peer % 4 = 2 THEN 'reply' WHEN tp = 'tcp' THEN 'opaque'
      WHEN tp = 'udp' AND peer % 5 = 0 THEN 'opaque' WHEN tp = 'udp' THEN 'dns' END AS app,
 CAST(1024 + peer % 50 AS INT) AS sport, CAST(packet_id % 3 AS INT) AS answers,
 CASE WHEN tp = 'udp' THEN 53 WHEN peer % 2 = 0 THEN 443 ELSE 80 END AS dport,
 CAST(peer % 4 AS INT) AS s3, CAST(peer % 200 AS INT) AS s4,
 CAST(CASE WHEN packet_id % 5 = 0 THEN 10 ELSE 192 END AS INT) AS d1,
 CAST(CASE WHEN packet_id % 5 = 0 THEN 0 ELSE 168 END AS INT) AS d2,
 CAST(CASE WHEN packet_id % 5 = 0 THEN packet_id % 4 ELSE peer % 3 END AS INT) AS d3,
 CAST(CASE WHEN packet_id % 5 = 0 THEN packet_id % 200 ELSE packet_id % 250 END AS INT) AS d4
FROM (SELECT o_orderkey AS packet_id, o_custkey AS peer, concat('eth', CAST(o_custkey % 3 AS STRING)) AS interface,
 o_orderdate AS created_at,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'ipv4'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ipv6'
      WHEN o_orderstatus = 'F' THEN 'arp' WHEN o_orderstatus = 'O' THEN 'lldp' ELSE 'runt' END AS net,
 CASE WHEN o_orderstatus = 'F' THEN 'tcp' WHEN o_orderstatus = 'O' THEN 'udp'
      WHEN o_custkey % 7 = 0 THEN 'igmp' ELSE 'icmp' END AS tp
 FROM {{orders}}) o
"""

# Application payloads, transport segments and whole frames as hex text, built from the inside out.
_DNS_HEX = (
    f"concat({_hex('packet_id % 65536', 4)}, '8180', '0001', {_hex('answers', 4)}, '0001', '0001',"
    f" '05', hex(concat('host', CAST(peer % 10 AS STRING))), '03', hex('com'), '00', '0001', '0001',"
    f" repeat(concat('c00c00010001', '0000003c', '0004', '0a00', {_hex('s3', 2)}, {_hex('s4', 2)}),"
    f" answers),"
    f" 'c00c00020001', '00000e10', '0004', '026e73', '00',"
    f" 'c00c001c0001', '00000e10', '0010', 'fe80', repeat('00', 12), {_hex('packet_id % 65536', 4)})"
)
_PAYLOAD = f"""
SELECT *, CASE app
  WHEN 'tls' THEN concat('16030300', '05', '0102030405')
  WHEN 'get' THEN hex(concat('GET /p/', CAST(peer AS STRING), ' HTTP/1.1', chr(13), chr(10), 'Host: h',
    CAST(peer % 10 AS STRING), '.example', chr(13), chr(10), 'X-Id:  ', CAST(packet_id AS STRING), ' ', chr(13), chr(10), chr(13), chr(10)))
  WHEN 'reply' THEN hex(concat('HTTP/1.1 404 Not  Found', chr(13), chr(10), 'Server: s', chr(13), chr(10), 'Server: t',
    CAST(peer % 3 AS STRING), chr(13), chr(10), chr(13), chr(10), 'body ', CAST(packet_id AS STRING), chr(13), chr(10), chr(13), chr(10), 'end'))
  WHEN 'dns' THEN {_DNS_HEX}
  WHEN 'opaque' THEN concat('ff00fe', {_hex('packet_id', 8)}) ELSE '' END AS app_hex
FROM {{wire}}
"""
_FRAME_PARTS = f"""
SELECT *, CASE tp
  WHEN 'tcp' THEN concat({_hex('sport', 4)}, {_hex('dport', 4)}, {_hex('packet_id', 8)}, '00000001', '7', '0', '12', 'ffff', '0000', '0000',
    '0204', '05b4', '0101', '0402', app_hex)
  WHEN 'udp' THEN concat({_hex('sport', 4)}, {_hex('dport', 4)}, {_hex('8 + length(app_hex) / 2', 4)}, 'beef', app_hex)
  WHEN 'icmp' THEN concat(CASE WHEN net = 'ipv6' THEN '80' ELSE '08' END, '00', 'abcd', {_hex('packet_id', 8)})
  ELSE '11640000e0000001' END AS tp_hex
FROM {{payload}}
"""
_PROTO = (
    "CASE tp WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'igmp' THEN 2 ELSE CASE WHEN net = 'ipv6' THEN 58 ELSE 1 END END"
)
_FRAMES = f"""
SELECT packet_id, interface, created_at, unhex(CASE WHEN net = 'runt' THEN '0200000000' ELSE
 concat('0200000000fe', '0200000000', {_hex('peer % 256', 2)},
  CASE net WHEN 'ipv4' THEN '0800' WHEN 'ipv6' THEN '86dd' WHEN 'arp' THEN '0806' ELSE '88cc' END,
  CASE net
   WHEN 'ipv4' THEN concat('45', '29', {_hex('20 + length(tp_hex) / 2', 4)}, {_hex('packet_id % 65536', 4)}, '4001', '40',
     {_hex(_PROTO, 2)}, 'c0de', '0a00', {_hex('s3', 2)}, {_hex('s4', 2)}, {_hex('d1', 2)}, {_hex('d2', 2)}, {_hex('d3', 2)}, {_hex('d4', 2)}, tp_hex,
     'aaaaaaaa')
   WHEN 'ipv6' THEN concat('6a5', {_hex('packet_id % 65536', 5)}, {_hex('length(tp_hex) / 2', 4)}, {_hex(_PROTO, 2)}, '40',
     'fe80', repeat('00', 12), {_hex('peer % 9 + 1', 4)}, 'ff02', repeat('00', 12), '00fb', tp_hex)
   WHEN 'arp' THEN concat('00010800', '0604', {_hex('1 + packet_id % 2', 4)}, '0200000000', {_hex('peer % 256', 2)},
     '0a00', {_hex('s3', 2)}, {_hex('s4', 2)}, '0200000000fe', '0a00', '00', 'fe')
   ELSE '0207' END) END) AS frame FROM {{frame_parts}}
"""

_APP_LENGTH = "CAST(length(app_hex) / 2 AS BIGINT)"
_TP_LENGTH = "CAST(length(tp_hex) / 2 AS BIGINT)"

FIXTURES: dict[str, str] = {
    "wire": _WIRE,
    "payload": _PAYLOAD,
    "frame_parts": _FRAME_PARTS,
    "frames": _FRAMES,
    # Bronze tables of the same packets, stated by construction rather than decoded.
    "packet": f"""
SELECT packet_id AS _id, interface,
 CAST(CASE net WHEN 'runt' THEN 5 WHEN 'lldp' THEN 16 WHEN 'arp' THEN 42 WHEN 'ipv4' THEN 38 + {_TP_LENGTH}
  ELSE 54 + {_TP_LENGTH} END AS BIGINT) AS length,
 created_at, created_at + INTERVAL '1' SECOND AS inserted_at, INTERVAL '1' SECOND AS brz_ingestion_duration FROM {{frame_parts}}""",
    "ethernet": f"""
SELECT packet_id AS _id, packet_id, concat('02:00:00:00:00:', {_hex('peer % 256', 2)}) AS source, '02:00:00:00:00:fe' AS destination,
 CASE net WHEN 'ipv4' THEN 2048 WHEN 'ipv6' THEN 34525 WHEN 'arp' THEN 2054 ELSE 35020 END AS ether_type,
 CAST(CASE net WHEN 'lldp' THEN 2 WHEN 'arp' THEN 28 WHEN 'ipv4' THEN 24 + {_TP_LENGTH} ELSE 40 + {_TP_LENGTH} END AS BIGINT) AS payload_length
 FROM {{frame_parts}} WHERE net <> 'runt'""",
    "ipv4": f"""
SELECT packet_id AS _id, packet_id, 4 AS version, 5 AS header_length, 10 AS dscp, 1 AS ecn, CAST(20 + {_TP_LENGTH} AS INT) AS total_length,
 CAST(packet_id % 65536 AS INT) AS identification, 2 AS flags, 1 AS fragment_offset, 64 AS ttl, {_PROTO} AS next_level_protocol, 49374 AS checksum,
 concat('10.0.', CAST(s3 AS STRING), '.', CAST(s4 AS STRING)) AS source,
 concat(CAST(d1 AS STRING), '.', CAST(d2 AS STRING), '.', CAST(d3 AS STRING), '.', CAST(d4 AS STRING)) AS destination
 FROM {{frame_parts}} WHERE net = 'ipv4'""",
    "ipv6": f"""
SELECT packet_id AS _id, packet_id, 6 AS version, 165 AS traffic_class, CAST(packet_id % 65536 AS INT) AS flow_label, CAST({_TP_LENGTH} AS INT) AS payload_length,
 {_PROTO} AS next_header, 64 AS hop_limit, concat('fe80::', lower(hex(CAST(peer % 9 + 1 AS BIGINT)))) AS source, 'ff02::fb' AS destination
 FROM {{frame_parts}} WHERE net = 'ipv6'""",
    "arp": f"""
SELECT packet_id AS _id, packet_id, 1 AS hardware_type, 2048 AS protocol_type, 6 AS hw_addr_len, 4 AS proto_addr_len,
 CAST(1 + packet_id % 2 AS INT) AS operation, concat('02:00:00:00:00:', {_hex('peer % 256', 2)}) AS sender_hw_addr,
 concat('10.0.', CAST(s3 AS STRING), '.', CAST(s4 AS STRING)) AS sender_proto_addr,
 '02:00:00:00:00:fe' AS target_hw_addr, '10.0.0.254' AS target_proto_addr FROM {{wire}} WHERE net = 'arp'""",
    "tcp": f"""
SELECT packet_id AS _id, packet_id, sport AS source, dport AS destination, packet_id AS sequence, CAST(1 AS BIGINT) AS acknowledgement, 7 AS data_offset, 0 AS reserved,
 18 AS flags, 65535 AS _window, 0 AS checksum, 0 AS urgent_ptr, '020405b401010402' AS options FROM {{wire}} WHERE tp = 'tcp'""",
    "udp": f"""
SELECT packet_id AS _id, packet_id, sport AS source, dport AS destination, CAST(8 + {_APP_LENGTH} AS INT) AS length, 48879 AS checksum
 FROM {{payload}} WHERE tp = 'udp'""",
    "icmp": """
SELECT packet_id AS _id, packet_id, CASE WHEN net = 'ipv6' THEN 6 ELSE 4 END AS version, CASE WHEN net = 'ipv6' THEN 128 ELSE 8 END AS type,
 0 AS code, 43981 AS checksum, CAST(4 AS BIGINT) AS payload_length FROM {wire} WHERE tp = 'icmp'""",
    "tls": "SELECT packet_id AS _id, packet_id, 22 AS content_type, 771 AS version, 5 AS length FROM {wire} WHERE app = 'tls'",
    "http": """
SELECT packet_id AS _id, packet_id, CASE app WHEN 'get' THEN 'request' ELSE 'response' END AS type, CASE WHEN app = 'get' THEN 'get' END AS method,
 CASE WHEN app = 'get' THEN concat('/p/', CAST(peer AS STRING)) END AS uri, 'HTTP/1.1' AS version,
 CASE WHEN app = 'reply' THEN 404 END AS status_code, CASE WHEN app = 'reply' THEN 'Not Found' END AS status_text,
 CASE WHEN app = 'get' THEN concat('h', CAST(peer % 10 AS STRING), '.example') END AS header_host,
 CASE WHEN app = 'get' THEN CAST(packet_id AS STRING) END AS header_id,
 CASE WHEN app = 'reply' THEN concat('t', CAST(peer % 3 AS STRING)) END AS header_server,
 CASE WHEN app = 'get' THEN '' ELSE concat('body ', CAST(packet_id AS STRING), chr(13), chr(10), chr(13), chr(10), 'end') END AS body
 FROM {wire} WHERE app IN ('get', 'reply')""",
    "dns_header": """
SELECT packet_id * 3 AS _id, packet_id, CAST(packet_id % 65536 AS INT) AS id, 1 AS is_response, 0 AS opcode, 0 AS is_authoriative, 0 AS is_truncated,
 1 AS is_recursion_desirable, 1 AS is_recursion_available, 0 AS zero_reserved, 0 AS is_answer_authenticated, 0 AS is_non_authenticated_data, 0 AS rcode,
 1 AS query_count, answers AS response_count, 1 AS authority_rr_count, 1 AS additional_rr_count FROM {wire} WHERE app = 'dns'""",
    "dns_question_text": """
SELECT packet_id * 5 AS _id, packet_id, concat('host', CAST(peer % 10 AS STRING)) AS label, 'A' AS qtype, 'IN' AS qclass FROM {wire} WHERE app = 'dns'""",
    # Up to two answers (as many as announced), then one name server and one IPv6 record per message.
    "dns_record_numbers": """
SELECT packet_id * 100 + 1 AS _id, packet_id, 1 AS n, 0 AS origin, 49164 AS name_tag, 'A' AS rtype, 'IN' AS rclass, CAST(60 AS BIGINT) AS ttl, 4 AS rdlength, s3, s4
 FROM {wire} WHERE app = 'dns' AND answers >= 1
UNION ALL SELECT packet_id * 100 + 2, packet_id, 2, 0, 49164, 'A', 'IN', CAST(60 AS BIGINT), 4, s3, s4 FROM {wire} WHERE app = 'dns' AND answers >= 2
UNION ALL SELECT packet_id * 100 + 50, packet_id, 50, 2, 49164, 'NS', 'IN', CAST(3600 AS BIGINT), 4, s3, s4 FROM {wire} WHERE app = 'dns'
UNION ALL SELECT packet_id * 100 + 60, packet_id, 60, 1, 49164, 'AAAA', 'IN', CAST(3600 AS BIGINT), 16, s3, s4 FROM {wire} WHERE app = 'dns'""",
    "interface_device": """
SELECT concat('eth', CAST(s_suppkey % 3 AS STRING)) AS interface,
 CASE WHEN s_nationkey = 7 THEN concat('fe80::', lower(hex(s_suppkey % 9 + 1))) ELSE concat('10.0.', CAST(s_suppkey % 4 AS STRING), '.', CAST(s_suppkey % 200 AS STRING)) END AS address,
 CASE WHEN s_nationkey = 3 THEN NULL WHEN s_nationkey = 7 THEN 'ffff:ffff:ffff:ffff::' WHEN s_nationkey % 2 = 0 THEN '255.255.255.0' ELSE '255.255.240.0' END AS netmask,
 CASE WHEN s_nationkey % 4 = 0 THEN concat('10.0.', CAST(s_suppkey % 4 AS STRING), '.255') END AS broadcast_address,
 CASE WHEN s_nationkey % 5 = 1 THEN concat('10.9.', CAST(s_suppkey % 4 AS STRING), '.1') END AS destination_address FROM {supplier}""",
    "interface": f"""
SELECT concat(interface, '|', address) AS _id, interface, address,
 min(CASE netmask WHEN '255.255.255.0' THEN '/24' WHEN '255.255.240.0' THEN '/20' WHEN 'ffff:ffff:ffff:ffff::' THEN '/64' END) AS netmask,
 min(broadcast_address) AS broadcast_address, min(destination_address) AS destination_address, {AS_OF_SQL} - INTERVAL '5' SECOND AS inserted_at
 FROM {{interface_device}} GROUP BY interface, address""",
    # Names repeat in upper case for another protocol, some with another port.
    "service": """
SELECT concat('svc', CAST(p_partkey AS STRING)) AS name, CAST(7000 + p_partkey % 50000 AS INT) AS port, 'tcp' AS protocol FROM {part}
UNION ALL SELECT concat('SVC', CAST(p_partkey AS STRING)) AS name, CAST(7000 + p_partkey % 50000 + p_size % 2 AS INT) AS port, 'udp' AS protocol FROM {part} WHERE p_type = 'ECONOMY'""",
    "host": "SELECT concat('Host', CAST(n_nationkey AS STRING)) AS name, concat('172.16.0.', CAST(n_nationkey AS STRING)) AS address FROM {nation}",
    "user": "SELECT c_name AS name, CAST(c_custkey AS INT) AS uid FROM {customer}",
    "process_row": """
SELECT user_id AS pid, user_id % 10 AS ppid, CAST(user_id % 5 AS INT) AS uid, CAST(date_trunc('day', ts) AS TIMESTAMP{ntz}) AS lstart,
 value AS pcpu, value / 2 AS pmem, CASE WHEN event_type = 'error' THEN 'Z' ELSE 'S' END AS status,
 concat('/usr/bin/', event_type, ' -u ''', CAST(user_id AS STRING), '''') AS command, ts AS created_at, event_id FROM {events}""",
    "process_list": """
SELECT event_id AS _id, pid, ppid, uid, lstart, pcpu, pmem, status, replace(command, '''', '"') AS command, created_at,
 created_at + INTERVAL '2' SECOND AS inserted_at, INTERVAL '2' SECOND AS brz_ingestion_duration FROM {process_row}""",
    "open_file_row": """
SELECT DISTINCT concat('cmd''', CAST(l_suppkey % 7 AS STRING)) AS command, l_suppkey AS pid, CAST(l_suppkey % 5 AS INT) AS uid,
 concat(CAST(l_linenumber AS STRING), 'u') AS fd, CASE l_returnflag WHEN 'A' THEN 'IPv4' WHEN 'R' THEN 'IPv6' ELSE 'REG' END AS type, '0x1' AS device,
 CAST(floor(l_quantity) AS BIGINT) AS size, CAST(l_partkey AS STRING) AS node,
 CASE l_returnflag
  WHEN 'A' THEN concat(CASE WHEN l_partkey % 11 = 0 THEN '*' WHEN l_partkey % 11 = 1 THEN concat('host', CAST(l_partkey % 30 AS STRING))
       WHEN l_partkey % 11 = 2 THEN 'fe80-0-0-0-1-2-3-4.local' ELSE concat('10.0.', CAST(l_suppkey % 4 AS STRING), '.', CAST(l_partkey % 200 AS STRING)) END, ':',
       CASE WHEN l_partkey % 3 = 0 THEN concat('svc', CAST(l_partkey % 20 AS STRING)) ELSE CAST(1024 + l_partkey % 50 AS STRING) END,
       CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE concat('->host', CAST(l_partkey % 30 AS STRING), ':443') END)
  WHEN 'R' THEN concat('[fe80::', CAST(l_suppkey % 9 + 1 AS STRING), ']:',
       CASE WHEN l_partkey % 5 = 0 THEN '*' ELSE CAST(1024 + l_partkey % 50 AS STRING) END,
       CASE WHEN l_linenumber % 4 = 1 THEN '->[2001:db8::1]:https' ELSE '' END)
  ELSE concat('/data/', CAST(l_partkey AS STRING), ' it''s') END AS name,
 l_shipdate AS created_at FROM {lineitem}""",
    "open_files": """
SELECT md5(concat(CAST(pid AS STRING), fd, type, node, name, CAST(size AS STRING), CAST(created_at AS STRING))) AS _id,
 replace(command, '''', '"') AS command, pid, uid, fd, type, device, size, node, replace(name, '''', '"') AS name, created_at,
 created_at + INTERVAL '3' SECOND AS inserted_at, INTERVAL '3' SECOND AS brz_ingestion_duration FROM {open_file_row}""",
    # Raw text as the tools print it.
    "raw_process": """
SELECT concat('  ', CAST(user_id AS STRING), '   ', CAST(user_id % 10 AS STRING), ' ', CAST(user_id % 5 AS STRING),
 ' Tue Aug  1 08:01:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ' 2023  0.5  ', CAST(event_id % 100 AS STRING), '.25 Ss   /usr/bin/', event_type, '   -k ', CAST(event_id AS STRING)) AS line FROM {events}
UNION ALL SELECT '  PID  PPID   UID                          STARTED %CPU %MEM STAT COMMAND' AS line FROM {region}""",
    "raw_open_files": """
SELECT l_orderkey, l_linenumber, concat('p', CAST(l_suppkey AS STRING), chr(10), 'ccmd', CAST(l_suppkey % 7 AS STRING), chr(10), 'u', CAST(l_suppkey % 5 AS STRING), chr(10),
 'fcwd', chr(10), 'tDIR', chr(10), 'D0x1', chr(10), 's640', chr(10), 'i2', chr(10), 'n/', chr(10),
 'f', CAST(l_linenumber AS STRING), 'u', chr(10), 'tIPv4', chr(10), 'n10.0.0.1:', CAST(1024 + l_partkey % 50 AS STRING), chr(10),
 'p', CAST(l_partkey AS STRING), chr(10), 'cother', chr(10), 'u0', chr(10), 'ftxt', chr(10), 's', CAST(l_orderkey AS STRING), chr(10), 'n/bin/x y', chr(10)) AS listing FROM {lineitem}""",
    "raw_hosts": """
SELECT CASE WHEN n_regionkey = 0 THEN '# skip me' WHEN n_regionkey = 1 THEN '10.1.1.1' ELSE
 concat('172.16.0.', CAST(n_nationkey % 20 AS STRING), chr(9), lower(n_name), '  alias', CAST(n_nationkey % 3 AS STRING), ' #x') END AS line FROM {nation}""",
    "raw_services": """
SELECT CASE WHEN p_size = 1 THEN '# comment' WHEN p_size = 2 THEN 'bad eighty/tcp'
 ELSE concat('svc-', CAST(p_partkey % 1000 AS STRING), '   ', CAST(1000 + p_partkey % 1000 AS STRING), '/tcp  # x') END AS line FROM {part}""",
    "raw_users": """
SELECT CASE WHEN c_nationkey = 0 THEN '# comment' WHEN c_nationkey = 1 THEN '' ELSE
 concat(lower(c_name), ':x:', CAST(c_custkey AS STRING), ':100:Full Name:/home/', CAST(c_custkey AS STRING), ':/bin/sh') END AS line FROM {customer}""",
    "raw_users_listing": "SELECT concat('_', lower(c_mktsegment), '  user ', CAST(c_custkey % 7 AS STRING), '      ', CAST(c_custkey AS STRING)) AS line FROM {customer}",
}



def _within(day: str, part: str) -> str:
    """A time on one of three days."""
    clock = f"lpad(CAST({part} % 20 AS STRING), 2, '0'), ':', lpad(CAST({part} % 60 AS STRING), 2, '0'), ':', lpad(CAST({part} % 60 AS STRING), 2, '0')"
    return f"CAST(concat('2024-01-0', CAST(1 + {day} % 3 AS STRING), ' ', {clock}) AS TIMESTAMP{{ntz}})"


# The test tables with the times of three days, so that telemetry can be loaded and refreshed day by day.
THREE_DAYS = {
    "orders": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, {_within('o_orderkey', 'o_orderkey')} AS o_orderdate FROM {{orders}}",
    "lineitem": f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, {_within('l_orderkey', 'l_partkey')} AS l_shipdate FROM {{lineitem}}""",
    "events": f"SELECT event_id, user_id, event_type, value, {_within('event_id', 'event_id')} AS ts FROM {{events}}",
}
REFRESHES = ["2024-01-01 23:59:00", "2024-01-02 23:59:00", "2024-01-03 23:59:00"]

#: Seconds that layers are kept by the retention query, and when it runs.
KEPT_SECONDS = {"bronze": 86_400, "silver": 3 * 86_400 + 3_600, "gold": 10 * 86_400}
RETAINED_AT = datetime(2024, 1, 15)
#: When all frames are loaded at once, and the columns that are compared then, by table.
LOADED = "1997-12-31 23:59:00"
HEADERS = {"host": "Host", "id": "X-Id", "server": "Server"}
FIELDS = {p: [c.split()[0] for c in ddl.split(", ")] for p, ddl in PROTOCOL_COLUMNS.items() if p != "http"} | {
    "http": ["type", "method", "uri", "version", "status_code", "status_text", *(f"header_{h}" for h in HEADERS), "body"]
}
SILVER_FIELDS = {
    "packet": ["interface", "length", "data_link", "network", "transport", "application"],
    "ethernet": [*FIELDS["ethernet"], "packet_length", "interface"],
    "ip": ["version", "length", "hop_limit", "next_protocol", "source", "destination", "packet_length", "interface"],
    "transport": ["protocol", "source", "destination", "packet_length", "interface"],
    "arp": [*FIELDS["arp"], "packet_length", "interface"],
    "dns": [*FIELDS["dns_header"], *FIELDS["dns_query"], *FIELDS["dns_response"]],
}
GOLD_FIELDS = {
    "fact_network_packet": ["_id", "interface", "length", "data_link", "network", "transport", "application", "created_at"],
    "fact_network_ip": ["_id", "ip_version", "transport_protocol", "source_address", "source_port", "destination_address", "destination_port", "created_at"],
    "dim_network_foreign_ip": ["address", "started_at"],
}

_REF = re.compile(r"\{(\w+)\}")


def _references(text: str) -> list[str]:
    return [r for r in dict.fromkeys(_REF.findall(text)) if r != "ntz"]


# Plans of fixtures (not their data), by application, folder and name: building one takes a while.
_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _once(spark, sf_dir, name, lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, name: str, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """A fixture (or test table) as a DataFrame; ``sources`` may stand in for test tables."""

    def build() -> DataFrame:
        parts = {ref: fixture(spark, sf_dir, ref, sources) for ref in _references(FIXTURES[name])}
        return spark.sql(FIXTURES[name].replace("{ntz}", "_NTZ"), **parts)

    if sources is not None and name in sources:
        return sources[name]
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    return build() if sources is not None else _once(spark, sf_dir, name, build)


def three_days(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stand-ins for test tables."""
    return {
        name: spark.sql(text.replace("{ntz}", "_NTZ"), **{name: table(spark, sf_dir, name)}) for name, text in THREE_DAYS.items()
    }


def with_fixtures(sql: str, views: dict[str, str] | None = None, instead: dict[str, str] | None = None) -> str:
    """DuckDB text of ``sql`` with everything it names in braces put in front as CTEs; ``instead``: texts that stand
    in for test tables."""
    texts = {**FIXTURES, **(views or {})}
    for name, text in (instead or {}).items():
        texts = {k: v.replace(f"{{{name}}}", f"{{in_{name}}}") for k, v in texts.items()}
        sql = sql.replace(f"{{{name}}}", f"{{in_{name}}}")
        texts[f"in_{name}"] = text
    order: list[str] = []

    def visit(text: str) -> None:
        for ref in _references(text):
            if ref in texts and ref not in order:
                visit(texts[ref])
                order.append(ref)

    visit(sql)
    body = sql.strip()
    if order:
        ctes = ", ".join(f"{name} AS ({texts[name].strip()})" for name in order)
        body = f"WITH {ctes}, {body[4:]}" if body.startswith("WITH") else f"WITH {ctes} {body}"
    return _REF.sub(lambda m: "" if m.group(1) == "ntz" else m.group(1), body)
