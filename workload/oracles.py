"""SQL of the registered queries for DuckDB, in terms of the same fixtures."""

from __future__ import annotations

from hostlake.plans.gold import COUNTED_TABLES
from hostlake.plans.lifecycle import retention_plan
from workload.fixtures import AS_OF_SQL, FIELDS, GOLD_FIELDS, KEPT_SECONDS, LOADED, RETAINED_AT, SILVER_FIELDS, THREE_DAYS, with_fixtures


def _us(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier}))"


_BRZ = f"{_us('inserted_at', 'created_at')} AS brz_ingestion_duration"
_STAMP = f"{AS_OF_SQL} AS inserted_at"
_SVR = f"{_STAMP}, {_us(AS_OF_SQL, 'inserted_at')} AS svr_ingestion_duration"
_P_SVR = f"{_STAMP}, {_us(AS_OF_SQL, 'p.inserted_at')} AS svr_ingestion_duration"
_OF_PACKET = (
    f"p.length AS packet_length, p.interface, p.created_at, {_us('p.inserted_at', 'p.created_at')} AS brz_ingestion_duration, {_P_SVR}"
)
_PRESENT = {
    "ethernet": "net <> 'runt'",
    "arp": "net = 'arp'",
    "ipv4": "net = 'ipv4'",
    "ipv6": "net = 'ipv6'",
    "tcp": "tp = 'tcp'",
    "udp": "tp = 'udp'",
    "icmp": "tp = 'icmp'",
    "dns": "app = 'dns'",
    "http": "app IN ('get', 'reply')",
    "tls": "app = 'tls'",
}
_LABELS = """
 CASE WHEN net <> 'runt' THEN 'ethernet' END AS data_link, CASE WHEN net IN ('ipv4', 'ipv6', 'arp') THEN net END AS network,
 CASE WHEN tp <> 'igmp' THEN tp END AS transport,
 CASE WHEN app IN ('get', 'reply') THEN 'http' WHEN app <> 'opaque' THEN app END AS application"""

_ENDPOINT_CHARS = r"[a-zA-Z0-9\-.*:\[\]]+"


def _side(column: str) -> str:
    """address and port of one side of a socket name: what stands before and after the last colon."""
    port = f"list_last(string_split({column}, ':'))"
    valid = f"regexp_full_match({column}, '{_ENDPOINT_CHARS}:{_ENDPOINT_CHARS}')"
    return (
        f"CASE WHEN {valid} THEN left({column}, length({column}) - length({port}) - 1) ELSE '' END AS {column}_address,"
        f" CASE WHEN {valid} THEN {port} ELSE '' END AS {column}_port"
    )


def _first(keys: str, order: str, columns: str, source: str) -> str:
    """First row of each key."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}"
    return f"SELECT {columns} FROM ({ranked}) r WHERE rn = 1"


def _readable(data: str, last: str) -> str:
    """Rule for DNS bytes: letters, digits and '-_ ' stay, others give '.', '' at both ends."""
    return (
        f"list_aggregate(list_transform({data}, lambda c, i: CASE WHEN regexp_matches(chr(CAST(c AS INTEGER)), '^[-_ 0-9A-Za-z]$') THEN chr(CAST(c AS INTEGER))"
        f" WHEN i = 1 OR i = {last} THEN '' ELSE '.' END), 'string_agg', '')"
    )


_QNAME = "list_concat([length(label)], list_transform(string_split(label, ''), lambda c: ascii(c)), [3, 99, 111, 109, 0])"
_RDATA = (
    "CASE rtype WHEN 'A' THEN [10, 0, s3, s4] WHEN 'NS' THEN [2, 110, 115, 0] ELSE"
    " list_concat([254, 128, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [CAST(packet_id % 65536 // 256 AS INT), CAST(packet_id % 256 AS INT)]) END"
)
_SOCKET_TEXTS = "source_address, source_port, destination_address, destination_port"
_UPSERT_COLUMNS = "o_custkey, o_orderpriority, o_orderstatus, o_totalprice, o_orderkey, inserted_at"
_UPSERT_ORDER = "inserted_at, o_orderstatus, o_totalprice, o_orderkey"

VIEWS = {
    "o_files": f"""
SELECT f.* EXCLUDE (src, dst, src_address, src_port, dst_address, dst_port, brz_ingestion_duration, inserted_at),
 {_BRZ}, CASE WHEN contains(src_address, ':') OR contains(src_address, '-') THEN replace(replace(split_part(src_address, '.', 1), '[', ''), ']', '') ELSE src_address END AS ip_source_address,
 src_port AS ip_source_port, replace(replace(dst_address, '[', ''), ']', '') AS ip_destination_address, dst_port AS ip_destination_port, {_SVR}
FROM (SELECT *, {_side('src')}, {_side('dst')} FROM (SELECT *, split_part(name, '->', 1) AS src, split_part(name, '->', 2) AS dst FROM {{open_files}}) a) f""",
    "o_processes": f"""
SELECT p.* EXCLUDE (inserted_at, brz_ingestion_duration), {_BRZ}, {_us('created_at', 'lstart')} AS duration, {_SVR} FROM {{process_list}} p""",
    "o_packets": f"""
SELECT p._id, p.interface, p.length, p.created_at, {_us('p.inserted_at', 'p.created_at')} AS brz_ingestion_duration, {_LABELS.strip()}, {_P_SVR}
 FROM {{packet}} p JOIN {{wire}} w ON p._id = w.packet_id""",
    "o_interfaces": f"""
SELECT _id, interface, CASE WHEN netmask IS NOT NULL THEN concat(address, netmask) END AS address, broadcast_address, destination_address, {_SVR} FROM {{interface}}""",
    "o_ip": f"""
SELECT i.packet_id AS _id, version, i.length, hop_limit, next_protocol, source, destination, {_OF_PACKET} FROM (
 SELECT packet_id, version, total_length AS length, ttl AS hop_limit, next_level_protocol AS next_protocol, source, destination FROM {{ipv4}}
 UNION ALL SELECT packet_id, version, payload_length, hop_limit, next_header, source, destination FROM {{ipv6}}) i LEFT JOIN {{packet}} p ON p._id = i.packet_id""",
    "o_transport": f"""
SELECT t.packet_id AS _id, protocol, source, destination, {_OF_PACKET} FROM (
 SELECT packet_id, 'TCP' AS protocol, source, destination FROM {{tcp}} UNION ALL SELECT packet_id, 'UDP', source, destination FROM {{udp}}) t
 LEFT JOIN {{packet}} p ON p._id = t.packet_id""",
    "o_dns": f"""
SELECT h.* EXCLUDE (_id), concat_ws('-', CAST(h._id AS VARCHAR), CAST(q._id AS VARCHAR), CAST(r._id AS VARCHAR)) AS _id,
 q.qname, q.qtype, q.qclass, r.origin, r.name_tag, r.rtype, r.rclass, r.ttl, r.rdlength, r.rdata,
 p.created_at, {_us('p.inserted_at', 'p.created_at')} AS brz_ingestion_duration, {_P_SVR}
 FROM {{dns_header}} h LEFT JOIN (SELECT *, {_QNAME} AS qname FROM {{dns_question_text}}) q ON q.packet_id = h.packet_id
 LEFT JOIN (SELECT *, {_RDATA} AS rdata FROM {{dns_record_numbers}}) r ON r.packet_id = h.packet_id
 LEFT JOIN {{packet}} p ON p._id = h.packet_id""",
    "o_dim_interface": f"""
SELECT interface, address, broadcast_address, destination_address,
 CASE WHEN contains(address, ':') THEN 'fe80::' WHEN address LIKE '%/24' THEN concat('10.0.', split_part(address, '.', 3), '.0')
  WHEN address LIKE '%/20' THEN '10.0.0.0' END AS network, inserted_at AS started_at, {_STAMP}
 FROM (SELECT *, row_number() OVER (PARTITION BY interface, address ORDER BY inserted_at, broadcast_address, destination_address) AS rn FROM {{o_interfaces}}) i WHERE rn = 1""",
    "o_socket_rows": f"""
SELECT f.pid, f.uid, f.command, f.created_at AS started_at,
 CASE WHEN f.ip_source_address <> '*' AND f.ip_source_address <> '' THEN coalesce(h1.address,
   CASE f.ip_source_address WHEN 'fe80-0-0-0-1-2-3-4' THEN 'fe80::1:2:3:4' ELSE CASE WHEN f.ip_source_address LIKE 'host%' THEN NULL ELSE f.ip_source_address END END) END AS source_address,
 CASE WHEN f.ip_source_port NOT IN ('*', '') THEN coalesce(s1.port, TRY_CAST(f.ip_source_port AS INTEGER)) END AS source_port,
 CASE WHEN f.ip_destination_address NOT IN ('*', '') THEN coalesce(h2.address, f.ip_destination_address) END AS destination_address,
 CASE WHEN f.ip_destination_port NOT IN ('*', '') THEN coalesce(s2.port, TRY_CAST(f.ip_destination_port AS INTEGER)) END AS destination_port
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, ip_source_address, ip_source_port, ip_destination_address, ip_destination_port
   ORDER BY created_at, uid, command) AS rn FROM {{o_files}} WHERE upper(type) IN ('IPV4', 'IPV6')) n WHERE rn = 1) f
 LEFT JOIN {{o_host}} h1 ON h1.name = lower(f.ip_source_address) LEFT JOIN {{o_host}} h2 ON h2.name = lower(f.ip_destination_address)
 LEFT JOIN {{o_service}} s1 ON s1.name = lower(f.ip_source_port) LEFT JOIN {{o_service}} s2 ON s2.name = lower(f.ip_destination_port)""",
    "o_host": "SELECT lower(name) AS name, min(address) AS address FROM {host} GROUP BY lower(name)",
    "o_service": "SELECT lower(name) AS name, min(port) AS port FROM {service} GROUP BY lower(name)",
    "o_sockets": _first(
        f"pid, {_SOCKET_TEXTS}",
        "started_at, uid, command",
        f"pid, uid, command, {_SOCKET_TEXTS}, started_at, {_STAMP}",
        "{o_socket_rows}",
    ),
    "o_fact_ip": f"""
SELECT t._id, CAST(i.version AS SMALLINT) AS ip_version, t.protocol AS transport_protocol, i.source AS source_address, t.source AS source_port,
 i.destination AS destination_address, t.destination AS destination_port, p.created_at, {_STAMP}
 FROM {{o_transport}} t, {{o_ip}} i, {{packet}} p WHERE t._id = i._id AND p._id = t._id""",
    "o_own": "SELECT DISTINCT split_part(address, '/', 1) AS host FROM {o_dim_interface} WHERE address IS NOT NULL",
    "o_foreign": f"""
SELECT address, CAST(NULL AS VARCHAR) AS domain_name, min(created_at) AS started_at, {_STAMP} FROM (
 SELECT source AS address, created_at FROM {{o_ip}} UNION ALL SELECT destination, created_at FROM {{o_ip}}) a
 WHERE address NOT IN (SELECT host FROM {{o_own}}) AND address NOT IN ('255.255.255.255', 'ff00::') GROUP BY address""",
    "o_process_network": f"""
SELECT DISTINCT s.pid, k.packet_id, k.send, {_STAMP} FROM (
 SELECT _id AS packet_id, created_at, source_port AS port, TRUE AS send FROM {{o_fact_ip}} WHERE source_address IN (SELECT host FROM {{o_own}})
 UNION ALL SELECT _id, created_at, destination_port, FALSE FROM {{o_fact_ip}} WHERE destination_address IN (SELECT host FROM {{o_own}})) k
 JOIN {{o_sockets}} s ON s.source_port = k.port AND k.created_at BETWEEN s.started_at AND s.inserted_at""",
    "o_open_port_rows": """
SELECT f.pid, f.uid, f.command, f.ip_source_port AS text, f.created_at AS started_at, s.port AS service_port,
 CASE WHEN f.ip_source_port NOT IN ('*', '') THEN coalesce(s.port, TRY_CAST(f.ip_source_port AS INTEGER)) END AS port
 FROM {o_files} f LEFT JOIN (SELECT DISTINCT lower(name) AS name, port FROM {service}) s ON s.name = lower(f.ip_source_port)""",
    "o_stored": _first(
        "o_custkey, o_orderpriority", _UPSERT_ORDER, _UPSERT_COLUMNS,
        "(SELECT *, o_orderdate AS inserted_at FROM {orders} WHERE o_orderstatus = 'F') o",
    ),
    "o_arriving": _first(
        "o_custkey, o_orderpriority", _UPSERT_ORDER, _UPSERT_COLUMNS,
        "(SELECT *, o_orderdate AS inserted_at FROM {orders} WHERE o_orderstatus <> 'F') o",
    ),
}

_SAME_KEY = "s.o_custkey = n.o_custkey AND s.o_orderpriority = n.o_orderpriority"
_KEYED = "o_custkey, o_orderpriority"


def _columns_of(fixture: str, columns: str) -> str:
    return f"SELECT {columns} FROM {{{fixture}}}"


_FANOUT = {
    "ethernet": "{ethernet}", "ipv4": "{ipv4}", "ipv6": "{ipv6}", "arp": "{arp}", "tcp": "{tcp}", "udp": "{udp}",
    "icmp": "{icmp}", "tls": "{tls}", "http": "{http}", "dns_header": "{dns_header}",
    "dns_query": f"(SELECT *, {_QNAME} AS qname FROM {{dns_question_text}}) q", "dns_response": f"(SELECT *, {_RDATA} AS rdata FROM {{dns_record_numbers}}) r",
}
_SILVER_SOURCES = {
    "packet": "{o_packets}",
    "ethernet": "(SELECT e.*, p.length AS packet_length, p.interface, p.created_at FROM {ethernet} e JOIN {packet} p ON p._id = e.packet_id) e",
    "ip": "{o_ip}",
    "transport": "{o_transport}",
    "arp": "(SELECT a.*, p.length AS packet_length, p.interface, p.created_at FROM {arp} a JOIN {packet} p ON p._id = a.packet_id) a",
    "dns": "{o_dns}",
}
_LOADED = f"TIMESTAMP '{LOADED}'"
_SILVER_LAGS = ["created_at", _us(_LOADED, "created_at"), _us(AS_OF_SQL, _LOADED)]
_GOLD_TEXTS = {"fact_network_packet": "{o_packets}", "fact_network_ip": "{o_fact_ip}", "dim_network_foreign_ip": "{o_foreign}"}


def _row_texts(name: str, key: str, columns: list[str], source: str, inserted: str, more: tuple[str, ...] | list[str] = ()) -> str:
    lists = {"qname": "array_to_string(qname, '.')", "rdata": "array_to_string(rdata, '.')"}
    text = ", ".join(f"CAST({lists.get(c, c)} AS VARCHAR)" for c in (*columns, *more))
    return f"SELECT '{name}' AS name, CAST({key} AS VARCHAR) AS key, concat_ws('|', {text}) AS fields, {inserted} AS inserted_at FROM {source}"


# Source and key columns of each gold table after a first refresh.
_GOLD_SOURCES = {
    "gold_file_service": ("(SELECT DISTINCT name, port, protocol FROM {service}) a", "name, port, protocol"),
    "gold_file_host": ("{host}", "name, address"),
    "gold_file_user": ("{user}", "name, uid"),
    "gold_dim_process": ("(SELECT DISTINCT pid, lstart FROM {process_list}) a", "pid, lstart"),
    "gold_dim_file_reg": ("(SELECT DISTINCT pid, fd, node FROM {open_files} WHERE type = 'REG') a", "pid, fd, node"),
    "gold_dim_network_interface": ("{o_dim_interface}", "interface, address"),
    "gold_dim_network_socket": ("{o_sockets}", f"pid, {_SOCKET_TEXTS}"),
    "gold_dim_network_open_port": ("{o_open_ports}", "pid, port"),
    "gold_dim_network_foreign_ip": ("{o_foreign}", "address"),
    # The host dimension of a first run has no facts to look at yet.
    "gold_dim_network_host": ("""(SELECT source_address AS address FROM {o_sockets} WHERE source_address IS NOT NULL UNION SELECT address FROM {o_foreign}
        UNION SELECT address FROM {o_dim_interface}) a""", "address"),
    "gold_fact_process": ("(SELECT DISTINCT pid, lstart, created_at FROM {process_list}) a", "pid, lstart, created_at"),
    "gold_fact_file_reg": ("(SELECT DISTINCT pid, fd, node, created_at FROM {open_files} WHERE type = 'REG') a", "pid, fd, node, created_at"),
    "gold_fact_network_packet": ("{packet}", "_id"),
    "gold_fact_network_ip": ("{o_fact_ip}", "_id"),
    "gold_fact_process_network": ("{o_process_network}", "pid, packet_id, send"),
    "gold_tech_table_count": ("(SELECT unnest(range(40)) AS id) a", "id"),
    "gold_tech_chrono": ("(SELECT unnest(['process_list', 'open_files', 'network_packet']) AS name) a", "name"),
}


def _exported(file_format: str) -> str:
    def rows(name: str, source: str, key: str) -> str:
        text = ", ".join(f"CAST({k} AS VARCHAR)" for k in key.split(", "))
        return f"SELECT '{name}' AS name, '{file_format}' AS format, concat_ws('|', {text}) AS key, {_STAMP} FROM {source}"

    return " UNION ALL ".join(rows(name, *source) for name, source in _GOLD_SOURCES.items())


VIEWS["o_arrivals"] = "SELECT event_id, TIMESTAMP '2023-12-16' + to_seconds((event_id * 7919) % 2592000) AS inserted_at FROM events"
VIEWS["o_open_ports"] = f"""
SELECT pid, uid, command, port, started_at, {_STAMP} FROM (SELECT *, row_number() OVER (PARTITION BY pid, port ORDER BY started_at, uid, command) AS rp FROM (
 SELECT *, row_number() OVER (PARTITION BY pid, service_port ORDER BY started_at, uid, command, text, port) AS rn FROM {{o_open_port_rows}}) r
 WHERE rn = 1 AND port IS NOT NULL) k WHERE rp = 1"""


def _lag_row(feed: str, view: str) -> str:
    columns = "max(brz_ingestion_duration) / 1e6 AS brz_max_ingest, min(brz_ingestion_duration) / 1e6 AS brz_min_ingest"
    columns += ", max(svr_ingestion_duration) / 1e6 AS svr_max_ingest, min(svr_ingestion_duration) / 1e6 AS svr_min_ingest"
    columns += ", (max(brz_ingestion_duration) + max(svr_ingestion_duration)) / 1e6 AS max_ingest"
    columns += ", (min(brz_ingestion_duration) + min(svr_ingestion_duration)) / 1e6 AS min_ingest"
    return f"SELECT '{feed}' AS name, {columns}, {_STAMP} FROM {{{view}}}"


_COUNT_SOURCES = {
    "bronze_process_list": "{process_list}", "bronze_open_files": "{open_files}", "bronze_network_packet": "{packet}", "bronze_network_interface": "{interface}",
    **{f"bronze_network_{p}": source for p, source in _FANOUT.items()},
    "silver_process_list": "{process_list}", "silver_open_files": "{open_files}", "silver_network_interface": "{interface}",
    **{f"silver_network_{p}": source for p, source in _SILVER_SOURCES.items()},
    **{name: source for name, (source, _) in _GOLD_SOURCES.items() if "_tech_" not in name},
}
_COUNTED = [(k, name, _COUNT_SOURCES[name]) for k, name in enumerate(COUNTED_TABLES)]

_V4_OCTET = "lpad(lower(hex(CAST(split_part(host, '.', {i}) AS BIGINT))), 2, '0')"

ORACLES: dict[str, str] = {
    # sources
    "parse_process_snapshot": """
SELECT user_id AS pid, user_id % 10 AS ppid, CAST(user_id % 5 AS INT) AS uid, TIMESTAMP '2023-08-01 08:01:00' + to_seconds(CAST(event_id % 60 AS INT)) AS lstart,
 CAST(0.5 AS DOUBLE) AS pcpu, CAST(event_id % 100 AS DOUBLE) + 0.25 AS pmem, 'Ss' AS status, concat('/usr/bin/', event_type, ' -k ', CAST(event_id AS VARCHAR)) AS command FROM events""",
    "parse_open_files": """
SELECT concat('cmd', CAST(l_suppkey % 7 AS VARCHAR)) AS command, l_suppkey AS pid, CAST(l_suppkey % 5 AS INT) AS uid, 'cwd' AS fd, 'DIR' AS type, '0x1' AS device,
 CAST(640 AS BIGINT) AS size, '2' AS node, '/' AS name FROM lineitem
UNION ALL SELECT concat('cmd', CAST(l_suppkey % 7 AS VARCHAR)), l_suppkey, CAST(l_suppkey % 5 AS INT), concat(CAST(l_linenumber AS VARCHAR), 'u'), 'IPv4', '',
 0, '', concat('10.0.0.1:', CAST(1024 + l_partkey % 50 AS VARCHAR)) FROM lineitem
UNION ALL SELECT 'other', l_partkey, 0, 'txt', '', '', l_orderkey, '', '/bin/x y' FROM lineitem""",
    "open_files_by_class": """
SELECT pid, fd, type, name, created_at, CASE type WHEN 'REG' THEN 'regular' ELSE 'network' END AS class FROM {open_files}
UNION ALL SELECT pid, fd, type, name, created_at, 'all' FROM {open_files}""",
    "parse_hosts": """
WITH kept AS (SELECT * FROM nation WHERE n_regionkey > 1)
SELECT DISTINCT unnest([lower(n_name), concat('alias', CAST(n_nationkey % 3 AS VARCHAR)), '#x']) AS name, concat('172.16.0.', CAST(n_nationkey % 20 AS VARCHAR)) AS address FROM kept""",
    "parse_services": """
SELECT DISTINCT concat('svc-', CAST(p_partkey % 1000 AS VARCHAR)) AS name, CAST(1000 + p_partkey % 1000 AS INT) AS port, 'tcp' AS protocol FROM part WHERE p_size > 2""",
    "parse_users": "SELECT lower(c_name) AS name, CAST(c_custkey AS INT) AS uid FROM customer WHERE c_nationkey > 1",
    "parse_users_listing": """
SELECT concat('_', lower(c_mktsegment), ' user ', CAST(c_custkey % 7 AS VARCHAR)) AS name, CAST(c_custkey AS INT) AS uid FROM customer""",
    "log_lines": """
SELECT concat_ws(' ', CAST(ts AS VARCHAR), event_type, CAST(event_id AS VARCHAR), props) AS row, TRUE AS has_file, TRUE AS has_date FROM events""",
    "interface_addresses": f"SELECT interface, address, netmask, broadcast_address, destination_address, {_STAMP} FROM {{interface_first}}",
    "snapshot_replace": f"""
SELECT 'service' AS lookup, name, concat(CAST(port AS VARCHAR), '/', protocol) AS value, {_STAMP} FROM {{service}}
UNION ALL SELECT DISTINCT 'host', unnest([lower(n_name), concat('alias', CAST(n_nationkey % 3 AS VARCHAR)), '#x']), concat('172.16.0.', CAST(n_nationkey % 20 AS VARCHAR)), {AS_OF_SQL}
 FROM nation WHERE n_regionkey > 1""",
    # packets
    "decode_packets": "SELECT _id, p.interface, length, p.created_at, concat_ws(',', "
    + ", ".join(f"CASE WHEN {condition} THEN '{layer}' END" for layer, condition in _PRESENT.items())
    + ") AS layers FROM {packet} p JOIN {wire} w ON w.packet_id = p._id",
    "packet_base": _columns_of("packet", "_id, interface, length, created_at"),
    **{f"decode_{p}": f"SELECT * EXCLUDE (_id) FROM {{{p}}}" for p in ("ethernet", "arp", "ipv4", "ipv6", "tcp", "udp", "icmp", "tls", "dns_header", "http")},
    "decode_dns_questions": f"SELECT packet_id, array_to_string({_QNAME}, '.') AS qname, qtype, qclass FROM {{dns_question_text}}",
    "decode_dns_records": f"""
SELECT packet_id, origin, name_tag, rtype, rclass, ttl, rdlength, array_to_string({_RDATA}, '.') AS rdata FROM {{dns_record_numbers}}""",
    "decode_http_pages": """
SELECT page_id, 'response' AS type, 'HTTP/1.1' AS version, 200 AS status_code, 'OK' AS status_text, url, md5(html) AS body_md5 FROM pages""",
    "classify_application": """
SELECT packet_id AS _id, CASE WHEN tp <> 'igmp' THEN tp END AS transport,
 CASE WHEN app IN ('get', 'reply') THEN 'http' WHEN app <> 'opaque' THEN app END AS application FROM {wire}""",
    "protocol_fanout": " UNION ALL ".join(
        [
            _row_texts("packet", "_id", ["interface", "length", "created_at"], "{packet}", _LOADED),
            *(_row_texts(p, "packet_id", columns, _FANOUT[p], _LOADED) for p, columns in FIELDS.items()),
        ]
    ),
    "frames_to_silver": " UNION ALL ".join(
        _row_texts(name, "packet_id" if name == "dns" else "_id", columns, _SILVER_SOURCES[name], AS_OF_SQL, _SILVER_LAGS)
        for name, columns in SILVER_FIELDS.items()
    ),
    "frames_to_gold": " UNION ALL ".join(
        _row_texts(name, columns[0], columns[1:], _GOLD_TEXTS[name], AS_OF_SQL) for name, columns in GOLD_FIELDS.items()
    ),
    # bronze
    "bronze_process_list": f"""
SELECT DISTINCT pid, ppid, uid, lstart, pcpu, pmem, status, replace(command, '''', '"') AS command, created_at, {_STAMP},
 {_us(AS_OF_SQL, 'created_at')} AS brz_ingestion_duration FROM {{process_row}}""",
    "bronze_open_files": f"""
SELECT DISTINCT replace(command, '''', '"') AS command, pid, uid, fd, type, device, size, node, replace(name, '''', '"') AS name, created_at, {_STAMP},
 {_us(AS_OF_SQL, 'created_at')} AS brz_ingestion_duration FROM {{open_file_row}}""",
    "batch_distinct": "SELECT l_suppkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem GROUP BY ALL",
    # silver
    "silver_process_list": "SELECT * FROM {o_processes}",
    "silver_open_files": "SELECT * FROM {o_files}",
    "silver_network_packet": "SELECT * FROM {o_packets}",
    "silver_network_packet_decoded": "SELECT * FROM {o_packets}",
    "silver_network_ethernet": f"""
SELECT e.packet_id AS _id, source, destination, ether_type, payload_length, {_OF_PACKET} FROM {{ethernet}} e LEFT JOIN {{packet}} p ON p._id = e.packet_id""",
    "silver_network_interface": "SELECT * FROM {o_interfaces}",
    "silver_network_dns": """
SELECT * REPLACE (array_to_string(qname, '.') AS qname, array_to_string(rdata, '.') AS rdata) FROM {o_dns}""",
    "dns_name_text": f"""
SELECT label, {_readable('data', 'length(data)')} AS question_parsed FROM (
 SELECT label, {_QNAME} AS data FROM (SELECT event_type AS label FROM events UNION ALL SELECT url FROM pages) l) d""",
    "dns_rdata_text": f"""
SELECT packet_id, origin, rtype, {_readable('qname', 'length(qname)')} AS question_parsed,
 CASE WHEN rclass = 'IN' AND rtype IN ('A', 'AAAA') THEN array_to_string(rdata, '.') ELSE {_readable('rdata', 'length(qname)')} END AS response_parsed FROM {{o_dns}}""",
    "silver_network_ip": "SELECT * FROM {o_ip}",
    "silver_network_transport": "SELECT * FROM {o_transport}",
    "silver_network_arp": f"""
SELECT a.packet_id AS _id, a.* EXCLUDE (_id, packet_id), {_OF_PACKET} FROM {{arp}} a LEFT JOIN {{packet}} p ON p._id = a.packet_id""",
    # gold
    "gold_dim_process": f"""
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY pid, lstart ORDER BY created_at DESC, command DESC, ppid DESC, uid DESC) AS rn FROM {{o_processes}}),
short AS (SELECT pid, command, row_number() OVER (PARTITION BY pid ORDER BY created_at, command) AS rn FROM {{open_files}})
SELECT l.pid, l.ppid, l.uid, s.command, l.command AS full_command, l.lstart AS started_at, {_STAMP} FROM latest l
 LEFT JOIN short s ON s.pid = l.pid AND s.rn = 1 WHERE l.rn = 1""",
    "gold_dim_file_reg": f"""
SELECT pid, uid, fd, node, command, name, created_at AS started_at, {_STAMP} FROM (
 SELECT *, row_number() OVER (PARTITION BY pid, fd, node ORDER BY created_at, uid, command, name) AS rn FROM {{open_files}} WHERE type = 'REG') r WHERE rn = 1""",
    "gold_dim_network_interface": "SELECT * FROM {o_dim_interface}",
    "gold_dim_network_socket": "SELECT * FROM {o_sockets}",
    "gold_dim_network_open_port": "SELECT * FROM {o_open_ports}",
    "gold_dim_network_open_port_resolved": f"""
SELECT pid, uid, command, port, started_at, {_STAMP} FROM (
 SELECT *, row_number() OVER (PARTITION BY pid, port ORDER BY started_at, uid, command) AS rn FROM {{o_open_port_rows}} WHERE port IS NOT NULL) r WHERE rn = 1""",
    "gold_dim_network_foreign_ip": "SELECT * FROM {o_foreign}",
    "gold_dim_network_host": f"""
SELECT address, split_part(address, '/', 1) AS host, {_STAMP} FROM (
 SELECT source_address AS address FROM {{o_sockets}} WHERE source_address IS NOT NULL UNION SELECT address FROM {{o_foreign}} UNION SELECT address FROM {{o_dim_interface}}
 UNION SELECT source_address FROM {{o_fact_ip}} UNION SELECT destination_address FROM {{o_fact_ip}}) a""",
    "gold_fact_process": f"""
SELECT pid, lstart AS started_at, created_at, pcpu, pmem, {_STAMP} FROM (
 SELECT *, row_number() OVER (PARTITION BY pid, lstart, created_at ORDER BY pcpu, pmem) AS rn FROM {{process_list}}) r WHERE rn = 1""",
    "gold_fact_file_reg": f"""
SELECT pid, fd, node, created_at, min(size) AS size, {_STAMP} FROM {{open_files}} WHERE type = 'REG' GROUP BY pid, fd, node, created_at""",
    "gold_fact_network_packet": f"""
SELECT _id, interface, length, data_link, network, transport, application, created_at, {_STAMP} FROM {{o_packets}}""",
    "gold_fact_network_ip": "SELECT * FROM {o_fact_ip}",
    "gold_fact_process_network": "SELECT * FROM {o_process_network}",
    "gold_fact_process_network_salted": "SELECT * FROM {o_process_network}",
    "gold_tech_table_count": " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS _id, '{name}' AS name, count(*) AS max_count, count(*) AS last_count, {_STAMP} FROM {source}"
        for i, name, source in _COUNTED
    ),
    "gold_tech_chrono": " UNION ALL ".join(
        [_lag_row("process_list", "o_processes"), _lag_row("open_files", "o_files"), _lag_row("network_packet", "o_packets")]
    ),
    # keyed writes
    "upsert_ignore": f"""
SELECT {_UPSERT_COLUMNS} FROM {{o_stored}} UNION ALL
SELECT {_UPSERT_COLUMNS} FROM {{o_arriving}} n WHERE NOT EXISTS (SELECT 1 FROM {{o_stored}} s WHERE {_SAME_KEY})""",
    "upsert_replace": f"""
SELECT {_UPSERT_COLUMNS} FROM {{o_arriving}} UNION ALL
SELECT {_UPSERT_COLUMNS} FROM {{o_stored}} s WHERE NOT EXISTS (SELECT 1 FROM {{o_arriving}} n WHERE {_SAME_KEY})""",
    "upsert_touch": f"""
WITH arriving AS (SELECT *, o_orderdate AS inserted_at, row_number() OVER (PARTITION BY {_KEYED} ORDER BY o_orderkey) AS rn,
 max(o_orderdate) OVER (PARTITION BY {_KEYED}) AS last FROM orders WHERE o_orderstatus <> 'F')
SELECT coalesce(s.o_custkey, n.o_custkey) AS o_custkey, coalesce(s.o_orderpriority, n.o_orderpriority) AS o_orderpriority,
 coalesce(s.o_orderstatus, n.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, n.o_totalprice) AS o_totalprice,
 coalesce(s.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.last, s.inserted_at) AS inserted_at
 FROM {{o_stored}} s FULL OUTER JOIN (SELECT * FROM arriving WHERE rn = 1) n ON {_SAME_KEY}""",
    "upsert_combine": f"""
SELECT coalesce(s.o_custkey, n.o_custkey) AS o_custkey, coalesce(s.o_orderpriority, n.o_orderpriority) AS o_orderpriority,
 coalesce(s.o_orderstatus, n.o_orderstatus) AS o_orderstatus, greatest(s.o_totalprice, n.o_totalprice) AS o_totalprice,
 coalesce(n.o_orderkey, s.o_orderkey) AS o_orderkey, least(s.inserted_at, n.inserted_at) AS inserted_at
 FROM {{o_stored}} s FULL OUTER JOIN {{o_arriving}} n ON {_SAME_KEY}""",
    "delete_matching": """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""",
    # retention, flush, export
    "retention": " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST(event_id AS VARCHAR) AS key, inserted_at FROM {{o_arrivals}} WHERE inserted_at >= TIMESTAMP '{RETAINED_AT}' - to_seconds({KEPT_SECONDS[name.split('_')[0]]})"
        for name in retention_plan(KEPT_SECONDS)
    ),
    "final_flush": _exported("parquet"),
    "export_gold": f"{_exported('parquet')} UNION ALL {_exported('csv')}",
    "inet_functions": f"""
SELECT interface, text, address, host, CASE WHEN network IS NOT NULL THEN concat(network, '/', CAST(prefix AS VARCHAR)) END AS network, prefix, family,
 CASE family WHEN 4 THEN concat('4', repeat('0', 24), {', '.join(_V4_OCTET.format(i=i) for i in range(1, 5))})
  WHEN 6 THEN concat('6fe80', repeat('0', 24), lpad(split_part(host, '::', 2), 4, '0')) END AS sort_key
 FROM (SELECT d.interface, d.text, d.address, split_part(d.address, '/', 1) AS host, i.network, CAST(split_part(d.address, '/', 2) AS INT) AS prefix,
  CASE WHEN contains(d.address, ':') THEN 6 WHEN d.address IS NOT NULL THEN 4 END AS family
  FROM (SELECT interface, address AS text, CASE WHEN netmask IS NOT NULL THEN concat(address, netmask) END AS address FROM {{interface}}) d
  LEFT JOIN {{o_dim_interface}} i ON i.interface = d.interface AND i.address = d.address) x""",
}
ORACLES |= {
    "stream_bronze": f"""
SELECT *, {AS_OF_SQL} AS created_at, {_STAMP}, CAST(0 AS BIGINT) AS brz_ingestion_duration FROM ({ORACLES["parse_process_snapshot"].strip()}) p""",
    "stream_silver_process": ORACLES["silver_process_list"],
    "stream_silver_packet": ORACLES["silver_network_packet_decoded"],
    "stream_socket": f"""
SELECT f.pid, f.created_at AS started_at, f.uid, f.command, f.inserted_at,
 CASE WHEN f.ip_source_address <> '*' AND f.ip_source_address <> '' THEN coalesce(h1.address,
   CASE f.ip_source_address WHEN 'fe80-0-0-0-1-2-3-4' THEN 'fe80::1:2:3:4' ELSE CASE WHEN f.ip_source_address LIKE 'host%' THEN NULL ELSE f.ip_source_address END END) END AS source_address,
 CASE WHEN f.ip_source_port NOT IN ('*', '') THEN coalesce(s1.port, TRY_CAST(f.ip_source_port AS INTEGER)) END AS source_port,
 CASE WHEN f.ip_destination_address NOT IN ('*', '') THEN coalesce(h2.address, f.ip_destination_address) END AS destination_address,
 CASE WHEN f.ip_destination_port NOT IN ('*', '') THEN coalesce(s2.port, TRY_CAST(f.ip_destination_port AS INTEGER)) END AS destination_port
 FROM (SELECT * FROM {{o_files}} WHERE type <> 'REG') f
 LEFT JOIN {{o_host}} h1 ON h1.name = lower(f.ip_source_address) LEFT JOIN {{o_host}} h2 ON h2.name = lower(f.ip_destination_address)
 LEFT JOIN {{o_service}} s1 ON s1.name = lower(f.ip_source_port) LEFT JOIN {{o_service}} s2 ON s2.name = lower(f.ip_destination_port)""",
    "stream_dim_socket": f"SELECT {_SOCKET_TEXTS}, pid, started_at, uid, command, inserted_at FROM {{o_sockets}}",
    "stream_process_network": "SELECT pid, packet_id, send FROM {o_process_network}",
}
# Of repeated interface keys the smallest row counts, column by column from the left.
VIEWS["interface_first"] = """
SELECT interface, address, netmask, broadcast_address, destination_address FROM (
 SELECT *, row_number() OVER (PARTITION BY interface, address ORDER BY netmask NULLS FIRST, broadcast_address NULLS FIRST, destination_address NULLS FIRST) AS rn FROM (
  SELECT interface, address, CASE netmask WHEN '255.255.255.0' THEN '/24' WHEN '255.255.240.0' THEN '/20' WHEN 'ffff:ffff:ffff:ffff::' THEN '/64' END AS netmask,
   broadcast_address, destination_address FROM {interface_device}) d) r WHERE rn = 1"""


# Three days, refreshed at the end of each. Sockets by the days they were seen on.
_FIRST_SOCKETS = """(SELECT *, row_number() OVER (PARTITION BY pid, ip_source_address, ip_source_port, ip_destination_address, ip_destination_port
   ORDER BY created_at, uid, command) AS rn FROM {o_files} WHERE upper(type) IN ('IPV4', 'IPV6')) n WHERE rn = 1"""
_SEEN_SOCKETS = """(SELECT * FROM {o_files} WHERE upper(type) IN ('IPV4', 'IPV6')) n"""
VIEWS["o_seen_sockets"] = VIEWS["o_socket_rows"].replace(_FIRST_SOCKETS, _SEEN_SOCKETS)
VIEWS["o_socket_days"] = f"""
SELECT pid, source_port, {_SOCKET_TEXTS.replace("source_port, ", "")}, min(started_at) AS start, list(DISTINCT day(started_at)) AS days
 FROM {{o_seen_sockets}} WHERE source_port IS NOT NULL GROUP BY ALL"""
VIEWS["o_own_days"] = """
SELECT split_part(address, '/', 1) AS host, min(CASE WHEN address LIKE '%/20' THEN 2 ELSE 1 END) AS day FROM {o_dim_interface} WHERE address IS NOT NULL GROUP BY 1"""
VIEWS["o_day_network"] = """
SELECT pid, packet_id, send, min(greatest(own_day, list_min(list_filter(days, lambda d: d >= packet_day)))) AS day FROM (
 SELECT s.pid, s.days, k.packet_id, k.send, k.own_day, k.packet_day FROM (
  SELECT _id AS packet_id, created_at, day(created_at) AS packet_day, source_port AS port, TRUE AS send, o.day AS own_day FROM {o_fact_ip} f JOIN {o_own_days} o ON o.host = f.source_address
  UNION ALL SELECT _id, created_at, day(created_at), destination_port, FALSE, o.day FROM {o_fact_ip} f JOIN {o_own_days} o ON o.host = f.destination_address) k
 JOIN {o_socket_days} s ON s.source_port = k.port AND k.created_at >= s.start AND list_max(s.days) >= k.packet_day) p GROUP BY 1, 2, 3"""


def _day_facts(name: str, key: str, source: str, day: str = "day(created_at)") -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in key.split(", "))
    return f"SELECT DISTINCT '{name}' AS name, concat_ws('|', {text}) AS key, TIMESTAMP '2023-12-31 23:59:00' + to_days(CAST({day} AS INT)) AS inserted_at FROM {source}"


DAY_ORACLES = {
    "refresh_days": " UNION ALL ".join(
        [
            _day_facts("gold_fact_process", "pid, lstart, created_at", "{process_list}"),
            _day_facts("gold_fact_file_reg", "pid, fd, node, created_at", "(SELECT * FROM {open_files} WHERE type = 'REG') f"),
            _day_facts("gold_fact_network_packet", "_id", "{packet}"),
            _day_facts("gold_fact_network_ip", "_id", "{o_fact_ip}"),
            _day_facts("gold_fact_process_network", "pid, packet_id, send", "{o_day_network}", "day"),
        ]
    ),
}


DAY_ORACLES |= {
    "stream_dim_socket_ttl": f"""
SELECT pid, {_SOCKET_TEXTS}, started_at, uid, command, {_STAMP} FROM {{o_sockets}}""",
    "stream_process_network_blocks": """
SELECT DISTINCT s.pid, k.packet_id, k.send FROM (
 SELECT _id AS packet_id, created_at, source_port AS port, TRUE AS send FROM {o_fact_ip} WHERE source_address IN (SELECT host FROM {o_own})
 UNION ALL SELECT _id, created_at, destination_port, FALSE FROM {o_fact_ip} WHERE destination_address IN (SELECT host FROM {o_own})) k
 JOIN {o_sockets} s ON s.source_port = k.port AND k.created_at BETWEEN s.started_at AND s.started_at + INTERVAL 6 HOURS AND k.created_at <= TIMESTAMP '2024-01-03 23:59:00'""",
    "stream_retention": "SELECT _id, pid, created_at, inserted_at FROM {process_list} WHERE created_at >= TIMESTAMP '2024-01-02'",
}
_STREAMED = (("bronze_process_list", "process_list"), ("bronze_open_files", "open_files"), ("bronze_network_packet", "packet"))
ORACLES["stream_counts"] = " UNION ALL ".join(
    [f"SELECT '{name}' AS name, CAST(count(*) AS DOUBLE) AS value, 'rows' AS what, {_STAMP} FROM {{{source}}}" for name, source in _STREAMED]
    + [
        f"SELECT '{name[7:]}', {end}(epoch_us(inserted_at) - epoch_us(created_at)) / 1e6, 'brz_{end}_ingest', {_STAMP} FROM {{{source}}}"
        for name, source in _STREAMED
        for end in ("max", "min")
    ]
)


def oracle_texts() -> dict[str, str]:
    days = {name: with_fixtures(sql, VIEWS, THREE_DAYS) for name, sql in DAY_ORACLES.items()}
    return {name: with_fixtures(sql, VIEWS) for name, sql in ORACLES.items()} | days
