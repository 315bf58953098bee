"""Decoding of single frames and messages."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hostlake.operators import packets
from hostlake.operators.dns import with_dns
from hostlake.operators.http import http_message
from hostlake.operators.packets import decode_packets, layer_labels, protocol_fanout, tls_record
from hostlake.functions.wire import hex_of

MACS = bytes.fromhex("66778899aabb001122334455")
QUESTION = b"\x03www\x07example\x03com\x00" + bytes.fromhex("00010001")
ANSWER = bytes.fromhex("c00c00010001000000 3c00045db8d822".replace(" ", ""))
DNS = bytes.fromhex("123481800001000100000000") + QUESTION + ANSWER + ANSWER
HTTP = b"POST /submit HTTP/1.1\r\nHost: example.com\r\nA: 1\r\nA: 2\r\nConnection: close\r\n\r\nname=x&y=z"
TLS = bytes.fromhex("16030300050102030405")


def ethernet(kind, payload):
    return MACS + struct.pack(">H", kind) + payload


def ipv4(proto, payload, padding=b""):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 7, 0x4000, 64, proto, 0)
    return ethernet(0x0800, head + bytes([192, 168, 0, 1, 192, 168, 0, 2]) + payload + padding)


def ipv6(proto, payload):
    source, target = bytes.fromhex("20010db8" + "0" * 22 + "01"), bytes.fromhex("20010db8" + "0" * 22 + "02")
    return ethernet(0x86DD, struct.pack(">IHBB", 0x60000000, len(payload), proto, 64) + source + target + payload)


def tcp(payload, options=b""):
    offset = (5 + len(options) // 4) << 4
    return struct.pack(">HHIIBBHHH", 1234, 443, 1, 4_000_000_000, offset, 0x12, 65535, 0, 0) + options + payload


def udp(payload):
    return struct.pack(">HHHH", 5353, 53, 8 + len(payload), 0) + payload


ARP = ethernet(0x0806, struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + MACS[6:] + bytes([10, 0, 0, 1]) + MACS[:6] + bytes([10, 0, 0, 2]))
FRAMES = {
    "dns4": ipv4(17, udp(DNS)),
    "dns6": ipv6(17, udp(DNS)),
    "dns_tcp": ipv4(6, tcp(DNS)),
    "http": ipv4(6, tcp(HTTP)),
    "tls": ipv4(6, tcp(TLS, b"\x01\x01\x01\x00")),
    "udp_http": ipv4(17, udp(HTTP)),
    "icmp4": ipv4(1, bytes.fromhex("0800f7ff00000000")),
    "icmp6": ipv6(58, bytes.fromhex("8000000000000000")),
    "igmp": ipv4(2, b"\x00" * 8),
    "igmp6": ipv6(2, b"\x00" * 8),
    "icmp6_on_4": ipv4(58, b"\x00" * 8),
    "arp": ARP,
    "short": b"\x00" * 5,
    "empty_tcp": ipv4(6, tcp(b""), padding=b"\x00" * 6),
    "cut_tcp": ipv4(6, b"\x00" * 12),
    "cut_ip": ethernet(0x0800, b"\x45" * 10),
    "zero": b"\x00" * 14,
}
LABELS = {
    "dns4": ("ethernet", "ipv4", "udp", "dns"),
    "dns6": ("ethernet", "ipv6", "udp", "dns"),
    "dns_tcp": ("ethernet", "ipv4", "tcp", "dns"),
    "http": ("ethernet", "ipv4", "tcp", "http"),
    "tls": ("ethernet", "ipv4", "tcp", "tls"),
    "udp_http": ("ethernet", "ipv4", "udp", None),
    "icmp4": ("ethernet", "ipv4", "icmp", None),
    "icmp6": ("ethernet", "ipv6", "icmp", None),
    "igmp": ("ethernet", "ipv4", None, None),
    "igmp6": ("ethernet", "ipv6", None, None),
    "icmp6_on_4": ("ethernet", "ipv4", None, None),
    "arp": ("ethernet", "arp", None, None),
    "short": (None, None, None, None),
    "empty_tcp": ("ethernet", "ipv4", "tcp", None),
    "cut_tcp": ("ethernet", "ipv4", None, None),
    "cut_ip": ("ethernet", None, None, None),
    "zero": ("ethernet", None, None, None),
}


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(name, "eth0", datetime(2024, 1, 1), bytearray(frame)) for name, frame in FRAMES.items()]
    frames = spark.createDataFrame(rows, "packet_id string, interface string, created_at timestamp_ntz, frame binary")
    return decode_packets(frames).cache()


def one(wide, name, layer):
    return wide.where(F.col("_id") == name).select(f"{layer}.*").first().asDict()


def test_labels_of_every_frame(wide):
    labels = layer_labels(wide)
    got = {r[0]: tuple(r)[1:] for r in wide.select("_id", *labels.values()).collect()}
    assert got == LABELS


def test_no_frame_is_lost_and_lengths_are_bytes(wide):
    assert {r._id: r.length for r in wide.collect()} == {name: len(frame) for name, frame in FRAMES.items()}


def test_fields(wide):
    assert one(wide, "zero", "ethernet")["payload_length"] == 0
    assert one(wide, "arp", "ethernet") == {"source": "00:11:22:33:44:55", "destination": "66:77:88:99:aa:bb", "ether_type": 2054, "payload_length": 28}
    assert one(wide, "arp", "arp")["target_proto_addr"] == "10.0.0.2"
    v4 = one(wide, "http", "ipv4")
    assert (v4["source"], v4["ttl"], v4["flags"], v4["fragment_offset"], v4["header_length"]) == ("192.168.0.1", 64, 2, 0, 5)
    v6 = one(wide, "dns6", "ipv6")
    assert (v6["version"], v6["source"], v6["destination"], v6["next_header"]) == (6, "2001:db8::1", "2001:db8::2", 17)
    segment = one(wide, "tls", "tcp")
    assert (segment["source"], segment["acknowledgement"], segment["data_offset"], segment["flags"], segment["options"]) == (1234, 4_000_000_000, 6, 18, "01010100")
    assert one(wide, "empty_tcp", "tcp")["options"] == ""
    assert one(wide, "icmp6", "icmp") == {"version": 6, "type": 128, "code": 0, "checksum": 0, "payload_length": 4}
    assert one(wide, "tls", "tls") == {"content_type": 22, "version": 771, "length": 5}


def test_dns_sections(wide):
    dns = wide.where("_id = 'dns4'").select("dns.*").first()
    assert bytes(dns.questions[0].qname) == b"\x03www\x07example\x03com\x00"
    assert (dns.questions[0].qtype, dns.questions[0].qclass) == ("A", "IN")
    # The header announces one of the two records.
    assert [(r.origin, r.name_tag, r.ttl, list(r.rdata)) for r in dns.records] == [(0, 0xC00C, 60, [93, 184, 216, 34])]
    assert dns.header.is_recursion_available == 1 and dns.header.id == 0x1234


def messages(spark, payloads):
    frame = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, p binary")
    return [r.dns for r in with_dns(frame, "p").orderBy("i").collect()]


def test_dns_refusals_and_odd_records(spark):
    header = bytes.fromhex("000181800001000000000001")
    root_option = bytes.fromhex("0000290500000000000000")  # 11 bytes: too short for a record
    unknown = bytes.fromhex("c00cfde8000900000001000100")[:-1] + b"\x07"
    got = messages(
        spark,
        [
            b"\x00" * 10,
            bytes.fromhex("0001818010230000000000 00".replace(" ", "")) + QUESTION,
            header + QUESTION + root_option,
            header + QUESTION + unknown,
            header[:5] + b"\x01\x00\x01" + header[8:] + QUESTION + ANSWER[:-1],
            header + QUESTION[:-3],
        ],
    )
    assert got[0] is None and got[1] is None and got[4] is None and got[5] is None
    assert got[2].records == [] and len(got[2].questions) == 1
    assert [(r.origin, r.rtype, r.rclass, list(r.rdata)) for r in got[3].records] == [(1, "TYPE65000", "CLASS9", [7])]


def test_dns_is_decoded_in_one_stage(spark):
    """Each stage copies the wide row; one message is one expression."""
    frame = spark.createDataFrame([(0, bytearray(DNS))], "i int, p binary")
    plan = with_dns(frame, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1


def test_dns_length_prefix_option(spark):
    rows = [("p", "e", datetime(2024, 1, 1), bytearray(ipv4(6, tcp(struct.pack(">H", len(DNS)) + DNS))))]
    frames = spark.createDataFrame(rows, "packet_id string, interface string, created_at timestamp_ntz, frame binary")
    assert decode_packets(frames).where("dns is not null").count() == 0
    assert decode_packets(frames, tcp_length_prefix=True).where("dns is not null").count() == 1


def test_http_messages(spark):
    payloads = [
        HTTP,
        b"HTTP/2 304 Not  Modified\r\n\r\n",
        b"get /x http/1.0\r\n",
        b"POST /submit HTTP/1.1\r\nHost: example.com",
        b"GET / HTTP/1.1\r\nno colon\r\n\r\n",
        b"FETCH / HTTP/1.1\r\n\r\n",
        b"GET /\r\n\r\n",
        b"HTTP/1.1 99999 x\r\n\r\n",
        b"\r\nGET / HTTP/1.1\r\n\r\n",
        b"\xff\xfe\r\n\r\n",
        b"",
        "GET /é HTTP/3\r\nK:\tv \r\n\r\nbödy\r\n\r\nmore".encode(),
    ]
    frame = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, p binary")
    got = [r.m for r in frame.select("i", http_message(F.col("p")).alias("m")).orderBy("i").collect()]
    assert (got[0].type, got[0].method, got[0].uri, got[0].version, got[0].body) == ("request", "post", "/submit", "HTTP/1.1", "name=x&y=z")
    assert got[0].headers == {"Host": "example.com", "A": "2", "Connection": "close"}
    assert (got[1].type, got[1].status_code, got[1].status_text, got[1].headers, got[1].body) == ("response", 304, "Not Modified", {}, "")
    assert (got[2].method, got[2].version, got[2].body) == ("get", "HTTP/1.0", "")
    assert got[3:11] == [None] * 8
    assert (got[11].uri, got[11].headers, got[11].body) == ("/é", {"K": "v"}, "bödy\r\n\r\nmore")


def test_tls_refusals(spark):
    payloads = [TLS, b"\xff" + TLS[1:], b"\x16\xff\xff\x00\x05", b"\x16\x03\x03\x00", b"\x14\x00\x02\x00\x01"]
    frame = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, p binary")
    records = frame.select("i", hex_of(F.col("p"), 5).alias("h")).select("i", tls_record("h").alias("t"))
    got = [r.t and tuple(r.t) for r in records.orderBy("i").collect()]
    assert got == [(22, 771, 5), None, None, None, (20, 2, 1)]


def test_fanout_tables(wide):
    tables = protocol_fanout(wide, F.lit("2024-01-02").cast("timestamp_ntz"))
    counts = {name.removeprefix("bronze_network_"): df.count() for name, df in tables.items()}
    assert counts == {
        "packet": 17, "ethernet": 16, "ipv4": 10, "ipv6": 3, "arp": 1, "tcp": 4, "udp": 3, "icmp": 2, "tls": 1,
        "dns_header": 3, "dns_query": 3, "dns_response": 3, "http": 1,
    }
    with pytest.raises(ValueError):
        packets.protocol_rows(wide, "quic")
