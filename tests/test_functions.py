"""Addresses against Python's own implementation, names, ids, clock."""

import ipaddress
import random

from pyspark.sql import functions as F

from hostlake.functions import clock, ids, inet, names


def evaluate(spark, values, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


def samples():
    rng = random.Random(7)
    texts = ["::", "::1", "1::", "fe80::1:2:3:4", "2001:db8:0:0:1:0:0:1", "0:0:1::", "1:0:0:2:0:0:0:3", "ff00::"]
    for _ in range(150):
        groups = [rng.choice([0, 0, 0, rng.randrange(65536)]) for _ in range(8)]
        texts.append(":".join(f"{g:x}" for g in groups))
    texts += [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(50)]
    return [f"{t}/{rng.randrange(129 if ':' in t else 33)}" for t in texts] + texts


def test_inet_against_ipaddress(spark):
    texts = samples()
    address = inet.inet(F.col("v"))
    host, network = inet.inet_host(address), inet.inet_network_host(address)
    got = evaluate(spark, texts, address, host, network, inet.inet_prefix(address), inet.inet_family(address), inet.inet_key(address))
    for text, (canonical, host_text, network_text, prefix, family, key) in zip(texts, got):
        expected = ipaddress.ip_interface(text)
        full = 128 if expected.version == 6 else 32
        length = expected.network.prefixlen
        assert canonical == str(expected.ip) + ("" if length == full else f"/{length}"), text
        assert host_text == str(expected.ip)
        assert network_text == str(expected.network.network_address), text
        assert (prefix, family) == (length, expected.version)
        assert int(key[1:], 16) == int(expected.ip)


def test_inet_refuses_other_text(spark):
    bad = ["", "*", "host", "1.2.3", "1.2.3.256", "1.2.3.4/33", "1:2", "1::2::3", ":::", ":1::2", "1:2:3:4:5:6:7:8:", "g::1", "::1/129", "1:2:3:4:5:6:7:8:9", None]
    assert evaluate(spark, bad, inet.inet(F.col("v"))) == [(None,)] * len(bad)
    assert evaluate(spark, ["::ffff:1.2.3.4", "010.1.1.1"], inet.inet(F.col("v"))) == [("::ffff:102:304",), ("10.1.1.1",)]


def test_netmask_length(spark):
    masks = ["255.255.255.0", "255.255.0.0", "0.0.0.0", "ffff:ffff::", None]
    assert evaluate(spark, masks, inet.netmask_length(F.col("v"))) == [(24,), (16,), (0,), (32,), (None,)]


def test_socket_sides(spark):
    values = ["10.0.0.1:80->[2001:db8::1]:443", "[fe80::1]:22", "*:*", "/var/log/x", "a-b.local:ssh->*:1", ""]
    source, port = names.socket_side(F.col("v"), 1)
    target, target_port = names.socket_side(F.col("v"), 2)
    got = evaluate(spark, values, names.source_host(source), port, names.without_brackets(target), target_port)
    assert got == [
        ("10.0.0.1", "80", "2001:db8::1", "443"),
        ("fe80::1", "22", "", ""),
        ("*", "*", "", ""),
        ("", "", "", ""),
        ("a-b", "ssh", "*", "1"),
        ("", "", "", ""),
    ]


def test_port_number(spark):
    assert evaluate(spark, ["0", "65535", "65536", "-1", "http"], names.port_number(F.col("v"))) == [(0,), (65535,), (None,), (None,), (None,)]


def test_ids_tell_null_from_text(spark):
    frame = spark.createDataFrame([(None, "a"), ("a", None), ("n", "a"), ("", "")], "x string, y string")
    both = frame.select(ids.row_id(F.col("x"), F.col("y")).alias("r"), ids.entity_id(F.col("x"), F.col("y")).alias("e"))
    assert len({r.r for r in both.collect()}) == 4
    assert len({r.e for r in both.collect()}) == 4


def test_clock(spark):
    frame = spark.range(1).select(
        clock.from_epoch_millis(F.lit(1500)).alias("ms"), clock.from_epoch_seconds(F.lit(1)).alias("s")
    )
    row = frame.select("ms", "s", clock.micros_between(F.col("s"), F.col("ms")).alias("us"), clock.interval_micros(F.col("ms") - F.col("s")).alias("iv")).first()
    assert (str(row.ms), str(row.s), row.us, row.iv) == ("1970-01-01 00:00:01.500000", "1970-01-01 00:00:01", 500000, 500000)
