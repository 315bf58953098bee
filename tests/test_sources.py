"""Text sources: listings, open files, lookups, logs, interfaces."""

import pytest
from pyspark.sql import functions as F

from hostlake.functions.clock import as_of_column
from hostlake.sources import interfaces, logs, lookups, open_files, processes

def now():
    return as_of_column("2024-01-01 00:00:00")

LISTING = """  PID  PPID   UID                          STARTED %CPU %MEM STAT COMMAND
    1     0     0 Mon Jan  1 08:01:10 2024  0.1  0.3 Ss   /sbin/boot
  812     1 70000 Tue Jan 16 09:05:12 2024  0.0  1.2 S    /usr/bin/display  :0 -seat s0
 4099   812  1000 Tue Jan 16 10:00:02 2024  0.0  0.1 S    sh
"""
OPEN_FILES = (
    "p163\nclogin\nu501\nfcwd\ntDIR\nD0x1\ns640\ni2\nn/\nftxt\ntREG\nD0x1\ns77\ni99\nn/bin/login x\n"
    "p8015\ncworker\nu0\nf3u\ntIPv4\nn10.0.0.1:80->10.0.0.2:443\n"
)

def lines(spark, text):
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")

def rows(df):
    return sorted(tuple(r) for r in df.collect())

def test_process_snapshot_drops_header_and_joins_arguments(spark):
    snapshot = spark.createDataFrame([(LISTING,)], "snapshot string")
    parsed = processes.parse_process_lines(processes.process_lines(snapshot), now()).orderBy("pid").collect()
    assert [r.pid for r in parsed] == [1, 812, 4099]
    assert parsed[1].command == "/usr/bin/display :0 -seat s0"
    assert (parsed[1].uid, parsed[1].status, str(parsed[1].lstart)) == (70000, "S", "2024-01-16 09:05:12")

def test_process_lines_recognise_the_header_in_any_place(spark):
    parsed = processes.parse_process_lines(lines(spark, LISTING.strip("\n")), now())
    assert parsed.count() == 3

def test_malformed_process_line_fails_or_is_kept_aside(spark):
    bad = lines(spark, "1 0 0 Mon Jan 1 08:01:10 2024 0.1 0.3 S sh\nx 0 0 Mon Jan 1 08:01:10 2024 0.1 0.3 S sh")
    with pytest.raises(Exception, match="malformed process line"):
        processes.parse_process_lines(bad, now()).collect()
    kept = processes.parse_process_lines(bad, now(), mode="permissive")
    assert kept.where("_corrupt is not null").count() == 1
    assert kept.count() == 2
    with pytest.raises(ValueError):
        processes.parse_process_lines(bad, now(), mode="other")

def test_open_files_blocks(spark):
    blob = spark.createDataFrame([(OPEN_FILES,), ("",)], "listing string")
    got = rows(open_files.parse_open_files(blob, now()).drop("created_at"))
    assert got == [
        ("login", 163, 501, "cwd", "DIR", "0x1", 640, "2", "/"),
        ("login", 163, 501, "txt", "REG", "0x1", 77, "99", "/bin/login x"),
        ("worker", 8015, 0, "3u", "IPv4", "", 0, "", "10.0.0.1:80->10.0.0.2:443"),
    ]

def test_open_file_classes(spark):
    regular, network = spark.range(2), spark.range(5)
    sizes = [open_files.open_files_by_class(regular, network, c).count() for c in ("regular", "network", "all")]
    assert sizes == [2, 5, 7]
    with pytest.raises(ValueError):
        open_files.open_files_by_class(regular, network, "none")

def test_hosts_one_row_per_alias_without_repeats(spark):
    text = "127.0.0.1\tlocalhost\n127.0.0.1\tlocalhost loop\n# 1.1.1.1 x\n10.0.0.9\n\n10.0.0.1 a b"
    assert rows(lookups.parse_hosts(lines(spark, text))) == [
        ("a", "10.0.0.1"),
        ("b", "10.0.0.1"),
        ("localhost", "127.0.0.1"),
        ("loop", "127.0.0.1"),
    ]
    assert lookups.parse_hosts(lines(spark, "# only\n# comments")).count() == 0

def test_services(spark):
    text = "web           80/tcp\nweb 80/tcp # again\nntp  123/udp\nwrong eighty/tcp\nline\n# c 1/tcp"
    assert rows(lookups.parse_services(lines(spark, text))) == [("ntp", 123, "udp"), ("web", 80, "tcp")]
    with pytest.raises(Exception, match="port out of range"):
        lookups.parse_services(lines(spark, "big 70000/tcp")).collect()

def test_users(spark):
    assert rows(lookups.parse_users(lines(spark, "# c\n\nann:x:12:100\nbob:x:13:1"))) == [("ann", 12), ("bob", 13)]
    assert rows(lookups.parse_users(lines(spark, "ann:12"), uid_field=2)) == [("ann", 12)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|invalid"):
        lookups.parse_users(lines(spark, "ann:x:none:1")).collect()

def test_users_listing_keeps_blanks_in_names(spark):
    assert rows(lookups.parse_users_listing(lines(spark, "user one   10\n_www 70"))) == [("_www", 70), ("user one", 10)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|invalid"):
        lookups.parse_users_listing(lines(spark, "lonely")).collect()

def test_log_lines_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("row 0\nrow 1\n")
    assert logs.log_lines(spark, str(tmp_path / "in")).count() == 2
    stream = logs.stream_log_lines(spark, str(tmp_path / "in"))

    def run():
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 2
    (tmp_path / "in" / "b.log").write_text("row 2\n")
    grown = run()
    assert rows(grown.select("row")) == [("row 0",), ("row 1",), ("row 2",)]
    assert grown.where(F.col("file").endswith("b.log") & (F.col("date") > 0)).count() == 1

def test_interface_addresses(spark):
    devices = spark.createDataFrame(
        [
            ("eth0", "10.0.0.1", "255.255.255.0", "10.0.0.255", None),
            ("eth0", "10.0.0.1", "255.255.255.0", "10.0.0.255", None),
            ("eth0", "fe80::1", "ffff:ffff:ffff:ffff::", None, None),
            ("lo", "127.0.0.1", None, None, None),
        ],
        "interface string, address string, netmask string, broadcast_address string, destination_address string",
    )
    got = {(r.interface, r.address): r.netmask for r in interfaces.interface_addresses(devices, now()).collect()}
    assert got == {("eth0", "10.0.0.1"): "/24", ("eth0", "fe80::1"): "/64", ("lo", "127.0.0.1"): None}


def test_no_local_folder_off_local_sessions():
    from types import SimpleNamespace

    from workload.scratch import work_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:1"))
    with pytest.raises(ValueError):
        work_folder(cluster, "x")
