"""Edge rows of silver and gold, schemas, retention, lookups, export and repeated refreshes."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hostlake.operators.packets import decode_packets
from hostlake.plans import gold, lifecycle, silver
from hostlake.schemas import TABLES, conform, empty, tables_of
from hostlake.sources.lake import Lake
from workload.fixtures import AS_OF, fixture
from workload.queries import bronze_tables, fill_bronze

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def open_files(spark, rows):
    """rows: (pid, type, name, seconds) -> silver open files."""
    data = [(f"r{i}", "cmd", p, 0, "3u", t, "", 0, str(i), n, at(s), at(s + 1)) for i, (p, t, n, s) in enumerate(rows)]
    schema = (
        "_id string, command string, pid bigint, uid int, fd string, type string, device string, size bigint, "
        "node string, name string, created_at timestamp_ntz, inserted_at timestamp_ntz"
    )
    bronze = spark.createDataFrame(data, schema)
    bronze = bronze.withColumn("brz_ingestion_duration", F.col("inserted_at") - F.col("created_at"))
    return silver.silver_open_files(bronze, at(100))


def lookups(spark):
    hosts = spark.createDataFrame([("Web-1", "10.0.0.7"), ("db", "10.0.0.8"), ("DB", "10.0.0.9")], "name string, address string")
    services = spark.createDataFrame(
        [("https", 443, "tcp"), ("HTTPS", 443, "udp"), ("dual", 7, "tcp"), ("dual", 8, "udp")], "name string, port int, protocol string"
    )
    return hosts, services


def test_the_registry_holds_42_tables(spark):
    assert len(TABLES) == 42
    assert [len(tables_of(layer)) for layer in ("bronze", "silver", "gold")] == [16, 9, 17]
    for table in TABLES.values():
        assert set(table.key) <= set(table.schema.names), table.name
        assert "inserted_at" in table.schema.names


def test_retention_covers_37_tables_or_25():
    assert len(lifecycle.retention_plan({"bronze": 15, "silver": 30, "gold": 1000})) == 37
    plan = lifecycle.retention_plan({"bronze": 15, "silver": 30, "gold": 0})
    assert len(plan) == 25 and not any(name.startswith("gold") for name in plan)


def test_retained_bounds(spark):
    rows = spark.createDataFrame([(1, at(0)), (2, at(5)), (3, None)], "i int, inserted_at timestamp_ntz")
    assert [r.i for r in lifecycle.retained(rows, 10, at(10)).collect()] == [1, 2, 3]
    assert [r.i for r in lifecycle.retained(rows, 10, at(11)).collect()] == [2, 3]
    assert lifecycle.retained(rows, 0, at(9999)).count() == 3


def test_refresh_skips_expired_rows_of_a_partition_in_use(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), unit="year")
    rows = spark.createDataFrame(
        [("old", at(0)), ("new", at(90))], "_id string, inserted_at timestamp_ntz"
    ).withColumn("created_at", F.col("inserted_at"))
    lifecycle.load_bronze(lake, "bronze_process_list", rows)
    lifecycle.run_silver(lake, at(100), retention={"bronze": 15, "silver": 15, "gold": 0})
    assert [r._id for r in lake.read("silver_process_list").collect()] == ["new"]
    assert lake.read("bronze_process_list").count() == 2
    lifecycle.run_silver(lake, at(100))
    assert lake.read("silver_process_list").count() == 2


def test_socket_edge_rows(spark):
    files = open_files(
        spark,
        [
            (1, "IPv4", "*:443->WEB-1:https", 5),
            (1, "IPv4", "*:443->WEB-1:https", 1),
            (2, "ipv6", "[fe80::1]:dual", 2),
            (3, "IPv4", "web-1.local:*->*:*", 3),
            (4, "IPv4", "db:70000", 4),
            (5, "REG", "10.0.0.1:80", 5),
            (6, "IPv4", "no endpoint", 6),
        ],
    )
    got = {r.pid: r for r in gold.gold_dim_network_socket(files, *lookups(spark), at(100)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6]
    assert (got[1].source_address, got[1].source_port, got[1].destination_address, got[1].destination_port) == (None, 443, "10.0.0.7", 443)
    assert got[1].started_at == at(1) and got[1].inserted_at == at(100)
    assert (got[2].source_address, got[2].source_port, got[2].destination_port) == ("fe80::1", 7, None)
    assert (got[3].source_address, got[3].source_port) == ("10.0.0.7", None)
    assert (got[4].source_address, got[4].source_port) == ("10.0.0.8", None)
    assert (got[6].source_address, got[6].source_port) == (None, None)


def test_open_port_ranking_and_its_option(spark):
    files = open_files(
        spark,
        [(1, "IPv4", "1.1.1.1:99", 3), (1, "IPv4", "1.1.1.1:98", 2), (1, "IPv4", "1.1.1.1:https", 4), (1, "IPv4", "1.1.1.1:443", 1),
         (2, "IPv4", "1.1.1.1:*", 1), (2, "IPv4", "1.1.1.1:5", 2), (3, "IPv4", "1.1.1.1:dual", 1)],
    )
    services = lookups(spark)[1]

    def ports(**options):
        rows = gold.gold_dim_network_open_port(files, services, at(100), **options)
        return sorted((r.pid, r.port, int((r.started_at - T0).total_seconds())) for r in rows.collect())

    # Named 443 and unnamed 443 meet in the key (pid, 443); pid 2's first unnamed row has no port.
    assert ports() == [(1, 443, 1), (3, 7, 1), (3, 8, 1)]
    assert ports(dedupe_on="resolved_port") == [(1, 98, 2), (1, 99, 3), (1, 443, 1), (2, 5, 2), (3, 7, 1), (3, 8, 1)]
    with pytest.raises(ValueError):
        gold.gold_dim_network_open_port(files, services, at(100), dedupe_on="port")


def test_foreign_addresses(spark):
    ip = spark.createDataFrame(
        [("10.0.0.1", "8.8.8.8", at(2)), ("8.8.8.8", "255.255.255.255", at(1)), ("ff00::1", "ff00::", at(3)), (None, "9.9.9.9", at(4))],
        "source string, destination string, created_at timestamp_ntz",
    )
    own = spark.createDataFrame([("eth0", "10.0.0.1/24"), ("eth1", None)], "interface string, address string")
    got = {r.address: r.started_at for r in gold.gold_dim_network_foreign_ip(ip, own, own, at(9)).collect()}
    assert got == {"8.8.8.8": at(1), "ff00::1": at(3), "9.9.9.9": at(4), None: at(4)}


def test_attribution_bounds_are_inclusive_and_address_is_not_compared(spark):
    fact = spark.createDataFrame(
        [(f"p{s}", "10.0.0.1", 50, "8.8.8.8", 443, at(s)) for s in (0, 1, 5, 6)] + [("in", "8.8.8.8", 443, "10.0.0.1", 50, at(3)), ("far", "8.8.8.8", 50, "9.9.9.9", 50, at(3))],
        "_id string, source_address string, source_port int, destination_address string, destination_port int, created_at timestamp_ntz",
    )
    own = spark.createDataFrame([("10.0.0.1/24",)], "address string")
    sockets = spark.createDataFrame(
        [(7, "1.2.3.4", 50, at(1), at(5)), (7, "4.3.2.1", 50, at(2), at(5)), (8, None, None, at(0), at(9))],
        "pid bigint, source_address string, source_port int, started_at timestamp_ntz, inserted_at timestamp_ntz",
    )
    owned = gold.gold_fact_process_network(fact, own, sockets, at(9), bucket_seconds=2)
    assert sorted((r.pid, r.packet_id, r.send) for r in owned.collect()) == [(7, "in", False), (7, "p1", True), (7, "p5", True)]


def test_dim_process_keeps_the_latest_row_and_one_command(spark):
    rows = [(1, 0, 0, at(0), "old", at(1), at(1)), (1, 5, 0, at(0), "new", at(2), at(2)), (2, 0, 0, at(0), "x", at(1), at(1))]
    processes = spark.createDataFrame(
        rows, "pid bigint, ppid bigint, uid int, lstart timestamp_ntz, command string, created_at timestamp_ntz, inserted_at timestamp_ntz"
    )
    files = open_files(spark, [(1, "REG", "/a", 1), (1, "REG", "/b", 2)])
    got = {r.pid: (r.ppid, r.full_command, r.command) for r in gold.gold_dim_process(processes, files, at(9)).collect()}
    assert got == {1: (5, "new", "cmd"), 2: (0, "x", None)}


def test_export_formats(spark, tmp_path):
    tables = {t.name: empty(spark, t.name) for t in tables_of("gold")}
    for file_format in ("parquet", "CSV"):
        assert len(lifecycle.export_gold(tables, str(tmp_path), file_format)) == 17
    with pytest.raises(ValueError):
        lifecycle.export_gold(tables, str(tmp_path), "json")


def test_lookups_are_replaced_and_old_versions_stay_readable(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    first = lifecycle.replace_lookups(lake, {"gold_file_host": lookups(spark)[0]}, AS_OF)["gold_file_host"]
    lifecycle.replace_lookups(lake, {"gold_file_host": lookups(spark)[0].limit(1)}, AS_OF)
    assert (first.count(), lake.read("gold_file_host").count()) == (3, 1)
    lake.drop_superseded("gold_file_host")
    assert lake.versions("gold_file_host") == [1, 2] and first.count() == 3
    lake.drop_superseded("gold_file_host", seconds=0)
    assert lake.versions("gold_file_host") == [2]
    with pytest.raises(ValueError):
        lifecycle.replace_lookups(lake, {"gold_dim_process": first}, AS_OF)


def test_refresh_twice_changes_nothing_but_last_seen(spark, sf_dir, tmp_path):
    lake = Lake(spark, str(tmp_path), unit="year")
    fill_bronze(lake, spark, sf_dir)

    def counts():
        return {t.name: lake.read(t.name).count() for t in TABLES.values()}

    lifecycle.final_flush(lake, AS_OF, str(tmp_path / "export"))
    first = counts()
    assert all(first.values()), [n for n, c in first.items() if c == 0]
    fill_bronze(lake, spark, sf_dir)  # the same snapshots once more
    lifecycle.run_silver(lake, AS_OF)
    lifecycle.run_gold(lake, AS_OF)
    second = counts()
    # The host dimension now also sees the facts of the first run.
    assert second.pop("gold_dim_network_host") >= first.pop("gold_dim_network_host")
    assert second == first

    before = lake.read("gold_dim_network_socket").count()
    lifecycle.run_retention(lake, datetime(2030, 1, 1), {"bronze": 15, "silver": 0, "gold": 600})
    assert lake.read("bronze_process_list").count() == 0
    assert lake.read("silver_process_list").count() == first["silver_process_list"]
    assert lake.read("gold_dim_network_socket").count() == 0 < before
    assert lake.read("gold_tech_chrono").count() == 3


def test_facts_are_replaced_over_several_days(spark, tmp_path):
    """One packet a day on a socket that lives on; all defaults, gold kept."""
    lake = Lake(spark, str(tmp_path))
    lifecycle.replace_lookups(lake, dict(zip(("gold_file_host", "gold_file_service"), lookups(spark), strict=True)), T0)
    day = 86400
    for d in range(3):
        now = at(d * day + 100)
        lifecycle.run_gold(lake, now)  # nothing new: nothing may change
        silver_rows = {
            "silver_open_files": open_files(spark, [(1, "IPv4", "10.0.0.1:50->8.8.8.8:443", d * day)]),
            "silver_process_list": spark.createDataFrame([("p1", 1, at(0), at(d * day), now)], "_id string, pid bigint, lstart timestamp_ntz, created_at timestamp_ntz, inserted_at timestamp_ntz"),
            "silver_network_packet": spark.createDataFrame([(f"k{d}", at(d * day + 1), now)], "_id string, created_at timestamp_ntz, inserted_at timestamp_ntz"),
            "silver_network_ip": spark.createDataFrame([(f"k{d}", 4, "10.0.0.1", "8.8.8.8", at(d * day + 1), now)], "_id string, version int, source string, destination string, created_at timestamp_ntz, inserted_at timestamp_ntz"),
            "silver_network_transport": spark.createDataFrame([(f"k{d}", "tcp", 50, 443, at(d * day + 1), now)], "_id string, protocol string, source int, destination int, created_at timestamp_ntz, inserted_at timestamp_ntz"),
        }
        for name, rows in silver_rows.items():
            lake.append(name, rows.withColumn("inserted_at", F.lit(now)))
        lake.replace("silver_network_interface", spark.createDataFrame([("eth0", "10.0.0.1/24", now)], "interface string, address string, inserted_at timestamp_ntz"))
        for later in (now, now + timedelta(seconds=10)):
            lifecycle.run_gold(lake, later)
            for name in ("gold_fact_process_network", "gold_fact_network_ip", "gold_fact_network_packet", "gold_fact_process"):
                rows = lake.read(name)
                assert rows.count() == rows.select(*TABLES[name].key).distinct().count() == d + 1, name
                # Rows still made of what silver holds are replaced, insert time included.
                assert {r.inserted_at for r in rows.collect()} == {later}, name
        old = lake.read("gold_fact_process_network")
        lifecycle.run_retention(lake, now, {"bronze": 0, "silver": 0, "gold": 0})
        assert old.count() == d + 1  # a job that began to read before goes on
    assert max(lake._numbers("gold_fact_process", "batch=")) > 6
    lifecycle.run_retention(lake, now, {"bronze": 0, "silver": 0, "gold": 0}, keep_seconds=0)
    assert len(lake._numbers("gold_fact_process", "batch=")) == 1
    assert lake.read("gold_fact_process_network").count() == 3


def test_refreshes_give_the_columns_of_their_tables(spark, sf_dir):
    silver_tables = silver.refresh_silver(bronze_tables(spark, sf_dir), AS_OF)
    assert set(silver_tables) == {t.name for t in tables_of("silver")}
    hosts, services = lookups(spark)
    gold_tables = lifecycle.refresh_gold(silver_tables, {"gold_file_host": hosts, "gold_file_service": services}, AS_OF)
    assert len(gold_tables) == 12
    for name, df in {**silver_tables, **gold_tables}.items():
        assert set(df.columns) == set(TABLES[name].schema.names), name


def test_decoded_and_joined_silver_agree(spark, sf_dir):
    joined = silver.refresh_silver(bronze_tables(spark, sf_dir), AS_OF)
    inserted = F.col("created_at") + F.make_dt_interval(secs=F.lit(1))
    decoded = silver.silver_from_decoded(decode_packets(fixture(spark, sf_dir, "frames")), inserted, AS_OF)
    for name in ("silver_network_ip", "silver_network_transport", "silver_network_arp", "silver_network_ethernet"):
        one, two = conform(joined[name], name), conform(decoded[name], name)
        assert one.count() == two.count() > 0
        assert one.exceptAll(two).count() == 0, name


def test_conform_orders_and_fills(spark):
    got = conform(spark.range(1).selectExpr("'x' as name"), "gold_file_user")
    assert got.columns == ["name", "uid", "inserted_at"]


def test_new_facts_are_written_by_the_tasks_that_made_them(spark, tmp_path):
    """Attributions may be many times their input: they are not shuffled before they are written."""
    lake = Lake(spark, str(tmp_path / "lake"))
    name, as_of = "gold_fact_process_network", "2024-01-01 10:00:00"
    rows = spark.range(300).select(F.col("id").alias("pid"), F.col("id").cast("string").alias("packet_id"), F.lit(True).alias("send"), F.lit(as_of).cast("timestamp_ntz").alias("inserted_at"))
    lifecycle._write_gold(lake, name, rows.repartition(3), as_of)
    assert len(list(Path(lake.root).rglob("period=2024-01-01/*.parquet"))) == 3
    # Keys that come again replace their rows, others stay.
    later = "2024-01-02 10:00:00"
    again = rows.where("pid < 100").withColumn("inserted_at", F.lit(later).cast("timestamp_ntz"))
    found = lifecycle._write_gold(lake, name, again, later)
    assert found.count() == 300 == found.select("pid").distinct().count()
    assert found.where(F.to_date("inserted_at") == "2024-01-02").count() == 100


def test_counts_of_all_tables_take_one_exchange(spark):
    tables = {name: spark.range(k % 3).select("id") for k, name in enumerate(gold.COUNTED_TABLES)}
    counts = gold.gold_tech_table_count(tables, AS_OF)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["_id"]: (r["name"], r["max_count"], r["last_count"]) for r in counts.collect()} == {k: (n, k % 3, k % 3) for k, n in enumerate(gold.COUNTED_TABLES)}
