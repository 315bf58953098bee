"""Change-driven refresh over several days: costs follow what is new, runs that broke off are made up for."""

import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hostlake.operators import interval_join
from hostlake.operators.packets import decode_packets
from hostlake.plans import changes, frames, gold, silver
from hostlake.schemas import TABLES, conform
from hostlake.sources.lake import Lake
from workload.fixtures import REFRESHES, fixture, three_days
from workload.queries import bronze_tables, days_lake, load_day

LATER = "2024-01-05 00:00:00"


@pytest.fixture(scope="module")
def lake(spark, sf_dir):
    """Two days, loaded and refreshed."""
    return days_lake(spark, sf_dir, "test", days=2)


def files_under(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*") if p.is_file()}


def counts(lake):
    names = {n: lake.read(n).count() for n in gold.COUNTED_TABLES if not n.startswith("bronze_network_") or n.endswith("interface")}
    return names | {n: df.count() for n, df in frames.frame_tables(lake).items()}


def stored_counts(lake):
    return {r["name"]: r["last_count"] for r in lake.read("gold_tech_table_count").collect()}


def test_counts_of_writes_are_the_rows_there(lake):
    found = stored_counts(lake)
    assert len(found) == 40
    assert found == counts(lake)


def test_a_refresh_without_news_writes_nothing(lake):
    before = files_under(lake.root)
    changes.refresh(lake, LATER)
    assert files_under(lake.root) == before


def test_a_replayed_load_changes_nothing(spark, sf_dir, lake):
    before = {n: df.count() for n, df in frames.frame_tables(lake).items()}
    load_day(lake, spark, sf_dir, 1, three_days(spark, sf_dir))
    assert {n: df.count() for n, df in frames.frame_tables(lake).items()} == before
    changes.refresh(lake, LATER)
    assert changes.refreshed_until(lake) == datetime.fromisoformat(REFRESHES[1])


def test_times_have_to_grow(spark, sf_dir, lake):
    with pytest.raises(ValueError):
        changes.refresh_gold(lake, REFRESHES[1])


def test_a_broken_run_is_made_up_for_without_reading_old_days(spark, sf_dir, tmp_path, monkeypatch):
    """The third day's first run stops in gold; old days are unreadable when the second run comes."""
    lake = Lake(spark, str(tmp_path / "lake"))
    sources = three_days(spark, sf_dir)
    for number, as_of in enumerate(REFRESHES[:2]):
        load_day(lake, spark, sf_dir, number, sources)
        changes.refresh(lake, as_of)
    load_day(lake, spark, sf_dir, 2, sources)

    def stops(*_, **__):
        raise RuntimeError("power cut")

    with monkeypatch.context() as broken:
        broken.setattr(changes, "_technical", stops)
        with pytest.raises(RuntimeError):
            changes.refresh(lake, REFRESHES[2])
    before = {n: lake.read(n).count() for n in TABLES if n.startswith(("silver_", "gold_fact_"))}
    kept = {}
    for path in Path(lake.root).rglob("period=2024-01-01/*.parquet"):
        # Sockets last seen on the first day live on: stored packets since then are attributed anew.
        if {"gold_fact_process_network", "gold_fact_network_ip"} & set(path.parts):
            continue
        kept[path] = path.read_bytes()
        os.chmod(path, 0o644)
        path.write_bytes(b"unreadable")
        Path(path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert len(kept) > 10
    with pytest.raises(Exception):
        lake.read("silver_process_list").agg(F.sum("pid")).collect()
    changes.refresh(lake, "2024-01-03 23:59:30")
    for path, content in kept.items():
        path.write_bytes(content)
    for name, rows in before.items():
        found = lake.read(name)
        assert found.count() == rows == found.select(*TABLES[name].key).distinct().count(), name
    assert stored_counts(lake) == counts(lake)


def test_a_key_that_comes_again_replaces_its_row(spark, lake):
    fact = lake.read("gold_fact_process")
    old = fact.where(F.to_date("inserted_at") == "2024-01-02").limit(1).collect()[0]
    rows, held = fact.count(), set(lake.periods("gold_fact_process"))
    again = spark.createDataFrame([("again", old.pid, old.started_at, old.created_at, 99.5)], "_id string, pid long, lstart timestamp_ntz, created_at timestamp_ntz, pcpu float")
    lake.add("silver_process_list", again.withColumn("inserted_at", F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")), datetime(2024, 1, 6).date())
    changes.refresh_gold(lake, "2024-01-06 00:00:10")
    after = lake.read("gold_fact_process")
    same = after.where((F.col("pid") == old.pid) & (F.col("started_at") == F.lit(old.started_at)) & (F.col("created_at") == F.lit(old.created_at))).collect()
    assert [(r.pcpu, r.inserted_at) for r in same] == [(99.5, datetime(2024, 1, 6, 0, 0, 10))]
    assert after.count() == rows and set(lake.periods("gold_fact_process")) == held | {datetime(2024, 1, 6).date()}
    assert stored_counts(lake)["gold_fact_process"] == rows


def test_dns_from_decoded_rows_equals_the_joined_table(spark, sf_dir):
    joined = silver.refresh_silver(bronze_tables(spark, sf_dir), REFRESHES[0])["silver_network_dns"]
    inserted = F.col("created_at") + F.make_dt_interval(secs=F.lit(1))
    decoded = silver.silver_from_decoded(decode_packets(fixture(spark, sf_dir, "frames")), inserted, REFRESHES[0])["silver_network_dns"]
    one, two = (conform(df, "silver_network_dns").drop("_id") for df in (joined, decoded))
    assert one.count() == two.count() > 0
    assert one.exceptAll(two).count() == 0
    assert decoded.select("_id").distinct().count() == decoded.count()


def test_attributions_known_are_not_compared_with_the_new_ones(spark, sf_dir, tmp_path, monkeypatch):
    """The third day's attributions are new by their making, and a packet that comes again still gets none twice."""
    lake, name = days_lake(spark, sf_dir, "compared", days=2), "gold_fact_process_network"
    compared, real = [], changes.without_keys
    monkeypatch.setattr(changes, "without_keys", lambda df, other, keys: compared.append(list(keys)) or real(df, other, keys))
    load_day(lake, spark, sf_dir, 2, three_days(spark, sf_dir))
    changes.refresh(lake, REFRESHES[2])
    key = list(TABLES[name].key)
    assert key not in compared
    rows = lake.read(name)
    assert rows.count() == rows.select(*key).distinct().count()
    packet = rows.limit(1).collect()[0].packet_id
    later = F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")
    for silver_name in ("silver_network_packet", "silver_network_ip", "silver_network_transport"):
        old = lake.read(silver_name).where(F.col("_id" if "_id" in lake.read(silver_name).columns else "packet_id") == packet)
        again = spark.createDataFrame(old.collect(), old.schema).withColumn("inserted_at", later)
        lake.add(silver_name, again, datetime(2024, 1, 6).date())
    before = rows.count()
    changes.refresh_gold(lake, "2024-01-06 00:00:10")
    assert key in compared
    after = lake.read(name)
    assert after.count() == after.select(*key).distinct().count() == before


def test_times_that_others_do_not_hold(spark):
    schema = "pid bigint, port int, started_at timestamp_ntz, inserted_at timestamp_ntz"
    second = lambda n, micros=0: datetime(2024, 1, 1, 0, 0, n, micros)
    own = [(1, 5, second(0), second(10)), (1, 5, second(8), second(20)), (2, 5, second(1), second(2)), (None, 5, second(3), second(3)), (4, 5, second(9), second(1))]
    others = [(1, 5, second(4), second(9)), (1, 5, second(9), second(12)), (2, 6, second(0), second(9)), (2, 5, second(0), second(5))]
    found = interval_join.uncovered(spark.createDataFrame(own, schema), spark.createDataFrame(others, schema), ["pid", "port"], "started_at", "inserted_at")
    assert {tuple(r) for r in found.collect()} == {
        (1, 5, second(0), second(3, 999_999)), (1, 5, second(12, 1), second(20)), (None, 5, second(3), second(3)),
    }
