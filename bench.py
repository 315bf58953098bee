"""Headline timings over stored tables; prints one JSON line.

The bronze tables (and raw listings and frames) are first written from the test tables, as the feeds
would leave them; that is not timed. Each entry is then run to the end, reading from storage.
A refresh runs every few seconds in one long-lived session, so the session is first warmed up with an
untimed refresh of the smallest tables (BENCH_WARM_UP=0 leaves that out).
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

from hostlake.operators import packets
from hostlake.plans import changes, frames, gold, lifecycle, silver
from hostlake.schemas import tables_of
from hostlake.session import build_session
from hostlake.sources import open_files
from hostlake.sources.lake import Lake
from workload.fixtures import AS_OF, LOADED, fixture
from workload.queries import fill_bronze


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    # The test tables spread few rows over seven years.
    lake = Lake(spark, f"{folder}/lake", unit="year")
    smallest = Path(sf_dir).parent / "sf0.001"
    if os.environ.get("BENCH_WARM_UP", "1") != "0" and smallest.exists():
        warm = Lake(spark, f"{folder}/warm", unit="year")
        fill_bronze(warm, spark, str(smallest))
        lifecycle.run_silver(warm, AS_OF)
        lifecycle.run_gold(warm, AS_OF)
    fill_bronze(lake, spark, sf_dir)
    for raw in ("frames", "raw_open_files"):
        fixture(spark, sf_dir, raw).repartition(int(cpus)).write.parquet(f"{folder}/{raw}")

    captured = Lake(spark, f"{folder}/captured")
    frames.load_frames(captured, spark.read.parquet(f"{folder}/frames"), LOADED)

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def stored(name: str):
        return lake.read(name)

    def labels() -> None:
        net = {t.name.removeprefix("bronze_network_"): stored(t.name) for t in tables_of("bronze")}
        run(silver.silver_network_packet(net["packet"], net, AS_OF))

    def process_network(**options) -> None:
        owned = gold.gold_fact_process_network(
            stored("gold_fact_network_ip"),
            stored("gold_dim_network_interface"),
            stored("gold_dim_network_socket"),
            AS_OF,
            **options,
        )
        run(owned.groupBy("pid", "send").agg(F.count(F.lit(1)).alias("packets")))

    def dim_process() -> None:
        run(gold.gold_dim_process(stored("silver_process_list"), stored("silver_open_files"), AS_OF))

    def dim_socket() -> None:
        files = stored("silver_open_files")
        run(gold.gold_dim_network_socket(files, stored("gold_file_host"), stored("gold_file_service"), AS_OF))

    def decode() -> None:
        run(packets.decode_packets(spark.read.parquet(f"{folder}/frames")))

    def listings() -> None:
        raw = spark.read.parquet(f"{folder}/raw_open_files").select("listing")
        run(open_files.parse_open_files(raw, F.lit(AS_OF).cast("timestamp_ntz")))

    # The refreshes come first: what they write is what the single queries read.
    jobs = {
        "silver_refresh": lambda: lifecycle.run_silver(lake, AS_OF),
        "gold_refresh": lambda: lifecycle.run_gold(lake, AS_OF),
        "packet_labels": labels,
        "process_network": process_network,
        "process_network_salted": lambda: process_network(salts=4),
        "dim_process": dim_process,
        "dim_socket": dim_socket,
        "decode_frames": decode,
        "parse_open_files": listings,
        # Change-driven: the six silver tables of all packets from stored frames, and a run that finds nothing new.
        "silver_from_frames": lambda: changes.refresh_silver(captured, AS_OF),
        "silver_nothing_new": lambda: changes.refresh_silver(captured, AS_OF),
    }
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "telemetry_refresh_and_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
