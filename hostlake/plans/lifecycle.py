"""Running the layers over a lake: refresh, retention, lookup reload, export."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.functions.clock import AsOf, as_of_column
from hostlake.functions.inet import inet_host
from hostlake.operators.keyed import (
    delete_matching,
    new_rows,
    upsert_combine,
    upsert_ignore,
    upsert_replace,
    upsert_touch,
    without_keys,
)
from hostlake.plans import gold, silver
from hostlake.plans.moments import moment
from hostlake.schemas import TABLES, conform, tables_of
from hostlake.sources.lake import KEEP_SECONDS, Lake, is_versioned

# Default retention in seconds per layer; 0 keeps everything.
RETENTION_SECONDS = {"bronze": 15, "silver": 15, "gold": 600}
# Default seconds between runs of each job; 0 turns a job off.
REFRESH_SECONDS = {"silver": 10, "gold": 10, "vacuum": 15, "file": 300, "export": 60}
EXPORT_FORMATS = ("parquet", "csv")
#: CSV keeps microseconds; read exports with this timestampNTZFormat.
CSV_TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: Writes at once where all tables are refreshed or exported. The plans of many writes, and a thread for each of their
#: exchanges, would be on the driver together.
FLUSH_WORKERS = 1

# Dimensions whose rows keep what was first seen and only get a new last-seen time.
_TOUCHED = (
    "gold_dim_file_reg",
    "gold_dim_network_interface",
    "gold_dim_network_socket",
    "gold_dim_network_open_port",
    "gold_dim_network_foreign_ip",
)
_CHRONO_MAX = ("brz_max_ingest", "svr_max_ingest", "max_ingest")
_CHRONO_MIN = ("brz_min_ingest", "svr_min_ingest", "min_ingest")


def merge_gold(name: str, existing: DataFrame, new: DataFrame) -> DataFrame:
    """Resulting rows of a versioned gold table under its write rule."""
    keys = TABLES[name].key
    if name in _TOUCHED:
        return upsert_touch(existing, new, keys, ["started_at"])
    if name == "gold_tech_table_count":
        return upsert_combine(existing, new, keys, greatest=["max_count"], latest=["name", "last_count", "inserted_at"])
    if name == "gold_tech_chrono":
        return upsert_combine(existing, new, keys, greatest=_CHRONO_MAX, least=_CHRONO_MIN, latest=["inserted_at"])
    return upsert_replace(existing, new, keys)


def refresh_gold(
    silver_tables: Mapping[str, DataFrame],
    lookups: Mapping[str, DataFrame],
    as_of: AsOf,
    previous_fact_ip: DataFrame | None = None,
    bucket_seconds: int = 3600,
    salts: int = 1,
) -> dict[str, DataFrame]:
    """The dimensions and facts out of silver and lookup tables, by table name.

    Hosts are gathered from the ``previous_fact_ip`` of the run before, as the host dimension runs
    before the fact; without it they are gathered from this run's fact.
    """
    files, ip = silver_tables["silver_open_files"], silver_tables["silver_network_ip"]
    hosts, services = lookups["gold_file_host"], lookups["gold_file_service"]
    interfaces = silver_tables["silver_network_interface"]
    dim_interface = gold.gold_dim_network_interface(interfaces, as_of)
    dim_socket = gold.gold_dim_network_socket(files, hosts, services, as_of)
    foreign = gold.gold_dim_network_foreign_ip(ip, interfaces, dim_interface, as_of)
    fact_ip = gold.gold_fact_network_ip(
        silver_tables["silver_network_transport"], ip, silver_tables["silver_network_packet"], as_of
    )
    host_source = fact_ip if previous_fact_ip is None else previous_fact_ip
    return {
        "gold_dim_process": gold.gold_dim_process(silver_tables["silver_process_list"], files, as_of),
        "gold_dim_file_reg": gold.gold_dim_file_reg(files, as_of),
        "gold_dim_network_interface": dim_interface,
        "gold_dim_network_socket": dim_socket,
        "gold_dim_network_open_port": gold.gold_dim_network_open_port(files, services, as_of),
        "gold_dim_network_foreign_ip": foreign,
        "gold_dim_network_host": gold.gold_dim_network_host(dim_socket, foreign, host_source, dim_interface, as_of),
        "gold_fact_process": gold.gold_fact_process(silver_tables["silver_process_list"], as_of),
        "gold_fact_file_reg": gold.gold_fact_file_reg(files, as_of),
        "gold_fact_network_packet": gold.gold_fact_network_packet(silver_tables["silver_network_packet"], as_of),
        "gold_fact_network_ip": fact_ip,
        "gold_fact_process_network": gold.gold_fact_process_network(
            fact_ip, dim_interface, dim_socket, as_of, bucket_seconds, salts
        ),
    }


def in_parallel(jobs: dict, workers: int = 3) -> dict:
    """Run independent table writes at once, so that a small table does not wait for a large one.

    Each write under way holds its plan, and a thread for each of its exchanges, on the driver.
    """
    with ThreadPoolExecutor(workers) as pool:
        futures = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: future.result() for name, future in futures.items()}


def _oldest_day(lake: Lake, layer: str) -> date | None:
    days = [day for t in tables_of(layer) if not is_versioned(t.name) for day in lake.periods(t.name)]
    return min(days, default=None)


def load_bronze(lake: Lake, name: str, rows: DataFrame) -> DataFrame:
    """Add parsed rows to a bronze table; rows that are there already are ignored.

    Loading the same snapshot again changes nothing. Interfaces are known by (interface, address).
    """
    incoming = conform(rows, name)
    if is_versioned(name):
        return lake.replace(name, upsert_ignore(lake.read(name), incoming, TABLES[name].key))
    return lake.append(name, new_rows(lake.read(name), incoming, TABLES[name].key))


def _read_retained(lake: Lake, layer: str, as_of: AsOf, retention: Mapping[str, int] | None) -> dict[str, DataFrame]:
    """Tables of a layer without the rows that have expired but are still in a partition in use."""
    seconds = retention_plan(retention) if retention else {}
    return {t.name: retained(lake.read(t.name), seconds.get(t.name, 0), as_of) for t in tables_of(layer)}


def run_silver(lake: Lake, as_of: AsOf, retention: Mapping[str, int] | None = None) -> None:
    """One silver refresh: rows of the retained bronze layer whose key silver does not hold yet."""
    bronze = _read_retained(lake, "bronze", as_of, retention)
    oldest_day = _oldest_day(lake, "bronze")

    def job(name: str, df: DataFrame):
        def write() -> None:
            rows = conform(df, name)
            if is_versioned(name):
                lake.replace(name, upsert_ignore(lake.read(name), rows, TABLES[name].key))
            else:
                # A silver row is inserted after its bronze row: older days cannot hold its key. And
                # bronze holds each key once (``load_bronze``), so these rows do too.
                known = lake.read_since(name, oldest_day)
                lake.append(name, new_rows(known, rows, TABLES[name].key, unique=True))

        return write

    in_parallel({name: job(name, df) for name, df in silver.refresh_silver(bronze, as_of).items()}, FLUSH_WORKERS)


def _write_gold(lake: Lake, name: str, df: DataFrame, as_of: AsOf, first_day: date | None = None) -> DataFrame:
    """Merge new rows into a gold table under its write rule.

    Rows of facts replace those of the same key, insert time included. They are made of rows inserted on
    ``first_day`` or later, and a fact is inserted after what it is made of, so older periods cannot hold
    their keys and stay as they are.
    """
    rows = conform(df, name)
    if is_versioned(name):
        return lake.replace(name, merge_gold(name, lake.read(name), rows))
    covered = [p for p in lake.periods(name) if first_day is None or p >= lake.period_of(first_day)]
    # Facts hold each key once by the way they are made. Attributions may be many times the rows they are made
    # of: all of them carry the time of the run, so they are written where they are made.
    others = without_keys(lake.read_since(name, first_day), rows, TABLES[name].key) if covered else None
    if isinstance(as_of, Column):
        return lake.rewrite(name, rows if others is None else others.unionByName(rows), covered)
    return lake.rewrite(name, others, covered, fresh=rows, day=moment(as_of).date())


def run_gold(
    lake: Lake,
    as_of: AsOf,
    bucket_seconds: int = 3600,
    salts: int = 1,
    retention: Mapping[str, int] | None = None,
) -> None:
    """One gold refresh. Every table is written before the next stage reads it back."""
    silver_tables = _read_retained(lake, "silver", as_of, retention)
    lookups = {n: lake.read(n) for n in ("gold_file_host", "gold_file_service", "gold_file_user")}
    files, processes = silver_tables["silver_open_files"], silver_tables["silver_process_list"]
    packets, ip = silver_tables["silver_network_packet"], silver_tables["silver_network_ip"]
    interfaces, transport = silver_tables["silver_network_interface"], silver_tables["silver_network_transport"]
    services = lookups["gold_file_service"]
    previous_fact_ip = lake.read("gold_fact_network_ip")

    first = {
        "gold_dim_process": gold.gold_dim_process(processes, files, as_of),
        "gold_dim_file_reg": gold.gold_dim_file_reg(files, as_of),
        "gold_dim_network_interface": gold.gold_dim_network_interface(interfaces, as_of),
        "gold_dim_network_socket": gold.gold_dim_network_socket(files, lookups["gold_file_host"], services, as_of),
        "gold_dim_network_open_port": gold.gold_dim_network_open_port(files, services, as_of),
        "gold_fact_process": gold.gold_fact_process(processes, as_of),
        "gold_fact_file_reg": gold.gold_fact_file_reg(files, as_of),
        "gold_fact_network_packet": gold.gold_fact_network_packet(packets, as_of),
        "gold_fact_network_ip": gold.gold_fact_network_ip(transport, ip, packets, as_of),
    }
    day = _oldest_day(lake, "silver")
    written = in_parallel({n: (lambda n=n, df=df: _write_gold(lake, n, df, as_of, day)) for n, df in first.items()}, FLUSH_WORKERS)
    dim_interface, dim_socket = written["gold_dim_network_interface"], written["gold_dim_network_socket"]
    foreign = _write_foreign_ip(
        lake, gold.gold_dim_network_foreign_ip(ip, interfaces, dim_interface, as_of), dim_interface
    )
    second = {
        "gold_dim_network_host": gold.gold_dim_network_host(
            dim_socket, foreign, previous_fact_ip, dim_interface, as_of
        ),
        "gold_fact_process_network": gold.gold_fact_process_network(
            written["gold_fact_network_ip"], dim_interface, dim_socket, as_of, bucket_seconds, salts
        ),
    }
    # Attributions are made of all packets that gold still holds, not only of those in silver.
    packet_day = min(lake.periods("gold_fact_network_ip"), default=None)
    in_parallel({n: (lambda n=n, df=df: _write_gold(lake, n, df, as_of, packet_day)) for n, df in second.items()}, FLUSH_WORKERS)
    counted = {name: lake.read(name) for name in gold.COUNTED_TABLES}
    technical = {
        "gold_tech_table_count": gold.gold_tech_table_count(counted, as_of),
        "gold_tech_chrono": gold.gold_tech_chrono(silver_tables, as_of),
    }
    in_parallel({n: (lambda n=n, df=df: _write_gold(lake, n, df, as_of)) for n, df in technical.items()}, FLUSH_WORKERS)


def _write_foreign_ip(lake: Lake, new: DataFrame, dim_interface: DataFrame) -> DataFrame:
    """Merge, then drop addresses that have meanwhile become an own interface."""
    name = "gold_dim_network_foreign_ip"
    merged = merge_gold(name, lake.read(name), conform(new, name))
    host = inet_host(F.col("address"))
    return lake.replace(name, delete_matching(merged, dim_interface, host, host))


def replace_lookups(lake: Lake, lookups: Mapping[str, DataFrame], as_of: AsOf) -> dict[str, DataFrame]:
    """Reload services, hosts and users: each becomes a new version of its whole table."""
    for name in lookups:
        if not name.startswith("gold_file_"):
            raise ValueError(f"{name} is no lookup table")
    stamped = {name: df.withColumn("inserted_at", as_of_column(as_of)) for name, df in lookups.items()}
    return in_parallel({n: (lambda n=n, df=df: lake.replace(n, df)) for n, df in stamped.items()})


def retained(df: DataFrame, seconds: int, as_of: AsOf) -> DataFrame:
    """Rows that retention keeps: not older than ``seconds`` at ``as_of``; 0 keeps all."""
    if seconds == 0:
        return df
    expiry = F.col("inserted_at") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    # Rows without an insert time are compared with nothing and stay.
    return df.where(F.coalesce(expiry >= as_of_column(as_of), F.lit(True)))


def retention_plan(seconds: Mapping[str, int] = RETENTION_SECONDS) -> dict[str, int]:
    """Seconds per table that retention applies to."""
    return {t.name: seconds[t.layer] for t in TABLES.values() if t.expires and seconds.get(t.layer, 0) > 0}


def run_retention(
    lake: Lake, as_of: datetime, seconds: Mapping[str, int] = RETENTION_SECONDS, keep_seconds: float = KEEP_SECONDS
) -> None:
    """Apply retention to storage, to the row.

    Versioned tables are rewritten without expired rows. Growing tables lose the partitions whose last row has expired,
    and of the partition in which the limit falls the rows before it; no other partition is opened.
    """

    def expire(name: str, keep: int) -> None:
        limit = as_of - timedelta(seconds=keep)
        if is_versioned(name):
            if lake.versions(name):
                lake.replace(name, retained(lake.read(name), keep, as_of))
            return
        lake.drop_before(name, limit.date())
        boundary = lake.period_of(limit.date())
        if boundary in lake.periods(name):
            lake.keep_rows(name, boundary, F.coalesce(F.col("inserted_at") >= as_of_column(limit), F.lit(True)))

    in_parallel({n: (lambda n=n, keep=keep: expire(n, keep)) for n, keep in retention_plan(seconds).items()})
    # Lookups and technical tables do not expire, but their old versions go too.
    for name in TABLES:
        lake.drop_superseded(name, keep_seconds)


def export_gold(tables: Mapping[str, DataFrame], directory: str, file_format: str = "parquet") -> list[str]:
    """Write every gold table to ``directory/table.format``; returns the paths."""
    file_format = file_format.lower()
    if file_format not in EXPORT_FORMATS:
        raise ValueError(f"unsupported export format {file_format!r}")
    paths = {t.name: f"{directory.rstrip('/')}/{t.name}.{file_format}" for t in tables_of("gold") if t.name in tables}

    def job(name: str):
        writer = tables[name].write.mode("overwrite").format(file_format)
        writer = writer.options(header=True, timestampNTZFormat=CSV_TIMES) if file_format == "csv" else writer
        return lambda: writer.save(paths[name])

    in_parallel({name: job(name) for name in paths}, FLUSH_WORKERS)
    return list(paths.values())


def final_flush(lake: Lake, as_of: AsOf, export_directory: str | None = None, file_format: str = "parquet", **gold_options) -> None:
    """The last run at a stop: silver, gold and export once more."""
    run_silver(lake, as_of)
    run_gold(lake, as_of, **gold_options)
    if export_directory is not None:
        export_gold({t.name: lake.read(t.name) for t in tables_of("gold")}, export_directory, file_format)
