"""Change-driven refresh: a run costs what is new, not what is stored.

Each run takes the rows inserted after what its outputs already show, and touches only the output it can reach.

* Silver knows how far it is by its own rows: insert time less the lag they carry is when their source was inserted. Rows
  from that time on are taken, those of that very time by their keys. The packet table is written after the other tables
  of packets and speaks for all of them, so a run that broke off is made up for.
* Gold knows by the technical tables, which are written last: silver rows inserted later are new. Refresh times have to
  grow from run to run.
* Periods are chosen by insert time, as a row is inserted after what it is made of: a key made of rows captured at t
  cannot be stored in periods before t. Clocks may differ by ``frames.SKEW``.
* Facts are appended; where a key comes again, its new row replaces the old one, and only the periods that hold such
  keys are rewritten. Dimensions are rewritten only when rows that touch them arrive.
* Packets are attributed when either side changes: new packets to all sockets, stored packets to the new parts of
  sockets' lives, and packets of an address that has become an own one.
* Counts come from the writes themselves (``observe``), and are added to the counts before.

A run without new rows writes nothing. Rows of facts carry the time of the run that made them; ``lifecycle.run_gold``
stamps all that silver holds anew.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hostlake.functions.clock import as_of_column, epoch_micros
from hostlake.functions.inet import inet_host
from hostlake.operators.interval_join import interval_join, uncovered
from hostlake.operators.keyed import delete_matching, new_rows, upsert_ignore, without_keys
from hostlake.plans import gold, silver
from hostlake.plans.frames import SKEW, wide_frames
from hostlake.plans.lifecycle import in_parallel, merge_gold
from hostlake.plans.moments import moment
from hostlake.schemas import PROTOCOL_COLUMNS, TABLES, conform
from hostlake.sources.lake import Lake, is_versioned

_PACKETS = "silver_network_packet"
_FEEDS = {"silver_process_list": silver.silver_process_list, "silver_open_files": silver.silver_open_files}
_SOCKET_KEY = TABLES["gold_dim_network_socket"].key


class Written:
    """Row counts of writes, by table, as Spark saw them pass."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def counted(self, name: str, df: DataFrame, write: Callable[[DataFrame], None]) -> int:
        seen = Observation()
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        # Nothing is observed where Spark finds out that there are no rows.
        self.rows[name] = seen.get.get("rows") or 0
        return self.rows[name]


def _after(df: DataFrame, mark: datetime | None, inclusive: bool = False) -> DataFrame:
    if mark is None:
        return df
    at = as_of_column(mark)
    return df.where(F.col("inserted_at") >= at if inclusive else F.col("inserted_at") > at)


def _source_time() -> Column:
    return F.col("inserted_at") - F.col("svr_ingestion_duration")


def shown_until(lake: Lake, name: str) -> datetime | None:
    """Insert time of the newest source row that a silver table shows; its newest period is read only."""
    for period in reversed(lake.periods(name)):
        newest = lake.read_since(name, period).agg(F.max(_source_time())).first()[0]
        if newest is not None:
            return newest
    return None


def _known(lake: Lake, name: str, mark: datetime | None) -> DataFrame:
    """Silver rows of sources inserted at ``mark`` or later."""
    rows = lake.read_since(name, None if mark is None else mark.date())
    return rows if mark is None else rows.where(_source_time() >= as_of_column(mark))


def refresh_silver(lake: Lake, as_of: str | datetime) -> Written:
    """Silver rows of what was loaded since the run before."""
    written, day = Written(), moment(as_of).date()

    def feed(name: str) -> None:
        source = name.replace("silver_", "bronze_")
        mark = shown_until(lake, name)
        rows = _after(lake.read_since(source, None if mark is None else mark.date()), mark, inclusive=True)
        fresh = without_keys(rows, _known(lake, name, mark), ["_id"])
        if not fresh.isEmpty():
            written.counted(name, conform(_FEEDS[name](fresh, as_of), name), lambda df: lake.add(name, df, day))

    def packets() -> None:
        mark = shown_until(lake, _PACKETS)
        wide = _after(wide_frames(lake, None if mark is None else mark.date()), mark, inclusive=True)
        if without_keys(wide.select("_id"), _known(lake, _PACKETS, mark), ["_id"]).isEmpty():
            return
        tables = silver.silver_from_decoded(wide, F.col("inserted_at"), as_of)
        last = {_PACKETS: tables.pop(_PACKETS)}
        for group in (tables, last):
            jobs = {}
            for name, df in group.items():
                # Rows of the time of the mark are there already, and those of a run that broke off.
                rows = new_rows(_known(lake, name, mark), conform(df, name), ["_id"], unique=True)
                jobs[name] = lambda name=name, rows=rows: written.counted(name, rows, lambda df: lake.add(name, df, day))
            in_parallel(jobs)

    def interfaces() -> None:
        name = "silver_network_interface"
        old, source = lake.read(name), lake.read("bronze_network_interface")
        fresh = without_keys(source, old, TABLES[name].key)
        if not fresh.isEmpty():
            rows = upsert_ignore(old, conform(silver.silver_network_interface(fresh, as_of), name), TABLES[name].key)
            written.counted(name, rows, lambda df: lake.replace(name, df))

    in_parallel({"packets": packets, "interfaces": interfaces, **{n: (lambda n=n: feed(n)) for n in _FEEDS}})
    return written


def refreshed_until(lake: Lake) -> datetime | None:
    """Time of the last gold refresh that ended."""
    return lake.read("gold_tech_table_count").agg(F.max("inserted_at")).first()[0]


def _add_facts(lake: Lake, written: Written, name: str, rows: DataFrame, since: datetime | None, mark: datetime | None, day) -> None:
    """Append rows of a fact that hold each key once; ``since``: when the oldest of them was captured."""
    rows = conform(rows, name)
    key = list(TABLES[name].key)
    recent = None if since is None else lake.period_of((since - SKEW).date())
    held = [p for p in lake.periods(name) if recent is None or p >= recent]
    removed = 0
    if held:
        stored = lake.read_since(name, held[0])
        named = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
        again = stored.alias("s").join(rows.select(*key).alias("n"), named, "left_semi")
        periods = again.select(F.to_date(F.date_trunc(lake.unit, "inserted_at"))).distinct()
        touched = [r[0] for r in periods.collect()]
        if touched:
            # Rows of a run that broke off were not counted yet.
            removed = again.where(F.col("inserted_at") <= as_of_column(mark)).count() if mark is not None else 0
            kept = stored.where(F.to_date(F.date_trunc(lake.unit, "inserted_at")).isin(touched))
            lake.rewrite(name, without_keys(kept, rows, key), touched)
    written.counted(name, rows, lambda df: lake.add(name, df, day))
    written.rows[name] -= removed


def _merge(lake: Lake, written: Written, name: str, rows: DataFrame) -> DataFrame:
    written.counted(name, merge_gold(name, lake.read(name), conform(rows, name)), lambda df: lake.replace(name, df))
    return lake.read(name)


def attributions(
    packets: DataFrame, stored: DataFrame, sockets: DataFrame, before: DataFrame, interfaces: DataFrame, own_before: DataFrame, as_of: datetime, **options
) -> list[DataFrame]:
    """(packet_id, created_at, port, send, pid) that became true with this run: of new packets, of stored packets at times
    that no socket of the process on the port held before, and of stored packets at addresses that were not own ones
    before. No pair is in two."""

    def owned(points: DataFrame, lives: DataFrame) -> DataFrame:
        return interval_join(points, lives, ["port"], ["pid"], "created_at", "started_at", "inserted_at", **options)

    def lives(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("source_port").isNotNull()).select("pid", F.col("source_port").alias("port"), "started_at", "inserted_at")

    host = inet_host(F.col("address"))
    added = delete_matching(interfaces, own_before, host, host)
    return [
        owned(gold.local_packets(packets, interfaces), lives(sockets)),
        owned(
            gold.local_packets(stored, own_before),
            uncovered(lives(new_parts(sockets, before, as_of)), lives(before), ["pid", "port"], "started_at", "inserted_at"),
        ),
        owned(gold.local_packets(stored, added), lives(sockets)),
    ]


def new_parts(sockets: DataFrame, before: DataFrame, as_of: datetime) -> DataFrame:
    """Sockets touched by this run, from the microsecond after their known life on."""
    known = before.select(*[F.col(k).alias(f"_b_{k}") for k in _SOCKET_KEY], F.col("inserted_at").alias("_until"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in _SOCKET_KEY])
    touched = sockets.where(F.col("inserted_at") == as_of_column(as_of)).join(known, same, "left")
    later = F.timestamp_micros(epoch_micros(F.col("_until")) + 1).cast("timestamp_ntz")
    return touched.withColumn("started_at", F.greatest("started_at", later)).select(*sockets.columns)


def refresh_gold(lake: Lake, as_of: str | datetime, bucket_seconds: int = 3600, salts: int = 1) -> Written:
    """Gold out of the silver rows inserted since the run before."""
    now, mark, written = moment(as_of), refreshed_until(lake), Written()
    if mark is not None and now <= mark:
        raise ValueError(f"a refresh at {now} does not follow the one at {mark}")
    day, first = now.date(), None if mark is None else mark.date()
    new = {n: _after(lake.read_since(n, first), mark) for n in (*_FEEDS, _PACKETS, "silver_network_ip", "silver_network_transport")}
    interfaces = lake.read("silver_network_interface")
    oldest = {n: new[n].agg(F.count(F.lit(1)), F.min("created_at")).first() for n in (*_FEEDS, _PACKETS)}
    has_processes, has_files, has_packets = (oldest[n][0] > 0 for n in (*_FEEDS, _PACKETS))
    has_interfaces = not _after(interfaces, mark).isEmpty()
    if not (has_processes or has_files or has_packets or has_interfaces):
        return written
    processes, files, packets = (new[n] for n in (*_FEEDS, _PACKETS))
    services, hosts = lake.read("gold_file_service"), lake.read("gold_file_host")
    sockets_before, own_before = lake.read("gold_dim_network_socket"), lake.read("gold_dim_network_interface")
    facts_before = lake.read_since("gold_fact_network_ip", first)

    def fact(name: str, rows: DataFrame, feed: str) -> Callable[[], None]:
        return lambda: _add_facts(lake, written, name, rows, oldest[feed][1], mark, day)

    def dimension(name: str, rows: DataFrame) -> Callable[[], None]:
        return lambda: _merge(lake, written, name, rows)

    jobs: dict[str, Callable[[], None]] = {}
    if has_processes or has_files:
        jobs["gold_dim_process"] = lambda: _merge(lake, written, "gold_dim_process", _dim_process(lake, processes, files, as_of))
    if has_processes:
        jobs["gold_fact_process"] = fact("gold_fact_process", gold.gold_fact_process(processes, as_of), "silver_process_list")
    if has_files:
        jobs["gold_dim_file_reg"] = dimension("gold_dim_file_reg", gold.gold_dim_file_reg(files, as_of))
        jobs["gold_dim_network_socket"] = dimension("gold_dim_network_socket", gold.gold_dim_network_socket(files, hosts, services, as_of))
        jobs["gold_dim_network_open_port"] = dimension("gold_dim_network_open_port", gold.gold_dim_network_open_port(files, services, as_of))
        jobs["gold_fact_file_reg"] = fact("gold_fact_file_reg", gold.gold_fact_file_reg(files, as_of), "silver_open_files")
    if has_interfaces:
        jobs["gold_dim_network_interface"] = dimension("gold_dim_network_interface", gold.gold_dim_network_interface(_after(interfaces, mark), as_of))
    if has_packets:
        rows = gold.gold_fact_network_packet(packets, as_of)
        jobs["gold_fact_network_packet"] = fact("gold_fact_network_packet", rows, _PACKETS)
        rows = gold.gold_fact_network_ip(new["silver_network_transport"], new["silver_network_ip"], packets, as_of)
        jobs["gold_fact_network_ip"] = fact("gold_fact_network_ip", rows, _PACKETS)
    in_parallel(jobs)

    dim_interface, dim_socket = lake.read("gold_dim_network_interface"), lake.read("gold_dim_network_socket")
    if has_packets or has_interfaces:
        name, host = "gold_dim_network_foreign_ip", inet_host(F.col("address"))
        seen = conform(gold.gold_dim_network_foreign_ip(new["silver_network_ip"], interfaces, dim_interface, as_of), name)
        outside = delete_matching(merge_gold(name, lake.read(name), seen), dim_interface, host, host)
        written.counted(name, outside, lambda df: lake.replace(name, df))
    touched = F.col("inserted_at") == as_of_column(as_of)
    foreign = lake.read("gold_dim_network_foreign_ip").where(touched)
    # The host dimension looks at the facts of the run before.
    before = facts_before.where(F.col("inserted_at") == as_of_column(mark)) if mark is not None else facts_before
    met = gold.gold_dim_network_host(dim_socket.where(touched), foreign, before, dim_interface, as_of)
    in_parallel(
        {
            "gold_dim_network_host": lambda: _merge(lake, written, "gold_dim_network_host", met),
            "gold_fact_process_network": lambda: _attribute(
                lake, written, now, mark, sockets_before, dim_socket, own_before, dim_interface, bucket_seconds=bucket_seconds, salts=salts
            ),
        }
    )
    _technical(lake, written, new, as_of, mark)
    return written


def _dim_process(lake: Lake, processes: DataFrame, files: DataFrame, as_of) -> DataFrame:
    """Rows of the process dimension that new process rows or commands change. The dimensions of files and sockets
    know the command of each process's earliest open file, so silver is not looked through again."""
    dims = [lake.read(n).select("pid", "command", F.col("started_at").alias("created_at")) for n in ("gold_dim_file_reg", "gold_dim_network_socket")]
    seen = reduce(DataFrame.unionByName, [*dims, files.select("pid", "command", "created_at")])
    latest = gold.gold_dim_process(processes, seen.join(processes.select("pid").distinct(), "pid", "left_semi"), as_of)
    known = lake.read("gold_dim_process").where(F.col("command").isNull())
    first = files.groupBy("pid").agg(F.min(F.struct("created_at", "command"))["command"].alias("_first"))
    named = known.join(first, "pid").withColumn("command", F.col("_first")).withColumn("inserted_at", as_of_column(as_of))
    return latest.unionByName(without_keys(named.select(*latest.columns), latest, ["pid", "started_at"]))


def _attribute(lake: Lake, written: Written, now, mark, sockets_before, sockets, own_before, interfaces, **options) -> None:
    name = "gold_fact_process_network"
    starts = new_parts(sockets, sockets_before, now).agg(F.min("started_at")).first()[0]
    host = inet_host(F.col("address"))
    becomes_own = mark is not None and not delete_matching(interfaces, own_before, host, host).isEmpty()
    reach = [t for t in (mark, starts) if t is not None]
    # Packets of an address that has just become an own one may be of any time.
    since = None if mark is None or becomes_own else lake.period_of((min(reach) - SKEW).date())
    packets = lake.read_since("gold_fact_network_ip", since)
    fresh = _after(packets, mark)
    stored = packets.where(F.col("inserted_at") <= as_of_column(mark)) if mark is not None else packets.limit(0)
    parts = attributions(fresh, stored, sockets, sockets_before, interfaces, own_before, now, **options)
    owned = reduce(DataFrame.unionByName, parts if becomes_own else parts[:2] if mark is not None else parts[:1])
    rows = owned.select(F.xxhash64("pid", "packet_id", "send").alias("_id"), "pid", "packet_id", "send", as_of_column(now).alias("inserted_at"))
    known, rows, uncounted = lake.read_since(name, since), conform(rows, name), 0
    if lake.periods(name):
        uncounted = _after(known, mark).count()  # of a run that broke off
        # What has just become true is not there yet, but for ends of packets that came again.
        added = delete_matching(interfaces, own_before, host, host)
        again = known if uncounted else attributed_before(known, packets, gold.local_packets(stored, added) if becomes_own else None)
        if uncounted or not again.isEmpty():
            rows = without_keys(rows, known if uncounted else known.join(again, ["packet_id", "send"], "left_semi"), TABLES[name].key)
    written.counted(name, rows, lambda df: lake.add(name, df, now.date()))
    written.rows[name] += uncounted


def attributed_before(known: DataFrame, packets: DataFrame, added: DataFrame | None) -> DataFrame:
    """Ends of packets (packet_id, send) with attributions that are older than the packet's row, which replaced another
    one then, or that are there although their address becomes an own one only now (``added``). Known attributions
    are reduced to the ends of packets first; they are many times as many."""
    first = known.groupBy("packet_id", "send").agg(F.min("inserted_at").alias("_first"))
    rows = packets.select(F.col("_id").alias("packet_id"), F.col("inserted_at").alias("_row"))
    again = first.join(rows, "packet_id").where("_first < _row").select("packet_id", "send")
    if added is None:
        return again.distinct()
    return again.unionByName(first.join(added, ["packet_id", "send"], "left_semi").select("packet_id", "send")).distinct()


def _frame_counts(wide: DataFrame) -> dict[str, int]:
    """Rows of the thirteen bronze tables of frames, from one look at which layers are there."""
    layers = [p for p in PROTOCOL_COLUMNS if not p.startswith("dns_")]
    sizes = [F.count(F.lit(1)).alias("packet"), *(F.count(p).alias(p) for p in layers), F.count("dns").alias("dns_header")]
    sizes += [F.sum(F.size(f"dns.{many}")).alias(name) for name, many in (("dns_query", "questions"), ("dns_response", "records"))]
    return {f"bronze_network_{k}": v or 0 for k, v in wide.agg(*sizes).first().asDict().items()}


def _technical(lake: Lake, written: Written, new: dict[str, DataFrame], as_of, mark) -> None:
    """Counts of all forty tables and lags of the new rows; the last tables of a run. Growing tables add what was
    written to what they held; of what was loaded since, or written by a run whose gold part broke off, only the new
    rows are counted."""
    before = {r["name"]: r["last_count"] for r in lake.read("gold_tech_table_count").collect()}  # forty rows
    first = None if mark is None else mark.date()
    def counted(name: str) -> int:
        loaded = name.startswith(("bronze_", "silver_", "gold_file_"))
        if name in written.rows:
            return written.rows[name] + (0 if is_versioned(name) else before.get(name, 0))
        if is_versioned(name):
            return lake.read(name).count() if loaded else before.get(name, 0)
        return before.get(name, 0) + (_after(lake.read_since(name, first), mark).count() if loaded else 0)

    framed = _frame_counts(_after(wide_frames(lake, first), mark))
    counts = in_parallel({n: (lambda n=n: counted(n)) for n in gold.COUNTED_TABLES if n not in framed})
    counts |= {n: before.get(n, 0) + c for n, c in framed.items()}
    rows = [(k, name, counts[name], counts[name]) for k, name in enumerate(gold.COUNTED_TABLES)]
    table = lake.spark.createDataFrame(rows, "_id int, name string, max_count long, last_count long")
    lags = gold.gold_tech_chrono(new, as_of).where(F.col("max_ingest").isNotNull())
    # The count table comes last: its time says that the run has ended.
    for name, df in (("gold_tech_chrono", lags), ("gold_tech_table_count", table.withColumn("inserted_at", as_of_column(as_of)))):
        lake.replace(name, merge_gold(name, lake.read(name), conform(df, name)))


def refresh(lake: Lake, as_of: str | datetime, **options) -> None:
    """Silver, then gold, as far as there is something new."""
    refresh_silver(lake, as_of)
    refresh_gold(lake, as_of, **options)
