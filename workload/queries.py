"""The registered queries: every operator over the whole fixture tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostlake.functions import inet, names
from hostlake.functions.clock import as_of_column, interval_micros
from hostlake.operators import keyed, packets
from hostlake.operators.http import http_message
from hostlake.plans import bronze, changes, frames, gold, lifecycle, silver
from hostlake.schemas import TABLES, conform, tables_of
from hostlake.session import configure
from hostlake.sources import interfaces, logs, lookups, open_files, processes
from hostlake.sources.lake import Lake, is_versioned
from hostlake.streaming import bounded, feeds, progress, refine
from workload.fixtures import AS_OF, FIELDS, GOLD_FIELDS, HEADERS, KEPT_SECONDS, LOADED, REFRESHES, RETAINED_AT, SILVER_FIELDS, fixture, table, three_days
from workload.scratch import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def lags_as_micros(df: DataFrame) -> DataFrame:
    """Interval columns as BIGINT microseconds, which every engine compares alike."""
    return df.select(
        *[
            interval_micros(F.col(name)).alias(name) if kind.startswith("interval") else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def as_of() -> Column:
    return as_of_column(AS_OF)


# ---- sources ------------------------------------------------------------------------------------


@query
def parse_process_snapshot(spark, d):
    lines = fixture(spark, d, "raw_process")
    parsed = processes.parse_process_lines(lines, as_of())
    return parsed.withColumns({c: F.col(c).cast("double") for c in ("pcpu", "pmem")}).drop("created_at")


@query
def parse_open_files(spark, d):
    listings = fixture(spark, d, "raw_open_files").select("listing")
    return open_files.parse_open_files(listings, as_of()).drop("created_at")


@query
def open_files_by_class(spark, d):
    files = fixture(spark, d, "open_files").select("pid", "fd", "type", "name", "created_at")
    network = open_files.is_network_file(F.col("type"))
    regular_feed, network_feed = files.where(~network), files.where(network)
    parts = [
        open_files.open_files_by_class(regular_feed, network_feed, c).withColumn("class", F.lit(c))
        for c in ("regular", "network", "all")
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def parse_hosts(spark, d):
    return lookups.parse_hosts(fixture(spark, d, "raw_hosts"))


@query
def parse_services(spark, d):
    return lookups.parse_services(fixture(spark, d, "raw_services"))


@query
def parse_users(spark, d):
    return lookups.parse_users(fixture(spark, d, "raw_users"))


@query
def parse_users_listing(spark, d):
    return lookups.parse_users_listing(fixture(spark, d, "raw_users_listing"))


@query
def log_lines(spark, d):
    folder = work_folder(spark, "logs") + "/files"
    text = table(spark, d, "events").select(F.concat_ws(" ", "ts", "event_type", "event_id", "props").alias("value"))
    text.write.text(folder)
    rows = logs.log_lines(spark, folder)
    return rows.select(
        "row", F.endswith("file", F.lit(".txt")).alias("has_file"), (F.col("date") > 0).alias("has_date")
    )


@query
def interface_addresses(spark, d):
    return interfaces.interface_addresses(fixture(spark, d, "interface_device"), as_of()).drop("_id")


@query
def snapshot_replace(spark, d):
    lake = Lake(spark, work_folder(spark, "lookups"))
    first = {"gold_file_service": fixture(spark, d, "service"), "gold_file_host": fixture(spark, d, "host")}
    lifecycle.replace_lookups(lake, first, AS_OF)
    second = {"gold_file_host": lookups.parse_hosts(fixture(spark, d, "raw_hosts"))}
    lifecycle.replace_lookups(lake, second, AS_OF)
    services = lake.read("gold_file_service").select(
        F.lit("service").alias("lookup"), "name", F.concat_ws("/", "port", "protocol").alias("value"), "inserted_at"
    )
    hosts = lake.read("gold_file_host").select(
        F.lit("host").alias("lookup"), "name", F.col("address").alias("value"), "inserted_at"
    )
    return services.unionByName(hosts)


# ---- packet decoding ----------------------------------------------------------------------------


def _decoded(spark, d, depth: str = "application") -> DataFrame:
    return packets.decode_packets(fixture(spark, d, "frames"), depth=depth)


@query
def decode_packets(spark, d):
    wide = _decoded(spark, d)
    present = [F.when(F.col(layer).isNotNull(), F.lit(layer)) for layer in packets.LAYERS]
    return wide.select("_id", "interface", "length", "created_at", F.concat_ws(",", *present).alias("layers"))


@query
def packet_base(spark, d):
    return packets.packet_base(fixture(spark, d, "frames"))


def _decode_query(protocol: str, depth: str) -> None:
    def run(spark, d):
        return packets.protocol_rows(_decoded(spark, d, depth), protocol)

    run.__name__ = f"decode_{protocol}"
    query(run)


for _depth, _protocols in {
    "data_link": ("ethernet",),
    "network": ("arp", "ipv4", "ipv6"),
    "transport": ("tcp", "udp", "icmp"),
    "application": ("tls", "dns_header"),
}.items():
    for _protocol in _protocols:
        _decode_query(_protocol, _depth)


def _numbers(data: str) -> Column:
    return F.array_join(F.col(data).cast("array<string>"), ".").alias(data)


@query
def decode_dns_questions(spark, d):
    rows = packets.protocol_rows(_decoded(spark, d), "dns_query")
    return rows.select("packet_id", _numbers("qname"), "qtype", "qclass")


@query
def decode_dns_records(spark, d):
    rows = packets.protocol_rows(_decoded(spark, d), "dns_response")
    return rows.select("packet_id", "origin", "name_tag", "rtype", "rclass", "ttl", "rdlength", _numbers("rdata"))


@query
def decode_http(spark, d):
    rows = packets.protocol_rows(_decoded(spark, d), "http")
    header = {"header_host": "Host", "header_id": "X-Id", "header_server": "Server"}
    return rows.select(
        *[c for c in rows.columns if c != "headers"],
        *[F.try_element_at("headers", F.lit(key)).alias(name) for name, key in header.items()],
    )


@query
def decode_http_pages(spark, d):
    """Whole web pages as message bodies, of any size and language."""
    crlf = F.lit("\r\n")
    head = F.concat(F.lit("HTTP/1.1 200 OK"), crlf, F.lit("X-Url: "), F.col("url"), crlf, crlf)
    messages = table(spark, d, "pages").select("page_id", F.concat(head, "html").cast("binary").alias("payload"))
    parsed = messages.select("page_id", http_message(F.col("payload")).alias("m"))
    return parsed.select(
        "page_id", "m.type", "m.version", "m.status_code", "m.status_text",
        F.col("m.headers")["X-Url"].alias("url"), F.md5(F.col("m.body").cast("binary")).alias("body_md5"),
    )


@query
def classify_application(spark, d):
    wide = _decoded(spark, d)
    labels = packets.layer_labels(wide)
    return wide.select("_id", labels["transport"].alias("transport"), labels["application"].alias("application"))


def row_texts(df: DataFrame, name: str, key: str, fields: list[Column]) -> DataFrame:
    """Rows of any table as (name, key, fields as one text, insert time)."""
    text = F.concat_ws("|", *[f.cast("string") for f in fields])
    return df.select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), text.alias("fields"), "inserted_at")


def frames_lake(spark, d, purpose: str) -> Lake:
    """All frames in one load."""
    lake = Lake(spark, work_folder(spark, purpose))
    frames.load_frames(lake, fixture(spark, d, "frames"), LOADED)
    return lake


@query
def protocol_fanout(spark, d):
    """Rows of the thirteen tables of one load of frames."""
    tables = frames.frame_tables(frames_lake(spark, d, "fanout"))
    parts = [row_texts(tables["bronze_network_packet"], "packet", "_id", [F.col(c) for c in ("interface", "length", "created_at")])]
    for protocol, columns in FIELDS.items():
        shown = {"qname": _numbers("qname"), "rdata": _numbers("rdata")}
        shown |= {f"header_{k}": F.try_element_at("headers", F.lit(v)) for k, v in HEADERS.items()}
        parts.append(row_texts(tables[f"bronze_network_{protocol}"], protocol, "packet_id", [shown.get(c, F.col(c)) for c in columns]))
    return reduce(DataFrame.unionByName, parts)


@query
def frames_to_silver(spark, d):
    """The six silver tables of packets, from frames without a join."""
    lake = frames_lake(spark, d, "silver")
    changes.refresh_silver(lake, AS_OF)
    parts = []
    for name, columns in SILVER_FIELDS.items():
        rows = lags_as_micros(lake.read(f"silver_network_{name}"))
        shown = {"qname": _numbers("qname"), "rdata": _numbers("rdata")}
        fields = [shown.get(c, F.col(c)) for c in (*columns, "created_at", "brz_ingestion_duration", "svr_ingestion_duration")]
        parts.append(row_texts(rows, name, "packet_id" if name == "dns" else "_id", fields))
    return reduce(DataFrame.unionByName, parts)


@query
def frames_to_gold(spark, d):
    """Frames and interfaces to gold, change-driven: packets, addresses and the addresses met."""
    lake = frames_lake(spark, d, "gold")
    lifecycle.load_bronze(lake, "bronze_network_interface", fixture(spark, d, "interface"))
    changes.refresh(lake, AS_OF)
    parts = [row_texts(lake.read(f"gold_{name}"), name, columns[0], [F.col(c) for c in columns[1:]]) for name, columns in GOLD_FIELDS.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- bronze -------------------------------------------------------------------------------------


@query
def bronze_process_list(spark, d):
    rows = bronze.bronze_process_list(fixture(spark, d, "process_row"), AS_OF)
    return lags_as_micros(rows.drop("_id"))


@query
def bronze_open_files(spark, d):
    rows = bronze.bronze_open_files(fixture(spark, d, "open_file_row"), AS_OF)
    return lags_as_micros(rows.drop("_id"))


@query
def batch_distinct(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return bronze.batch_distinct(rows)


# ---- silver -------------------------------------------------------------------------------------

_PROTOCOLS = ("ethernet", "ipv4", "ipv6", "arp", "tcp", "udp", "icmp", "tls", "http", "dns_header")


def bronze_tables(spark, d, sources=None) -> dict[str, DataFrame]:
    """Bronze tables out of the fixtures, as the stored tables would hold them."""
    net = {p: fixture(spark, d, p, sources) for p in ("packet", "interface", *_PROTOCOLS)}
    named_headers = [F.struct(F.lit(v).alias("key"), F.col(f"header_{k}").alias("value")) for k, v in HEADERS.items()]
    known = F.filter(F.array(*named_headers), lambda h: h["value"].isNotNull())
    net["http"] = net["http"].withColumn("headers", F.map_from_entries(known)).drop(*(f"header_{k}" for k in HEADERS))
    question = fixture(spark, d, "dns_question_text", sources)
    net["dns_query"] = question.select(
        "_id", "packet_id", _name_bytes(F.col("label")).alias("qname"), "qtype", "qclass"
    )
    net["dns_response"] = _dns_records(fixture(spark, d, "dns_record_numbers", sources))
    named = {f"bronze_network_{p}": df for p, df in net.items()}
    for name, df in named.items():
        if "inserted_at" not in df.columns:
            named[name] = df.withColumn("inserted_at", as_of())
    return {
        "bronze_process_list": fixture(spark, d, "process_list", sources),
        "bronze_open_files": fixture(spark, d, "open_files", sources),
        **named,
    }


def _ascii_bytes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("smallint"))


def _name_bytes(label: Column) -> Column:
    """Length, label, length 3, 'com', 0."""
    tail = F.array(*[F.lit(b).cast("smallint") for b in (3, 99, 111, 109, 0)])
    return F.concat(F.array(F.length(label).cast("smallint")), _ascii_bytes(label), tail)


def _dns_records(numbers: DataFrame) -> DataFrame:
    def small(*values) -> Column:
        return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("smallint") for v in values])

    low = F.col("packet_id") % 65536
    rdata = (
        F.when(F.col("rtype") == "A", small(10, 0, F.col("s3"), F.col("s4")))
        .when(F.col("rtype") == "NS", small(2, 110, 115, 0))
        .otherwise(small(254, 128, *[0] * 12, F.floor(low / 256), low % 256))
    )
    return numbers.select(
        "_id", "packet_id", "origin", "name_tag", "rtype", "rclass", "ttl", "rdlength", rdata.alias("rdata")
    )


@query
def silver_process_list(spark, d):
    return lags_as_micros(silver.silver_process_list(fixture(spark, d, "process_list"), AS_OF))


@query
def silver_open_files(spark, d):
    return lags_as_micros(silver.silver_open_files(fixture(spark, d, "open_files"), AS_OF))


@query
def silver_network_packet(spark, d):
    net = {p: fixture(spark, d, p) for p in _PROTOCOLS}
    return lags_as_micros(silver.silver_network_packet(fixture(spark, d, "packet"), net, AS_OF))


@query
def silver_network_packet_decoded(spark, d):
    """The same table straight from frames, without joins."""
    inserted = F.col("created_at") + F.make_dt_interval(secs=F.lit(1))
    return lags_as_micros(silver.silver_from_decoded(_decoded(spark, d), inserted, AS_OF)["silver_network_packet"])


@query
def silver_network_ethernet(spark, d):
    rows = silver.silver_network_ethernet(fixture(spark, d, "ethernet"), fixture(spark, d, "packet"), AS_OF)
    return lags_as_micros(rows)


@query
def silver_network_interface(spark, d):
    return lags_as_micros(silver.silver_network_interface(fixture(spark, d, "interface"), AS_OF))


def _silver_dns(spark, d) -> DataFrame:
    net = bronze_tables(spark, d)
    return silver.silver_network_dns(
        net["bronze_network_dns_header"], net["bronze_network_dns_query"], net["bronze_network_dns_response"],
        net["bronze_network_packet"], AS_OF,
    )


@query
def silver_network_dns(spark, d):
    rows = lags_as_micros(_silver_dns(spark, d))
    return rows.select(
        *[_numbers(c) if c in ("qname", "rdata") else F.col(c) for c in rows.columns if not c.endswith("_parsed")],
    )


@query
def dns_name_text(spark, d):
    """Every event type and page address as a DNS name."""
    events = table(spark, d, "events").select(F.col("event_type").alias("label"))
    urls = table(spark, d, "pages").select(F.col("url").alias("label"))
    labels = events.unionByName(urls)
    return labels.select("label", names.dns_question_text(_name_bytes(F.col("label"))).alias("question_parsed"))


@query
def dns_rdata_text(spark, d):
    return _silver_dns(spark, d).select("packet_id", "origin", "rtype", "question_parsed", "response_parsed")


@query
def silver_network_ip(spark, d):
    rows = silver.silver_network_ip(
        fixture(spark, d, "ipv4"), fixture(spark, d, "ipv6"), fixture(spark, d, "packet"), AS_OF
    )
    return lags_as_micros(rows)


@query
def silver_network_transport(spark, d):
    rows = silver.silver_network_transport(
        fixture(spark, d, "tcp"), fixture(spark, d, "udp"), fixture(spark, d, "packet"), AS_OF
    )
    return lags_as_micros(rows)


@query
def silver_network_arp(spark, d):
    return lags_as_micros(silver.silver_network_arp(fixture(spark, d, "arp"), fixture(spark, d, "packet"), AS_OF))


# ---- gold ---------------------------------------------------------------------------------------

class Layers:
    """Silver tables of the fixtures, each built when asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def files(self) -> DataFrame:
        return silver.silver_open_files(fixture(self.spark, self.d, "open_files"), AS_OF)

    def processes(self) -> DataFrame:
        return silver.silver_process_list(fixture(self.spark, self.d, "process_list"), AS_OF)

    def interfaces(self) -> DataFrame:
        return silver.silver_network_interface(fixture(self.spark, self.d, "interface"), AS_OF)

    def packets(self) -> DataFrame:
        net = {p: fixture(self.spark, self.d, p) for p in _PROTOCOLS}
        return silver.silver_network_packet(fixture(self.spark, self.d, "packet"), net, AS_OF)

    def _of_packet(self, build, *names_: str) -> DataFrame:
        return build(*[fixture(self.spark, self.d, n) for n in (*names_, "packet")], AS_OF)

    def ip(self) -> DataFrame:
        return self._of_packet(silver.silver_network_ip, "ipv4", "ipv6")

    def transport(self) -> DataFrame:
        return self._of_packet(silver.silver_network_transport, "tcp", "udp")

    def hosts(self) -> DataFrame:
        return fixture(self.spark, self.d, "host")

    def services(self) -> DataFrame:
        return fixture(self.spark, self.d, "service")

    def dim_interface(self) -> DataFrame:
        return gold.gold_dim_network_interface(self.interfaces(), AS_OF)

    def dim_socket(self) -> DataFrame:
        return gold.gold_dim_network_socket(self.files(), self.hosts(), self.services(), AS_OF)

    def fact_ip(self) -> DataFrame:
        return gold.gold_fact_network_ip(self.transport(), self.ip(), self.packets(), AS_OF)

    def foreign_ip(self) -> DataFrame:
        return gold.gold_dim_network_foreign_ip(self.ip(), self.interfaces(), self.dim_interface(), AS_OF)

    def process_network(self, **options) -> DataFrame:
        return gold.gold_fact_process_network(
            self.fact_ip(), self.dim_interface(), self.dim_socket(), AS_OF, **options
        )


@query
def gold_dim_process(spark, d):
    layers = Layers(spark, d)
    return gold.gold_dim_process(layers.processes(), layers.files(), AS_OF)


@query
def gold_dim_file_reg(spark, d):
    return gold.gold_dim_file_reg(Layers(spark, d).files(), AS_OF)


@query
def gold_dim_network_interface(spark, d):
    return Layers(spark, d).dim_interface().drop("_id")


@query
def gold_dim_network_socket(spark, d):
    return Layers(spark, d).dim_socket().drop("_id")


@query
def gold_dim_network_open_port(spark, d):
    layers = Layers(spark, d)
    return gold.gold_dim_network_open_port(layers.files(), layers.services(), AS_OF)


@query
def gold_dim_network_open_port_resolved(spark, d):
    layers = Layers(spark, d)
    return gold.gold_dim_network_open_port(layers.files(), layers.services(), AS_OF, dedupe_on="resolved_port")


@query
def gold_dim_network_foreign_ip(spark, d):
    return Layers(spark, d).foreign_ip().drop("_id")


@query
def gold_dim_network_host(spark, d):
    layers = Layers(spark, d)
    sockets = gold.socket_addresses(layers.files(), layers.hosts())
    packets_ = gold.packet_addresses(layers.transport(), layers.ip(), layers.packets())
    rows = gold.gold_dim_network_host(sockets, layers.foreign_ip(), packets_, layers.dim_interface(), AS_OF)
    return rows.drop("_id")


@query
def gold_fact_process(spark, d):
    return gold.gold_fact_process(Layers(spark, d).processes(), AS_OF)


@query
def gold_fact_file_reg(spark, d):
    return gold.gold_fact_file_reg(Layers(spark, d).files(), AS_OF)


@query
def gold_fact_network_packet(spark, d):
    return gold.gold_fact_network_packet(Layers(spark, d).packets(), AS_OF)


@query
def gold_fact_network_ip(spark, d):
    return Layers(spark, d).fact_ip()


@query
def gold_fact_process_network(spark, d):
    return Layers(spark, d).process_network().drop("_id")


@query
def gold_fact_process_network_salted(spark, d):
    """The same rows with hot ports spread over salted parts."""
    return Layers(spark, d).process_network(salts=4).drop("_id")


def _silver_by_name(layers: Layers) -> dict[str, DataFrame]:
    return {
        "silver_process_list": layers.processes(),
        "silver_open_files": layers.files(),
        "silver_network_packet": layers.packets(),
    }


@query
def gold_tech_table_count(spark, d):
    """Counts of all forty tables after a refresh."""
    return _flushed(spark, d, export=False)[0].read("gold_tech_table_count")


@query
def gold_tech_chrono(spark, d):
    return gold.gold_tech_chrono(_silver_by_name(Layers(spark, d)), AS_OF)


# ---- keyed writes -------------------------------------------------------------------------------


def _orders_by_customer(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stored: orders that are finished; arriving: all others; one key per customer and priority."""
    rows = table(spark, d, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey",
        F.col("o_orderdate").alias("inserted_at"),
    )
    keys = ["o_custkey", "o_orderpriority"]
    stored = keyed.first_per_key(rows.where(F.col("o_orderstatus") == "F"), keys, ["inserted_at"])
    return stored, rows.where(F.col("o_orderstatus") != "F")


_KEYS = ("o_custkey", "o_orderpriority")


@query
def upsert_ignore(spark, d):
    stored, new = _orders_by_customer(spark, d)
    return keyed.upsert_ignore(stored, new, _KEYS, ["inserted_at"])


@query
def upsert_replace(spark, d):
    stored, new = _orders_by_customer(spark, d)
    return keyed.upsert_replace(stored, new, _KEYS, ["inserted_at"])


@query
def upsert_touch(spark, d):
    stored, new = _orders_by_customer(spark, d)
    return keyed.upsert_touch(stored, new, _KEYS, ["o_orderkey"])


@query
def upsert_combine(spark, d):
    stored, new = _orders_by_customer(spark, d)
    arriving = keyed.first_per_key(new, _KEYS, ["inserted_at"])
    return keyed.upsert_combine(
        stored, arriving, _KEYS, greatest=["o_totalprice"], least=["inserted_at"], latest=["o_orderkey"]
    )


@query
def delete_matching(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    cheap = table(spark, d, "part").where(F.col("p_type") == "ECONOMY")
    return keyed.delete_matching(rows, cheap, F.col("l_partkey"), F.col("p_partkey"))


# ---- retention, flush, export -------------------------------------------------------------------


@query
def retention(spark, d):
    """Storage after retention: all 37 tables that expire, each filled with every event at the time it came in."""
    lake = Lake(spark, work_folder(spark, "retention"))
    rows = fixture(spark, d, "process_list").select("_id", "created_at", "inserted_at")
    # Telemetry lies on one of thirty days before.
    rows = rows.withColumn("inserted_at", F.expr("timestampadd(SECOND, (_id * 7919) % 2592000, TIMESTAMP_NTZ '2023-12-16 00:00:00')"))
    keyed_by = {"boolean": F.col("_id") % 2 == 0, "timestamp_ntz": F.col("created_at")}
    names = list(lifecycle.retention_plan(KEPT_SECONDS))

    def fill(name: str) -> None:
        key = {c: keyed_by.get(TABLES[name].schema[c].dataType.simpleString(), F.col("_id")) for c in TABLES[name].key}
        filled = rows.select("_id", *[v.alias(c) for c, v in key.items() if c != "_id"], "inserted_at")
        (lake.replace if is_versioned(name) else lake.append)(name, filled)

    lifecycle.in_parallel({n: (lambda n=n: fill(n)) for n in names})
    lifecycle.run_retention(lake, RETAINED_AT, KEPT_SECONDS)
    # Gold ids of dimensions and facts are not keys: the first column of the key tells the event.
    left = [lake.read(n).select(F.lit(n).alias("name"), F.col(_event_key(n)).cast("string").alias("key"), "inserted_at") for n in names]
    return reduce(DataFrame.unionByName, left)


def _event_key(name: str) -> str:
    return next(c for c in TABLES[name].key if c not in ("started_at", "created_at", "send"))


def fill_bronze(lake: Lake, spark, d) -> None:
    tables = bronze_tables(spark, d)
    lifecycle.in_parallel({n: (lambda n=n, df=df: lifecycle.load_bronze(lake, n, df)) for n, df in tables.items()}, lifecycle.FLUSH_WORKERS)
    lookups_ = {f"gold_file_{n}": fixture(spark, d, n) for n in ("service", "host", "user")}
    lifecycle.replace_lookups(lake, lookups_, AS_OF)


def _flushed(spark, d, export: bool = True) -> tuple[Lake, str]:
    folder = work_folder(spark, "flush")
    lake = Lake(spark, f"{folder}/lake", unit="year")
    fill_bronze(lake, spark, d)
    lifecycle.final_flush(lake, AS_OF, f"{folder}/export" if export else None)
    return lake, f"{folder}/export"


def _exported_rows(spark, folder: str, file_format: str) -> DataFrame:
    """Keys and insert times of all seventeen exported tables."""
    parts = []
    for t in tables_of("gold"):
        rows = spark.read.schema(t.schema).format(file_format).options(header=True, timestampNTZFormat=lifecycle.CSV_TIMES).load(f"{folder}/{t.name}.{file_format}")
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in t.key])
        parts.append(rows.select(F.lit(t.name).alias("name"), F.lit(file_format).alias("format"), key.alias("key"), "inserted_at"))
    return reduce(DataFrame.unionByName, parts)


@query
def final_flush(spark, d):
    """Bronze to exported gold: all rows of the exported tables."""
    return _exported_rows(spark, _flushed(spark, d)[1], "parquet")


@query
def export_gold(spark, d):
    """All seventeen tables in two formats, read back."""
    lake, folder = _flushed(spark, d, export=False)
    tables = {t.name: lake.read(t.name) for t in tables_of("gold")}
    for file_format in ("parquet", "csv"):
        lifecycle.export_gold(tables, folder, file_format)
    return reduce(DataFrame.unionByName, [_exported_rows(spark, folder, f) for f in ("parquet", "csv")])


# ---- change-driven refresh ----------------------------------------------------------------------


def load_day(lake: Lake, spark, d, number: int, sources: dict[str, DataFrame]) -> None:
    """What the feeds bring on one of three days. Addresses of wide networks come up on the second."""
    on_day = F.dayofmonth("created_at") == number + 1
    for feed in ("process_list", "open_files"):
        lifecycle.load_bronze(lake, f"bronze_{feed}", fixture(spark, d, feed, sources).where(on_day))
    loaded = REFRESHES[number].replace("23:59", "23:30")
    frames.load_frames(lake, fixture(spark, d, "frames", sources).where(on_day), loaded)
    late = F.coalesce(F.col("netmask") == "/20", F.lit(False))
    own = fixture(spark, d, "interface").where(late if number == 1 else ~late).withColumn("inserted_at", as_of_column(loaded))
    if number < 2:
        lifecycle.load_bronze(lake, "bronze_network_interface", own)
    if number == 0:
        lifecycle.replace_lookups(lake, {f"gold_file_{n}": fixture(spark, d, n) for n in ("service", "host", "user")}, loaded)


def days_lake(spark, d, purpose: str, days: int = 3) -> Lake:
    lake = Lake(spark, work_folder(spark, purpose))
    sources = three_days(spark, d)
    for number, as_of_ in enumerate(REFRESHES[:days]):
        load_day(lake, spark, d, number, sources)
        changes.refresh(lake, as_of_)
    return lake


@query
def refresh_days(spark, d):
    """Three days, each loaded and refreshed by its changes: keys of all facts and the run that made them."""
    lake = days_lake(spark, d, "days")
    facts = []
    for t in tables_of("gold"):
        if t.name.startswith("gold_fact_"):
            key = F.concat_ws("|", *[F.col(k).cast("string") for k in t.key])
            facts.append(lake.read(t.name).select(F.lit(t.name).alias("name"), key.alias("key"), "inserted_at"))
    return reduce(DataFrame.unionByName, facts)


@query
def inet_functions(spark, d):
    address = F.col("address")
    typed = fixture(spark, d, "interface").select(
        "interface", F.col("address").alias("text"), inet.inet(F.concat("address", "netmask")).alias("address")
    )
    return typed.select(
        "interface", "text", "address",
        inet.inet_host(address).alias("host"), inet.inet_network(address).alias("network"),
        inet.inet_prefix(address).alias("prefix"), inet.inet_family(address).alias("family"),
        inet.inet_key(address).alias("sort_key"),
    )


# ---- streams ------------------------------------------------------------------------------------
# Each stream reads stored files in several micro-batches, runs until all are processed, and the
# result is read back from what it wrote.


def _stored_stream(spark, df: DataFrame, folder: str, name: str) -> DataFrame:
    """A stream of two micro-batches of as many files as Spark shuffles into, so no task takes a fixed share of all rows."""
    path, files = f"{folder}/{name}", stream_files(spark)
    df.repartition(files).write.parquet(path)
    return feeds.stream_table(spark, df.schema, path, max_files=files // 2)


def stream_files(spark) -> int:
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _finish(started) -> None:
    started.awaitTermination()


@query
def stream_bronze(spark, d):
    folder = work_folder(spark, "stream")
    files = stream_files(spark)
    fixture(spark, d, "raw_process").repartition(files).write.text(f"{folder}/raw")
    lines = feeds.stream_lines(spark, f"{folder}/raw", max_files=files // 2)

    def to_bronze(batch: DataFrame) -> DataFrame:
        return bronze.bronze_process_list(processes.parse_process_lines(batch, as_of()), AS_OF)

    _finish(feeds.write_batches(lines, f"{folder}/bronze", f"{folder}/state", to_bronze))
    rows = spark.read.parquet(f"{folder}/bronze").drop("batch", "_id")
    return lags_as_micros(rows.withColumns({c: F.col(c).cast("double") for c in ("pcpu", "pmem")}))


@query
def stream_silver_process(spark, d):
    """Every row arrives twice; the second is ignored."""
    folder = work_folder(spark, "stream")
    once = fixture(spark, d, "process_list")
    rows = _stored_stream(spark, once.unionByName(once), folder, "bronze")
    silver_rows = refine.stream_silver_process(rows, AS_OF, "400 days")
    _finish(feeds.append_to(silver_rows, f"{folder}/silver", f"{folder}/state"))
    return lags_as_micros(spark.read.parquet(f"{folder}/silver"))


@query
def stream_silver_packet(spark, d):
    folder = work_folder(spark, "stream")
    frames = _stored_stream(spark, fixture(spark, d, "frames"), folder, "frames")
    inserted = F.col("created_at") + F.make_dt_interval(secs=F.lit(1))
    rows = refine.stream_silver_packets(frames, inserted, AS_OF)["silver_network_packet"]
    _finish(feeds.append_to(rows, f"{folder}/silver", f"{folder}/state"))
    return lags_as_micros(spark.read.parquet(f"{folder}/silver"))


def _socket_stream(spark, d, folder: str) -> DataFrame:
    files = _stored_stream(spark, Layers(spark, d).files(), folder, "files")
    layers = Layers(spark, d)
    return refine.stream_sockets(files, layers.hosts(), layers.services())


@query
def stream_socket(spark, d):
    folder = work_folder(spark, "stream")
    _finish(feeds.append_to(_socket_stream(spark, d, folder), f"{folder}/sockets", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/sockets")


@query
def stream_dim_socket(spark, d):
    folder = work_folder(spark, "stream")
    changes = refine.stream_dim_sockets(_socket_stream(spark, d, folder))
    _finish(feeds.write_batches(changes, f"{folder}/dim", f"{folder}/state", mode="update"))
    keys = TABLES["gold_dim_network_socket"].key
    return refine.latest_state(spark.read.parquet(f"{folder}/dim").drop("batch"), keys, ["uid", "command"])


@query
def stream_process_network(spark, d):
    folder = work_folder(spark, "stream")
    layers = Layers(spark, d)
    fact_ip = _stored_stream(spark, layers.fact_ip(), folder, "fact_ip")
    sockets = _stored_stream(spark, layers.dim_socket(), folder, "dim_socket")
    owned = refine.stream_process_network(fact_ip, layers.dim_interface(), sockets, "4000 days")
    _finish(feeds.append_to(owned, f"{folder}/owned", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/owned")


def day_by_day(spark, sources: dict[str, tuple[DataFrame, str]], folder: str, start: Callable[..., StreamingQuery]) -> None:
    """``start`` gets a stream of each source (rows, time) and starts a query, which goes on from its checkpoint for each of
    three days: a micro-batch holds the files of one day, as many as the tasks that made them."""
    for name, (df, time_) in sources.items():
        df.withColumn("_day", F.dayofmonth(time_)).write.partitionBy("_day").parquet(f"{folder}/{name}-days")
    for number in range(3):
        for name, (df, _) in sources.items():
            rows = spark.read.schema(df.schema).parquet(f"{folder}/{name}-days/_day={number + 1}") if has_day(spark, f"{folder}/{name}-days", number + 1) else df.limit(0)
            rows.write.mode("append").parquet(f"{folder}/{name}")
        _finish(start(*[feeds.stream_table(spark, df.schema, f"{folder}/{name}", max_files=1_000_000) for name, (df, _) in sources.items()]))


def has_day(spark, folder: str, day: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_day={day}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _three_day_sockets(spark, d) -> DataFrame:
    layers = Layers(spark, d)
    files = silver.silver_open_files(fixture(spark, d, "open_files", three_days(spark, d)), AS_OF)
    return refine.stream_sockets(files, layers.hosts(), layers.services())


@query
def stream_dim_socket_ttl(spark, d):
    """First and last sight of sockets; the state of those not seen for six hours goes."""
    folder = work_folder(spark, "stream")
    for key, value in bounded.STATE_STORE.items():
        spark.conf.set(key, value)
    keys = TABLES["gold_dim_network_socket"].key

    def start(sockets: DataFrame) -> StreamingQuery:
        changed = bounded.first_and_last_with_ttl(sockets, keys, ["uid", "command"], timedelta(hours=6), "1 hour")
        return feeds.write_batches(changed, f"{folder}/dim", f"{folder}/state", mode="update")

    day_by_day(spark, {"sockets": (_three_day_sockets(spark, d), "started_at")}, folder, start)
    return refine.latest_state(spark.read.parquet(f"{folder}/dim").drop("batch"), keys, ["uid", "command"])


@query
def stream_process_network_blocks(spark, d):
    """Packets of three days to sockets that live for six hours at most; state lasts a block and the delay."""
    folder = work_folder(spark, "stream")
    net = {n: fixture(spark, d, n, three_days(spark, d)) for n in ("tcp", "udp", "ipv4", "ipv6", "packet")}
    transport = silver.silver_network_transport(net["tcp"], net["udp"], net["packet"], AS_OF)
    ip = silver.silver_network_ip(net["ipv4"], net["ipv6"], net["packet"], AS_OF)
    fact_ip = gold.gold_fact_network_ip(transport, ip, net["packet"], AS_OF)
    files = silver.silver_open_files(fixture(spark, d, "open_files", three_days(spark, d)), AS_OF)
    layers = Layers(spark, d)
    sockets = gold.gold_dim_network_socket(files, layers.hosts(), layers.services(), REFRESHES[-1])

    def start(packets_: DataFrame, lives: DataFrame) -> StreamingQuery:
        owned = bounded.process_network_by_blocks(packets_, layers.dim_interface(), lives, timedelta(hours=6), "12 hours")
        return feeds.append_to(owned, f"{folder}/owned", f"{folder}/state")

    day_by_day(spark, {"fact_ip": (fact_ip, "created_at"), "sockets": (sockets, "started_at")}, folder, start)
    return spark.read.parquet(f"{folder}/owned")


@query
def stream_retention(spark, d):
    """Processes of three days by day, kept for one day before the newest."""
    folder = work_folder(spark, "stream")
    rows = fixture(spark, d, "process_list", three_days(spark, d))
    source = {"bronze": (rows.select("_id", "pid", "created_at", "inserted_at"), "created_at")}
    day_by_day(spark, source, folder, lambda stream: bounded.write_days(stream, f"{folder}/silver", f"{folder}/state", "created_at", keep_days=1))
    return spark.read.parquet(f"{folder}/silver").drop("day", "batch")


@query
def stream_counts(spark, d):
    """Counts and lags of running streams, merged into the technical tables."""
    folder = work_folder(spark, "stream")
    lake, seen = Lake(spark, f"{folder}/lake"), progress.FeedProgress()
    spark.streams.addListener(seen)
    try:
        feeds_ = {"bronze_process_list": "process_list", "bronze_open_files": "open_files", "bronze_network_packet": "packet"}
        for name, source in feeds_.items():
            stream = _stored_stream(spark, fixture(spark, d, source), folder, name)
            watched = progress.observed(stream, name).select("_id", "created_at", "inserted_at")
            _finish(feeds.append_to(watched, f"{folder}/{name}-out", f"{folder}/{name}-state"))
        # Reports come after the batch, on a thread of their own.
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        deadline = time.monotonic() + 60
        while any(n not in seen.rows or seen.rows[n] < spark.read.parquet(f"{folder}/{n}-out").count() for n in feeds_) and time.monotonic() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    for name, df in seen.tables(spark, AS_OF).items():
        lake.replace(name, lifecycle.merge_gold(name, lake.read(name), conform(df, name)))
    counts = lake.read("gold_tech_table_count").select("name", F.col("last_count").cast("double").alias("value"), F.lit("rows").alias("what"), "inserted_at")
    lags = lake.read("gold_tech_chrono").select("name", F.explode(F.array(
        F.struct(F.col("brz_max_ingest").alias("value"), F.lit("brz_max_ingest").alias("what")), F.struct(F.col("brz_min_ingest").alias("value"), F.lit("brz_min_ingest").alias("what"))
    )).alias("x"), "inserted_at").select("name", "x.value", "x.what", "inserted_at")
    return counts.unionByName(lags)
