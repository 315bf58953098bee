"""Gold: dimensions, facts and technical tables.

"First" and "latest" rows per key are aggregates (``operators.keyed.first_per_key``), not windows,
so rows are reduced on the map side. Lookups are reduced to one row per key before they are joined
and carry no broadcast hint: Spark broadcasts them while they are below its size threshold and
shuffles (splitting hot keys) beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.functions.clock import AsOf, as_of_column, interval_micros
from hostlake.functions.ids import entity_id
from hostlake.functions.inet import inet, inet_host, inet_network_host
from hostlake.functions.names import port_number
from hostlake.operators.interval_join import interval_join
from hostlake.operators.keyed import delete_matching, first_per_key
from hostlake.schemas import TABLES
from hostlake.sources.open_files import is_network_file

# Addresses that are never foreign, besides the own interfaces. The multicast entry
# is compared by equality of its host text, not by containment.
_NEVER_FOREIGN = ("255.255.255.255", "ff00::")
# Feeds whose ingestion lags are measured.
_MEASURED_FEEDS = ("process_list", "open_files", "network_packet")
# Over how many parts rows of one number, or of no name, are dealt where they are looked up.
_PARTS = 64


def gold_dim_process(processes: DataFrame, open_files: DataFrame, as_of: AsOf) -> DataFrame:
    """Latest state of each (pid, start); short command of the earliest open file of the pid."""
    newest_first = F.struct("inserted_at", "created_at", "command", "ppid", "uid")
    latest = processes.groupBy("pid", F.col("lstart").alias("started_at")).agg(F.max(newest_first).alias("p"))
    commands = (
        open_files.select("pid", "command", "created_at")
        .groupBy("pid")
        .agg(F.min(F.struct("created_at", "command")).alias("f"))
        .select("pid", F.col("f.command").alias("command"))
    )
    return latest.join(commands, "pid", "left").select(
        "pid",
        F.col("p.ppid").alias("ppid"),
        F.col("p.uid").alias("uid"),
        "command",
        F.col("p.command").alias("full_command"),
        "started_at",
        as_of_column(as_of).alias("inserted_at"),
    )


def gold_dim_file_reg(open_files: DataFrame, as_of: AsOf) -> DataFrame:
    """First sight of each regular file of a process."""
    regular = open_files.where(~is_network_file(F.col("type"))).select(
        "pid", "uid", "fd", "node", "command", "name", F.col("created_at").alias("started_at")
    )
    first = first_per_key(regular, ["pid", "fd", "node"], ["started_at"])
    return first.withColumn("inserted_at", as_of_column(as_of))


def gold_dim_network_interface(interfaces: DataFrame, as_of: AsOf) -> DataFrame:
    rows = interfaces.select(
        "interface", "address", "broadcast_address", "destination_address", F.col("inserted_at").alias("started_at")
    )
    first = first_per_key(rows, ["interface", "address"], ["started_at"])
    return first.select(
        entity_id(F.col("interface"), F.col("address")).alias("_id"),
        "interface", "address", "broadcast_address", "destination_address",
        inet_network_host(F.col("address")).alias("network"),
        "started_at",
        as_of_column(as_of).alias("inserted_at"),
    )


def _host_lookup(hosts: DataFrame, key: str, value: str) -> DataFrame:
    """One address per lower-case name (the smallest, where a name has several)."""
    return hosts.groupBy(F.lower("name").alias(key)).agg(F.min("address").alias(value)).where(F.col(key).isNotNull())


def _port_lookup(services: DataFrame, key: str, value: str) -> DataFrame:
    return services.groupBy(F.lower("name").alias(key)).agg(F.min("port").alias(value)).where(F.col(key).isNotNull())


def _lookup(rows: DataFrame, column: str, lookup: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """Left join on the lower-case text of ``column``; '' and '*' name nothing and are not looked up.

    ``dealt`` is for rows that were not reduced to different texts before: most of them hold a number that all share,
    or name nothing, and would meet in one task. They are dealt over ``_PARTS`` parts, and names that are numbers,
    of which there are few, are repeated for each part.
    """
    name = F.lower(column)
    keyed = rows.withColumn(key, F.when(~F.col(column).isin("", "*"), name))
    if not dealt:
        return keyed.join(lookup, key, "left").drop(key)
    number = F.coalesce(F.rlike(key, F.lit("^[0-9]+$")), F.lit(True))
    part = F.when(number, F.pmod(F.xxhash64(*rows.columns), F.lit(_PARTS)).cast("int")).otherwise(0)
    copies = F.when(number, F.sequence(F.lit(0), F.lit(_PARTS - 1))).otherwise(F.array(F.lit(0)))
    found = keyed.withColumn("_part", part).join(lookup.withColumn("_part", F.explode(copies)), [key, "_part"], "left")
    return found.drop(key, "_part")


def _resolved_hosts(endpoints: DataFrame, hosts: DataFrame, dealt: bool = False) -> tuple[DataFrame, Column, Column]:
    """Endpoints with their host names looked up, and the source and destination addresses made of them."""
    looked_up = _lookup(endpoints, "ip_source_address", _host_lookup(hosts, "_k1", "_source_host"), "_k1", dealt)
    looked_up = _lookup(looked_up, "ip_destination_address", _host_lookup(hosts, "_k2", "_destination_host"), "_k2", dealt)
    source = F.coalesce("_source_host", "ip_source_address")
    return (
        looked_up,
        inet(F.when(F.col("ip_source_address") != "*", F.translate(source, "-", ":"))).alias("source_address"),
        F.when(
            ~F.col("ip_destination_address").isin("*", ""), F.coalesce("_destination_host", "ip_destination_address")
        ).alias("destination_address"),
    )


def resolve_sockets(endpoints: DataFrame, hosts: DataFrame, services: DataFrame, dealt: bool = False) -> DataFrame:
    """Endpoint texts to addresses and ports, by host and service names regardless of case.

    ``dealt``: many endpoints have the same texts (``_lookup``)."""
    looked_up, source_address, destination_address = _resolved_hosts(endpoints, hosts, dealt)
    looked_up = _lookup(looked_up, "ip_source_port", _port_lookup(services, "_k3", "_source_service"), "_k3", dealt)
    looked_up = _lookup(looked_up, "ip_destination_port", _port_lookup(services, "_k4", "_destination_service"), "_k4", dealt)
    nothing = ["*", ""]
    return looked_up.select(
        *[c for c in endpoints.columns if not c.startswith("ip_")],
        source_address,
        F.when(
            ~F.col("ip_source_port").isin(nothing),
            F.coalesce("_source_service", port_number(F.col("ip_source_port"))),
        ).alias("source_port"),
        destination_address,
        F.when(
            ~F.col("ip_destination_port").isin(nothing),
            F.coalesce("_destination_service", port_number(F.col("ip_destination_port"))),
        ).alias("destination_port"),
    )


SOCKET_ENDPOINTS = ("ip_source_address", "ip_source_port", "ip_destination_address", "ip_destination_port")


def gold_dim_network_socket(
    open_files: DataFrame, hosts: DataFrame, services: DataFrame, as_of: AsOf
) -> DataFrame:
    """First sight of each socket of a process, with endpoints resolved.

    Rows are reduced to the first of each (pid, endpoint texts) before anything is looked up.
    Sockets that resolve to the same values are one socket; the earlier stays.
    """
    network = open_files.where(is_network_file(F.col("type"))).select(
        "pid", *SOCKET_ENDPOINTS, F.col("created_at").alias("started_at"), "uid", "command"
    )
    first = first_per_key(network, ["pid", *SOCKET_ENDPOINTS], ["started_at"])
    key = list(TABLES["gold_dim_network_socket"].key)
    resolved = first_per_key(resolve_sockets(first, hosts, services), key, ["started_at"])
    return resolved.select(
        entity_id(*[F.col(c) for c in key]).alias("_id"),
        "pid", "uid", "command",
        "source_address", "source_port", "destination_address", "destination_port",
        "started_at",
        as_of_column(as_of).alias("inserted_at"),
    )


def socket_addresses(open_files: DataFrame, hosts: DataFrame) -> DataFrame:
    """The pairs of addresses in the socket dimension. Neither processes nor ports nor first sights play a part, so
    rows are reduced to the different address texts before anything is looked up."""
    texts = open_files.where(is_network_file(F.col("type"))).select("ip_source_address", "ip_destination_address").distinct()
    looked_up, *addresses = _resolved_hosts(texts, hosts)
    return looked_up.select(*addresses).distinct()


def gold_dim_network_open_port(
    open_files: DataFrame, services: DataFrame, as_of: AsOf, dedupe_on: str = "service_port"
) -> DataFrame:
    """Source ports a process holds open, with the time they were first seen.

    ``dedupe_on="service_port"`` ranks within (pid, port of the matching service): all ports
    without a service name share one group, of which only the first row counts - also where that
    row has no port itself. ``dedupe_on="resolved_port"`` ranks within (pid, port).
    """
    if dedupe_on not in ("service_port", "resolved_port"):
        raise ValueError(f"unknown dedupe_on {dedupe_on!r}")
    rows = open_files.select(
        "pid", F.col("ip_source_port").alias("text"), F.col("created_at").alias("started_at"), "uid", "command"
    )
    first = first_per_key(rows, ["pid", "text"], ["started_at"])
    # A name may stand for several ports; each is a group of its own.
    ports = services.select(F.lower("name").alias("_k"), F.col("port").alias("service_port")).distinct()
    named = F.coalesce(F.col("service_port"), port_number(F.col("text")))
    looked_up = _lookup(first, "text", ports.where(F.col("_k").isNotNull()), "_k")
    resolved = looked_up.withColumn("port", F.when(~F.col("text").isin("*", ""), named))
    if dedupe_on == "service_port":
        ranked = first_per_key(
            resolved.select("pid", "service_port", "started_at", "uid", "command", "text", "port"),
            ["pid", "service_port"],
            ["started_at", "uid", "command", "text"],
        )
    else:
        ranked = resolved
    kept = ranked.where(F.col("port").isNotNull()).select("pid", "port", "started_at", "uid", "command")
    return (
        first_per_key(kept, ["pid", "port"], ["started_at"])
        .select("pid", "uid", "command", "port", "started_at")
        .withColumn("inserted_at", as_of_column(as_of))
    )


def gold_dim_network_foreign_ip(
    ip: DataFrame, interfaces: DataFrame, dim_interface: DataFrame, as_of: AsOf
) -> DataFrame:
    """Addresses seen in packets that are not the host's own, with the time they were first seen."""
    sides = ip.select(F.explode(F.array("source", "destination")).alias("address"), "created_at")
    first = sides.groupBy("address").agg(F.min("created_at").alias("started_at"))
    own = interfaces.select(inet_host(F.col("address")).alias("_key"))
    fixed = F.col("address").isin(*_NEVER_FOREIGN)
    # An unknown address is not equal to anything and stays, as it would in the outer-join form.
    outside = delete_matching(first.where(F.coalesce(~fixed, F.lit(True))), own, F.col("address"), F.col("_key"))
    foreign = delete_matching(outside, dim_interface, inet_host(F.col("address")), inet_host(F.col("address")))
    return foreign.select(
        entity_id(F.col("address")).alias("_id"),
        "address",
        F.lit(None).cast("string").alias("domain_name"),
        "started_at",
        as_of_column(as_of).alias("inserted_at"),
    )


def gold_dim_network_host(
    dim_socket: DataFrame, dim_foreign_ip: DataFrame, fact_ip: DataFrame, dim_interface: DataFrame, as_of: AsOf
) -> DataFrame:
    """Every address met anywhere. With and without prefix length are two addresses of one host.

    Of sockets and of packets only the addresses are read: where the tables are not stored, ``socket_addresses`` and
    ``packet_addresses`` make them from less.
    """
    both_sides = F.explode(F.array("source_address", "destination_address")).alias("address")
    addresses = [
        dim_socket.where(F.col("source_address").isNotNull()).select(F.col("source_address").alias("address")),
        dim_foreign_ip.select("address"),
        fact_ip.select(both_sides),
        dim_interface.select("address"),
    ]
    distinct = reduce(DataFrame.unionByName, addresses).distinct()
    return distinct.select(
        entity_id(F.col("address")).alias("_id"),
        "address",
        inet_host(F.col("address")).alias("host"),
        as_of_column(as_of).alias("inserted_at"),
    )


def gold_fact_process(processes: DataFrame, as_of: AsOf) -> DataFrame:
    rows = processes.select("pid", F.col("lstart").alias("started_at"), "created_at", "pcpu", "pmem")
    first = first_per_key(rows, TABLES["gold_fact_process"].key)
    return first.withColumn("inserted_at", as_of_column(as_of))


def gold_fact_file_reg(open_files: DataFrame, as_of: AsOf) -> DataFrame:
    rows = open_files.where(~is_network_file(F.col("type"))).select("pid", "fd", "node", "created_at", "size")
    first = first_per_key(rows, TABLES["gold_fact_file_reg"].key)
    return first.withColumn("inserted_at", as_of_column(as_of))


def gold_fact_network_packet(packets: DataFrame, as_of: AsOf) -> DataFrame:
    return packets.select(
        "_id", "interface", "length", "data_link", "network", "transport", "application", "created_at",
        as_of_column(as_of).alias("inserted_at"),
    )


def gold_fact_network_ip(transport: DataFrame, ip: DataFrame, packets: DataFrame, as_of: AsOf) -> DataFrame:
    """Packets with an IP and a transport layer. Both joins share one partitioning by packet id."""
    ports = transport.select(
        "_id", F.col("protocol").alias("transport_protocol"),
        F.col("source").alias("source_port"), F.col("destination").alias("destination_port"),
    )
    addresses = ip.select(
        "_id", F.col("version").cast("smallint").alias("ip_version"),
        F.col("source").alias("source_address"), F.col("destination").alias("destination_address"),
    )
    joined = ports.join(addresses, "_id").join(packets.select("_id", "created_at"), "_id")
    return joined.select(
        "_id", "ip_version", "transport_protocol",
        "source_address", "source_port", "destination_address", "destination_port",
        "created_at",
        as_of_column(as_of).alias("inserted_at"),
    )


def packet_addresses(transport: DataFrame, ip: DataFrame, packets: DataFrame) -> DataFrame:
    """The pairs of addresses in the fact of IP packets: of packets that have a transport layer, whichever it is."""
    known = ip.join(transport.select("_id"), "_id", "left_semi").join(packets.select("_id"), "_id", "left_semi")
    return known.select(F.col("source").alias("source_address"), F.col("destination").alias("destination_address")).distinct()


def local_packets(fact_ip: DataFrame, dim_interface: DataFrame) -> DataFrame:
    """Both ends of each packet that lie on an own interface: (packet_id, created_at, port, send)."""

    def end(side: str, send: bool) -> Column:
        return F.struct(
            F.col(f"{side}_address").alias("address"), F.col(f"{side}_port").alias("port"), F.lit(send).alias("send")
        )

    ends = fact_ip.select(
        F.col("_id").alias("packet_id"),
        "created_at",
        F.inline(F.array(end("source", True), end("destination", False))),
    )
    own = dim_interface.select(inet_host(F.col("address")).alias("_host")).where(F.col("_host").isNotNull()).distinct()
    local = ends.where(F.col("port").isNotNull()).withColumn("_host", inet_host(F.col("address")))
    return local.join(own, "_host", "left_semi").select("packet_id", "created_at", "port", "send")


def gold_fact_process_network(
    fact_ip: DataFrame,
    dim_interface: DataFrame,
    dim_socket: DataFrame,
    as_of: AsOf,
    bucket_seconds: int = 3600,
    salts: int = 1,
) -> DataFrame:
    """Which process sent or received which packet.

    A local end of a packet belongs to every process with a socket on that port whose
    [started_at, inserted_at] holds the packet's time; the address is not compared. The sockets of
    a process on one port are merged to disjoint pieces of time first, so every (pid, packet_id,
    send) comes out once and the large result needs no distinct.
    """
    sockets = dim_socket.where(F.col("source_port").isNotNull()).select(
        "pid", F.col("source_port").alias("port"), "started_at", "inserted_at"
    )
    owned = interval_join(
        local_packets(fact_ip, dim_interface),
        sockets,
        keys=["port"],
        owner=["pid"],
        point="created_at",
        start="started_at",
        end="inserted_at",
        bucket_seconds=bucket_seconds,
        salts=salts,
    )
    return owned.select(
        # None of the three is ever NULL, so the plain hash is safe; this is the largest table.
        F.xxhash64("pid", "packet_id", "send").alias("_id"),
        "pid",
        "packet_id",
        "send",
        as_of_column(as_of).alias("inserted_at"),
    )


# Counted tables in the order of their ids 0..39.
COUNTED_TABLES = (
    "bronze_process_list",
    "bronze_open_files",
    "bronze_network_packet",
    "bronze_network_ethernet",
    "bronze_network_interface",
    "bronze_network_ipv4",
    "bronze_network_ipv6",
    "bronze_network_arp",
    "bronze_network_tcp",
    "bronze_network_udp",
    "bronze_network_icmp",
    "bronze_network_tls",
    "bronze_network_http",
    "bronze_network_dns_header",
    "bronze_network_dns_query",
    "bronze_network_dns_response",
    "silver_process_list",
    "silver_open_files",
    "silver_network_packet",
    "silver_network_ethernet",
    "silver_network_interface",
    "silver_network_ip",
    "silver_network_arp",
    "silver_network_transport",
    "silver_network_dns",
    "gold_dim_process",
    "gold_dim_file_reg",
    "gold_dim_network_interface",
    "gold_dim_network_socket",
    "gold_dim_network_open_port",
    "gold_dim_network_foreign_ip",
    "gold_dim_network_host",
    "gold_fact_process",
    "gold_fact_file_reg",
    "gold_fact_network_packet",
    "gold_fact_network_ip",
    "gold_fact_process_network",
    "gold_file_service",
    "gold_file_host",
    "gold_file_user",
)


def gold_tech_table_count(tables: dict[str, DataFrame], as_of: AsOf) -> DataFrame:
    """Row counts of the tables given; one pass over their union and one exchange, no column is read."""
    given = [(k, name) for k, name in enumerate(COUNTED_TABLES) if name in tables]
    spark = tables[given[0][1]].sparkSession
    # A row that counts nothing for each table: empty ones are shown too.
    named = spark.createDataFrame([(k, name, 0) for k, name in given], "_id int, name string, n long")
    rows = [tables[name].select(F.lit(k).alias("_id"), F.lit(name).alias("name"), F.lit(1).cast("long").alias("n")) for k, name in given]
    counts = reduce(DataFrame.unionByName, [named, *rows]).groupBy("_id", "name").agg(F.sum("n").alias("last_count"))
    return counts.select("_id", "name", F.col("last_count").alias("max_count"), "last_count", as_of_column(as_of).alias("inserted_at"))


def gold_tech_chrono(silver: dict[str, DataFrame], as_of: AsOf) -> DataFrame:
    """Largest and smallest lags of three feeds, in seconds."""
    rows = []
    for feed in _MEASURED_FEEDS:
        lags = silver[f"silver_{feed}"].select(
            interval_micros(F.col("brz_ingestion_duration")).alias("brz"),
            interval_micros(F.col("svr_ingestion_duration")).alias("svr"),
        )
        ends = lags.agg(
            F.max("brz").alias("brz_max"), F.min("brz").alias("brz_min"),
            F.max("svr").alias("svr_max"), F.min("svr").alias("svr_min"),
        )
        rows.append(
            ends.select(
                F.lit(feed).alias("name"),
                (F.col("brz_max") / 1e6).alias("brz_max_ingest"),
                (F.col("brz_min") / 1e6).alias("brz_min_ingest"),
                (F.col("svr_max") / 1e6).alias("svr_max_ingest"),
                (F.col("svr_min") / 1e6).alias("svr_min_ingest"),
                ((F.col("brz_max") + F.col("svr_max")) / 1e6).alias("max_ingest"),
                ((F.col("brz_min") + F.col("svr_min")) / 1e6).alias("min_ingest"),
            )
        )
    return reduce(DataFrame.unionByName, rows).withColumn("inserted_at", as_of_column(as_of))
