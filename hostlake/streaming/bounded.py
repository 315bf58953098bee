"""Streams whose state and output stay bounded however long they run: first and last sight and attribution by time
blocks, output by event day."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostlake.plans.gold import local_packets
from hostlake.sources.lake import Lake
from hostlake.streaming.feeds import triggered
from hostlake.streaming.refine import stream_sockets

#: State on disk, for many keys.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def first_and_last_with_ttl(
    stream: DataFrame, keys: Sequence[str], attributes: Sequence[str], idle: timedelta, delay: str, first: str = "started_at", last: str = "inserted_at"
) -> DataFrame:
    """``refine.first_and_last_seen`` with state that goes: first sight of a key with its attributes, and time of the last,
    by blocks of time ``idle`` long. The state of a key is a row for each block it was seen in, and is cleared once the
    watermark has passed the block, so ``idle`` and the delay after a sight at the latest.

    Write it in update mode. Bringing together what was written (``refine.latest_state``) gives the first of all sights.
    """
    timed = stream.withColumn("event_time", F.col(first).cast("timestamp")).withWatermark("event_time", delay)
    block = F.window("event_time", f"{int(idle.total_seconds())} seconds")
    ranked = [first, *attributes]
    grouped = timed.groupBy(block, *keys).agg(F.min(F.struct(*ranked)).alias("f"), F.max(last).alias(last))
    return grouped.select(*keys, *[F.col(f"f.{c}").alias(c) for c in ranked], last)


def sockets_by_current_lookups(lake: Lake) -> Callable[[DataFrame], DataFrame]:
    """What ``feeds.write_batches`` does with each micro-batch of silver open files: sockets, resolved against the host and
    service tables as they are then, so that a running stream follows reloads."""
    return lambda batch: stream_sockets(batch, lake.read("gold_file_host"), lake.read("gold_file_service"))


def process_network_by_blocks(
    fact_ip: DataFrame, dim_interface: DataFrame, sockets: DataFrame, max_socket_age: timedelta, delay: str = "600 seconds", block: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Attribution of packets to processes where both come as streams, with state by (port, time block).

    Lives of sockets, at most ``max_socket_age`` long, are cut to blocks of time; a packet lies in one. So a busy port is
    spread over the partitions of its blocks, and a piece leaves the state when the watermark has passed its block,
    however long the socket lives. Rows later than ``delay`` are dropped.
    """
    width = int(block.total_seconds())
    seconds = lambda c: F.unix_seconds(F.col(c))
    points = (
        local_packets(fact_ip, dim_interface)
        .withColumn("packet_time", F.col("created_at").cast("timestamp"))
        .withColumn("packet_block", F.floor(seconds("packet_time") / width))
        .withWatermark("packet_time", delay)
    )
    oldest = F.col("start_time") + F.make_dt_interval(secs=F.lit(max_socket_age.total_seconds()))
    lives = sockets.where(F.col("source_port").isNotNull()).select(
        "pid", F.col("source_port").alias("socket_port"), F.col("started_at").cast("timestamp").alias("start_time"), F.col("inserted_at").cast("timestamp").alias("end_time")
    )
    lives = lives.withColumn("end_time", F.least("end_time", oldest)).where("start_time <= end_time")
    cut = lives.withColumn("socket_block", F.explode(F.sequence(F.floor(seconds("start_time") / width), F.floor(seconds("end_time") / width))))
    pieces = cut.select(
        "pid",
        "socket_port",
        "socket_block",
        F.greatest("start_time", F.timestamp_seconds(F.col("socket_block") * width)).alias("from_time"),
        F.least("end_time", F.timestamp_seconds((F.col("socket_block") + 1) * width)).alias("to_time"),
    ).withWatermark("from_time", delay)
    held = (
        (F.col("port") == F.col("socket_port"))
        & (F.col("packet_block") == F.col("socket_block"))
        & (F.col("packet_time") >= F.col("from_time"))
        & (F.col("packet_time") <= F.col("to_time"))
        # A piece ends with its block: this is what lets Spark drop it.
        & F.expr(f"packet_time <= from_time + interval {width} seconds")
    )
    owned = points.join(pieces, held, "inner").select("pid", "packet_id", "send", "packet_time")
    # Several sockets of a process on one port may hold the same packet.
    return owned.dropDuplicatesWithinWatermark(["pid", "packet_id", "send"]).drop("packet_time")


def write_days(df: DataFrame, path: str, checkpoint: str, time: str, keep_days: int, period_seconds: int | None = None) -> StreamingQuery:
    """Rows by day of their event time, for ``keep_days`` days before the newest day seen; older days go whole.

    A micro-batch that is run again overwrites what it wrote. Rows of days that are gone already are not written.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days = batch.withColumn("day", F.to_date(time)).withColumn("batch", F.lit(number))
        batch.persist()
        newest = max((d for d in (days.agg(F.max("day")).first()[0], *_days(spark, path)) if d is not None), default=None)
        if newest is not None:
            first = newest - timedelta(days=keep_days)
            kept = days.where(F.col("day") >= F.lit(first.isoformat()).cast("date"))
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
            for day in _days(spark, path):
                if day < first:
                    fs, target = _file_system(spark, f"{path}/day={day.isoformat()}")
                    fs.delete(target, True)
        batch.unpersist()

    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return triggered(writer, period_seconds).start()


def _file_system(spark, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _days(spark, path: str) -> list[date]:
    fs, target = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n[4:5].isdigit())
