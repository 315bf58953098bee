"""Address rows of network interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.functions.ids import row_id
from hostlake.functions.inet import netmask_length


def interface_addresses(devices: DataFrame, inserted_at: Column) -> DataFrame:
    """One row per (interface, address).

    ``devices`` holds interface, address, netmask (as an address), broadcast_address and
    destination_address. The netmask becomes '/n'. Of repeated keys the smallest row is kept.
    """
    bits = netmask_length(F.col("netmask"))
    rows = devices.select(
        "interface",
        "address",
        F.when(F.col("netmask").isNotNull(), F.concat(F.lit("/"), bits.cast("string"))).alias("netmask"),
        "broadcast_address",
        "destination_address",
    )
    values = ["netmask", "broadcast_address", "destination_address"]
    kept = rows.groupBy("interface", "address").agg(F.min(F.struct(*values)).alias("v"))
    return kept.select(
        row_id(F.col("interface"), F.col("address")).alias("_id"),
        "interface",
        "address",
        *[F.col(f"v.{c}").alias(c) for c in values],
        inserted_at.alias("inserted_at"),
    )
