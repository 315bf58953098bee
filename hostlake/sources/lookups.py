"""System lookup files: hosts, services and users, as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pattern: "name  port/protocol", the rest of the line is ignored.
_SERVICE = r"^([a-zA-Z0-9-]+)\s+(\d{1,5})/([a-zA-Z0-9-]+)"


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def parse_hosts(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, address) per alias; lines starting with '#' or holding fewer than two words give nothing."""
    words = lines.where(~F.startswith(line, F.lit("#"))).select(_words(F.col(line)).alias("w"))
    pairs = words.where(F.size("w") >= 2).select(
        F.explode(F.slice("w", 2, F.size("w"))).alias("name"), F.col("w")[0].alias("address")
    )
    return pairs.distinct()


def parse_services(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, port, protocol); lines of another form are dropped, a port above 65535 fails the job."""
    port = F.regexp_extract(line, _SERVICE, 2).cast("int")
    too_big = F.raise_error(F.concat(F.lit("port out of range: "), F.col(line))).cast("int")
    return (
        lines.where(F.col(line).rlike(_SERVICE))
        .select(
            F.regexp_extract(line, _SERVICE, 1).alias("name"),
            F.when(port <= 65535, port).otherwise(too_big).alias("port"),
            F.regexp_extract(line, _SERVICE, 3).alias("protocol"),
        )
        .distinct()
    )


def parse_users(lines: DataFrame, line: str = "line", uid_field: int = 3) -> DataFrame:
    """(name, uid) of colon-separated accounts; comments and blank lines are skipped, a bad uid fails."""
    rows = lines.where(~F.startswith(line, F.lit("#")) & (F.col(line) != ""))
    return rows.select(
        F.split_part(line, F.lit(":"), F.lit(1)).alias("name"),
        F.split_part(line, F.lit(":"), F.lit(uid_field)).cast("int").alias("uid"),
    )


def parse_users_listing(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, uid) of listing lines: the last word is the uid, the words before it are the name."""
    words = lines.select(_words(F.col(line)).alias("w")).where(F.size("w") > 0)
    return words.select(
        F.array_join(F.slice("w", 1, F.size("w") - 1), " ").alias("name"),
        F.element_at("w", -1).cast("int").alias("uid"),
    )
