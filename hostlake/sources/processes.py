"""Process listings: one line per process, header line first.

Line layout: pid ppid uid, five start-date tokens, %cpu %mem, state, command with arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The date tokens read "Tue Aug 29 08:01:10 2023"; the weekday is not parsed.
_START_FORMAT = "MMM d HH:mm:ss yyyy"
_HEADER_FIRST_TOKEN = "PID"


def process_lines(snapshots: DataFrame, text: str = "snapshot") -> DataFrame:
    """Lines of whole snapshots without their first line; other columns are kept."""
    keep = [c for c in snapshots.columns if c != text]
    lines = snapshots.select(*keep, F.posexplode(F.split(text, r"\r?\n")).alias("_pos", "line"))
    return lines.where((F.col("_pos") > 0) & (F.col("line") != "")).drop("_pos")


def parse_process_lines(lines: DataFrame, created_at: Column, mode: str = "failfast", line: str = "line") -> DataFrame:
    """Typed processes out of listing lines.

    ``failfast`` raises on a malformed line, ``permissive`` keeps it with NULL fields and the text
    in ``_corrupt``. Header lines are recognised by their first token, so lines may come in any
    order and from many snapshots at once.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")
    keep = [c for c in lines.columns if c != line]
    fields = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    tokens = lines.select(*keep, F.col(line).alias("_line"), fields.alias("f"), created_at.alias("created_at"))
    tokens = tokens.where(F.col("f")[0] != _HEADER_FIRST_TOKEN)

    def token(i: int) -> Column:
        return F.get("f", F.lit(i))

    started = F.array_join(F.slice("f", 5, 4), " ")
    typed = tokens.select(
        *keep,
        "_line",
        "created_at",
        token(0).try_cast("bigint").alias("pid"),
        token(1).try_cast("bigint").alias("ppid"),
        token(2).try_cast("int").alias("uid"),
        F.try_to_timestamp(started, F.lit(_START_FORMAT)).cast("timestamp_ntz").alias("lstart"),
        token(8).try_cast("float").alias("pcpu"),
        token(9).try_cast("float").alias("pmem"),
        token(10).alias("status"),
        F.array_join(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), " ").alias("command"),
    )
    required = ["pid", "ppid", "uid", "lstart", "pcpu", "pmem", "status"]
    broken = F.lit(False)
    for name in required:
        broken = broken | F.col(name).isNull()
    columns = [*keep, *required[:-1], "status", "command", "created_at"]
    if mode == "permissive":
        return typed.select(*columns, F.when(broken, F.col("_line")).alias("_corrupt"))
    message = F.concat(F.lit("malformed process line: "), F.col("_line"))
    checked = typed.withColumn("pid", F.when(broken, F.raise_error(message).cast("bigint")).otherwise(F.col("pid")))
    return checked.select(*columns)
