"""Bronze typing: parsed rows to stored rows with ids, insert time and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.functions.clock import AsOf, as_of_column
from hostlake.functions.ids import row_id


def _straight_quotes(text: str) -> Column:
    return F.translate(text, "'", '"')


def batch_distinct(rows: DataFrame) -> DataFrame:
    """Repeated rows of one batch are stored once."""
    return rows.dropDuplicates()


def _stored(rows: DataFrame, as_of: AsOf) -> DataFrame:
    inserted = as_of_column(as_of)
    identity = [F.col(c) for c in rows.columns]
    return rows.select(
        row_id(*identity).alias("_id"),
        *rows.columns,
        inserted.alias("inserted_at"),
        (inserted - F.col("created_at")).alias("brz_ingestion_duration"),
    )


def bronze_process_list(processes: DataFrame, as_of: AsOf) -> DataFrame:
    """``processes`` as parsed by ``sources.processes``; single quotes in commands become double quotes."""
    rows = processes.select(
        "pid", "ppid", "uid", "lstart", "pcpu", "pmem", "status",
        _straight_quotes("command").alias("command"), "created_at",
    )
    return _stored(batch_distinct(rows), as_of)


def bronze_open_files(files: DataFrame, as_of: AsOf) -> DataFrame:
    """``files`` as parsed by ``sources.open_files``; quotes in command and name are swapped."""
    rows = files.select(
        _straight_quotes("command").alias("command"), "pid", "uid", "fd", "type", "device", "size", "node",
        _straight_quotes("name").alias("name"), "created_at",
    )
    return _stored(batch_distinct(rows), as_of)
