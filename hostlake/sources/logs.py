"""Log files that grow, as rows (file, date, row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shape(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.unix_timestamp(F.col("_metadata.file_modification_time")).alias("date"),
        F.col("value").alias("row"),
    )


def log_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows of files in a store that all executors read."""
    return _shape(spark.read.text(paths))


def stream_log_lines(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """Rows of files as they arrive in ``directory`` (rotated segments; a file is read once)."""
    return _shape(spark.readStream.option("maxFilesPerTrigger", max_files).text(directory))
