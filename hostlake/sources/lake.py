"""Tables on storage: Parquet directories under one root, ``root/layer/table/``.

Three kinds. *Versioned* tables (dimensions, lookups, technical tables) are rewritten whole: a write
goes to a new ``v=N`` directory and readers take the newest one that finished, so a path is never
overwritten while it is read. *Growing* tables (bronze, silver) are appended in partitions by
insert time (``period=``, the first day of a day, month or year), so that retention drops whole
partitions and key checks read recent ones only. *Replaced* tables (facts) have such partitions too, but
their rows may be replaced: a write goes to a new ``batch=N`` directory that covers some periods whole, and
readers take each period from the newest finished batch that covers it.

What newer versions or batches have taken the place of is removed by age, so that a job that began to read
it can end.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.schemas import TABLES, conform, empty

_PERIOD = "period"
_BATCH = "batch="
_VERSION = "v="
_UNITS = ("day", "month", "year")
#: How long what was replaced stays readable.
KEEP_SECONDS = 6 * 3600


def is_versioned(name: str) -> bool:
    return name.startswith(("gold_dim_", "gold_file_", "gold_tech_")) or name.endswith("_interface")


def is_replaced(name: str) -> bool:
    return name.startswith("gold_fact_")


class Lake:
    def __init__(self, spark: SparkSession, root: str, unit: str = "day"):
        """``unit`` is the length of a partition; take a longer one where a day holds few rows."""
        if unit not in _UNITS:
            raise ValueError(f"unknown partition unit {unit!r}")
        self.spark = spark
        self.root = root.rstrip("/")
        self.unit = unit

    def period_of(self, day: date) -> date:
        """First day of the partition that holds ``day``."""
        if self.unit == "year":
            return day.replace(month=1, day=1)
        return day.replace(day=1) if self.unit == "month" else day

    def path(self, name: str) -> str:
        return f"{self.root}/{TABLES[name].layer}/{name}"

    def _file_system(self, path: str):
        # The session's own Hadoop file system: the root may be local, HDFS or an object store.
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _children(self, path: str) -> list[str]:
        fs, hadoop_path = self._file_system(path)
        if not fs.exists(hadoop_path):
            return []
        return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]

    def _finished(self, path: str) -> bool:
        fs, marker = self._file_system(f"{path}/_SUCCESS")
        return fs.exists(marker)

    def _finished_before(self, path: str, seconds: float) -> bool:
        """Whether a directory was finished at least so long ago."""
        if not self._finished(path):
            return False
        fs, marker = self._file_system(f"{path}/_SUCCESS")
        return time.time() - fs.getFileStatus(marker).getModificationTime() / 1000 >= seconds

    def _numbers(self, name: str, mark: str) -> list[int]:
        """Numbers of the versions or batches, newest first, finished or not."""
        return sorted((int(c[len(mark) :]) for c in self._children(self.path(name)) if c.startswith(mark)), reverse=True)

    def _batches(self, name: str) -> Iterator[tuple[int, list[date]]]:
        """Finished batches, newest first, with the periods they cover."""
        for number in self._numbers(name, _BATCH):
            path = f"{self.path(name)}/{_BATCH}{number}"
            if self._finished(path):
                yield number, self.periods_at(path)

    def _current(self, name: str) -> dict[date, str]:
        """Where each period of a replaced table is."""
        found: dict[date, str] = {}
        for number, periods in self._batches(name):
            for period in periods:
                found.setdefault(period, f"{self.path(name)}/{_BATCH}{number}/{_PERIOD}={period.isoformat()}")
        return found

    def periods_at(self, path: str) -> list[date]:
        mark = f"{_PERIOD}="
        return sorted(date.fromisoformat(c[len(mark) :]) for c in self._children(path) if c.startswith(mark))

    def versions(self, name: str) -> list[int]:
        """Finished versions, oldest first."""
        numbers = [int(c[2:]) for c in self._children(self.path(name)) if c.startswith("v=")]
        return sorted(n for n in numbers if self._finished(f"{self.path(name)}/v={n}"))

    def read(self, name: str) -> DataFrame:
        schema = TABLES[name].schema
        if is_versioned(name):
            finished = (f"{self.path(name)}/{_VERSION}{n}" for n in self._numbers(name, _VERSION))
            newest = next((path for path in finished if self._finished(path)), None)
            return empty(self.spark, name) if newest is None else self.spark.read.schema(schema).parquet(newest)
        if is_replaced(name):
            return self._read_paths(name, self._current(name).values())
        if not self._finished(self.path(name)):
            return empty(self.spark, name)
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.names)

    def _read_paths(self, name: str, paths: Iterable[str]) -> DataFrame:
        paths = list(paths)
        schema = TABLES[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else empty(self.spark, name)

    def periods(self, name: str) -> list[date]:
        """Partitions a growing or replaced table holds, oldest first; a look at directory names only."""
        return sorted(self._current(name)) if is_replaced(name) else self.periods_at(self.path(name))

    def read_since(self, name: str, first_day: date | None) -> DataFrame:
        """Partitions that hold ``first_day`` or later days; older ones are not opened."""
        if is_replaced(name) and first_day is not None:
            first = self.period_of(first_day)
            return self._read_paths(name, [path for period, path in self._current(name).items() if period >= first])
        # An append of no rows leaves a finished table without partitions.
        if first_day is None or not self.periods(name):
            return self.read(name)
        schema = TABLES[name].schema
        stored = self.spark.read.schema(schema).parquet(self.path(name))
        recent = F.col(_PERIOD) >= F.lit(self.period_of(first_day).isoformat()).cast("date")
        return stored.where(recent).select(*schema.names)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new version of a versioned table and read it back.

        The number follows the newest directory, finished or not, so a failed write is passed over.
        """
        target = f"{self.path(name)}/{_VERSION}{max(self._numbers(name, _VERSION), default=0) + 1}"
        conform(df, name).write.mode("error").parquet(target)
        return self.spark.read.schema(TABLES[name].schema).parquet(target)

    def _write_periods(self, name: str, df: DataFrame | None, path: str, max_records_per_file: int, fresh: DataFrame | None = None, day: date | None = None) -> None:
        parts = []
        if df is not None:
            dated = conform(df, name).withColumn(_PERIOD, F.to_date(F.date_trunc(self.unit, "inserted_at")))
            # Rows of a period are brought together, in as many files as their size calls for.
            parts.append(dated.hint("rebalance", _PERIOD))
        if fresh is not None:
            # All of one period: they are together already, and written by the tasks that made them.
            parts.append(conform(fresh, name).withColumn(_PERIOD, F.lit(self.period_of(day).isoformat()).cast("date")))
        dated = reduce(DataFrame.unionByName, parts)
        dated.write.mode("append").option("maxRecordsPerFile", max_records_per_file).partitionBy(_PERIOD).parquet(path)

    def append(self, name: str, df: DataFrame, max_records_per_file: int = 5_000_000) -> DataFrame:
        if is_replaced(name):
            return self.rewrite(name, self.read(name).unionByName(conform(df, name)), self.periods(name), max_records_per_file)
        self._write_periods(name, df, self.path(name), max_records_per_file)
        return self.read(name)

    def rewrite(
        self, name: str, df: DataFrame | None, covered: list[date], max_records_per_file: int = 5_000_000, fresh: DataFrame | None = None, day: date | None = None
    ) -> DataFrame:
        """Write all rows of the covered periods, and of new ones, of a replaced table. A covered period that
        has lost its rows is an empty directory, made before the batch is finished.

        ``fresh`` are rows that are all inserted on ``day``, whose period has to be covered if it is held: they are
        written with the others, but not shuffled."""
        path = f"{self.path(name)}/{_BATCH}{max(self._numbers(name, _BATCH), default=0) + 1}"
        for period in covered:
            fs, target = self._file_system(f"{path}/{_PERIOD}={period.isoformat()}")
            fs.mkdirs(target)
        self._write_periods(name, df, path, max_records_per_file, fresh, day)
        return self.read(name)

    def add(self, name: str, df: DataFrame, day: date) -> None:
        """Append rows that are all inserted on one day and whose keys are new: files are added to that period, nothing
        is rewritten, and rows are written by the tasks that made them."""
        path, period = self.path(name), self.period_of(day)
        if is_replaced(name):
            newest = next((n for n, _ in self._batches(name)), max(self._numbers(name, _BATCH), default=0) + 1)
            held = self._current(name).get(period)
            path = f"{path}/{_BATCH}{newest}" if held is None else held.rpartition("/")[0]
        dated = conform(df, name).withColumn(_PERIOD, F.lit(period.isoformat()).cast("date"))
        dated.write.mode("append").option("maxRecordsPerFile", 5_000_000).partitionBy(_PERIOD).parquet(path)

    def _delete(self, path: str) -> None:
        fs, target = self._file_system(path)
        fs.delete(target, True)

    def drop_superseded(self, name: str, seconds: float = KEEP_SECONDS) -> None:
        """Remove versions, or periods of batches, whose successor was finished ``seconds`` ago or earlier. Take
        more seconds than the longest job lasts."""
        if is_versioned(name):
            numbers = self._numbers(name, _VERSION)
            old = next((k for k, n in enumerate(numbers) if self._finished_before(f"{self.path(name)}/{_VERSION}{n}", seconds)), len(numbers))
            for number in numbers[old + 1 :]:
                self._delete(f"{self.path(name)}/{_VERSION}{number}")
        elif is_replaced(name):
            settled: set[date] = set()
            for number, periods in list(self._batches(name)):
                path = f"{self.path(name)}/{_BATCH}{number}"
                for period in settled & set(periods):
                    self._delete(f"{path}/{_PERIOD}={period.isoformat()}")
                if settled.issuperset(periods) and settled:
                    self._delete(path)
                elif self._finished_before(path, seconds):
                    settled |= set(periods)

    def drop_before(self, name: str, first_kept_day: date) -> None:
        """Remove whole partitions of a growing or replaced table that end before ``first_kept_day``."""
        # Older batches first: a reader in between must not see rows that a newer batch replaced.
        batches = [n for n, _ in self._batches(name)][::-1] if is_replaced(name) else []
        roots = [f"{self.path(name)}/{_BATCH}{n}" for n in batches] if is_replaced(name) else [self.path(name)]
        for root in roots:
            self.drop_periods(root, first_kept_day)

    def keep_rows(self, name: str, period: date, condition: Column) -> None:
        """Rewrite one partition of a growing or replaced table with the rows that fulfil a condition, if others are there."""
        path = self._current(name)[period] if is_replaced(name) else f"{self.path(name)}/{_PERIOD}={period.isoformat()}"
        rows = self._read_paths(name, [path])
        if rows.where(~condition).isEmpty():
            return
        if is_replaced(name):
            self.rewrite(name, rows.where(condition), [period])
            return
        dated = rows.where(condition).withColumn(_PERIOD, F.lit(period.isoformat()).cast("date"))
        if dated.isEmpty():
            self._delete(path)
        else:
            # Spark writes aside, and puts the partition in its place when all tasks have ended.
            dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PERIOD).parquet(self.path(name))

    def drop_periods(self, path: str, first_kept_day: date) -> None:
        for period in self.periods_at(path):
            if period < self.period_of(first_kept_day):
                self._delete(f"{path}/{_PERIOD}={period.isoformat()}")
