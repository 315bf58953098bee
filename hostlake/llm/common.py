"""Helpers shared by the operators: working tables, Arrow passes, text keys.

Rules that hold for every operator here:

* a result column replaces an input column of the same name; all other input columns pass through;
* a row is a document, whether or not its id is NULL or repeated;
* nothing is kept on machine-local folders of a cluster: working tables go to the shared folder.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import hostlake
from hostlake.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one Arrow batch: a batch of very long texts must still fit in a Python worker.
BATCH_ROWS = "1024"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their workers import it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(hostlake.__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ship-')}/package", "zip", root, "hostlake")
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """The package on the executors, and runtime settings of the operators."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one. Only a local session may go without a shared folder."""
    shared = shared_folder(spark)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: later jobs do not repeat its work,
    and a lost executor costs only the tasks it was running."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict[tuple, object] = {}


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks, such as tables and caches. Workers are used again by later
    stages, so only the state asked for last is kept."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def broadcast_if_small(df: DataFrame, values: str, most: int) -> DataFrame:
    """A stored table for broadcast if its rows and the elements of an array column are counted to be few."""
    elements = df.agg(F.coalesce(F.sum(F.size(values) + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if elements <= most else df


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only. lower() is the same, and faster, where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; inside other lambdas it would be computed per element."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def arrow_append(
    df: DataFrame,
    fields: Sequence[T.StructField],
    compute: Callable[[pa.RecordBatch], Sequence[pa.Array]],
    without: Sequence[str] = (),
) -> DataFrame:
    """Adds columns that compute() makes from each Arrow batch; columns of the same name are replaced, those
    in `without` are not passed on."""
    new = {f.name for f in fields} | set(without)
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in new]
    schema = T.StructType([df.schema.fields[i] for i in keep] + list(fields))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(compute(batch))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + made, names)

    return df.mapInArrow(run, schema)

