"""Working folders of queries that write tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from hostlake.session import shared_folder


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names; a local one only in a local session (tests)."""
    shared = shared_folder(spark)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"hostlake-{purpose}-")
    return f"{shared.rstrip('/')}/hostlake-{purpose}-{uuid.uuid4().hex}"
