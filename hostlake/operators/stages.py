"""Row-level stages of a deep decoding chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns as one stage, computed once per row.

    The columns come out of a one-element generator, which the optimizer does not look through. A
    filter on a decoded layer would otherwise be pushed to the scan with the expressions of all
    stages below it written out in place, which grows exponentially with the number of stages.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
