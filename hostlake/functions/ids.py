"""Deterministic identifiers.

``row_id`` is a 128-bit surrogate for rows that the feeds deliver without a key; at 10^11 rows a
64-bit hash would already collide, so it is not used to decide whether two rows are the same.
``entity_id`` is the short opaque id of gold rows, whose uniqueness rests on their natural key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tagged(col: Column) -> Column:
    # NULL and text must not meet: hashing skips NULLs, so ('a', NULL) would equal (NULL, 'a').
    text = col.cast("string")
    return F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), text))


def row_id(*cols: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *[_tagged(c) for c in cols]).cast("binary"))


def entity_id(*cols: Column) -> Column:
    return F.xxhash64(*[_tagged(c) for c in cols])
