"""Keyed writes as DataFrame rewrites: existing rows and new rows in, resulting rows out.

Keys may be NULL, and NULL equals NULL. Where one batch holds several rows of a key, the smallest
row (ordered by ``order`` and then by all its columns) counts, so a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

_SOURCE = "_src"


def sort_key(col: Column | str) -> list[Column]:
    """Ordering columns that put NULL last, as in ``ORDER BY col ASC NULLS LAST``."""
    col = F.col(col) if isinstance(col, str) else col
    return [col.isNull(), col]


def _ranking(df: DataFrame, ranked: Sequence[str]) -> tuple[list[Column], dict[str, Callable[[str], Column]]]:
    """Struct fields that order rows by ``ranked``, and how to get each column back out of the struct.

    Maps have no order; their sorted entries do.
    """
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, MapType)}
    parts, restore = [], {}
    for i, name in enumerate(ranked):
        value = F.array_sort(F.map_entries(name)) if name in maps else F.col(name)
        parts += [part.alias(f"_{i}_{j}") for j, part in enumerate(sort_key(value))]

        def back(struct: str, i: int = i, is_map: bool = name in maps) -> Column:
            stored = F.col(f"{struct}._{i}_1")
            return F.map_from_entries(stored) if is_map else stored

        restore[name] = back
    return parts, restore


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The smallest row of each key.

    An aggregate instead of a window: rows are reduced before the shuffle, so a key that holds a
    large part of all rows costs its tasks one row each.
    """
    values = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in values if c not in order]]
    if not ranked:
        return df.select(*keys).distinct()
    parts, restore = _ranking(df, ranked)
    grouped = df.groupBy(*keys).agg(F.min(F.struct(*parts)).alias("_first"))
    return grouped.select(*[F.col(c) if c in keys else restore[c]("_first").alias(c) for c in df.columns])


def without_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    left, right = df.alias("l"), other.select(*keys).alias("r")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.join(right, condition, "left_anti")


def new_rows(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = (), unique: bool = False
) -> DataFrame:
    """What an insert-or-ignore appends. Only the key columns of ``existing`` are read.

    ``unique`` says that ``new`` holds each key once already, which saves a shuffle.
    """
    incoming = new if unique else first_per_key(new, keys, order)
    return without_keys(incoming, existing, keys)


def upsert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert or ignore: existing rows stay, new rows come in only for absent keys."""
    return existing.unionByName(new_rows(existing, new, keys, order))


def upsert_replace(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert or replace: a new row takes the place of the whole existing row."""
    incoming = first_per_key(new, keys, order)
    return without_keys(existing, incoming, keys).unionByName(incoming)


def upsert_touch(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = (), touched: str = "inserted_at"
) -> DataFrame:
    """Insert, on conflict refresh ``touched`` only: the attributes first stored stay."""
    stored = existing.withColumn(_SOURCE, F.lit(0))
    incoming = new.withColumn(_SOURCE, F.lit(1))
    values = [c for c in existing.columns if c not in keys and c != touched]
    ranked = [*order, *[c for c in values if c not in order]]
    parts, restore = _ranking(existing, ranked)
    latest = F.coalesce(
        F.max(F.when(F.col(_SOURCE) == 1, F.col(touched))), F.max(F.when(F.col(_SOURCE) == 0, F.col(touched)))
    )
    grouped = (
        stored.unionByName(incoming)
        .groupBy(*keys)
        .agg(F.min(F.struct(F.col(_SOURCE), *parts)).alias("_first"), latest.alias("_touched"))
    )

    def column(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name == touched:
            return F.col("_touched").alias(name)
        return restore[name]("_first").alias(name)

    return grouped.select(*[column(c) for c in existing.columns])


def upsert_combine(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    greatest: Sequence[str] = (),
    least: Sequence[str] = (),
    latest: Sequence[str] = (),
) -> DataFrame:
    """Insert, on conflict combine: maximum, minimum or new value per column; NULLs do not count."""
    rows = existing.withColumn(_SOURCE, F.lit(0)).unionByName(new.withColumn(_SOURCE, F.lit(1)))
    combined = rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in greatest],
        *[F.min(c).alias(c) for c in least],
        *[F.max_by(c, _SOURCE).alias(c) for c in latest],
        *[
            F.min_by(c, _SOURCE).alias(c)
            for c in existing.columns
            if c not in (*keys, *greatest, *least, *latest)
        ],
    )
    return combined.select(*existing.columns)


def delete_matching(df: DataFrame, other: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Delete rows whose derived key occurs in ``other`` (a NULL key is kept)."""
    keyed = df.withColumn("_key", left_key)
    keys = other.select(right_key.alias("_key")).where(F.col("_key").isNotNull()).distinct()
    return keyed.join(keys, "_key", "left_anti").select(*df.columns)
