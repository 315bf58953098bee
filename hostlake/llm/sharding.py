"""Operator 6: sharding by sampled splitters.

Records are ordered by their key columns (for texts: hash of the text, then id, so that equal texts lie
side by side and a hot text can still be cut) and, among equals, by a row number stored with them. A sample
weighted by size gives splitters at its quantiles; they cut the order into ranges of about equal bytes,
several per shard. The exact bytes and rows of all ranges are counted - their number depends on the shards,
not on the input - and ranges that turn out overfull are subdivided by splitters from a sample of their own.
A record then goes to the shard in whose equal part of all bytes its middle byte lies, so the sizes of
shards differ by about one record.

Rows: records of NULL size have size 0; NULL keys sort first; repeated rows are records of their own; an
empty table gives no rows. Other columns pass through; those called like results are replaced.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.common import stored

#: Ranges for each shard and sampled keys for each range: they bound what the driver holds.
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 24
#: A range of more than this many times its share is subdivided.
OVERFULL = 2.5
ROUNDS = 3


def text_size(text: Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of a text (NULL: none) and a fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + overhead


def sampled_splitters(records: DataFrame, ranges: int, total: int) -> list[tuple[int, int, int]]:
    """Quantiles of a sample in which a record's chance is in proportion to its size. Whether a record is
    drawn follows from its key alone, so a repeated task draws the same ones."""
    wanted = ranges * SAMPLES_PER_RANGE
    chance = F.pmod(F.xxhash64("_a", "_b", "_row"), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(chance * total < F.col("_size") * wanted).select("_a", "_b", "_row")
    keys = sorted(tuple(r) for r in drawn.collect())  # about `wanted`, however many records there are
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def range_of(cuts: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below a key, by binary search over three constant arrays."""
    if not cuts:
        return F.lit(0)
    a, b, row = (F.array(*[F.lit(c[k]).cast("bigint") for c in cuts]) for k in range(3))
    steps = [1 << k for k in range(len(cuts).bit_length())][::-1]

    def step(at: Column, jump: Column) -> Column:
        to = at + jump
        x, y, z = F.element_at(a, to), F.element_at(b, to), F.element_at(row, to)
        same = F.col("_a") == x
        reached = (x < F.col("_a")) | (same & (y < F.col("_b"))) | (same & (y == F.col("_b")) & (z <= F.col("_row")))
        return F.when(to > len(cuts), at).when(reached, to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def shard(docs: DataFrame, shards: int = 24, size: str = "size", keys: tuple[str, str] = ("text_hash", "doc_id")) -> DataFrame:
    """docs with shard (0 .. shards - 1) and slot (gapless from 0 in each shard). keys: two integer columns."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    least = F.lit(-(1 << 63))
    records = stored(
        docs.select(
            *names,
            F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"),
            F.coalesce(F.col(keys[0]).cast("bigint"), least).alias("_a"),
            F.coalesce(F.col(keys[1]).cast("bigint"), least).alias("_b"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "records",
    )
    total = records.agg(F.sum("_size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    cuts = sampled_splitters(records, ranges, total)
    for _ in range(ROUNDS):
        ranged = records.withColumn("_range", range_of(cuts))
        counted = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.sum("_size"), F.count("*")).collect()}
        overfull = [k for k, (b, n) in counted.items() if b * ranges > OVERFULL * total and n > 1]
        finer = sampled_splitters(ranged.where(F.col("_range").isin(overfull)), 4 * len(overfull), sum(counted[k][0] for k in overfull)) if overfull else []
        if not set(finer) - set(cuts):
            break
        cuts = sorted({*cuts, *finer})
    else:
        ranged = records.withColumn("_range", range_of(cuts))
        counted = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.sum("_size"), F.count("*")).collect()}
    count = len(cuts) + 1
    bytes_before = F.array(*[F.lit(x).cast("bigint") for x in accumulate((counted.get(k, (0, 0))[0] for k in range(count)), initial=0)])
    rows_before = F.array(*[F.lit(x).cast("bigint") for x in accumulate((counted.get(k, (0, 0))[1] for k in range(count)), initial=0)])
    order = Window.partitionBy("_range").orderBy("_a", "_b", "_row")
    before = F.element_at(bytes_before, F.col("_range") + 1) + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = ranged.select(
        *names,
        F.least(F.floor((before * 2 + F.col("_size")) * shards / F.lit(2 * max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.element_at(rows_before, F.col("_range") + 1) + F.row_number().over(order) - 1).alias("_place"),
    )
    placed = stored(placed, "placed")
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_place")).collect()}
    starts = F.array(*[F.lit(first.get(k, 0)).cast("bigint") for k in range(shards)])
    return placed.select(*names, "shard", (F.col("_place") - F.element_at(starts, F.col("shard") + 1)).cast("bigint").alias("slot"))
